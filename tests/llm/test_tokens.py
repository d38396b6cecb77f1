"""Encoding, token files and packing against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlark.llm import encoding, packing, token_files
from rasterlark.llm.encoding import Encoder

FILES = {True: "byte_bpe_50k.json", False: "word_bpe_49k.json"}
MADE = {}


def both(keeps_space):
    if keeps_space not in MADE:
        path = public_tokenizers.path(FILES[keeps_space])
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        MADE[keeps_space] = Encoder(path, keeps_space), plain
    return MADE[keeps_space]


def plainly(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


bits = st.sampled_from(
    ["a", "the", "É", "E", "J", "\u030c", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "1", "23", "#", ".", ",", "\x00",
     "\x01", "\x1c", "\xa0", "日本", "̈", "<|endoftext|>"]
)


@pytest.mark.parametrize("keeps_space", [True, False])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(bits, max_size=25).map("".join), max_size=4))
def test_parts_give_the_ids_of_the_whole_text(keeps_space, texts):
    encoder, plain = both(keeps_space)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [plainly(plain, t) for t in texts]


def test_a_share_of_the_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(encoding, "BYTES_AT_ONCE", 4000)
    monkeypatch.setattr(encoding, "REMEMBERED", 40_000)
    path, plain = public_tokenizers.path(FILES[False]), both(False)[1]
    texts = [" ".join(map(str, range(100 * i, 100 * i + 150))) for i in range(40)]
    texts += [None, "É" * 1500 + " word " * 700]
    lean, seen = Encoder(path, False, share=0.25), []
    some = lean._some
    monkeypatch.setattr(lean, "_some", lambda part: (seen.append((sum(map(len, part)), len(part))), some(part))[1])
    got = [np.frombuffer(x, "<u4").tolist() for x in lean.encode(texts)]
    assert got == [plainly(plain, t) for t in texts]
    assert all(size <= 1000 for size, n in seen if n > 1)
    assert lean.held <= 10_000


@pytest.mark.parametrize("keeps_space", [True, False])
def test_long_texts_and_many_distinct_parts(keeps_space, monkeypatch):
    monkeypatch.setattr(encoding, "SLOTS", 16)
    monkeypatch.setattr(encoding, "BYTES_AT_ONCE", 500)
    encoder, plain = both(keeps_space)
    texts = ["a", " ".join(map(str, range(3000))), "x" * 2000, "y " + "É" * 900 + " z. Q,\u0301\n\n  b\xa0 c " * 90]
    texts += [None, "", "one two", "日本\u3000 " * 400 + "!"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [plainly(plain, t) for t in texts]
    for text in texts:
        pieces = list(encoding.pieces_of((text or "").encode()))
        assert b"".join(pieces).decode() == (text or "")
        for piece in pieces:
            starts = encoding.part_starts(np.frombuffer(piece, np.uint8), np.arange(bool(piece)))
            assert len(piece) <= 500 or len(starts) == 1


def test_a_text_with_over_a_million_distinct_parts():
    encoder, plain = both(True)
    text = " ".join(map(str, range(1_300_000)))
    assert len(text) > encoding.BYTES_AT_ONCE
    (got,) = encoder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == plainly(plain, text)


def test_token_files_round_trip(spark, documents, awkward, tmp_path):
    directory = str(tmp_path / "tokens")
    path = public_tokenizers.path(FILES[True])
    token_files.write_tokens(documents(awkward), directory, path, end_id=2)
    found = token_files.read_tokens(spark, directory, with_ids=True).collect()
    found.sort(key=lambda r: r.start)
    _, plain = both(True)
    rows = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    start = 0
    for row, (_, text, *_rest) in zip(found, rows):
        ids = plainly(plain, text) + [2]
        assert row.ids == ids and row.start == start and row.n_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_a_cut_file_is_refused(spark, documents, prose, tmp_path):
    directory = tmp_path / "tokens"
    path = public_tokenizers.path(FILES[True])
    token_files.write_tokens(documents([(1, prose(50))]), str(directory), path, end_id=2)
    name = token_files.read_index(str(directory))["shards"][0]["shard"]
    file = directory / f"{name}.bin"
    file.write_bytes(file.read_bytes()[:-2])
    with pytest.raises(ValueError, match="wrong size"):
        token_files.read_shard(str(directory), name, 2)


def test_no_documents_make_an_empty_index(spark, documents, tmp_path):
    directory = str(tmp_path / "none")
    path = public_tokenizers.path(FILES[True])
    token_files.write_tokens(documents([]), directory, path, end_id=2)
    assert token_files.read_index(directory)["shards"] == []
    assert token_files.read_tokens(spark, directory).count() == 0


def one_by_one(totals, shares, window):
    """The scheduler as a loop over windows and queues."""
    left, deficit, out = list(totals), [0] * len(totals), []
    unit = 1 << packing.FRACTION
    while any(left):
        weight = [s if n else 0.0 for s, n in zip(shares, left)]
        if not any(weight):
            weight = [float(n) for n in left]
        quantum = [
            max(1, int(w / sum(weight) * (window * unit))) if w else 0 for w in weight
        ]
        alive = [n > 0 for n in left]
        while all(n > 0 for n, a, q in zip(left, alive, quantum) if a and q):
            for i, q in enumerate(quantum):
                if not q:
                    continue
                deficit[i] += q
                n = min(deficit[i] // unit, left[i])
                out += [i] * n
                left[i] -= n
                deficit[i] = deficit[i] - n * unit if left[i] else deficit[i] % unit
        deficit = [d if n else 0 for d, n in zip(deficit, left)]
    return out


@pytest.mark.parametrize(
    "totals, shares",
    [
        ([100, 50, 30], [1, 1, 1]),
        ([7, 0, 200], [0.5, 0.3, 0.2]),
        ([40, 40], [0, 1]),
        ([1, 1, 1, 500], [0.001, 5, 1, 0.3]),
        ([], []),
    ],
)
def test_the_formula_is_the_round_robin(totals, shares):
    epochs = packing.schedule(np.array(totals), np.array(shares), window=16)
    expected = one_by_one(totals, shares, 16)
    got = np.full(sum(totals), -1)
    for queue, total in enumerate(totals):
        for start in range(0, total, 7):
            size = min(7, total - start)
            for _, _, n, at in zip(
                *packing.place(epochs, np.array([queue]), np.array([start]), np.array([size]))
            ):
                assert (got[at : at + n] == -1).all()
                got[at : at + n] = queue
    assert got.tolist() == expected


def check_pieces(rows, texts, plain, sequence=2048):
    ids = [np.array(plainly(plain, t) + [1], "<u4") for t in texts]
    wanted = Counter(x.tobytes() for x in ids)
    places = sorted((r.sequence_id * sequence + r.offset, r.length) for r in rows)
    at = 0
    for place, length in places:
        assert place == at
        at += length
    assert at == sum(map(len, ids))
    assert all(r.offset + r.length <= sequence for r in rows)
    known = defaultdict(list)
    for r in rows:
        known[r.doc_id, r.doc_tokens].append(r)
    by_size = Counter(len(x) for x in ids)
    assert Counter(r.doc_tokens for r in rows if r.start == 0) == by_size
    assert wanted
    return known


def test_packing_places_every_token_once(documents, awkward):
    path = public_tokenizers.path(FILES[False])
    rows = packing.pack_documents(documents(awkward), path).collect()
    _, plain = both(False)
    known = check_pieces(rows, [r[1] for r in awkward], plain)
    for doc_id, text, *_ in awkward:
        ids = np.array(plainly(plain, text) + [1], "<u4")
        pieces = known[doc_id, len(ids)]
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes())


def test_windows_hold_the_target_shares(documents, prose):
    rows = [(i, prose(300, i), "en", "abc"[i % 3]) for i in range(150)]
    path = public_tokenizers.path(FILES[False])
    tokens = packing.stored(packing.tokenize(documents(rows), path, 1), "t")
    found = packing.pack(tokens, {"a": 0.6, "b": 0.3, "c": 0.1}, window=2048)
    held = defaultdict(Counter)
    for r in found.collect():
        held[r.sequence_id][r.queue] += r.length
    names = Counter()
    for number in range(5):
        for queue, n in held[number].items():
            names[queue] += n
    assert sorted(round(n / (5 * 2048), 2) for n in names.values()) == [0.1, 0.3, 0.6]


def test_packing_nothing(documents):
    path = public_tokenizers.path(FILES[False])
    assert packing.pack_documents(documents([]), path).count() == 0


@pytest.mark.parametrize("with_targets", [False, True])
def test_every_window_holds_the_share_of_each_of_many_sources(spark, monkeypatch, with_targets):
    monkeypatch.setattr(packing, "CELLS", 700)
    ids = np.arange(40, dtype="<u2").tobytes()
    rows = [(i, f"s{i % 300}" if i % 300 else None, 40, bytearray(ids)) for i in range(1200)]
    schema = "doc_id long, source string, size long, ids binary"
    tokens = packing.stored(spark.createDataFrame(rows, schema), "t")
    wanted = {None if i == 0 else f"s{i}": 1 + i % 2 for i in range(200)}
    found = packing.pack(tokens, wanted if with_targets else None, sequence=2000, window=6000)
    found = found.collect()
    assert sorted((r.doc_id, t) for r in found for t in range(r.start, r.start + r.length)) == [
        (i, t) for i in range(1200) for t in range(40)
    ]
    assert all(r.length > 0 for r in found)
    held = defaultdict(Counter)
    for r in found:
        held[(r.sequence_id * 2000 + r.offset) // 6000][r.doc_id % 300] += r.length
    for number in range(4 if with_targets else 8):
        for i in range(300):
            share = (1 + i % 2) * (i < 200) / 300 if with_targets else 1 / 300
            assert abs(held[number][i] - 6000 * share) <= 2


def test_less_than_a_token_a_window():
    totals, shares = [3, 400, 2, 50], [0.001, 0.9, 0.0004, 0.0986]
    epochs = packing.schedule(np.array(totals), np.array(shares), window=16)
    got = np.full(sum(totals), -1)
    for queue, total in enumerate(totals):
        (row, start, length, at) = packing.place(
            epochs, np.array([queue]), np.array([0]), np.array([total])
        )
        assert (length > 0).all() and length.sum() == total
        for n, a in zip(length, at):
            got[a : a + n] = queue
    assert got.tolist() == one_by_one(totals, shares, 16)
