"""Token ids of whole texts, by a tokenizer file, part by part.

Byte-pair tokenizers split a text by a pattern before they merge. Where no
match of the pattern can reach over a space or line end that follows a visible
character, nor from a letter to a full stop, the ids of a text are those of its
parts, so a task encodes each distinct part once. Parts are found and compared
as arrays of bytes, and handed to the tokenizer in groups, because a call costs
more than a word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress

import numpy as np

from rasterlark.llm.common import shelf

BYTES_AT_ONCE = 2_000_000  # of texts; hashing them takes some 25 times as many
REMEMBERED = 40_000_000  # bytes of the parts a worker process keeps, with their ids
PART_COST = 130  # bytes of a remembered part beside its own
GROUP = 64  # parts in one call
SLOTS = 1 << 20  # of a hash table at first; it grows with the distinct parts
MARK = "\x01"  # stands between parts where the tokenizer drops white space
LATIN = 0xC8  # the first bytes of characters below U+0240 are no larger
DOTTED = "İ".encode()
SPACES = b" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
# Bytes that may end a white-space character beyond ASCII, and those before it.
WIDE_LAST = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
WIDE_BEFORE = [0x80, 0x81, 0x9A, 0xC2]


def _table(values: list[int] | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


IS_SPACE, IS_LAST, IS_BEFORE = _table(SPACES), _table(WIDE_LAST), _table(WIDE_BEFORE)
IS_CUT, IS_TAIL = _table(b" \n"), _table(b".,;:!?")
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IS_WORD = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes before `at` may be a white-space character beyond ASCII."""
    return IS_LAST[data[at - 1]] & IS_BEFORE[data[at - 2]]


def part_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where parts start: at each text, at each space or line end behind a
    visible character and at each closing mark behind an ASCII letter or digit.
    Some visible characters beyond ASCII are taken for white space; the part is
    then longer, not wrong."""
    starts = IS_CUT[data]
    starts[1:] &= ~IS_SPACE[data[:-1]]
    wide = np.flatnonzero(starts[2:]) + 2
    starts[wide[_wide_space(data, wide)]] = False
    starts[1:] |= IS_TAIL[data[1:]] & IS_WORD[data[:-1]]
    starts[texts] = True
    return np.flatnonzero(starts)


def pieces_of(text: bytes, at_once: int | None = None) -> Iterator[bytes]:
    """The text, cut where parts start into pieces of at most `at_once` bytes,
    by default BYTES_AT_ONCE; only a part that is longer makes a longer piece."""
    data = np.frombuffer(text, np.uint8)
    at_once = at_once or BYTES_AT_ONCE
    low = 0
    while len(text) - low > at_once:
        size = at_once
        starts = part_starts(data[low : low + size + 1], np.zeros(1, np.int64))[1:][-1:]
        while not len(starts) and low + size < len(text):
            size *= 2
            starts = part_starts(data[low : low + size + 1], np.zeros(1, np.int64))[1:2]
        if not len(starts):
            break
        yield text[low : low + int(starts[0])]
        low += int(starts[0])
    yield text[low:]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    `keeps_space`: white space is part of the ids, as in byte-level vocabularies
    whose tokens hold as many characters as bytes; else the tokenizer drops
    white space and case. Strings of special tokens in a text are ordinary text.
    `share`: it works with that part of BYTES_AT_ONCE and REMEMBERED, in less
    memory and more time.
    """

    def __init__(self, tokenizer_file: str, keeps_space: bool, share: float = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.share = share
        self.known: dict[bytes, bytes] = {}
        self.held = 0  # bytes, about
        self.common: set[bytes] = set()  # known parts that came again
        rng = np.random.default_rng(1)
        self._code = rng.integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
        self._powers = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
        if keeps_space:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes[i] = len(token)
        else:
            self.normalizer = self.tokenizer.normalizer
            (self.mark,) = self._ids([MARK])[0]

    # -- parts and their ids --------------------------------------------------

    def _ids(self, texts: list[str], bare: bool = False) -> list[list[int]]:
        """`bare`: Latin letters without marks of their own need no composition,
        only lower case, which is then the same in every library. One tokenizer
        serves both, as a second one would take as much memory again."""
        if bare:
            self.tokenizer.normalizer = None
        try:
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        finally:
            if bare:
                self.tokenizer.normalizer = self.normalizer
        return [x.ids for x in encoded]

    def _alone(self, part: bytes) -> bytes:
        return np.array(self._ids([part.decode()])[0], "<u4").tobytes()

    def _together(
        self, parts: list[bytes], sizes: np.ndarray, bare: bool = False
    ) -> dict[bytes, bytes]:
        """Ids of parts that start with a space or line end, or drop it, and end
        in a visible character."""
        if not parts:
            return {}
        between = b"" if self.keeps_space else f" {MARK} ".encode()
        groups = range(0, len(parts), GROUP)
        texts = [(between.join(parts[i : i + GROUP]) + between).decode() for i in groups]
        if bare:
            texts = [t.lower() for t in texts]
        ids = np.concatenate([np.array(x, "<u4") for x in self._ids(texts, bare)])
        if self.keeps_space:
            ends = np.cumsum(sizes)
            reached = np.cumsum(self.bytes[ids])
            high = np.searchsorted(reached, ends) + 1
            sound = high[-1] == len(ids) and (reached[high - 1] == ends).all()
            low = np.concatenate([[0], high[:-1]])
        else:
            high = np.flatnonzero(ids == self.mark)
            sound = len(high) == len(parts)
            low = np.concatenate([[0], high[:-1] + 1])
        if not sound:
            raise ValueError("a token reaches over a space")
        raw = ids.tobytes()
        return {
            part: raw[a:b] for part, a, b in zip(parts, (4 * low).tolist(), (4 * high).tolist())
        }

    # -- texts ----------------------------------------------------------------

    def _heads(self, hashed: np.ndarray, slots: int) -> np.ndarray | None:
        """For each part the first of the same hash; None if the distinct ones
        fill more than half of that many slots, a power of two, and some are
        left without one."""
        slot = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (slot >> np.uint64(65 - slots.bit_length())).astype(np.int64)
        first = np.full(len(hashed), -1)
        table = np.full(slots, -1)
        open_ = np.arange(len(hashed))
        filled = 0
        while len(open_):
            if 2 * filled > slots:
                return None
            at = slot[open_]
            free = table[at] < 0
            table[at[free][::-1]] = open_[free][::-1]
            head = table[at]
            filled += int((head == open_).sum())
            hit = hashed[head] == hashed[open_]
            first[open_[hit]] = head[hit]
            open_ = open_[~hit]
            slot[open_] = (slot[open_] + 1) % slots
        return first

    def _first_of_equals(
        self, data: np.ndarray, start: np.ndarray, size: np.ndarray
    ) -> np.ndarray:
        """For each part an equal part that stands for all equal ones, by a hash
        table; equality is checked byte by byte."""
        inner = np.arange(len(data), dtype=np.int32)
        inner -= np.repeat(start.astype(np.int32), size)
        inner &= len(self._powers) - 1
        values = self._code[data]
        values *= self._powers[inner]
        hashed = np.add.reduceat(values, start)
        del inner, values
        hashed ^= size.astype(np.uint64) << np.uint64(40)
        slots = SLOTS
        while (first := self._heads(hashed, slots)) is None:
            slots *= 4
        other = np.flatnonzero(first != np.arange(len(start)))
        unequal = size[other] != size[first[other]]
        if not unequal.any():
            length = size[other]
            inner = np.arange(length.sum(), dtype=np.int32) - np.repeat(
                (np.cumsum(length) - length).astype(np.int32), length
            )
            ours = data[np.repeat(start[other].astype(np.int32), length) + inner]
            theirs = data[np.repeat(start[first[other]].astype(np.int32), length) + inner]
            differ = ours != theirs
            if differ.any():
                unequal[np.repeat(np.arange(len(other)), length)[differ]] = True
        first[other[unequal]] = other[unequal]
        return first

    def encode(self, texts: list[str | bytes | None]) -> list[bytes]:
        raw = [t.encode() if isinstance(t, str) else (t or b"") for t in texts]
        out: list[bytes] = []
        low = size = 0
        at_once = max(1, int(BYTES_AT_ONCE * self.share))
        for high, text in enumerate(raw):
            if len(text) > at_once:
                out += self._some(raw[low:high])
                out.append(b"".join(self._some([piece])[0] for piece in pieces_of(text, at_once)))
                low, size = high + 1, 0
                continue
            if high > low and size + len(text) > at_once:
                out += self._some(raw[low:high])
                low, size = high, 0
            size += len(text)
        return out + self._some(raw[low:])

    def _some(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = b"".join(texts)
        if not whole:
            return [b""] * len(texts)
        data = np.frombuffer(whole, np.uint8)
        if not self.keeps_space:
            # Not a letter that the next character may be combined with: the two
            # together may have another lower case.
            small = LOWER[data]
            wide = np.flatnonzero(data[1:] >= 0x80)
            small[wide] = data[wide]
            data, whole = small, small.tobytes()
        base = np.cumsum(sizes) - sizes
        start = part_starts(data, base[sizes > 0])
        size = np.diff(np.append(start, len(data)))
        first = self._first_of_equals(data, start, size)
        heads = np.flatnonzero(first == np.arange(len(first)))
        parts = [
            whole[a : a + n] for a, n in zip(start[heads].tolist(), size[heads].tolist())
        ]
        known = self.known
        fresh = np.array([p not in known for p in parts])
        if not fresh.all():
            self.common.update(compress(parts, (~fresh).tolist()))
        # Alone: parts that end in white space or start without it.
        ends = start[heads] + size[heads]
        alone = IS_SPACE[data[ends - 1]]
        alone |= (size[heads] > 2) & _wide_space(data, ends)
        if self.keeps_space:
            alone |= ~IS_CUT[data[start[heads]]]
        elif MARK.encode() in whole:
            alone |= np.array([MARK.encode() in p for p in parts])
        for i in np.flatnonzero(fresh & alone).tolist():
            known[parts[i]] = self._alone(parts[i])
        plain = fresh & ~alone
        groups = [(plain, False)]
        if not self.keeps_space:
            latin = np.maximum.reduceat(data, start)[heads] <= LATIN
            if DOTTED in whole:
                latin &= np.array([DOTTED not in p for p in parts])
            groups = [(plain & ~latin, False), (plain & latin, True)]
        for chosen, bare in groups:
            at = np.flatnonzero(chosen)
            known |= self._together([parts[i] for i in at.tolist()], size[heads[at]], bare)
        ids = [known[p] for p in parts]
        # Ids of all parts in order, from those of the distinct ones.
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        number = np.empty(len(first), np.int64)
        number[heads] = np.arange(len(heads))
        number = number[first]
        count = length[number]
        ends = np.cumsum(count)
        shift = (np.cumsum(length) - length)[number] - (ends - count)
        tokens = flat[np.repeat(shift, count) + np.arange(ends[-1])]
        # The ids of a text end with those of its last part.
        last = np.searchsorted(start, base + sizes) - 1
        high = np.where(last >= 0, ends[last], 0)
        low = np.concatenate([[0], high[:-1]])
        stream = tokens.tobytes()
        self.held += sum(PART_COST + len(parts[i]) + len(ids[i]) for i in np.flatnonzero(fresh))
        remembered = REMEMBERED * self.share
        if self.held > remembered:
            self.known = {p: known[p] for p in self.common if p in known}
            self.held = sum(PART_COST + len(p) + len(i) for p, i in self.known.items())
            if self.held > remembered / 2:
                self.known, self.common, self.held = {}, set(), 0
        return [stream[4 * a : 4 * b] for a, b in zip(low.tolist(), high.tolist())]


def encoder_for(tokenizer_file: str, keeps_space: bool, share: float = 1) -> Encoder:
    """One encoder for each worker process: later tasks use what it remembers."""
    made = shelf().setdefault("encoders", {})
    if (tokenizer_file, keeps_space, share) not in made:
        made[tokenizer_file, keeps_space, share] = Encoder(tokenizer_file, keeps_space, share)
    return made[tokenizer_file, keeps_space, share]
