"""The pipeline's stages and the registered queries."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference
from rasterlark.llm import common, near_duplicates, oracle, queries

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, documents, prose):
    passage = prose(110, 77)
    rows = [(i, prose(120, i), "en", f"src{i % 5}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "src1") for i in range(5)]
    rows += [(200 + i, prose(50, 300 + i) + " " + passage, "en", "src2") for i in range(3)]
    rows += [(300, None, "en", "src1"), (301, "123 456", "en", "src1"), (1, rows[1][1], "en", "src1")]
    docs = documents(rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        left[name] = docs.collect()
        if name != "sequence_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: sorted(r.doc_id for r in found) for name, found in left.items()}
    assert 300 not in ids["language_id"] and 301 not in ids["language_id"]
    assert ids["near_duplicate_removal"] == [*range(60), 200, 201, 202]
    assert ids["repeat_removal"] == ids["near_duplicate_removal"]
    for r in left["repeat_removal"]:
        assert (passage in r.text) is False and r.n_chars == len(r.text)
    whole = {r[0]: r[1] for r in rows}
    assert all(r.text == whole[r.doc_id] for r in left["repeat_removal"] if r.doc_id < 60)
    assert set(ids["source_mixing"]) <= set(ids["repeat_removal"])
    words = lambda found: sum(len(r.text.split()) for r in found)
    assert 0.8 <= words(left["source_mixing"]) / words(left["repeat_removal"]) <= 0.9
    pieces = defaultdict(int)
    for r in left["sequence_packing"]:
        pieces[r.doc_id] += r.length
    assert sorted(pieces) == ids["source_mixing"]


def test_passages_of_over_fifty_words_go(spark, documents):
    """Passages of 51 words, shorter than the 400 bytes of op7, in texts that are
    otherwise their own; shorter common phrases stay."""
    word = lambda k: "".join("aeioubdfgklmnprst"[(k * 7919 // 17**i) % 17] for i in range(5))
    passage = " ".join(word(k) for k in range(51))
    phrase = " ".join(word(k) for k in range(60, 80))
    own = [" ".join(word(1000 * i + k) for k in range(100, 200)) for i in range(1, 30)]
    rows = [(i, f"{t} {passage} {t[::-1]}" if i < 6 else f"{t} {phrase} {t[::-1]}") for i, t in enumerate(own)]
    assert 250 < len(passage) < 400
    kept = {r.doc_id: r.text for r in corpus_pipeline.repeat_removal(spark, documents(rows), SF).collect()}
    for i, text in rows:
        if i < 6:
            assert kept[i].replace(" ", "") == (own[i] + own[i][::-1]).replace(" ", "")
        else:
            assert kept[i] == text


def test_language_stage_keeps_mixtures_and_unlabelled_tables(spark, documents):
    sounds = {"x": "ka lo mi", "y": "zun bre ost", "z": "wiq fap duj"}
    pure = [(i, f"{t} " * 30, lang) for i, (lang, t) in enumerate(list(sounds.items()) * 30)]
    even = " ".join(f"{t} " * 30 for t in sounds.values())
    rows = [*pure, (1000, even, "x"), (1001, even, None), (1002, "12 34", "x"), (1003, None, "x")]
    kept = corpus_pipeline.language_id(spark, documents(rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(90), 1000, 1001]
    unlabelled = documents([(i, t, None) for i, t, *_ in rows])
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == len(rows)


def test_stages_take_awkward_and_no_documents(spark, documents, awkward):
    for rows in (awkward, []):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert (docs.count() > 0) == bool(rows)


def test_packing_leaves_nothing_in_idle_workers(spark, documents, prose, monkeypatch):
    """Idle worker processes share an executor's memory with those that encode."""
    monkeypatch.setattr(common, "SHELF", "shelf_of_this_test")

    def look(batches):
        import sys

        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kept": ["shelf_of_this_test" in sys.modules]})

    docs = documents([(i, prose(60, i)) for i in range(30)])
    corpus_pipeline.sequence_packing(spark, docs, SF)  # all documents are encoded by now
    workers = spark.range(0, 16, 1, 16).mapInArrow(look, "kept boolean").collect()
    assert len(workers) == 16 and not any(r.kept for r in workers)


def test_stages_hand_documents_over_in_small_batches(spark, documents):
    def batches_of(docs):
        def count(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

        return [r.rows for r in docs.coalesce(1).mapInArrow(count, "rows long").collect()]

    before = spark.conf.get(corpus_pipeline.BATCH)
    docs = documents([(i, f"text {i}") for i in range(2500)])
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "source_mixing":  # no Python there
                spark.conf.set(corpus_pipeline.BATCH, before)
                stage(spark, docs.limit(0), SF)
                assert max(batches_of(docs)) <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline.BATCH, 64)
        corpus_pipeline.language_id(spark, docs.limit(0), SF)
        assert spark.conf.get(corpus_pipeline.BATCH) == "64"
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_whole_pipeline_on_the_tables(spark):
    before = spark.conf.get(corpus_pipeline.BATCH)
    found = corpus_pipeline.run(spark, SF)
    assert spark.conf.get(corpus_pipeline.BATCH) == before
    assert found.columns[:2] == ["doc_id", "start"]
    total = found.selectExpr("sum(length) AS n", "max(sequence_id) AS last").first()
    assert total.n > 0 and total.last == (total.n - 1) // 2048


@pytest.mark.parametrize("name", sorted(oracle.all_oracles()))
def test_queries_equal_their_sql(spark, name):
    assert difference(spark, SF, queries.all_queries()[name], oracle.all_oracles()[name]) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for number in range(1, 11):
        assert sum(n.startswith(f"op{number}_") for n in names) == 1


@pytest.mark.parametrize("name", ["op2_subword_lattice", "op3_mixture_packing", "op5_token_files",
                                  "op7_interval_expansion", "op9_minhash_join", "op10_language_mixture"])
def test_queries_return_every_document(spark, name):
    found = queries.all_queries()[name](spark, SF)
    expected = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").limit(1).fetchall()[0][0]
    assert found.select("doc_id").distinct().count() == expected


def test_near_duplicate_recall_is_stated():
    assert near_duplicates.choose_bands(0.8, 0.995).recall(0.8) >= 0.995
