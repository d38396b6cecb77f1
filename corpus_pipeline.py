"""Documents to packed training sequences, in stages.

Each stage takes the documents its predecessor kept and returns documents
again, the last one packed pieces. Between stages the documents are written
as Parquet and reread.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.llm import languages, mixing, near_duplicates, packing, suffix_dedup
from rasterlark.llm.common import fold, stored
from rasterlark.llm.queries import DOMAIN, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_SHARE = 0.9  # of the words that arrive at the mixing stage
PASSAGE_BYTES = 200  # of a repeated string: passages of over 50 words are rarely shorter
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # of whole documents that a worker process and its JVM hold at once

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with rows handed to Python in batches of at most BATCH_ROWS.
    The setting stays in the session, as the result is computed later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which a language or a mixture of languages is found;
    those without a letter go. Without any label nothing is learned, and all
    documents stay. The label column is left as it is."""
    model = languages.learn_languages(docs.where(fold(F.col("doc_id"), 3) != 1))
    if not model.languages:
        return docs.select(*COLUMNS)
    tagged = languages.predict_languages(docs, model, COLUMNS)
    return tagged.where("lang_pred <> 'und'").select(*COLUMNS)


@in_small_batches
def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class. Rows of one
    doc_id are one document; rows without doc_id all stay."""
    docs = docs.select(*COLUMNS)
    classes = near_duplicates.near_duplicates(docs)
    gone = stored(classes.where("class_id <> doc_id").select("doc_id"), "pipeline-gone")
    if gone.count() <= near_duplicates.FETCH_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    again = stored(again.select("doc_id"), "pipeline-again")
    if not again.isEmpty():
        single = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
        )
        kept = kept.join(again, "doc_id", "left_anti").unionByName(
            single.select("doc_id", "row.*")
        )
    return kept.select(*COLUMNS)


@in_small_batches
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of at least PASSAGE_BYTES out of the texts; a
    character of which a part is cut goes as a whole. Documents of which no
    visible character is left go."""
    cut = suffix_dedup.remove_repeats(docs, ["doc_id", "lang", "source"], length=PASSAGE_BYTES)
    text = F.expr("try_validate_utf8(CAST(kept AS STRING))")
    # Cuts stand on character boundaries of almost all texts; where one does
    # not, the broken bytes are replaced and the replacement removed.
    whole = F.coalesce(text, F.replace(F.expr("make_valid_utf8(CAST(kept AS STRING))"), F.lit("�"), F.lit("")))
    docs = cut.withColumn("text", whole).where(F.col("text").rlike(r"[^\s]"))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of words for domains, their languages and sources, as far as
    they hold them; no document is repeated."""
    placed = docs.select(*COLUMNS, F.expr(DOMAIN).alias("domain"))
    counted = placed.select(
        "doc_id", "domain", "lang", "source", mixing.count_words(F.col("text")).alias("n_tokens")
    )
    leaves = mixing.plan(stored(counted, "pipeline-words"), share=MIX_SHARE, epochs=1)
    return mixing.take(placed, leaves).select(*COLUMNS)


@in_small_batches
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents. Workers of earlier stages are idle beside those that
    encode, so none keeps the tokenizer beyond its task."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, remember=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_removal", near_duplicate_removal),
    ("repeat_removal", repeat_removal),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

# Tokenizers, suffix sorting and hashing in tasks have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH, rows)
    return docs
