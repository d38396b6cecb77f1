"""Registered queries: one for each operator, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.llm import (
    languages,
    lattice,
    mixing,
    near_duplicates,
    outliers,
    packing,
    periodic_runs,
    search,
    suffix_dedup,
    token_files,
    toxicity,
    url_rules,
    vector_codes,
)
from rasterlark.llm.common import fold, stored, table
from rasterlark.sinks.scratch import scratch_directory

TOKENIZERS = None  # folder of public vocabulary files; None: the installed one


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from six folds in seven, scores every document."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", "text", (fold(F.col("doc_id"), 7) != 2).alias("trains"))
    pieces = lattice.read_pieces(vocabulary("piece_bpe_32k.model"))
    scored = lattice.score_texts(rows, pieces)
    return scored.withColumn("held_out", ~F.col("trains")).drop("trains")


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1
    )


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files to the shared scratch folder and reads them back."""
    directory = scratch_directory(spark, "token-files")
    documents = table(spark, sf_dir, "documents")
    token_files.write_tokens(documents, directory, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, directory)


LISTED = [
    url_rules.HostRule("net", "/", "block"),
    url_rules.HostRule("example.net", "/en/", "allow"),
    url_rules.HostRule("example.com", "/de/", "block"),
    url_rules.HostRule("org", "/fr/", "allow"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its number says toxic or of low quality.
    Every labelled page counts, also where pages share all tokens."""
    pages = table(spark, sf_dir, "pages")
    labels = (
        table(spark, sf_dir, "labels")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(F.expr("coalesce(toxic = 1 OR quality = 0, false)")).alias("bad"))
    )
    url = F.col("url")
    tokens = url_rules.url_tokens(url, url_rules.host_of(url), url_rules.path_of(url))
    baskets = (
        pages.where("instr(url, '://') > 0")
        .join(labels, "page_id")
        .select(tokens.alias("tokens"), "bad")
    )
    rules = url_rules.mine_rules(baskets)
    return url_rules.judge_urls(pages, rules, LISTED)


def op7_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Domains of the sources, by their number; sources without one have none.
DOMAIN = "CONCAT('domain', CAST(TRY_CAST(REGEXP_EXTRACT(source, '([0-9]+)', 1) AS BIGINT) % 4 AS STRING))"
MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2},
    "lang": {"en": 3, "de": 2},
    "source": {"src0": 2},
}


def op8_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many words as the corpus has, from at most two epochs of a source."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(DOMAIN).alias("domain"),
        "lang",
        "source",
        mixing.count_words(F.col("text")).alias("n_tokens"),
    )
    documents = stored(documents, "mix-documents")
    leaves = mixing.plan(documents, MIX_WEIGHTS, share=1.0, epochs=2, seed=7)
    return mixing.take(documents, leaves, seed=7)


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two folds in three, predicts for every document."""
    documents = table(spark, sf_dir, "documents")
    model = languages.learn_languages(documents.where(fold(F.col("doc_id"), 3) != 1))
    tagged = documents.select("doc_id", "text", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    return languages.predict_languages(tagged, model, ["doc_id", "held_out"])


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents, words that repeat themselves from a place on."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), planted_period)
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")
            ),
        )
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Label rows that are broadcast; more are joined by exchange.
LABELS_AT_ONCE = 500_000


def op12_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of three folds in four, scores every document. A
    quarter of the labelled documents of those folds is for calibration."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    labels = stored(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    if labels.count() <= LABELS_AT_ONCE:
        labels = F.broadcast(labels)
    quarter = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 4 % 4 = 1")
    labelled = documents.select("doc_id", "text").join(labels, "doc_id")
    held = quarter.alias("calibrates")
    model = toxicity.learn_toxicity(
        labelled.select(F.col("doc_id").alias("key"), "text", "toxic", held)
    )
    rows = documents.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return toxicity.score_texts(rows, model, ["doc_id", "held_out"])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def all_queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
