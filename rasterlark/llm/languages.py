"""Language identification by mixtures of languages.

Every language is a distribution over character n-grams, learned by counting.
A document is a mixture of languages: expectation-maximisation estimates the
proportions from the likelihoods of its n-grams, and a language stays in the
set only while it earns more log-likelihood than it costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import tidy

ORDER = 3  # bytes of an n-gram
BUCKETS = 1 << 16  # hashed n-grams
STEPS = 10  # of expectation-maximisation
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """`log_p[g, l]`: log-probability of n-gram bucket g in language l. Its size
    is BUCKETS times the number of languages, whatever the corpus."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _letter_table() -> np.ndarray:
    """ASCII letters in lower case, bytes beyond ASCII as they are, else space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


LETTERS = _letter_table()


def gram_buckets(text: bytes) -> np.ndarray:
    """Hashed n-grams of a whole text, runs of non-letters taken as one space."""
    code = LETTERS[np.frombuffer(text, np.uint8)]
    space = code == 32
    kept = ~(space[1:] & space[:-1])
    code = np.concatenate([[32], code[:1], code[1:][kept], [32]]).astype(np.uint32)
    if len(code) < ORDER:
        return np.zeros(0, np.int64)
    grams = np.zeros(len(code) - ORDER + 1, np.uint32)
    for n in range(ORDER):
        grams = (grams << np.uint32(8)) | code[n : n + len(grams)]
    return ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letter(text: bytes) -> bool:
    letters = LETTERS[np.frombuffer(text, np.uint8)]
    if ((letters != 32) & (letters < 128)).any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for text, language in zip(texts, batch.column(1).to_pylist()):
            if language not in counts:
                counts[language] = np.zeros(BUCKETS, np.int64)
            counts[language] += np.bincount(gram_buckets(text), minlength=BUCKETS)
    for language, count in counts.items():
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "language": pa.array([language] * len(found), pa.string()),
                "gram": pa.array(found, pa.int64()),
                "n": pa.array(count[found], pa.int64()),
            }
        )


def learn_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5
) -> LanguageModel:
    """Counts n-grams of every labelled text; rows without text or label, and
    texts without a letter, teach nothing.

    Tasks count whole partitions before the exchange, so a language with most
    of the rows is no hot key. Only the counts, at most BUCKETS for a language,
    reach the driver.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = (
        rows.mapInArrow(tidy(_count_grams), "language string, gram long, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["language"].unique())
    table = np.full((BUCKETS, len(languages)), alpha)
    at = np.searchsorted(languages, counts["language"].to_numpy(dtype=object)) if languages else []
    table[counts["gram"].to_numpy(np.int64), at] += counts["n"].to_numpy(np.float64)
    log_p = np.log(table) - np.log(table.sum(axis=0))
    return LanguageModel(tuple(languages), log_p)


def _proportions(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Language proportions and log-likelihood; p is n-grams x languages."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = counts.sum()
    for _ in range(STEPS):
        share = share * ((counts / (p @ share)) @ p) / total
    return share, float(counts @ np.log(p @ share))


def mixture(
    grams: np.ndarray, log_p: np.ndarray, p: np.ndarray, penalty: float
) -> tuple[list[int], np.ndarray]:
    """Languages in the document and their proportions.

    Neighbouring n-grams overlap, so log-likelihood counts 1/ORDER; an extra
    language costs `penalty` * log(n-grams). The best single language stands
    against the mixture of all, from which the rarest language is taken away
    one by one; the best penalised set wins, the smaller one if equal.
    """
    count = np.bincount(grams, minlength=len(p))
    found = np.flatnonzero(count)
    count, rows, logs = count[found].astype(float), p[found], log_p[found]
    cost = penalty * np.log(max(len(grams), 2))
    single = count @ logs
    best = int(np.argmax(single))
    chosen, share, value = [best], np.ones(1), single[best] / ORDER
    subset = list(range(p.shape[1]))
    while len(subset) > 1:
        proportions, likelihood = _proportions(rows[:, subset], count)
        if len(chosen) == 1 and likelihood / ORDER - cost <= value:
            break  # even the superset does not pay for one more language
        penalised = likelihood / ORDER - cost * (len(subset) - 1)
        if penalised > value - cost * (len(chosen) - 1):
            chosen, share, value = list(subset), proportions, likelihood / ORDER
        subset.pop(int(np.argmin(proportions)))
    return chosen, share


def predict_languages(
    documents: DataFrame,
    model: LanguageModel,
    keep: list[str],
    text: str = "text",
    penalty: float = 2.0,
) -> DataFrame:
    """Columns `keep` plus lang_pred, score, lang_set and lang_shares.

    lang_pred has the largest proportion, ties to the alphabetically first;
    score is that proportion, lang_set and lang_shares the whole set in falling
    order. Texts that are null or have no letter, and all texts if nothing was
    learned, get `und`, score 0 and empty lists. Repeated rows stay repeated.
    """
    spark = documents.sparkSession
    # Plain arrays: workers may lack this package, and with it the model's class.
    shipped = spark.sparkContext.broadcast((model.languages, model.log_p))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p = shipped.value
        p = np.exp(log_p)
        for batch in batches:
            names, scores, sets, shares = [], [], [], []
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
                text_bytes = value.as_py()
                if not text_bytes or not languages or not has_letter(text_bytes):
                    chosen, share = [], np.zeros(0)
                else:
                    chosen, share = mixture(gram_buckets(text_bytes), log_p, p, penalty)
                order = np.argsort(-share, kind="stable")
                sets.append([languages[chosen[i]] for i in order])
                shares.append([min(1.0, float(share[i])) for i in order])
                names.append(sets[-1][0] if chosen else UNDETERMINED)
                scores.append(shares[-1][0] if chosen else 0.0)
            columns = [
                *batch.columns[:-1],
                pa.array(names, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(sets, pa.list_(pa.string())),
                pa.array(shares, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, [*keep, "lang_pred", "score", "lang_set", "lang_shares"]
            )

    kept = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]
    )
    return kept.mapInArrow(
        tidy(predict),
        f"{schema}, lang_pred string, score double, "
        "lang_set array<string>, lang_shares array<double>",
    )
