"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 6 characters of the lower-cased text, hashed to BUCKETS, present or not. In how many
toxic and other texts each occurs is counted by a Spark aggregation; the features that tell most are chosen there too.
Each is scaled by the log of its smoothed share among toxic texts over that among the others, and a logistic regression
is fitted to the scaled features. Scaling and weights fold into one number for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .bytesops import slices
from .common import bounded_batches, crc_bucket
from .quality import labelled_rows

BITS = 22
LENGTHS = (3, 4, 5, 6)
#: Bounds of the fit: labelled texts, bytes of a text, features.
TRAIN_DOCS, TRAIN_TEXT_BYTES, FEATURES = 5000, 60_000, 1 << 13
#: Texts that a feature occurs in at least.
LEAST_TEXTS = 3
SMOOTHING, PENALTY, STEPS = 0.5, 1.0, 200
_MIX = 0x9E3779B97F4A7C15
_STEP = 0x100000001B3


def bucket_of(gram: str) -> int:
    """The bucket of one n-gram."""
    value = 0
    for c in gram:
        value = (value * _STEP + ord(c)) % (1 << 64)
    return (value * (_MIX + 2 * len(gram)) % (1 << 64)) >> (64 - BITS)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the texts that n-grams belong to and their buckets."""
    lowered = [text.lower() for text in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(lowered)), [len(text) for text in lowered])
    value = chars
    for n in range(2, max(LENGTHS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        value = value[:m] * np.uint64(_STEP) + chars[n - 1 :]
        if n in LENGTHS:
            inside = doc[:m] == doc[n - 1 :]
            yield doc[:m][inside], ((value[inside] * np.uint64(_MIX + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class NgramModel:
    """The n-gram buckets that count, what each adds, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.table: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities that the texts are toxic."""
        if self.table is None:
            self.table = np.zeros(1 << BITS, np.float32)
            self.table[self.buckets] = self.weights
        total = np.full(len(texts), self.intercept)
        for doc, bucket in grams(texts):
            counts = self.table[bucket] != 0
            if counts.any():
                pairs = np.unique((doc[counts] << BITS) | bucket[counts])
                total += np.bincount(pairs >> BITS, self.table[pairs & ((1 << BITS) - 1)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def distinct_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets: texts and buckets, in order. n-grams of different lengths that share a bucket are one."""
    found = [(doc << BITS) | bucket for doc, bucket in grams(texts)]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of a slice have each bucket."""
    for batch in batches:
        for part in slices(batch, "text"):
            doc, bucket = distinct_buckets([t or "" for t in part.column("text").to_pylist()])
            toxic = part.column("label").to_numpy(zero_copy_only=False)[doc] == 1
            used, place = np.unique(bucket, return_inverse=True)
            seen = [np.bincount(place[which], minlength=len(used)).astype(np.int64) for which in (~toxic, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0]), pa.array(seen[1])], names=["bucket", "other", "toxic"])


def _present(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Which features each text has."""
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    for batch in batches:
        for part in slices(batch, "text"):
            doc, bucket = distinct_buckets([t or "" for t in part.column("text").to_pylist()])
            feature = place[bucket]
            doc, feature = doc[feature >= 0], feature[feature >= 0]
            offsets = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32()))], names=["doc_id", "label", "features"])


def log_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The log of a feature's smoothed share of toxic texts over that of the others."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((other + SMOOTHING) / (n_other + 2 * SMOOTHING))


def learned(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = TRAIN_DOCS) -> NgramModel:
    """A model of labelled documents outside the held-out fold.

    Texts stay with the executors: what comes to the driver are the counts of FEATURES features and, for `most` texts, which
    of them each has.
    """
    spark = docs.sparkSession
    rows = written(labelled_rows(docs, labels, "toxic", folds, held_out, most, TRAIN_TEXT_BYTES), "labelled-texts")
    if rows.count() > most:
        rows = rows.where(F.col("draw") <= rows.select("draw").orderBy("draw").limit(most).agg(F.max("draw")).first()[0])
    sizes = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1)
    share = float(np.clip(n_toxic / max(1, n_toxic + n_other) if sizes else 0.5, 1e-3, 1 - 1e-3))
    if not n_toxic or not n_other:
        return NgramModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(_occurrences, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    both = F.col("other") + F.col("toxic")
    spread = F.abs(F.col("toxic") / n_toxic - F.col("other") / n_other) / F.sqrt((both + 1) / (n_toxic + n_other))
    best = counts.where(both >= LEAST_TEXTS).orderBy(F.desc(spread), "bucket").limit(FEATURES).toArrow()
    buckets = best.column("bucket").to_numpy()
    ratio = log_ratios(best.column("toxic").to_numpy(), best.column("other").to_numpy(), n_toxic, n_other)
    sent = spark.sparkContext.broadcast(buckets)
    found = sorted((r.doc_id, r.label, r.features) for r in rows.mapInArrow(lambda batches: _present(batches, sent.value), "doc_id long, label int, features array<int>").collect())
    matrix = np.zeros((len(found), len(buckets)), np.float32)
    for row, (_, _, features) in zip(matrix, found, strict=True):
        row[features] = ratio[features]
    weight, intercept = _logistic(matrix, np.array([label == 1 for _, label, _ in found], np.float32))
    return NgramModel(buckets, (weight * ratio).astype(np.float32), intercept)


def _logistic(matrix: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Adam steps over all rows."""
    width = matrix.shape[1]
    theta, first, second = (np.zeros(width + 1) for _ in range(3))
    theta[-1] = np.log(labels.mean() / (1 - labels.mean()))
    for step in range(1, STEPS + 1):
        margin = matrix @ theta[:-1].astype(np.float32) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels).astype(np.float32)
        slope = np.append(error @ matrix + PENALTY * theta[:-1], error.sum()) / len(labels)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _score(batches: Iterator[pa.RecordBatch], model: NgramModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            scores = model.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The toxicity of each document's whole text: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Null texts count as empty; an empty text has the intercept's score; a text of any length is scored as a whole, though
    none above TRAIN_TEXT_BYTES is learned from. Null doc_ids fall in fold 0. Labels without a document and null labels
    are not learned from; a document that is labelled twice is learned twice. Without labels, or with one kind alone,
    every score is their share (0.5 without any). Repeated rows are scored one by one; an empty table gives no rows;
    other columns are ignored, whatever their names. Of features that tell equally much, the lower buckets are taken.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learned(docs, labels, folds, held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(lambda batches: _score(batches, model.value, threshold), "doc_id long, held_out boolean, score double, predicted int")
