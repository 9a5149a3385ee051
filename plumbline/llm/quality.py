"""Document quality by a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and adds a shallow tree over one feature's bins to that feature's lookup
table; then the pairs of features with the most left to explain get tables of their own in the same way. A document is
scored by adding up bins of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SPACED, byte_class, ngram_hash, prefix_hash, raw, slices, span_hash, words_of
from .common import bounded_batches, bounded_sample, crc_bucket

#: Bounds of the fit: labelled texts and bytes of a text.
TRAIN_DOCS, TRAIN_TEXT_BYTES = 6000, 200_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS = 48, 12, 150, 60, 6
RATE, LEAST = 0.15, 5.0

FEATURES = (
    "log_bytes", "word_bytes", "upper", "symbols", "marks", "digits", "non_ascii", "breaks", "distinct_words", "top_word",
    "distinct_pairs", "distinct_lines", "odd_ends", "stops", "upper_words", "long_words", "bars",
)

_CLASSES = {
    "upper": byte_class(r"[A-Z]"),
    "letter": byte_class(r"[A-Za-z\x80-\xff]"),
    "symbols": byte_class(r"[^\sA-Za-z0-9\x80-\xff.,;:'\"()!?-]"),
    "marks": byte_class(r"[!?]"),
    "digits": byte_class(r"[0-9]"),
    "non_ascii": byte_class(r"[\x80-\xff]"),
    "breaks": byte_class(r"\n"),
    "bars": byte_class(r"[|<>{}\[\]\\]"),
}
_PLAIN_END = byte_class(r"[A-Za-z0-9\x80-\xff.,;:'\"()!?-]")
_STOP = byte_class(r"[.!?]")


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many values differ and how often the most frequent one stands."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    owner = (keys[starts] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(starts, len(keys))))
    return np.bincount(owner, minlength=n).astype(float), top


def features_of(column: pa.Array) -> np.ndarray:
    """A row of features for each whole text; an empty text has zeros."""
    body, ends = raw(column)
    n = len(ends) - 1
    size = np.diff(ends).astype(float)
    total = np.maximum(size, 1)

    def share(accepted: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(accepted[body], dtype=np.int64)))
        return np.diff(sums[ends]).astype(float)

    counts = {name: share(accepted) for name, accepted in _CLASSES.items()}
    words = words_of(column, SPACED)
    n_words = np.diff(words.first).astype(float)
    per_word = np.maximum(n_words, 1)
    distinct, top = _distinct(words.doc, words.hash, n)
    pairs = ngram_hash(words.hash, 2)
    same = words.doc[: len(pairs)] == words.doc[1:] if len(pairs) else np.zeros(0, bool)
    distinct_pairs, _ = _distinct(words.doc[: len(pairs)][same], pairs[same], n)
    breaks = np.flatnonzero(body == 10)
    starts = np.unique(np.concatenate([ends[:-1][size > 0], breaks + 1]))
    starts = starts[starts < len(body)]
    line_ends = np.minimum(np.append(starts[1:], len(body)), len(body))
    owner = np.searchsorted(ends, starts, "right") - 1
    trimmed = np.where((line_ends > starts) & (body[np.maximum(line_ends - 1, 0)] == 10), line_ends - 1, line_ends) if len(starts) else line_ends
    lines, _ = _distinct(owner, span_hash(prefix_hash(body), starts, trimmed), n) if len(starts) else (np.zeros(n), None)
    n_lines = np.bincount(owner, minlength=n).astype(float) if len(starts) else np.zeros(n)
    last = body[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    of_words = lambda flags: np.bincount(words.doc, flags, n) / per_word if len(words.doc) else np.zeros(n)
    length = (words.end - words.start).astype(float)
    first = body[words.start] if len(words.start) else last
    letters = np.maximum(counts["letter"], 1)
    return np.column_stack(
        [
            np.log1p(size), of_words(length), counts["upper"] / letters, counts["symbols"] / total, counts["marks"] / total, counts["digits"] / total, counts["non_ascii"] / total,
            counts["breaks"] / per_word, distinct / per_word, top / per_word, distinct_pairs / np.maximum(n_words - 1, 1), lines / np.maximum(n_lines, 1),
            of_words(~_PLAIN_END[last]), of_words(_STOP[last]), of_words(_CLASSES["upper"][first] & _CLASSES["upper"][body[np.minimum(words.start + 1, max(len(body) - 1, 0))]] if len(first) else first), of_words(length > 24), counts["bars"] / total,
        ]
    )


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature and one for each chosen pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        out = np.full(len(rows), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, rows[:, k])]
        for (a, b), table in self.pairs.items():
            out += table[np.searchsorted(self.pair_edges[a], rows[:, a]), np.searchsorted(self.pair_edges[b], rows[:, b])]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    kinds = np.unique(values)
    if len(kinds) <= bins:
        return (kinds[:-1] + kinds[1:]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins and the first bin above it; 0 if there is none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < LEAST / 10) | (hr < LEAST / 10)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Steps for the bins of one feature: a tree of `depth` levels over them."""
    _, cut = _best_cut(g, h) if depth else (0, 0)
    if not cut:
        return np.full(len(g), RATE * g.sum() / (h.sum() + 1))
    return np.concatenate([_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Steps for a table of two features: one cut of the first and, on each side, one of the second."""
    best = (0.0, np.zeros_like(g))
    for cut in range(1, len(g)):
        gain, steps = 0.0, np.zeros_like(g)
        for side in (slice(None, cut), slice(cut, None)):
            sg, sh = g[side].sum(axis=0), h[side].sum(axis=0)
            gain += _best_cut(sg, sh)[0]
            steps[side] = _shallow_tree(sg, sh, 1)
        if gain > best[0]:
            best = (gain, steps)
    return best


def fit(rows: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Boost the features' tables in turn, then those of the pairs with the largest gain."""
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    edges = [_quantile_edges(rows[:, k], BINS) for k in range(width)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    bins = [np.searchsorted(e, rows[:, k]) for k, e in enumerate(edges)]
    margin = np.full(len(labels), base)
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-margin))
            size = len(edges[k]) + 1
            step = _shallow_tree(np.bincount(bins[k], labels - p, size), np.bincount(bins[k], p * (1 - p), size))
            model.tables[k] += step
            margin += step[bins[k]]
    model.pair_edges = [_quantile_edges(rows[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(e, rows[:, k]) for k, e in enumerate(model.pair_edges)]

    def grid(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (labels - p, p * (1 - p)))
        return *_pair_tree(g, h), cell

    ranked = sorted(((grid(a, b)[0], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)
    for gain, a, b in ranked[:PAIRS]:
        if gain > 1e-6:
            model.pairs[a, b] = np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            _, step, cell = grid(a, b)
            table += step
            margin += step.ravel()[cell]
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, longest: int) -> DataFrame:
    """Labelled documents outside the held-out fold: doc_id, text, label, draw. The same ones in every run.

    At most `most` labels are drawn, few enough to broadcast. Should documents share ids, there may be more rows: those
    of the least `draw` are to be taken.
    """
    known = labels.where(F.col(label).isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = bounded_sample(known, "doc_id", most)
    texts = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("draw", F.xxhash64(F.lit(19), "doc_id", "text"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = features_of(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("draw"), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "label", "draw", "features"])


def learned(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = TRAIN_DOCS) -> AdditiveModel:
    """A model of labelled documents outside the held-out fold. Features come to the driver, `most` rows of them; texts don't."""
    drawn = labelled_rows(docs, labels, "quality", folds, held_out, most, TRAIN_TEXT_BYTES).mapInArrow(_featured, "doc_id long, label int, draw long, features array<double>")
    rows = sorted((r.doc_id, list(r.features), r.label) for r in drawn.orderBy("draw", "doc_id", "label").limit(most).collect())
    return fit(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in rows], float))


def _score(batches: Iterator[pa.RecordBatch], model: AdditiveModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            scores = model.scores(features_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The quality of each document's whole text: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Null texts count as empty and are scored by the features of an empty text; a text of any length is scored as a whole,
    though none above TRAIN_TEXT_BYTES is learned from. Null doc_ids fall in fold 0. Labels without a document and null
    labels are not learned from; a document that is labelled twice is learned twice. Without labels, or with one kind
    alone, every score is their share (0.5 without any). Repeated rows are scored one by one; an empty table gives no
    rows; other columns are ignored, whatever their names. Of equally good cuts the first is taken.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learned(docs, labels, folds, held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(lambda batches: _score(batches, model.value, threshold), "doc_id long, held_out boolean, score double, predicted int")
