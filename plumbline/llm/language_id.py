"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the byte n-grams of lengths 1 to 3 that both hold (presence, not counts), normalised by
the numbers of their n-grams; n-grams are hashed to BUCKETS. Nyström landmarks give features, and one ridge regression
against the rest is fitted for each language. As the kernel is a product of presence vectors, landmarks and weights
fold into one matrix, and a batch of texts is scored by a product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import slices
from .common import bounded_batches, crc_bucket

BITS = 16
BUCKETS = 1 << BITS
LENGTHS = (1, 2, 3)
#: Bounds of the fit: labelled texts, bytes of a text, landmarks; there are a text and a landmark for each language at least.
TRAIN_DOCS, TRAIN_TEXT_BYTES, LANDMARKS = 2400, 60_000, 240
#: Texts that are expected of each language at least, so that the hash leaves none out.
LEAST_DRAWN = 48
RIDGE = 1e-3
#: How sharply differences of the regressions become scores.
SHARPNESS = 8.0
UNDETERMINED = "und"
#: Texts in a presence matrix.
ROWS = 16


def buckets_of(data: np.ndarray) -> np.ndarray:
    """The n-gram buckets of one text's bytes, with repetitions."""
    wide, gram, parts = data.astype(np.uint32), np.zeros(len(data), np.uint32), []
    for n in LENGTHS:
        m = len(data) - n + 1
        if m > 0:
            gram = (gram[:m] << np.uint32(8)) | wide[n - 1 :]
            parts.append((gram * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of flags for each text."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    for row, text in zip(out, texts, strict=True):
        row[buckets_of(np.frombuffer(text, np.uint8))] = 1
    return out


def prepared(text: str | None) -> bytes:
    """Lower case, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """Languages, the n-gram buckets of the landmarks and what each of them adds to each language's regression."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The regressions' values for each text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), ROWS):
            flags = presence(texts[at : at + ROWS])
            sizes = np.maximum(1, np.count_nonzero(flags, axis=1))
            out[at : at + ROWS] = (flags[:, self.vocabulary].astype(np.float32) @ self.weights) / np.sqrt(sizes)[:, None]
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its score between 0 and 1."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        values = self.scores(texts) * SHARPNESS
        odds = np.exp(values - values.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = values.argmax(axis=1)
        return [self.languages[k] for k in best], odds[np.arange(len(best)), best]


def fit(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression on Nyström features, each language against the rest, all languages weighing the same."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    y = np.array([languages.index(x) for x in labels])
    own = [np.flatnonzero(y == k) for k in range(len(languages))]
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rows[np.linspace(0, len(rows) - 1, min(each, len(rows))).astype(int)] for rows in own])
    flags = presence([texts[i] for i in chosen])
    sizes = np.maximum(1, np.count_nonzero(flags, axis=1))
    vocabulary = np.flatnonzero(flags.any(axis=0))
    marks = flags[:, vocabulary].astype(np.float32) / np.sqrt(sizes)[:, None].astype(np.float32)
    del flags
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.zeros((len(texts), int(keep.sum())))
    for at in range(0, len(texts), ROWS):
        rows = presence(texts[at : at + ROWS])
        norm = np.sqrt(np.maximum(1, np.count_nonzero(rows, axis=1)))[:, None]
        features[at : at + ROWS] = ((rows[:, vocabulary].astype(np.float32) @ marks.T) / norm) @ whiten
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1.0 / np.bincount(y, minlength=len(languages)))[y][:, None]
    gram = features.T @ (features * weight)
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), features.T @ (target * weight))
    return LanguageModel(languages, vocabulary, (marks.T @ (whiten @ solved)).astype(np.float32))


def learned(docs: DataFrame, folds: int = 5, held_out: int = 0, most: int = TRAIN_DOCS) -> LanguageModel:
    """A model of labelled documents outside the held-out fold: at most `most` texts, an equal share for each language.

    All languages that occur are learned, from a text each at least. Texts longer than TRAIN_TEXT_BYTES bytes aren't
    learned from; they are predicted from their whole text like any other.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_TEXT_BYTES) & (crc_bucket(F.col("doc_id"), folds) != held_out))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    each = max(1, most // max(1, len(counts)))
    drawn = max(1.3 * each, LEAST_DRAWN)
    shares = docs.sparkSession.createDataFrame([(row["lang"], min(1 << 30, int(drawn / row["count"] * (1 << 30)) + 1)) for row in counts], "lang string, share long")
    # a row for each language
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30)) < F.col("share")).limit(max(2 * most, 3 * LEAST_DRAWN * len(counts)))
    taken: dict[str, int] = {}
    texts, labels = [], []
    for row in sorted(picked.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text)):
        if taken.get(row.lang, 0) < each:
            taken[row.lang] = taken.get(row.lang, 0) + 1
            texts.append(prepared(row.text))
            labels.append(row.lang)
    return fit(texts, labels)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            lettered = [i for i, text in enumerate(texts) if has_letter(text)]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            found, values = model.predict([prepared(texts[i]) for i in lettered])
            for i, name, value in zip(lettered, found, values, strict=True):
                names[i], scores[i] = name, float(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def any_ascii(text: str) -> bool:
    """Whether a letter is among the first characters: a cheap test that settles nearly all texts."""
    return any(c.isalpha() for c in text[:40])


def has_letter(text: str | None) -> bool:
    return bool(text) and (any_ascii(text) or any(c.isalpha() for c in text))


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is found, with all their columns: those that `predicted` doesn't call undetermined.

    Without a model, as nothing is labelled, letters alone decide. Each row is judged by its own text.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                keep = np.array([has_letter(text) for text in texts], bool)
                at = np.flatnonzero(keep)
                if sent.value.languages and len(at):
                    names, _ = sent.value.predict([prepared(texts[i]) for i in at])
                    keep[at] = [name != UNDETERMINED for name in names]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(found, docs.schema)


def predicted(docs: DataFrame, model: LanguageModel | None = None, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The language of each document's whole text: doc_id, held_out, lang_pred, score.

    lang_pred is a learned language, or `und` with score 0 where the text is null, has no letter, or nothing could be
    learned. `lang`, `source` and `doc_id` have no part in a prediction. Null doc_ids count as held out; repeated rows
    are predicted one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(model or learned(docs, folds, held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(lambda batches: _predict(batches, model.value), "doc_id long, held_out boolean, lang_pred string, score double")
