"""Benchmark decontamination by winnowing.

1. A benchmark window is `window` consecutive words of an item, or a shorter item as a whole. Its fingerprint is the least
   hash of K consecutive words in it, which is what winnowing keeps of each sliding window; a short item is its own
   fingerprint. Equal windows have equal fingerprints, so every shared span of that many words is found.
2. A bit filter of a bounded size, made from the fingerprints, lets each document's fingerprints that can't match end in
   the task that reads the document. It decides nothing else: what passes it is joined.
3. The documents' fingerprints are joined with the benchmark's, and each hit is extended to the windows around it, which
   are joined with the benchmark's windows by hash and word for word.
4. The hits of each row of `docs` are united.

Rows of `docs` have a key of their own while they are looked at, so rows of equal or null doc_ids stay apart. Both joins
broadcast the benchmark's side if it is small by measure; otherwise its rows are repeated for a few salts, over which a
passage that many documents hold is spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .bytesops import ALNUM, Words, mixed, ngram_hash, slices, window_minimum, words_of
from .common import bounded_batches, salted, small

#: Words in a k-gram; a benchmark window of n words gives n - K + 1 hashes to choose from.
K = 5
#: Bits of the filter: so many for each benchmark window, within bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27

WINDOW = pa.struct([("start", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("hash", pa.int64()), ("win", pa.binary())])
_WINDOW_SQL = "start: long, size: int, print: long, hash: long, win: binary"


def windows_of(words: Words, size: int, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where `size` words stay in one text, with the fingerprint and the hash of the words from there."""
    at = np.arange(max(0, len(words.doc) - size + 1))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    hashes = ngram_hash(words.hash, size)
    k = min(K, size)
    prints = window_minimum(ngram_hash(words.hash, k), size - k + 1) if full and len(hashes) else hashes
    return at, prints[at], hashes[at]


def _bench_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"), ALNUM)
            names = [str(x) for x in part.column("item_id").to_pylist()]
            sizes = np.minimum(np.diff(words.first), window)
            for size in sorted(set(sizes.tolist()) - {0}):
                at, prints, hashes = windows_of(words, size, size == window)
                own = sizes[words.doc[at]] == size
                at, prints, hashes = at[own], prints[own], hashes[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size), pa.int32()), pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array([words.text(i, size) for i in at.tolist()], pa.binary()), pa.array([names[d] for d in words.doc[at].tolist()], pa.string())],
                    names=["size", "print", "hash", "win", "item"],
                )


class BitFilter:
    """Which fingerprints may be in the benchmark: one bit for each, in 64-bit words."""

    def __init__(self, bits: int, places: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[places] = values.view(np.uint64)

    def passes(self, prints: np.ndarray) -> np.ndarray:
        """Whether each fingerprint may be in the benchmark; never wrongly false."""
        bit = mixed(prints) >> self.shift
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _bit_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    for batch in batches:
        bit = mixed(batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)) >> shift
        yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["place", "value"])


def bit_filter(prints: DataFrame, n: int) -> BitFilter:
    """The filter of distinct fingerprints. At most MOST_BITS / 64 words of it come to the driver, however many there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    rows = prints.mapInArrow(lambda batches: _bit_words(batches, bits), "place long, value long").groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()
    return BitFilter(bits, rows.column("place").to_numpy(), rows.column("value").to_numpy())


def _scan(batches: Iterator[pa.RecordBatch], known: BitFilter, sizes: list[int], window: int) -> Iterator[pa.RecordBatch]:
    """Per row: its number of words and its windows whose fingerprints pass the filter."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"), ALNUM)
            found: list[tuple[np.ndarray, ...]] = []
            texts: list[bytes] = []
            for size in sizes:
                at, prints, hashes = windows_of(words, size, size == window)
                good = known.passes(prints)
                found.append((words.doc[at[good]], at[good], np.full(int(good.sum()), size), prints[good], hashes[good]))
                texts += [words.text(i, size) for i in at[good].tolist()]
            doc, at, size, prints, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
            order = np.argsort(doc, kind="stable")
            offsets = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
            fields = [pa.array((at - words.first[doc])[order], pa.int64()), pa.array(size[order], pa.int32()), pa.array(prints[order].astype(np.uint64).view(np.int64)), pa.array(hashes[order].astype(np.uint64).view(np.int64)), pa.array([texts[i] for i in order.tolist()], pa.binary())]
            windows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(WINDOW)))
            kept = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(name) for name in kept), pa.array(np.diff(words.first), pa.int64()), windows], names=[*kept, "n_words", "windows"])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of covered words, their number and the digest of the items."""
    for batch in batches:
        n_hit, runs, items, digests = [], [], [], []
        for hits, sets in zip(batch.column("hits").to_pylist(), batch.column("sets").to_pylist(), strict=True):
            own: list[int] = []
            for start, end in sorted((h["start"], h["start"] + h["size"]) for h in hits or ()):
                if own and start <= own[-1]:
                    own[-1] = max(own[-1], end)
                else:
                    own += [start, end]
            runs.append(own)
            n_hit.append(sum(own[1::2]) - sum(own[::2]))
            items.append(sorted(sets or ()))
            digests.append(hashlib.sha256(",".join(items[-1]).encode()).hexdigest())
        kept = [name for name in batch.schema.names if name not in ("hits", "sets")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), pa.array(n_hit, pa.int64()), pa.array(digests, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            names=[*kept, "n_hit", "items_sha256", "runs", "items"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Benchmark words in each document.

    Returns a row for each row of `docs`, whatever the sizes of the two tables: doc_id, the columns named in `carry`,
    n_words, n_hit, items_sha256, runs (word positions 'from' and 'to' in turn) and items (ids as sorted strings).
    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. Null and empty texts have
    no words and no hits; rows of null or repeated doc_ids are looked at one by one; a text of any length is looked at
    as a whole. Null item ids are named 'None', rows of one item id are one item, and an empty benchmark hits nothing.
    An empty table gives no rows. Other columns of either table are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = items.mapInArrow(lambda batches: _bench_windows(batches, window), "size int, print long, hash long, win binary, item string")
    bench = written(found.groupBy("size", "print", "hash", "win").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    prints = written(bench.select("size", "print").distinct(), "benchmark-prints")
    sizes = [row[0] for row in prints.select("size").distinct().orderBy("size").collect()]  # at most `window` of them
    known = spark.sparkContext.broadcast(bit_filter(prints.select("print"), prints.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop("text").schema)
    scan = texts.mapInArrow(lambda batches: _scan(batches, known.value, sizes, window), f"{kept}, n_words long, windows array<struct<{_WINDOW_SQL}>>")
    rows = written(scan.withColumn("_row", F.monotonically_increasing_id()), "document-windows")
    windows = rows.where(F.size("windows") > 0).select("_row", F.inline("windows"))
    matched = salted(windows, prints, ["size", "print"], "_row", "left_semi")
    hits = salted(matched, bench.drop("print"), ["size", "hash", "win"], "_row", "inner", "64 + octet_length(win) + 32 * size(items)")
    united = hits.groupBy("_row").agg(F.collect_list(F.struct("start", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("sets"))
    marks = written(united, "document-hits")
    joined = rows.drop("windows").join(small(marks, "64 + 16 * size(hits) + 32 * size(sets)"), "_row", "left").drop("_row")
    return joined.mapInArrow(_summary, f"{kept}, n_words long, n_hit long, items_sha256 string, runs array<long>, items array<string>")
