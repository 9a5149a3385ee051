"""Near-duplicate documents by HyperMinHash.

1. Each document's word shingles are hashed once. The leading bits of a hash choose one of REGISTERS buckets, and a bucket
   keeps, of the least rest of a hash in it, the number of leading zeros and the next bits, 32 bits in all; 0 is an empty
   bucket.
2. Documents with the same set are one class and go on as its least doc_id.
3. For banding, an empty register takes the value of the first filled one in an order of its own (densification), so that
   any two registers agree about as often as the sets are similar, however small they are, and a band rests on several
   shingles where there are several. BANDS bands of registers put classes into groups. At similarity 0.8 two classes miss
   each other with a probability of (1 - 0.8 ** 5) ** 40, about 1e-7.
4. In each group every member is held against two of its members, not against all. Similarity is estimated from the
   registers that either has, corrected for those that agree by chance; pairs that can't reach the threshold go.
5. Likely pairs are confirmed on the full sets of shingles of their texts: first each class's likeliest partner, then
   the likely pairs that still lie in different components.
6. In groups that still hold several components, members outside the commonest one are held against two of its
   members once more. Those that stay outside are compared, on their full sets, with the members that share a group
   with them and are of a size that allows the threshold: blocks of them, bounded by their shingles, go against chunks of
   the others, and only links leave the task. So no link between components is lost, and no pairs are written down.

No group is gathered in one task: groups are joined with their chosen members by keys that are salted where they have many
rows, and texts travel only for the pairs and blocks that are confirmed. Sets are sets of 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .bytesops import SPACED, Words, mixed, ngram_hash, slices, words_of
from .common import bounded_batches, lookup, small
from .components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Bits of a hash behind those that choose a bucket, and of them those behind the leading zeros that a register keeps.
REST, MANTISSA = 44, 26
#: Mantissa bits of the short registers that similarity is estimated from.
SHORT = 10
#: How many standard deviations below the threshold an estimate may lie.
DEVIATIONS = 5
#: Shingles outside a component that are compared at once, and shingles that they are streamed past in one task; a block
#: is streamed past at least four times its own, as every such task reads the block.
BLOCK, STREAM = 500_000, 50_000
#: Texts and shingles that a task takes where pairs or blocks are few, and rows of registers.
TEXTS, SHINGLES, WIDE = 1000, 200_000, 4096
#: Members that are confirmed beside one copy of their partner's text.
CHUNK = 64
#: What ids are combined with to order a group's members by.
ORDER = 0x2545F4914F6CDD1D
#: Sets whose shingles are sorted together.
SORTED = 4096


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The distinct hashes of each text's n-word shingles; a text of fewer words is one shingle."""
    whole = ngram_hash(words.hash, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        size = b - a
        if size >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(ngram_hash(words.hash[a:b], size) if size else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set: leading zeros (and one) and mantissa of the least rest in each bucket, 0 if empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint32)
    for first in range(0, len(sets), SORTED):
        some = sets[first : first + SORTED]
        values = np.concatenate(some)
        if not len(values):
            continue
        row = np.repeat(np.arange(len(some), dtype=np.uint64), [len(s) for s in some])
        bucket = ((values >> np.uint64(48)) * np.uint64(REGISTERS)) >> np.uint64(16)
        keys = np.sort(((row * np.uint64(REGISTERS) + bucket) << np.uint64(REST)) | (values & np.uint64((1 << REST) - 1)))
        place = keys >> np.uint64(REST)
        least = keys[np.concatenate(([True], place[1:] != place[:-1]))]
        rest = least & np.uint64((1 << REST) - 1)
        _, exponent = np.frexp(rest.astype(np.float64))
        zeros = (REST - exponent).astype(np.uint64)
        mantissa = np.where(rest > 1, (rest << (np.uint64(64 - REST + 1) + np.minimum(zeros, np.uint64(REST - 2)))) >> np.uint64(64 - MANTISSA), np.uint64(0))
        out[first : first + SORTED].reshape(-1)[(least >> np.uint64(REST)).astype(np.int64)] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return out


def _orders() -> np.ndarray:
    """For each register all registers, itself first and the others in an order of its own."""
    draw = np.random.Generator(np.random.PCG64(20240229))
    orders = np.array([[j, *(k for k in draw.permutation(REGISTERS).tolist() if k != j)] for j in range(REGISTERS)])
    return orders


_ORDERS = _orders()
#: Registers that are tried for all rows at once before the rest is looked up.
TRIED = 12


def densified(kept: np.ndarray) -> np.ndarray:
    """Registers in which each empty one has the value of the first filled one in its order; a row has a filled one."""
    filled, out = kept != 0, kept.copy()
    for first in range(0, len(kept), 256):
        rows, flags = kept[first : first + 256], filled[first : first + 256]
        tried = flags[:, _ORDERS[:, :TRIED]]
        source = _ORDERS[np.arange(REGISTERS), tried.argmax(axis=2)]
        row, register = np.nonzero(~tried.any(axis=2))
        for at in range(0, len(row), 4096):
            r, j = row[at : at + 4096], register[at : at + 4096]
            source[r, j] = _ORDERS[j, flags[r[:, None], _ORDERS[j]].argmax(axis=1)]
        out[first : first + 256] = np.take_along_axis(rows, source, axis=1)
    return out


def halves(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last 16 bits of registers. The first ones, zeros and SHORT mantissa bits, are enough to estimate by."""
    return (kept >> np.uint32(MANTISSA - SHORT)).astype(np.uint16), kept.astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of filled short registers of disjoint sets of n and m shingles that agree by chance."""
    n, m = n / REGISTERS, m / REGISTERS
    total = np.zeros(np.broadcast(n, m).shape)
    for zeros in range(REST):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += (np.exp(-n * low) - np.exp(-n * high)) * (np.exp(-m * low) - np.exp(-m * high))
    return total / (1 << SHORT) / np.maximum(1 - np.exp(-(n + m)), 1e-9)


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of sets by their registers, and how many registers it rests on."""
    filled = ((a | b) != 0).sum(axis=1)
    agree = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1)
    by_chance = chance(n.astype(float), m.astype(float))
    return (agree - by_chance) / (1 - by_chance), filled


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(words_of(part.column("text"), SPACED), n)
            marks = [(int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64))) for s in sets]
            digests = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            kept = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(pa.array([row.tobytes() if len(s) else None for row, s in zip(half, sets, strict=True)], pa.binary()) for half in halves(kept))],
                names=["doc_id", "n", "d1", "d2", "high", "low"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            high, low = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64) for c in ("high", "low"))
            kept = densified(((high << np.uint64(16)) | low).reshape(-1, REGISTERS)).reshape(-1, BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(kept), axis=0)
            for j in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + kept[:, :, j] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column("rep").to_numpy(zero_copy_only=False), BANDS))], names=["band", "rep"])


def _estimate(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("ra", "rb"))
        n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("na", "nb"))
        values, filled = estimated(a, b, n, m)
        good = pa.array(values >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(filled, 1)))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(values).filter(good), pa.array(n + m).filter(good)], names=["a", "b", "estimate", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and chunk, the hub's own text first."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(words_of(part.column("text"), SPACED), n)
            a, b = [], []
            for key, doc, role, shingles in zip(part.column("hub").to_pylist(), part.column("doc_id").to_pylist(), part.column("role").to_pylist(), sets, strict=True):
                if role == 0:
                    hub, own = key, shingles
                elif key == hub:
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(shingles) - both):
                        a.append(key)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tasks(texts: int, shingles: int | None) -> int:
    """How many tasks take texts with so many shingles, if there aren't fewer partitions anyway."""
    return max(1, -(-texts // TEXTS), -(-(shingles or 0) // SHINGLES))


class _Search:
    """The classes of one corpus and what is known of their links."""

    def __init__(self, texts: DataFrame, reps: DataFrame, n: int, percent: int):
        self.texts, self.reps, self.n, self.percent = texts, reps, n, percent
        self.labels: DataFrame | None = None

    def likely(self, pairs: DataFrame, most: int) -> DataFrame:
        """The pairs (a, b), about `most`, whose sizes and registers allow the threshold, with their estimates."""
        pairs = written(pairs, "pairs", most)
        most = pairs.count()
        joined = pairs
        for x, y in (("a", "b"), ("b", "a")):
            fans = written(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("fan")), "fans", most)
            side = fans.join(self.reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("high").alias(f"r{x}")), x)
            joined = lookup(joined, side, [x], "fan", by=y, sizes=fans).drop("fan")
        joined = joined.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        joined = joined.coalesce(max(1, -(-most // WIDE)))
        return written(joined.mapInArrow(lambda batches, p=self.percent / 100: _estimate(batches, p), "a long, b long, estimate double, shingles long"), "likely")

    def confirm(self, pairs: DataFrame) -> None:
        """Hold the full sets of the pairs against each other and add the links; the pairs say how many shingles they have."""
        n, percent = self.n, self.percent
        most, shingles = pairs.agg(2 * F.count(F.lit(1)), F.sum("shingles")).first()
        fans = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan"))
        member = pairs.join(fans, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / CHUNK)).alias("chunk"), F.col("b").alias("doc_id"), F.lit(1).alias("role"))
        hubs = member.select("hub", "chunk", F.col("hub").alias("doc_id"), F.lit(0).alias("role")).distinct()
        wanted = written(member.unionByName(hubs), "wanted", most)
        rows = self.texts.join(small(wanted, "128"), "doc_id").select("hub", "chunk", "role", "doc_id", "text")
        ordered = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "doc_id").coalesce(_tasks(most, shingles))
        found = written(ordered.mapInArrow(lambda batches: _confirm(batches, n, percent), "a long, b long"), "confirmed")
        self.join(found)

    def join(self, found: DataFrame) -> None:
        """Take new links into the components: only what they join is gone through again."""
        if self.labels is None:
            self.labels = components(found)
            return
        label = lambda x: self.labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        ends = found.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        bridges = written(ends.where("a <> b").distinct(), "bridges", found.count())
        if bridges.isEmpty():
            return
        merged = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("least"))
        kept = self.labels.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        fresh = merged.select(F.col("component").alias("node"), F.col("least").alias("component")).join(self.labels.select("node"), "node", "left_anti")
        self.labels = written(kept.unionByName(fresh), "labels", self.labels.count() + merged.count())

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that lie in different components."""
        label = lambda x: self.labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def settle(self, pairs: DataFrame, most: int, fully: bool) -> None:
        """Confirm each class's likeliest partner and, `fully`, all other likely pairs that still lie apart."""
        likely = self.likely(pairs, most)
        most = likely.count()
        if not most:
            return
        ends = likely.select(F.col("a").alias("x"), F.struct(F.col("b").alias("y"), "shingles").alias("other"), "estimate").union(likely.select("b", F.struct("a", "shingles"), "estimate"))
        best = ends.groupBy("x").agg(F.max_by("other", F.col("estimate")).alias("other")).select("x", "other.*")
        first = written(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shingles").distinct(), "first", most)
        self.confirm(first)
        if not fully:
            return
        rest = written(self.apart(likely.select("a", "b", "shingles").join(first, ["a", "b"], "left_anti")), "rest", most)
        if not rest.isEmpty():
            self.confirm(rest)

    def split_groups(self, members: DataFrame) -> DataFrame:
        """The members (band, rep) of groups with several components: component, and the group's commonest one as main."""
        most = members.count()
        labelled = members.join(self.labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        counts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        split = counts.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        return written(lookup(labelled, written(split.drop("kinds"), "split", most // 2), ["band"], "size", by="rep").select("band", "rep", "component", "main"), "split-groups", most)

    def compare(self, members: DataFrame) -> None:
        """Hold what lies outside a main component against all that shares a group with it, on full sets.

        Sizes are put into classes that grow by the ratio that the threshold allows, so that only neighbouring classes meet.
        """
        n, percent, most = self.n, self.percent, members.count()
        ratio = 1.001 * max(1.0, 100 / percent)
        sized = members.select("main", "rep", "component").distinct().join(self.reps.select("rep", "n"), "rep")
        sized = written(sized.withColumn("size", F.floor(F.log("n") / float(np.log(ratio))).cast("int")), "sized", most)
        near = sized.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
        outside = sized.where("component <> main")
        blocks = outside.groupBy("main", "size").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.sum("n").alias("asked"))
        sizes = near.groupBy("main", "size").agg(F.sum("n").alias("streamed"), F.count(F.lit(1)).alias("rows")).join(blocks, ["main", "size"])
        sizes = sizes.withColumn("chunks", F.ceil(F.col("streamed") / F.greatest(F.lit(STREAM), 4 * F.col("asked") / F.col("blocks"))))
        sizes = written(sizes, "block-sizes", 3 * most)
        shingles = sizes.agg(F.sum(F.col("asked") * F.col("chunks") + F.col("streamed") * F.col("blocks"))).first()[0]
        sizes = sizes.select("main", "size", "rows", "blocks", "chunks")
        each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
        join = lambda rows: lookup(rows, sizes, ["main", "size"], "rows", by="rep")
        asked = join(outside).select("main", "size", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("role"), F.col("rep").alias("doc_id"), "component")
        streamed = join(near).select("main", "size", each("blocks").alias("block"), F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("chunks")).alias("chunk"), F.lit(1).alias("role"), F.col("rep").alias("doc_id"), "component")
        wanted = written(asked.unionByName(streamed), "blocks", 4 * most)
        tasks = _tasks(wanted.count(), shingles)
        rows = self.texts.join(small(wanted, "160"), "doc_id").select("main", "size", "block", "chunk", "role", "doc_id", "component", "text")
        ordered = rows.repartition("main", "size", "block", "chunk").sortWithinPartitions("main", "size", "block", "chunk", "role", "doc_id").coalesce(tasks)
        found = written(ordered.mapInArrow(lambda batches: _compare(batches, n, percent), "a long, b long"), "block-links")
        self.join(found)


def _compare(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, the block first: links between the block and what is streamed past it, one for each
    member of the block and other component."""
    group, reps, comps, sets = None, [], [], []
    index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            found = shingle_sets(words_of(part.column("text"), SPACED), n)
            a, b = [], []
            keys = zip(*(part.column(c).to_pylist() for c in ("main", "size", "block", "chunk", "role", "doc_id", "component")), strict=True)
            for (*key, role, rep, component), shingles in zip(keys, found, strict=True):
                if key != group:
                    group, reps, comps, sets, index = key, [], [], [], None
                    seen.clear()
                if role == 0:
                    reps.append(rep), comps.append(component), sets.append(shingles)
                    continue
                if not sets:
                    continue
                if index is None:
                    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    values = np.concatenate(sets)
                    order = np.argsort(values, kind="stable")
                    index = (values[order], owner[order], np.array([len(s) for s in sets]))
                values, owner, sizes = index
                low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
                counts = high - low
                at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero(100 * both >= percent * (sizes + len(shingles) - both)).tolist():
                    if comps[i] != component and (reps[i], component) not in seen:
                        seen.add((reps[i], component))
                        a.append(min(rep, reps[i]))
                        b.append(max(rep, reps[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _ordered_pairs(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _chosen(members: DataFrame, seed: int) -> DataFrame:
    """Each group's size and two of its members, the extremes of one order: groups of alike members choose the same few."""
    order = F.col("rep").bitwiseXOR(F.lit(seed))
    extremes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("low"), F.max(order).alias("high")).where("size > 1")
    return extremes.withColumns({c: F.col(c).bitwiseXOR(F.lit(seed)) for c in ("low", "high")})


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns a row for each row of `docs`: doc_id, n_shingles, component_id (the least doc_id reachable by links, its own
    included) and kept (doc_id = component_id). Words are runs of anything but ASCII white space after lower-casing
    A-Z; a document of fewer than `shingle` words is one shingle; null texts and texts without words have no shingles
    and link with nothing; a text of any length gives its whole set. Rows that repeat a doc_id and its text each get the same row; different texts are taken to
    have different doc_ids. A row with a null doc_id links with nothing: its component_id is null and it is kept. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(texts.mapInArrow(lambda batches: _sketch(batches, shingle), "doc_id long, n long, d1 long, d2 long, high binary, low binary"), "sketches")
    known = sketches.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(known.groupBy("d1", "d2", "n", "high", "low").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")), "classes", known.count(), WIDE)
    most = BANDS * reps.count()
    bands = reps.select("rep", "high", "low").mapInArrow(_bands, "band long, rep long")
    members = written(lookup(bands, written(_chosen(bands, ORDER), "chosen", most), ["band"], "size", by="rep"), "groups", most)
    search = _Search(texts, reps, shingle, percent)
    search.settle(_ordered_pairs(members.select("rep", F.explode(F.array("low", "high")).alias("other")), "rep", "other"), 2 * members.count(), fully=True)
    if search.labels is None:  # no link so far: every class is a component of its own
        search.labels = spark.createDataFrame([], "node long, component long")
    large = members.where("size > 3").select("band", "rep")  # both chosen members settle smaller groups
    split = search.split_groups(large)
    if not split.isEmpty():
        order = F.when(F.col("component") == F.col("main"), F.xxhash64(F.lit(1), "rep", "band"))
        chosen = written(split.groupBy("band").agg(F.min_by("rep", order).alias("low"), F.max_by("rep", order).alias("high"), F.count_if(F.col("component") != F.col("main")).alias("size")), "chosen", split.count())
        pairs = lookup(split.where("component <> main"), chosen, ["band"], "size", by="rep").select("rep", F.explode(F.array("low", "high")).alias("other"))
        search.settle(_ordered_pairs(pairs, "rep", "other"), 2 * split.count(), fully=False)
        search.compare(search.split_groups(split.select("band", "rep")))
    classed = reps.select("d1", "d2", "n", "rep", "class_size")
    classed = classed.join(search.labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classed = written(classed.select("d1", "d2", "n", "component", "class_size"), "classed", most // BANDS)
    joined = lookup(known.select("doc_id", "n", "d1", "d2"), classed, ["d1", "d2", "n"], "class_size").select("doc_id", "n", "component")
    alone = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = joined.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
