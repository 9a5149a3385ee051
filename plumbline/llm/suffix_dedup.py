"""Removal of repeated substrings with a run-length index.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller doc_id.

1. Copies of whole texts are one class and go on as its least doc_id.
2. Every string of `length` bytes has a fingerprint: the least hash of K consecutive bytes in it. Equal strings have equal
   fingerprints, and a text has far fewer fingerprints than strings. Fingerprints are exchanged in compressed blocks; those
   of a single document end there.
3. A fingerprint's owner is the least document that has it. Each document sends the parts of its text whose strings
   have shared fingerprints to the group of their owner, so that all equal strings meet in one group. Groups of too
   much text are split by fingerprint. A fingerprint of more than HOT_DOCS documents has groups of its own: its documents
   are dealt to several, and its owner's part goes to each.
4. Groups are taken in batches. A run-length index of the owners' parts is built and the matching statistics of all other
   parts are streamed through it. Of what the owners don't settle, strings that stand once by their hash are done; the
   others get an index of their own, through which they are streamed once more; there the least document of each class
   of equal strings decides.
5. What remains unsettled in the groups of one hot fingerprint may stand in several of them. It goes through steps 2 to 4
   once more, with whole strings as fingerprints: then the owner has every string of its group.
6. Matched strings are united per document, and the rest of its bytes is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .bytesops import SLICE_BYTES, mixed, powers, prefix_hash, raw, slices, span_hash, window_minimum, winnowed
from .common import bounded_batches, lookup, small
from .run_length_index import RunLengthIndex

#: Bytes under a fingerprint; a string of n bytes offers n - K + 1 of them. Fewer where strings are short.
K = 24
#: Bits of a fingerprint. Different strings that share one only meet in a group in vain.
PRINT_BITS = 48
#: Fingerprints that are exchanged together, and shared ones in a group before it is split.
BLOCK_PRINTS, GROUP_PRINTS = 2 << 20, 400_000
#: Documents of a fingerprint that meet in one group, and what sets the groups of a hot one apart from splits.
HOT_DOCS, HOT_SPLIT = 2000, 1 << 50
#: Bytes of parts that are indexed together.
BATCH_BYTES = 4 << 20
#: Longer parts are streamed in pieces of so many strings.
PIECE = 1024


def gram_bytes(length: int) -> int:
    """Bytes under a fingerprint for strings of `length` bytes."""
    return min(K, max(1, length // 2))


def gram_prints(body: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint candidates of all places of a byte array."""
    m = len(body) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(body)
    _, down = powers(len(prefix))
    return mixed((prefix[k:] - prefix[:m]) * down[:m]) >> np.uint64(64 - PRINT_BITS)


def _prints(batches: Iterator[pa.RecordBatch], length: int, k: int, blocks: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = docs = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, docs
        doc_ids, values, owner = np.concatenate(ids), np.concatenate(prints), np.concatenate(owners).astype(np.uint32)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        block = ((values * np.uint64(blocks)) >> np.uint64(PRINT_BITS)).astype(np.int64) if blocks < 1 << (64 - PRINT_BITS) else (values % np.uint64(blocks)).astype(np.int64)
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        rows: list[tuple[int, int, bytes, bytes, bytes]] = []
        for at in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[at], cuts[at + 1]
            used, place = np.unique(owner[a:b], return_inverse=True)
            steps = np.diff(values[a:b], prepend=np.uint64(0))
            rows.append((int(at), int(b - a), squeeze(planes(steps)), squeeze(doc_ids[used].tobytes()), squeeze(planes(place.astype(np.uint32)))))
        ids.clear(), prints.clear(), owners.clear()
        held = docs = 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "prints", "docs", "places"])

    for batch in batches:
        for part in slices(batch, "text"):
            body, ends = raw(part.column("text"))
            values = gram_prints(body, k)
            at = winnowed(values, length - k + 1)
            doc = np.searchsorted(ends, at, "right") - 1
            whole = at + k <= ends[doc + 1]
            ids.append(part.column("doc_id").to_numpy(zero_copy_only=False))
            prints.append(values[at[whole]])
            owners.append(doc[whole] + docs)
            docs += part.num_rows
            held += int(whole.sum())
            if held >= BLOCK_PRINTS:
                yield from flush()
    if ids:
        yield from flush()


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type, n: int) -> np.ndarray:
    """The values again."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).ravel()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; out go the fingerprints of more than one document: doc, print, owner, documents."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    current, prints, docs = None, [], []

    def finish() -> Iterator[pa.RecordBatch]:
        value, doc = np.concatenate(prints), np.concatenate(docs)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        value, doc = value[fresh], doc[fresh]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        size = np.diff(np.append(first, len(value)))
        keep = np.repeat(size > 1, size)
        for at in range(0, int(keep.sum()), 50_000):
            some = np.flatnonzero(keep)[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(value[some].astype(np.int64)), pa.array(np.repeat(doc[first], size)[some]), pa.array(np.repeat(size, size)[some])], names=["doc_id", "print", "owner", "docs"])

    for batch in batches:
        for block, n, values, ids, places in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "prints", "docs", "places")), strict=True):
            if block != current and prints:
                yield from finish()
                prints, docs = [], []
            current = block
            prints.append(np.cumsum(unplaned(expand(values), np.uint64, n), dtype=np.uint64))
            docs.append(np.frombuffer(expand(ids), np.int64)[unplaned(expand(places), np.uint32, n)])
    if prints:
        yield from finish()


PARTS = {"owner": pa.int64(), "split": pa.int64(), "salt": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "body": pa.binary()}


def _parts(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The parts of each text (from `base` on in its document) whose strings have shared fingerprints, by group."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int, bytes]] = []
        lists = batch.column("shared")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        columns = [flat.field(name).to_numpy(zero_copy_only=False) for name in ("print", "owner", "splits", "salts")]
        for i, (doc, base, data) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("base").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            if len(data) < length:
                continue
            known, owner, splits, salts = (c[offsets[i] : offsets[i + 1]] for c in columns)
            order = np.argsort(known)
            known, owner, splits, salts = known[order].astype(np.uint64), owner[order], splits[order], salts[order]
            least = window_minimum(gram_prints(np.frombuffer(data, np.uint8), k), length - k + 1)
            at = np.minimum(np.searchsorted(known, least), len(known) - 1)
            hit = known[at] == least
            split = np.where(salts[at] > 0, least.astype(np.int64) + HOT_SPLIT, (least % splits[at].astype(np.uint64)).astype(np.int64))
            key = np.where(hit, owner[at], -1)
            change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (split[1:] != split[:-1]) | (hit[1:] != hit[:-1]), [True])))
            own_salt = int(mixed(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(1))
            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                if hit[a]:
                    of, n = int(owner[at[a]]), int(salts[at[a]])
                    for salt in range(n) if n and of == doc else (own_salt % n if n else 0,):
                        rows.append((of, int(split[a]), salt, doc, base + a, data[a : b + length - 1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PARTS.values(), strict=True)], names=list(PARTS))


def spans_of(marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked places of parts that lie behind each other: part, first place in it, place behind the last."""
    begins = np.cumsum(sizes + 1) - sizes  # an unmarked place stands before each part and at the end
    apart = np.zeros(len(marks) + len(sizes) + 1, bool)
    inside = np.ones(len(apart), bool)
    inside[begins - 1] = inside[-1] = False
    apart[inside] = marks
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    part = np.searchsorted(begins, edges[::2], "right") - 1
    return part, edges[::2] - begins[part], edges[1::2] - begins[part]


def twice(bodies: list[bytes], sizes: np.ndarray, length: int) -> np.ndarray:
    """Which strings of the bodies (`sizes` of each) share their hash with another one: no other string can have an equal."""
    hashes, at = [np.zeros(0, np.uint64)], 0
    ends = np.cumsum([len(b) for b in bodies])
    while at < len(bodies):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")))
        prefix = prefix_hash(np.frombuffer(b"".join(bodies[at:to]), np.uint8))
        starts = np.flatnonzero(_strings(sizes[at:to], length))
        hashes.append(span_hash(prefix, starts, starts + length))
        at = to
    values = np.concatenate(hashes)
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    found = np.zeros(len(values), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return found


def _strings(sizes: np.ndarray, length: int) -> np.ndarray:
    """Of all bytes of bodies with so many strings each, those at which a string starts."""
    starts = np.ones(int((sizes + length - 1).sum()), bool)
    ends = np.cumsum(sizes + length - 1)
    starts[(ends[:, None] - np.arange(1, length)).ravel()] = False
    return starts


#: Pieces whose results are taken over at once.
TAKEN = 4096


def earlier(bodies: list[bytes], docs: np.ndarray, owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part, which of its strings also start in a part of a smaller document."""
    flat, sizes = earlier_flat(bodies, docs, owners, length)
    return np.split(flat, np.cumsum(sizes)[:-1])


def earlier_flat(bodies: list[bytes], docs: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in one array, and how many strings each part has."""
    sizes = np.maximum(np.array([len(b) for b in bodies], np.int64) - (length - 1), 0)
    begins = np.cumsum(sizes) - sizes
    flags = np.zeros(int(sizes.sum()), bool)

    def stream(indexed: list[tuple[bytes, int]], asked: list[tuple[int, int, bytes]]) -> None:
        """asked: part, the string it begins with, bytes."""
        if not indexed or not asked:
            return
        texts: dict[bytes, int] = {}
        for body, doc in indexed:
            texts[body] = min(doc, texts.get(body, doc))
        pieces: dict[bytes, int] = {}
        cut = [(part, at + a, pieces.setdefault(body[a : a + PIECE + length - 1], len(pieces))) for part, at, body in asked for a in range(0, len(body) - length + 1, PIECE)]
        index = RunLengthIndex(list(texts), np.array(list(texts.values()), np.int64), length)
        order = list(pieces)
        least, first = index.streamed(order)
        strings = np.array([len(p) for p in order], np.int64) - (length - 1)
        for n in range(0, len(cut), TAKEN):
            part, at, piece = np.array(cut[n : n + TAKEN], np.int64).T
            counts = strings[piece]
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = least[np.repeat(first[piece], counts) + place] < np.repeat(docs[part], counts)
            flags[(np.repeat(begins[part] + at, counts) + place)[hit]] = True

    owned = [(b, int(d)) for b, d, o in zip(bodies, docs, owners, strict=True) if d == o]
    stream(owned, [(i, 0, b) for i, (b, d, o) in enumerate(zip(bodies, docs, owners, strict=True)) if d != o and len(b) >= length])
    part, a, b = spans_of(~flags & np.repeat(docs != owners, sizes), sizes)
    left = [bodies[i][x : y + length - 1] for i, x, y in zip(part.tolist(), a.tolist(), b.tolist(), strict=True)]
    # of what is left, strings that stand there once are settled; the others are indexed
    of, x, y = spans_of(twice(left, b - a, length), b - a)
    again = [(i, at, left[n][u : v + length - 1]) for n, i, at, u, v in zip(of.tolist(), part[of].tolist(), (a[of] + x).tolist(), x.tolist(), y.tolist(), strict=True)]
    stream([(body, int(docs[i])) for i, _, body in again], again)
    return flags, sizes


def _matched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; out go runs of bytes that repeat: doc, [from, to, ...]. What a group of a hot fingerprint
    doesn't settle goes out as start and body."""
    rows: list[tuple[int, int, int, int, bytes]] = []  # owner, split, doc, start, body
    held, group = 0, None

    def finish() -> Iterator[pa.RecordBatch]:
        owners, splits, docs, starts = np.array([r[:4] for r in rows], np.int64).T
        flags, sizes = earlier_flat([r[4] for r in rows], docs, owners, length)
        part, a, b = spans_of(flags, sizes)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = np.stack((a + starts[part], b + starts[part] + length - 1), axis=1).ravel()
        runs = pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(part)), pa.int32()), pa.array(bounds))
        yield matches(docs[part[first]], runs, pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary()))
        part, a, b = spans_of(~flags & np.repeat((splits >= HOT_SPLIT) & (docs != owners), sizes), sizes)
        open_ = [rows[i][4][x : y + length - 1] for i, x, y in zip(part.tolist(), a.tolist(), b.tolist(), strict=True)]
        yield matches(docs[part], pa.nulls(len(part), pa.list_(pa.int64())), pa.array(a + starts[part]), pa.array(open_, pa.binary()))

    def matches(docs: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *columns], names=["doc_id", "runs", "base", "text"])

    for batch in batches:
        for owner, split, salt, doc, start, body in zip(*(batch.column(c).to_pylist() for c in PARTS), strict=True):
            if (owner, split, salt) != group and held >= BATCH_BYTES:
                yield from finish()
                rows.clear()
                held = 0
            group = (owner, split, salt)
            rows.append((owner, split, doc, start, body))
            held += len(body)
    if rows:
        yield from finish()


def _round(texts: DataFrame, length: int, k: int, blocks: int) -> DataFrame:
    """One pass of fingerprints, groups and indexes over texts (doc_id, base, text as bytes): doc_id, runs, base, text."""
    sent = texts.mapInArrow(lambda batches: _prints(batches, length, k, blocks), "block long, n long, prints binary, docs binary, places binary")
    shared = written(sent.repartition("block").sortWithinPartitions("block").mapInArrow(_shared, "doc_id long, print long, owner long, docs long"), "shared-prints")
    hot = F.col("docs") > HOT_DOCS
    sizes = written(shared.where(~hot).groupBy("owner").count().where(F.col("count") > GROUP_PRINTS).select("owner", F.ceil(F.col("count") / GROUP_PRINTS).alias("splits")), "group-splits")
    listed = shared.join(small(sizes), "owner", "left").withColumn("splits", F.coalesce("splits", F.lit(1))).withColumn("salts", F.when(hot, F.ceil(F.col("docs") / HOT_DOCS)).otherwise(0))
    lists = listed.groupBy("doc_id").agg(F.collect_list(F.struct("print", "owner", "splits", "salts")).alias("shared"))
    parts = texts.join(lists, "doc_id").mapInArrow(lambda batches: _parts(batches, length, k), "owner long, split long, salt long, doc_id long, start long, body binary")
    grouped = parts.repartition("owner", "split", "salt").sortWithinPartitions("owner", "split", "salt", "doc_id", "start")
    return written(grouped.mapInArrow(lambda batches: _matched(batches, length), "doc_id long, runs array<long>, base long, text binary"), "repeat-runs")


def _cleaned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, removed, spans, digests, kept = [], [], [], [], [], []
        for doc, text, runs, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs", "is_copy")), strict=True):
            data = (text or "").encode()
            united = [[0, len(data)]] if copy and len(data) >= length else []
            if not copy:
                for a, b in sorted(pair for run in runs or () for pair in zip(run[::2], run[1::2], strict=True)):
                    if united and a <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], b)
                    else:
                        united.append([a, b])
            rest, at = [], 0
            for a, b in united:
                rest.append(data[at:a])
                at = b
            rest.append(data[at:])
            ids.append(doc), sizes.append(len(data)), spans.append(len(united)), removed.append(sum(b - a for a, b in united))
            kept.append(b"".join(rest))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents without bytes that repeat strings of documents with smaller ids.

    Returns a row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (lower-case hexadecimal, of the remaining bytes) and kept (the remaining bytes; they may end inside a character).
    Texts are UTF-8 bytes, null is empty; matches don't cross documents and are judged on the input. Rows that repeat a
    doc_id and text have equal rows; different texts are taken to have different doc_ids. Of equal strings the one in the
    least doc_id stays, wherever it stands; a text of any length is treated as a whole. A row with a null doc_id stays
    whole and nothing is removed for its sake. Texts shorter than `length` stay whole. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    if length < 8:
        raise ValueError("strings must have 8 bytes at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = texts.where("doc_id IS NOT NULL")
    digests = named.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    classes = written(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "text-classes")
    copies = written(lookup(digests, classes, ["digest"], "class_size").where("doc_id <> rep").select("doc_id").distinct(), "copies")
    marked = small(copies)
    single = named.where(F.octet_length("text") >= length).join(marked, "doc_id", "left_anti")
    blocks = max(512, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = single.select("doc_id", F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("text"))
    found = _round(whole, length, gram_bytes(length), blocks)
    unsettled = found.where("runs IS NULL").select("doc_id", "base", "text")
    found = found.where("runs IS NOT NULL").select("doc_id", "runs")
    if not unsettled.isEmpty():
        found = found.unionByName(_round(unsettled, length, length, blocks).where("runs IS NOT NULL").select("doc_id", "runs"))
    runs = found.groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))
    marks = written(runs.withColumn("is_copy", F.lit(False)).unionByName(copies.select("doc_id", F.lit(None).cast("array<array<long>>").alias("runs"), F.lit(True).alias("is_copy"))), "repeat-marks")
    size = "64 + coalesce(aggregate(runs, 0, (total, run) -> total + 24 + 8 * size(run)), 0)"
    joined = texts.join(small(marks, size), "doc_id", "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))
    return joined.mapInArrow(lambda batches: _cleaned(batches, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
