"""Hierarchical multi-length packing of token ids.

Every document ends with an end id. What fills whole windows of the longest tier is cut off first; the rest of each
document goes to the shortest tier that holds it. Each tier is packed by itself, longest first: a document's rest opens
a window of its tier, and the gap behind it is filled from shorter tiers, first by the longest rests that fit and then
by the beginning of one that is cut. Leftovers of the shortest tier stay for the next batch; at the end of a partition
they fill sequences whose lengths are powers of two. So no sequence needs padding.

The pieces are written to the shared folder. Sequences are then laid in a row, longest tier first, and the row is cut into
step groups of the same number of tokens; so a group holds sequences of one tier, but for those at the edge of two, and
no two groups differ by more than two sequences. What that takes is a sum for each task and tier.

The packing is local to a partition of the input: no text is shuffled. Memory holds the ids of one batch and a window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import written

from .common import bounded_batches, small
from .tokens import CACHE_PARTS, encoded, public_path

#: Context sizes, each a power of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens that are packed together.
BATCH_TOKENS = 1 << 20
#: Tokens in a step group.
STEP_TOKENS = 1 << 15

#: `before` counts the tokens of the same task and tier in earlier sequences.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part int, before long"
_FIELDS = pa.schema([(n, pa.int32() if kind == "int" else pa.int64()) for n, kind in (f.split() for f in SCHEMA.split(", "))])


class Packer:
    """Packs the documents of one partition; rows are the pieces of documents in their sequences."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.next_id = part << 40
        self.part = part
        self.tokens: dict[int, int] = {}  # by tier
        self.rows: list[tuple] = []
        self.rests: list[tuple[int, int, np.ndarray, object, int]] = []  # length, order, ids, document, start
        self.order = 0

    def add(self, doc_id: object, ids: np.ndarray) -> int:
        """Take a document; returns its number of ids."""
        longest, whole = self.tiers[-1], len(ids) // self.tiers[-1]
        for k in range(whole):
            self._emit([(ids[k * longest : (k + 1) * longest], doc_id, k * longest, len(ids))], longest)
        if len(ids) > whole * longest:
            self._keep(ids[whole * longest :], doc_id, whole * longest, len(ids))
        return len(ids)

    def _keep(self, ids: np.ndarray, doc_id: object, start: int, total: int) -> None:
        self.order += 1
        insort(self.rests, (len(ids), self.order, ids, doc_id, (start, total)), key=lambda x: x[:2])

    def _take(self, most: int) -> tuple | None:
        """The longest rest of at most so many ids."""
        at = bisect_right(self.rests, most, key=lambda x: x[0])
        return self.rests.pop(at - 1) if at else None

    def _emit(self, pieces: list[tuple], size: int) -> None:
        before = self.tokens.get(size, 0)
        self.tokens[size] = before + size
        offset = 0
        for ids, doc_id, start, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, size, self.part, before))
            offset += len(ids)
        self.next_id += 1

    def _fill(self, size: int, first: tuple) -> list[tuple]:
        """A window of `size` ids that begins with a rest: the gap takes whole shorter rests, then a cut one."""
        pieces, gap = [first], size - len(first[0])
        while gap and self.rests:
            rest = self._take(gap)
            if rest is None:
                length, _, ids, doc_id, (start, total) = self.rests.pop(0)
                self._keep(ids[gap:], doc_id, start + gap, total)
                ids = ids[:gap]
            else:
                _, _, ids, doc_id, (start, total) = rest
            pieces.append((ids, doc_id, start, total))
            gap -= len(ids)
        return pieces

    def pack(self, final: bool = False) -> None:
        """Pack what is kept; less than a window of the longest tier that is in use may stay unless this is the end."""
        total = sum(x[0] for x in self.rests)
        for size, below in zip(reversed(self.tiers), (*reversed(self.tiers[:-1]), 0), strict=True):
            while total >= size and self.rests[-1][0] > below:
                _, _, ids, doc_id, (start, whole) = self.rests.pop()
                self._emit(self._fill(size, (ids, doc_id, start, whole)), size)
                total -= size
            if self.rests and self.rests[-1][0] > below:
                break
        if final:
            left = sum(x[0] for x in self.rests)
            while left:
                size = 1 << (left.bit_length() - 1)
                while size > self.tiers[-1]:
                    size >>= 1
                at = len(self.rests) - 1
                length, _, ids, doc_id, (start, total) = self.rests.pop(at)
                if length > size:
                    self._keep(ids[size:], doc_id, start + size, total)
                    ids = ids[:size]
                self._emit(self._fill(size, (ids, doc_id, start, total)), size)
                left -= size

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The rows so far."""
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, tiers: tuple[int, ...], cache_parts: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    packer = Packer(context.partitionId() if context else 0, tiers)
    end, held = np.uint32(end_id).tobytes(), 0
    for doc_ids, _, found in encoded(batches, tokenizer, cache_parts):
        for doc_id, ids in zip(doc_ids, found, strict=True):
            held += packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if held >= BATCH_TOKENS:
            packer.pack()
            held = 0
        yield from packer.flush()
    packer.pack(final=True)
    yield from packer.flush()


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, cache_parts: int = CACHE_PARTS) -> DataFrame:
    """Pack all documents into sequences of the tiers' lengths, or of a smaller power of two at a partition's end.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset (in the sequence),
    tier (the sequence's length) and step_group. Each id of each row's text lies in exactly one piece, and offsets leave
    no gap. Step groups are numbered from 0 and hold about `step_tokens` tokens, whatever the tier.

    A null or empty text is the end id alone; a text of any length is cut into pieces. Null doc_ids stay null; rows that
    repeat a doc_id are packed separately. Of rests of one length, the one that came last is taken first. An empty table
    gives no rows; other columns are ignored, whatever their names. Sequence ids are unique; they depend on how the
    input is split into partitions. A smaller `cache_parts` takes less memory and more time.
    """
    if any(size & (size - 1) for size in tiers):
        raise ValueError("tiers must be powers of two")
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(lambda batches: _pack(batches, path, end_id, tuple(sorted(tiers)), cache_parts), SCHEMA), "pieces")
    sums = pieces.where("offset = 0").groupBy("part", "tier").agg(F.sum("tier").alias("tokens"))
    # a row for each task and tier: one task adds up what is far smaller than the pieces
    order = Window.orderBy(F.desc("tier"), "part")
    laid = written(sums.withColumn("base", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("tokens").over(Window.partitionBy())), "step-bases")
    groups = F.greatest(F.lit(1), F.round(F.col("total") / step_tokens).cast("long"))
    place = F.coalesce("base", F.lit(0)) + F.col("before")
    found = pieces.join(small(laid), ["part", "tier"]).withColumn("step_group", F.floor(place * groups / F.col("total")).cast("long"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
