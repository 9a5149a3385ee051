"""Token ids as binary files: a shared zstandard dictionary, one frame for each document, an offset index.

File format, all integers little-endian:

    4 bytes   magic "PLTK"
    u32       version, 1
    u64       number of documents n
    32 bytes  SHA-256 of the dictionary
    u64       length of the dictionary's frame, which follows the header
    i64[n]    document ids (the least value stands for null)
    u64[n]    numbers of ids
    u64[n+1]  offsets of the frames, from the beginning of the frames
    bytes     the frames: zstandard with the dictionary over unsigned 32-bit ids

The dictionary travels in each file, so a file can be read alone; its hash lets a reader keep one copy. A short
document is read by its offset without touching the others.

Documents are range-partitioned by id, and by a hash of the text among equal ids, and sorted. Each attempt of a task
writes files of its own names; the rows that it returns name them, and these rows are what counts: they are written as a
table, of which Spark keeps one attempt's part. Files that no row names are left over from an attempt that was lost and
aren't read into the result. Where a file's ids begin is a running sum over the files, not over documents.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import scratch_path, written

from .common import bounded_batches, bounded_sample
from .tokens import encoded, encoder, public_path

MAGIC, VERSION = b"PLTK", 1
HEAD = struct.Struct("<4sIQ32sQ")
NULL_ID = -(1 << 63)
#: Documents and bytes of text that the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_TEXT, DICTIONARY_BYTES = 1000, 20_000, 64 << 10
#: Bytes of text in a file, about.
FILE_TEXT_BYTES = 32 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary over serialized id arrays; with too little to learn from, their raw bytes."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\x00" * 8


def pack_file(doc_ids: list[int | None], ids: list[bytes], dictionary: bytes, frames: list[bytes]) -> bytes:
    """A file of the documents' frames."""
    import zstandard

    stored = zstandard.ZstdCompressor().compress(dictionary)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames], dtype=np.uint64))).astype("<u8")
    keys = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    counts = np.array([len(x) // 4 for x in ids], "<u8")
    head = HEAD.pack(MAGIC, VERSION, len(frames), hashlib.sha256(dictionary).digest(), len(stored))
    return b"".join([head, stored, keys.tobytes(), counts.tobytes(), offsets.tobytes(), *frames])


class TokenFile:
    """Reads the documents of a file's bytes, all or one by one."""

    def __init__(self, content: bytes):
        import zstandard

        magic, version, self.n, digest, stored = HEAD.unpack_from(content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of a known version")
        at = HEAD.size + stored
        dictionary = zstandard.ZstdDecompressor().decompress(content[HEAD.size : at])
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary doesn't have the hash in the header")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.doc_ids = np.frombuffer(content, "<i8", self.n, at)
        self.counts = np.frombuffer(content, "<u8", self.n, at + 8 * self.n)
        self.offsets = np.frombuffer(content, "<u8", self.n + 1, at + 16 * self.n)
        self.frames = memoryview(content)[at + 24 * self.n + 8 :]

    def ids(self, at: int) -> np.ndarray:
        """The ids of one document, by its place in the file."""
        frame = self.frames[int(self.offsets[at]) : int(self.offsets[at + 1])]
        raw = self.reader.decompress(frame, max_output_size=4 * int(self.counts[at])) if self.counts[at] else b""
        if len(raw) != 4 * int(self.counts[at]):
            raise ValueError("a frame doesn't hold the number of ids in the index")
        return np.frombuffer(raw, "<u4")


def _filesystem(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    import zstandard

    end = np.uint32(end_id).tobytes()
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    doc_ids: list[int | None] = []
    all_ids: list[bytes] = []
    frames: list[bytes] = []
    text_bytes = n_file = 0
    part, attempt = _partition(), uuid.uuid4().hex

    def finish() -> pa.RecordBatch:
        nonlocal text_bytes, n_file
        name = f"{part:08d}-{n_file:05d}-{attempt}.pltk"
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_{name}") as out:  # a reader never meets half a file
            out.write(pack_file(doc_ids, all_ids, dictionary, frames))
        system.move(f"{base}/_{name}", f"{base}/{name}")
        row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([n_file], pa.int64()), pa.array([sum(map(len, all_ids)) // 4], pa.int64())], names=["file", "part", "n_file", "n_ids"])
        doc_ids.clear(), all_ids.clear(), frames.clear()
        text_bytes, n_file = 0, n_file + 1
        return row

    for keys, texts, found in encoded(batches, tokenizer):
        for doc_id, text, ids in zip(keys, texts, found, strict=True):
            doc_ids.append(doc_id)
            all_ids.append(ids + end)
            frames.append(compressor.compress(all_ids[-1]))
            text_bytes += len(text)
        if text_bytes >= FILE_TEXT_BYTES:
            yield finish()
    if frames:
        yield finish()


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            found = TokenFile(content.as_buffer().to_pybytes())
            counts = found.counts.astype(np.int64)
            crcs = [zlib.crc32(found.ids(i).tobytes()) for i in range(found.n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path.rsplit("/", 1)[-1]] * found.n),
                    pa.array([None if x == NULL_ID else x for x in found.doc_ids.tolist()], pa.int64()),
                    pa.array(np.cumsum(counts) - counts),
                    pa.array(counts),
                    pa.array(crcs, pa.int64()),
                ],
                names=["file", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def sample_texts(docs: DataFrame) -> list[str]:
    """The texts that the dictionary is trained on: at most SAMPLE_DOCS, none longer than SAMPLE_TEXT characters."""
    rows = docs.where(F.length("text").between(1, SAMPLE_TEXT)).select("doc_id", "text")
    return [row.text for row in bounded_sample(rows, "doc_id", SAMPLE_DOCS).collect()]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents in ascending doc_id order; returns the files: name, part, n_file, n_ids, start."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(encoder(tokenizer).encode(sample_texts(rows)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("tie", F.xxhash64("text"))  # many rows of one id, or of none, don't end in one task
    ordered = tied.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    files = written(ordered.mapInArrow(lambda batches: _write(batches, folder, tokenizer, end_id, dictionary), "file string, part long, n_file long, n_ids long"), "token-files")
    # one row a file, so a single task for the running sum holds little however many documents there are
    before = Window.orderBy("part", "n_file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """The documents in the files: doc_id, start, n_tokens, ids_crc32."""
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.pltk").load(folder).select("path", "content")
    found = bodies.mapInArrow(_read, "file string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return found.join(files.select("file", F.col("start").alias("file_start")), "file").select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents as token files and read them back.

    Returns a row per document: doc_id, start (ids of all documents before it), n_tokens (with the end id) and
    ids_crc32. A null or empty text is the end id alone; a text of any length is one document. Null doc_ids come first;
    rows that repeat a doc_id stand next to each other, in the order of a hash of their texts. An empty table gives no
    rows; other columns are ignored, whatever their names. `folder` must be new or empty.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-binary")
    files = write_files(docs, folder, tokenizer or public_path("word_bpe_49k.json"), end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, folder, files)
