"""Versioned Parquet tables with a pointer that is written last, and write-once stores."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = 1


def _filesystem(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, source, target) -> None:
    """Rename over what is there: a reader finds the old pointer or the new one at any time."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(source.makeQualified(source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())), target.makeQualified(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())), options)


def manifest(spark: SparkSession, paths: list[str], settings: str = "") -> str:
    """A digest of the files under some paths (path, size, time of change) and of settings: equal where nothing changed."""
    lines = [settings]
    for path in paths:
        root, system = _filesystem(spark, path)
        if not system.exists(root):
            continue
        if system.getFileStatus(root).isFile():
            lines.append(f"{path} {system.getFileStatus(root).getLen()} {system.getFileStatus(root).getModificationTime()}")
            continue
        files = system.listFiles(root, True)
        while files.hasNext():
            status = files.next()
            lines.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


def derive_if_changed(spark: SparkSession, root: str, inputs: list[str], settings: str, derive: Callable[[], dict[str, DataFrame]]) -> bool:
    """Publish a build unless the one at hand was derived from the same files and settings; says whether it was derived."""
    build = manifest(spark, inputs, settings)[:16]
    target, system = _filesystem(spark, f"{root}/current.json")
    if system.exists(target) and json.loads(spark.read.text(f"{root}/current.json").first()[0])["build"] == build:
        return False
    publish(spark, root, build, derive())
    return True


def build_identity(ordered: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One digest of a table's rows in order: those of blocks of rows, put together in their order."""
    blocks = ordered.select(F.floor(F.col(order) / 4096).alias("block"), F.col(order).alias("at"), F.sha2(F.concat_ws("\x00", *columns), 256).alias("digest"))
    each = blocks.groupBy("block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest"), F.count(F.lit(1)).alias("rows"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), ","), 256).alias("build"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def sync_caches(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each of two caches (key, hash, value) lacks: rows to add to the local one and to the remote one.

    Entries are what their key and hash say, so none is replaced. Empty values aren't worth keeping and aren't sent.
    """
    full = lambda t: t.where(F.coalesce("value", F.lit("")) != "")
    to_local = full(remote).join(local.select("key", "hash"), ["key", "hash"], "left_anti")
    to_remote = full(local).join(remote.select("key", "hash"), ["key", "hash"], "left_anti")
    return to_local.select("key", "hash", "value"), to_remote.select("key", "hash", "value")


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON lines: id, text and the fields of `meta`. A line that isn't one fails the read."""
    meta = "repo string, kind string, source string, session_id string, author string, ts string, state string, url string, number long, labels array<string>, campaign_id string, campaign_role string, capture_source string, agent_attr string"
    rows = spark.read.schema(f"id long, text string, meta struct<{meta.replace(' string', ': string').replace(' long', ': long').replace(' array', ': array')}>").option("mode", "FAILFAST").json(path)
    return rows.select("id", "text", "meta.*")


def line_chunks(lines: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Lines (stream, seq, line) put into chunks of at most so many bytes: stream, chunk, lines, bytes, body.

    A line is never cut; one that is longer than a chunk is a chunk of its own. Chunks hold the lines that begin in their
    range of bytes, so each is bounded by a chunk and a line, and is made without looking at the others.
    """
    size = F.octet_length("line") + 1
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("bytes", size.cast("long")).withColumn("end", F.sum("bytes").over(before))
    numbered = placed.withColumn("chunk", F.floor((F.col("end") - 1) / chunk_bytes).cast("long"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("stream", "chunk").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.concat(body, F.lit("\n")).alias("body"))


def read_partitioned(spark: SparkSession, path: str, streams: list[str] | None = None, since_day: str = "", until_day: str = "") -> DataFrame:
    """Events stored by day and stream; streams and days are partition values, so other files aren't opened."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string"))
    if streams:
        rows = rows.where(F.col("stream").isin(*streams))
    if since_day:
        rows = rows.where(F.col("day") >= since_day)
    return rows.where(F.col("day") <= until_day) if until_day else rows


def stale(spark: SparkSession, inputs: str, pointer: str, slack_s: int = 60) -> bool:
    """Whether some input file changed more than `slack_s` seconds after the pointer was written."""
    root, system = _filesystem(spark, inputs)
    target, there = _filesystem(spark, pointer)
    if not there.exists(target) or not system.exists(root):
        return there.exists(target) is False
    newest, files = 0, system.listFiles(root, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest > there.getFileStatus(target).getModificationTime() + 1000 * slack_s


def publish(spark: SparkSession, root: str, build: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a build, then point to it; readers never see a part of a build."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/builds/{build}/{name}")
    pointer = json.dumps({"build": build, "format": FORMAT, "tables": sorted(tables)})
    temporary, system = _filesystem(spark, f"{root}/_current.{build}.tmp")
    out = system.create(temporary, True)
    out.write(bytearray(pointer.encode()))
    out.close()
    target, _ = _filesystem(spark, f"{root}/current.json")
    _replace(spark, temporary, target)


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the build that is pointed to."""
    pointer = json.loads(spark.read.text(f"{root}/current.json").first()[0])
    if pointer["format"] != FORMAT:
        raise ValueError(f"unknown format {pointer['format']}")
    return {name: spark.read.parquet(f"{root}/builds/{pointer['build']}/{name}") for name in pointer["tables"]}


def append_new(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Append rows whose key isn't stored yet: what is written once stays."""
    target, system = _filesystem(spark, path)
    fresh = rows.dropDuplicates([key])
    if system.exists(target):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def partitioned_events(events: DataFrame, path: str) -> None:
    """Events by day of the event and stream, so that windows of days and machines prune files."""
    events.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day", "stream").parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests and issues from JSON arrays, one file a repository and kind, named <repo>__<kind>.json."""
    schema = "number long, title string, body string, state string, url string, createdAt string, author struct<login:string>, labels array<struct<name:string>>, additions long, deletions long, mergedAt string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    name = F.col("_metadata.file_name")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    shaped = rows.select(
        F.regexp_extract(name, r"^(.+)__[^_]+\.json$", 1).alias("repo"), F.regexp_extract(name, r"__([^_]+)\.json$", 1).alias("kind"), "number", text.alias("text"), "state", "url", F.col("createdAt").alias("created"),
        F.coalesce("author.login", F.lit("")).alias("author"), F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"), "additions", "deletions", F.substring("mergedAt", 1, 10).alias("merged_day"),
    )
    return shaped.where(F.length(F.regexp_replace("text", r"\s+", "")) > 0)
