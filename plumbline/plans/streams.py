"""Queries that run a stream over what is there and read its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.activity import SINCE, _ev
from plumbline.plans.adapter import duck_envelopes, envelopes, raw_envelopes
from plumbline.session import scratch_path
from plumbline.sources.envelopes import ENVELOPE
from plumbline.streaming import ingest


def _landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "landing")
    rows = raw_envelopes(spark, sf_dir).withColumns({"v": F.lit(1), "rollup_dim": F.lit("")})
    # the payload is an object in the lines and JSON text in the schema
    rows.select(*[F.col(f.name) for f in ENVELOPE.fields]).write.json(path)
    return path


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as records of files, one a stream, of which the starts alone name the session."""
    rows = ingest.stream_envelopes(spark, _landed(spark, sf_dir))
    named = F.when(F.col("kind") == "session_start", F.concat(F.lit("S"), "stream"))
    return rows.select(F.col("stream").alias("file"), F.col("seq").alias("offset"), "kind", named.alias("session_id"))


def _last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "ord")
    return envelopes(spark, sf_dir).where("session_id <> ''").groupBy("session_id").agg(*[F.max_by(c, order).alias(c) for c in ("stream", "source", "ts", "seq")])


def _result(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    ingest.append_to(stream, path, scratch_path(spark, f"{label}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_dedup": lambda s, d: _result(ingest.deduplicated(ingest.stream_envelopes(s, _landed(s, d)), None), "stream-dedup").select("event_id"),
    "stream_boundary": lambda s, d: _result(ingest.staged_boundary(ingest.stream_envelopes(s, _landed(s, d)).where("session_id <> 'dup'"), SINCE), "stream-boundary").groupBy("session_id").agg(F.count(F.lit(1)).alias("events")),
    "stream_idle_ends": lambda s, d: _result(ingest.idle_ends(ingest.stream_envelopes(s, _landed(s, d))), "stream-idle"),
    "stream_starts": lambda s, d: _result(ingest.first_starts(ingest.stream_envelopes(s, _landed(s, d)).where("session_id <> 'dup'")), "stream-starts").groupBy("session_id").agg(F.count_if(F.col("kind") == "session_start").alias("starts"), F.count_if(F.col("kind") != "session_start").alias("others")),
    "stream_files": lambda s, d: _result(ingest.with_file_session(_records(s, d)), "stream-files").groupBy("session_id").agg(F.count(F.lit(1)).alias("records")),
    "session_ends": lambda s, d: ingest.session_ends(_last_events(s, d), 1_705_000_000_000).select("session_id", "ts", "kind", "payload"),
    "session_ends_at_shutdown": lambda s, d: ingest.session_ends(_last_events(s, d), None, role="writer").select("session_id", "payload", "stream", "seq"),
}

ORACLES: dict[str, str] = {
    "stream_starts": _ev("SELECT session_id, least(count(*) FILTER (kind = 'session_start'), 1) AS starts, count(*) FILTER (kind <> 'session_start') AS others FROM raw WHERE session_id <> 'dup' GROUP BY 1"),
    "stream_files": _ev("SELECT 'S' || stream AS session_id, count(*) AS records FROM raw WHERE stream IN (SELECT stream FROM raw WHERE kind = 'session_start') GROUP BY 1"),
    "session_ends": _ev("SELECT session_id, max(ts) AS ts, 'session_end' AS kind, '{\"reason\":\"idle\"}' AS payload FROM e WHERE session_id <> '' GROUP BY 1 HAVING 1705000000000 - max(ts_ms) > 600000"),
    "session_ends_at_shutdown": _ev("SELECT session_id, '{\"reason\":\"shutdown\",\"campaign_role\":\"writer\"}' AS payload, stream, seq + row_number() OVER (PARTITION BY stream ORDER BY session_id) AS seq FROM (SELECT session_id, arg_max(stream, (ts, ord)) AS stream, arg_max(seq, (ts, ord)) AS seq FROM e WHERE session_id <> '' GROUP BY 1)"),
    "stream_dedup": "SELECT DISTINCT event_id FROM (" + duck_envelopes() + ")",
    "stream_boundary": _ev(f"""SELECT session_id, count(*) + max(staged) AS events FROM (
        SELECT session_id, ts, CASE WHEN max(CASE WHEN kind = 'session_start' AND ts < '{SINCE}' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) = 1 THEN 1 ELSE 0 END AS staged FROM e) WHERE ts >= '{SINCE}' GROUP BY session_id"""),
}
