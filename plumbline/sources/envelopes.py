"""Event envelopes: schema, scan of append-only JSON lines, and payload columns parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = ("claude_code", "codex_cli", "cowork", "harness", "devin", "github")
KINDS = ("user_prompt", "assistant_message", "tool_call", "tool_result", "thinking", "attachment_ref", "session_start", "session_end", "agent_meta")

#: The envelope as it is stored; the payload stays JSON text, absent `v` reads as 1 and absent strings as "".
ENVELOPE = T.StructType(
    [
        T.StructField("v", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("rollup_dim", T.StringType()),
    ]
)

_USAGE = "struct<in:bigint,out:bigint,cache_read:bigint,cache_create:bigint>"
_TOTAL = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"
#: What the operators read of a payload. Nested values that may have any shape are kept as JSON text.
PAYLOAD = (
    "text string, preview string, model string, tool_use_id string, call_id string, name string, input string, arguments string, action string, "
    "content string, output string, is_error boolean, tool_name string, local_path string, source_system string, subtype string, event_kind string, "
    f"msg_id string, usage {_USAGE}, payload struct<info:struct<total_token_usage:{_TOTAL}>,turn_id:string,duration_ms:bigint>, turn_id string, duration_ms bigint, "
    "pr_url string, pr_repository string, pr_number bigint, cwd string, actor string, tracker_version string, campaign_id string, campaign_role string, "
    "backend string, reason string, parent_session_id string, child_session_id string"
)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Scan a folder of envelope lines; `file` and `ord` give the order of reading, malformed lines have `corrupt`."""
    schema = T.StructType([*ENVELOPE.fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = lines.select(parsed.alias("e"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    return rows.select("e.*", "file", "ord").withColumn("v", F.coalesce("v", F.lit(1)))


def well_formed(lines: DataFrame) -> DataFrame:
    """Envelopes of known version; the rest is counted by `malformed`."""
    return lines.where(F.col("corrupt").isNull() & (F.col("v") == 1))


def malformed(lines: DataFrame) -> DataFrame:
    """How many lines of each file aren't envelopes."""
    return lines.where(F.col("corrupt").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("malformed"))


def dedup_events(events: DataFrame, order: str = "ord") -> DataFrame:
    """First sighting of each event_id; events without one all pass."""
    key = F.when(F.coalesce("event_id", F.lit("")) != "", F.col("event_id")).otherwise(F.concat(F.lit("\0"), F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy("_sighted").orderBy(order)) == 1
    return events.withColumn("_sighted", key).withColumn("_first", first).where("_first").drop("_first", "_sighted")


def typed(events: DataFrame) -> DataFrame:
    """Envelopes with the payload parsed once into struct `p`, and derived time columns."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("day", F.substring("ts", 1, 10)).withColumn("ts_ms", epoch_ms(F.col("ts")))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of an RFC 3339 text; null if it can't be parsed."""
    return F.unix_millis(F.try_to_timestamp(ts))


def call_id(p: str = "p") -> Column:
    """The id that ties a call to its result."""
    return F.coalesce(F.col(f"{p}.tool_use_id"), F.col(f"{p}.call_id"), F.lit(""))
