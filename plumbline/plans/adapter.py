"""The driver's tables as envelopes, in SQL that both Spark and DuckDB read.

`conversations` become the messages of sessions, `events` their calls, results, usage records and markers. Every 97th
event is delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import scratch_path
from plumbline.sources.envelopes import dedup_events, typed
from plumbline.sources.tables import manifest

ENVELOPES_SQL = """
SELECT event_id, stream, seq, ts, source, session_id, kind, payload, ord FROM (
SELECT 'c' || conv_id || '-' || turn AS event_id,
       'edge-box-' || (conv_id % 7) || '-' || CASE conv_id % 3 WHEN 0 THEN 'claudecode' WHEN 1 THEN 'codex' ELSE 'cowork' END AS stream,
       CAST(conv_id * 100 + turn AS BIGINT) AS seq,
       CAST(DATE '2024-01-01' + CAST(floor(conv_id % 700 / 24) AS INT) AS STRING) || 'T' || lpad(CAST(conv_id % 24 AS STRING), 2, '0') || ':' ||
           lpad(CAST(turn % 60 AS STRING), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS STRING), 2, '0') || 'Z' AS ts,
       CASE conv_id % 3 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex_cli' ELSE 'cowork' END AS source,
       'c' || conv_id AS session_id,
       CASE role WHEN 'user' THEN 'user_prompt' WHEN 'assistant' THEN 'assistant_message' ELSE 'session_start' END AS kind,
       CASE WHEN role = 'system' THEN '{"cwd":"/w/NATION_' || (conv_id % 25) || '-fix/src","actor":"Customer#' || lpad(CAST(conv_id AS STRING), 9, '0') || '","tracker_version":"1.' || (conv_id % 4) || '","campaign_id":"camp' || (conv_id % 3) || '","campaign_role":"' || CASE conv_id % 2 WHEN 0 THEN 'writer' ELSE 'reviewer' END || '"}'
            ELSE '{"text":"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '","model":"model-' || (conv_id % 3) || '"}' END AS payload,
       CAST(conv_id * 100 + turn AS BIGINT) AS ord
FROM {conversations}
UNION ALL
SELECT 'e' || event_id AS event_id,
       'edge-dev-' || (user_id % 9) || '-' || CASE user_id % 4 WHEN 0 THEN 'claudecode' WHEN 1 THEN 'codex' WHEN 2 THEN 'cowork' ELSE 'harness' END AS stream,
       event_id AS seq,
       replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' AS ts,
       CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex_cli' WHEN 2 THEN 'cowork' ELSE 'harness_x' END AS source,
       'u' || user_id || '-' || substr(CAST(ts AS STRING), 1, 10) AS session_id,
       CASE event_type
            WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'error' THEN 'tool_result' WHEN 'purchase' THEN 'agent_meta'
            ELSE CASE WHEN k % 4 = 0 THEN 'session_start' WHEN k % 20 = 7 THEN 'attachment_ref' WHEN k % 20 = 3 THEN 'agent_meta' ELSE 'user_prompt' END END AS kind,
       CASE event_type
            WHEN 'click' THEN CASE WHEN user_id % 4 = 1
                THEN '{"call_id":"t' || (k % 3) || '","name":"' || CASE WHEN k % 2 = 0 THEN 'exec_command' ELSE 'write_stdin' END || '","arguments":"{\\"cmd\\":\\"make step-' || k || '\\",\\"session_id\\":' || (k % 2) || ',\\"chars\\":\\"' || CASE WHEN k % 5 = 0 THEN 'y' ELSE '' END || '\\"}"}'
                ELSE '{"tool_use_id":"t' || (k % 3) || '","name":"' || CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Bash' ELSE 'Grep' END || '","input":{"file_path":"/w/NATION_' || (k % 25) || '/src/f' || (k % 9) || '.py","limit":' || (k % 4) || '}}' END
            WHEN 'view' THEN CASE WHEN user_id % 4 = 1
                THEN '{"call_id":"t' || (k % 3) || '","output":"Wall time: ' || (k % 7) || '.5 seconds Process ' || CASE WHEN k % 3 = 0 THEN 'exited with code 0 Output: done ' || k ELSE 'running with session ID ' || (k % 2) END || '"}'
                ELSE '{"tool_use_id":"t' || (k % 3) || '","content":"line ' || k || ' Exit code ' || (k % 2) || '","is_error":false}' END
            WHEN 'error' THEN CASE WHEN user_id % 4 = 1
                THEN '{"call_id":"t' || (k % 3) || '","output":"' || CASE k % 3 WHEN 0 THEN 'write_stdin failed: closed' WHEN 1 THEN 'Process exited with code -2' ELSE 'aborted by user' END || '"}'
                ELSE '{"tool_use_id":"t' || (k % 3) || '","content":"failed ' || k || '","is_error":true}' END
            WHEN 'purchase' THEN CASE
                WHEN user_id % 4 = 1 AND k % 3 = 0 THEN '{"subtype":"event_msg","event_kind":"token_count","payload":{"info":{"total_token_usage":{"input_tokens":' || (event_id + 50) || ',"cached_input_tokens":' || (event_id % 900) || ',"output_tokens":' || k || '}}}}'
                WHEN user_id % 4 = 1 AND k % 3 = 1 THEN '{"subtype":"event_msg","event_kind":"task_started","turn_id":"turn-' || event_id || '"}'
                WHEN user_id % 4 = 1 AND k % 6 = 2 THEN '{"subtype":"event_msg","event_kind":"task_complete","duration_ms":' || (k * 100) || '}'
                WHEN user_id % 4 = 1 THEN '{"subtype":"event_msg","event_kind":"turn_aborted"}'
                WHEN k % 4 = 0 THEN '{"subtype":"turn_duration","duration_ms":' || (k * 50) || '}'
                ELSE '{"subtype":"usage","msg_id":"m' || (event_id % 400) || '","model":"model-' || (k % 3) || '","usage":{"in":' || k || ',"out":' || (k % 11) || ',"cache_read":' || (k * 3) || ',"cache_create":' || (k % 5) || '}}' END
            ELSE CASE
                WHEN k % 4 = 0 THEN '{"cwd":"/w/NATION_' || (k % 25) || '-side/src","actor":"Customer#' || lpad(CAST(user_id AS STRING), 9, '0') || '","tracker_version":"1.' || (k % 4) || '","campaign_id":"camp' || (k % 3) || '","campaign_role":"writer"}'
                WHEN k % 20 = 7 THEN '{"tool_name":"Edit","local_path":"/w/NATION_' || (k % 25) || '/src/mod/f' || (k % 9) || '.py"}'
                WHEN k % 20 = 3 THEN '{"subtype":"pr_link","pr_url":"https://host.example/o/NATION_' || (k % 25) || '/pull/' || k || '"}'
                WHEN k % 10 = 1 THEN '{"text":"<system-reminder> tidy up ' || k || '"}'
                ELSE '{"text":"please make the cart total round half up, case ' || k || '"}' END END AS payload,
       10000000 + event_id AS ord
FROM (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) x
UNION ALL
SELECT 'e' || event_id AS event_id, 'edge-dev-' || (user_id % 9) || '-codex' AS stream, event_id AS seq,
       replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' AS ts, 'codex_cli' AS source, 'dup' AS session_id, 'user_prompt' AS kind,
       '{"text":"this event was delivered twice"}' AS payload, 900000000 + event_id AS ord
FROM {events} WHERE event_id % 97 = 0
) y
"""


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's tables as envelopes, with the events that came twice."""
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("conversations", "events")}
    # the template's braces are JSON: only the two table names are filled in
    for name, frame in read.items():
        frame.createOrReplaceTempView(f"plumbline_{name}")
    return spark.sql(_escaped(ENVELOPES_SQL.replace("{conversations}", "plumbline_conversations").replace("{events}", "plumbline_events")))


def _escaped(sql: str) -> str:
    """Spark reads backslashes in string literals as escapes."""
    return sql.replace("\\", "\\\\")


#: Event stores of this process by application and state of the inputs.
_stores: dict[tuple[str, str], tuple[str, StructType]] = {}


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes, each event once, with parsed payloads, from a store that is derived once for each state of the inputs.

    The store is partitioned by day, so that windows of time read their days alone, and holds payloads as columns, of
    which a query reads those it names.
    """
    key = (spark.sparkContext.applicationId, manifest(spark, [f"{sf_dir}/conversations.parquet", f"{sf_dir}/events.parquet"]))
    if key not in _stores:
        rows = typed(dedup_events(raw_envelopes(spark, sf_dir)))
        path = scratch_path(spark, "events")
        rows.repartition("day", F.pmod(F.xxhash64("session_id"), F.lit(4))).write.partitionBy("day").parquet(path)
        _stores[key] = (path, rows.schema)
    path, schema = _stores[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def duck_envelopes() -> str:
    """The same for DuckDB."""
    return ENVELOPES_SQL.replace("{conversations}", "conversations").replace("{events}", "events")
