"""Native agent logs as envelopes.

Lines are decoded one by one into records by the rules below; what depends on more than one line - a file's session id, the
first record of a session, lifecycle lines before a conversation - is done by windows over the decoded records.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.ids import ulid
from plumbline.functions.redaction import redacted_text

DECODED = "file string, offset long, sub int, ts_ms long, ts string, session_id string, kind string, payload string, lifecycle boolean"
FILE_TOOLS = frozenset(("Write", "Edit", "MultiEdit", "NotebookEdit"))
TASK_FILE_TOOLS = frozenset(("apply_patch", "read_file", "write_file", "edit_file"))
#: Lifecycle lines of a session before its first message; with more than that it is a heartbeat until one comes.
HEARTBEAT_LINES = 200

Item = tuple[str, dict[str, Any]]


def resolved(ts: str, fallback_ms: int) -> tuple[int, str]:
    """Milliseconds and UTC text of an RFC 3339 time, or of the fallback."""
    try:
        moment = dt.datetime.fromisoformat(ts)
        if moment.tzinfo is None:
            raise ValueError(ts)
    except ValueError:
        moment = dt.datetime.fromtimestamp(fallback_ms / 1000, dt.UTC)
    moment = moment.astimezone(dt.UTC)
    ms = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)
    return ms, moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def preview(text: str) -> str:
    """The first 200 characters."""
    return text if len(text) <= 200 else text[:200] + "…"


def said(text: str, **more: Any) -> dict[str, Any]:
    """A message's payload."""
    return {"text": text, "preview": preview(text), **more}


def _text(value: Any) -> str:
    return value if isinstance(value, str) else ""


def _texts(parts: Any) -> str:
    return "\n\n".join(t for t in (_text(p.get("text")) for p in parts if isinstance(p, dict)) if t) if isinstance(parts, list) else ""


def _path(values: Any, keys: tuple[str, ...]) -> str:
    return next((values[k] for k in keys if isinstance(values.get(k), str) and values[k]), "") if isinstance(values, dict) else ""


def user_blocks(content: Any, meta: bool = False) -> Iterator[Item]:
    """A user record's content: a text is a prompt, each result block a result, each other block a prompt."""
    kind, extra = ("agent_meta", {"subtype": "user_meta"}) if meta else ("user_prompt", {})
    if isinstance(content, str):
        yield kind, said(content, **extra)
    for block in content if isinstance(content, list) else ():
        if block.get("type") == "tool_result":
            yield "tool_result", {"tool_use_id": _text(block.get("tool_use_id")), "content": block.get("content"), "is_error": block.get("is_error") is True}
        else:
            yield kind, said(_text(block.get("text")), **extra)


def assistant_blocks(content: Any, model: str, prefix: str) -> Iterator[Item]:
    """An assistant record's content: thoughts and calls by themselves, files that calls touch, all text as one message."""
    chunks = []
    for block in content if isinstance(content, list) else ():
        kind = block.get("type")
        if kind == "text" and isinstance(block.get("text"), str):
            chunks.append(block["text"])
        elif kind == "thinking":
            yield "thinking", said(_text(block.get("thinking")))
        elif kind == "tool_use":
            name, call, given = _text(block.get("name")), _text(block.get("id")), block.get("input")
            yield "tool_call", {"tool_use_id": call, "name": name, "input": given}
            path = _path(given, ("file_path", "notebook_path", "path", "target_file"))
            if name in FILE_TOOLS and path:
                yield "attachment_ref", {"tool_use_id": call, "tool_name": name, "local_path": path, "source_system": f"{prefix}_{name.lower()}"}
    if chunks:
        yield "assistant_message", said("\n\n".join(chunks), model=model)


#: Records that become one item: type -> subtype and the fields that are taken along, by their names in the log.
_CLAUDE_META = {
    "permission-mode": ("permission_mode", {"permission_mode": "permissionMode"}),
    "last-prompt": ("last_prompt", {"last_prompt": "lastPrompt"}),
    "file-history-snapshot": ("file_history_snapshot", {"message_id": "messageId", "is_snapshot_update": "isSnapshotUpdate"}),
    "pr-link": ("pr_link", {"pr_number": "prNumber", "pr_repository": "prRepository", "pr_url": "prUrl"}),
}


def claude_items(record: dict[str, Any]) -> tuple[str, list[Item]]:
    """The session and items of a line of the first native format."""
    kind, session, message = record["type"], _text(record.get("sessionId")), record.get("message") or {}
    items: list[Item] = []
    if record.get("isSidechain") and record.get("agentId"):
        parent, session = session, f"agent-{record['agentId']}"
        items.append(("agent_meta", {"subtype": "subagent_parent", "parent_session_id": parent, "child_session_id": session, "agent_id": record["agentId"]}))
    items.append(("session_start", {"session_id": session, "version": _text(record.get("version")), "cwd": _text(record.get("cwd")), "git_branch": _text(record.get("gitBranch")), "entrypoint": _text(record.get("entrypoint"))}))
    if kind == "user":
        items += user_blocks(message.get("content"), record.get("isMeta") is True)
    elif kind == "assistant":
        model = _text(message.get("model"))
        items += assistant_blocks(message.get("content"), model, "claudecode")
        usage = message.get("usage")
        if isinstance(usage, dict):
            names = {"in": "input_tokens", "out": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_create": "cache_creation_input_tokens"}
            items.append(("agent_meta", {"subtype": "usage", "msg_id": _text(message.get("id")), "model": model, "usage": {k: usage.get(v) or 0 for k, v in names.items()}}))
    elif kind == "attachment":
        items.append(("attachment_ref", {"attachment": record.get("attachment"), "uuid": _text(record.get("uuid")), "cwd": _text(record.get("cwd"))}))
    elif kind == "system":
        items.append(("agent_meta", {"subtype": _text(record.get("subtype")), "message_count": record.get("messageCount") or 0, "duration_ms": record.get("durationMs") or 0}))
    else:
        subtype, fields = _CLAUDE_META.get(kind, (kind, {}))
        items.append(("agent_meta", {"subtype": subtype, **{k: record.get(v) for k, v in fields.items()}}))
    return session, items


def codex_items(record: dict[str, Any]) -> tuple[str, list[Item]]:
    """The items of a line of the second format; the session is the file's."""
    kind, p = record["type"], record.get("payload") or {}
    inner = _text(p.get("type"))
    if kind == "session_meta":
        return "", [("session_start", {"session_id": _text(p.get("id")), **{k: _text(p.get(k)) for k in ("cli_version", "cwd", "originator", "source")}})]
    if kind == "event_msg":
        return "", [("agent_meta", {"subtype": "event_msg", "event_kind": inner, "payload": p})]
    if kind != "response_item":
        return "", [("agent_meta", {"subtype": kind, "payload": p})]
    call = {"name": _text(p.get("name")), "call_id": _text(p.get("call_id"))}
    if inner == "message":
        role, text = _text(p.get("role")), _texts(p.get("content"))
        kinds = {"user": "user_prompt", "assistant": "assistant_message"}
        return "", [(kinds[role], said(text, role=role)) if role in kinds else ("agent_meta", {"subtype": f"message_{role}", **said(text)})]
    if inner == "reasoning":
        return "", [("thinking", said(_texts(p.get("summary")) or _texts(p.get("content"))))]
    if inner == "function_call":
        arguments = _text(p.get("arguments"))
        items: list[Item] = [("tool_call", {**call, "arguments": arguments})]
        try:
            path = _path(json.loads(arguments), ("path", "file_path", "target_file", "filename"))
        except ValueError:
            path = ""
        if path and call["name"] in TASK_FILE_TOOLS:
            items.append(("attachment_ref", {"call_id": call["call_id"], "tool_name": call["name"], "local_path": path, "source_system": f"codex_{call['name']}"}))
        return "", items
    if inner == "custom_tool_call":
        return "", [("tool_call", {**call, "input": p.get("input"), "status": _text(p.get("status")), "variant": "custom"})]
    if inner in ("function_call_output", "custom_tool_call_output"):
        return "", [("tool_result", {"call_id": call["call_id"], "output": _text(p.get("output")), **({"variant": "custom"} if inner.startswith("custom") else {})})]
    if inner == "web_search_call":
        return "", [("tool_call", {"name": "web_search", "action": p.get("action"), "status": _text(p.get("status"))})]
    return "", [("agent_meta", {"subtype": f"response_item:{inner}", "payload": p})]


def cowork_items(record: dict[str, Any]) -> tuple[str, list[Item]]:
    """The session and items of a line of the third format."""
    kind, session, message = record["type"], _text(record.get("session_id")), record.get("message") or {}
    start = ("session_start", {"session_id": session, "version": "v1", "client_platform": _text(record.get("client_platform")), "parent_tool_use_id": _text(record.get("parent_tool_use_id"))})
    if kind == "user":
        return session, [start, *user_blocks(message.get("content"))]
    if kind == "assistant":
        return session, [start, *assistant_blocks(message.get("content"), _text(message.get("model")), "cowork")]
    fields = {
        "system": {"subtype": "cowork_" + (_text(record.get("subtype")) or "system"), **{k: _text(record.get(v)) for k, v in (("cwd", "cwd"), ("model", "model"), ("claude_code_version", "claude_code_version"), ("permission_mode", "permissionMode"))}},
        "result": {"subtype": "cowork_result", "status": _text(record.get("subtype")) or _text(record.get("status")), "result": record.get("result")},
        "rate_limit_event": {"subtype": "cowork_rate_limit"},
        "queue-operation": {"subtype": "cowork_queue", "operation": _text(record.get("operation")), "preview": preview(_text(record.get("content")))},
    }
    return session, [start, ("agent_meta", fields.get(kind, {"subtype": kind}))]


FORMATS: dict[str, tuple[str, Callable[[dict[str, Any]], tuple[str, list[Item]]]]] = {"claude_code": ("claudecode", claude_items), "codex_cli": ("codex", codex_items), "cowork": ("cowork", cowork_items)}


#: Lines at the head of a file that tell its version.
HEAD_LINES = {"claude_code": 50, "codex_cli": 20, "cowork": 50}


def version_of(source: str, lines: list[bytes]) -> str:
    """The version that a file's first lines name; empty if none does."""
    for line in lines[: HEAD_LINES[source]]:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if not isinstance(record, dict):
            continue
        if source == "codex_cli":
            if record.get("type") == "session_meta":
                return _text((record.get("payload") or {}).get("cli_version"))
        elif source == "cowork":
            if _text(record.get("_audit_hmac")):
                return "v1"
        elif _text(record.get("version")):
            return record["version"]
    return ""


def supported(source: str, version: str) -> bool:
    """Whether a version's records are known; others are left alone rather than guessed at."""
    if source == "claude_code":
        return version == "2.1" or version.startswith("2.1.")
    if source == "codex_cli":
        return version == "" or version.startswith("0.")
    return version == "v1"


def _rows(content: bytes, source: str, file: str, mtime: int) -> Iterator[tuple]:
    """The decoded records of a file's whole lines; what follows the last line break isn't a whole line yet."""
    _, decode = FORMATS[source]
    offset = 0
    for line in content.split(b"\n")[:-1]:
        at, offset = offset, offset + len(line) + 1
        if not line.strip():
            continue
        try:
            record = json.loads(line)
            if not isinstance(record, dict) or not _text(record.get("type")):
                raise ValueError("no type")
            session, items = decode(record)
        except (ValueError, AttributeError, TypeError):
            yield (file, at, 0, None, None, None, "malformed", None, None)
            continue
        ms, ts = resolved(_text(record.get("_audit_timestamp")) or _text(record.get("timestamp")), mtime)
        life = record["type"] not in ("user", "assistant")
        for i, (kind, payload) in enumerate(items):
            yield (file, at, i, ms, ts, session, kind, json.dumps(payload, separators=(",", ":"), ensure_ascii=False), life)


#: Decoded records that leave a task at once, and cursors of files that are broadcast.
BLOCK, BROADCAST_FILES = 5000, 100_000


def _decode(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    names = [c.split()[0] for c in DECODED.split(", ")]
    for batch in batches:
        for file, content, mtime in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
            if not supported(source, version_of(source, content.split(b"\n", HEAD_LINES[source])[: HEAD_LINES[source]])):
                continue
            rows = _rows(content, source, file, mtime)
            while block := list(islice(rows, BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), kinds, strict=True)], names=names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.unix_millis("modificationTime").alias("mtime"))


def detect_versions(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The version of each file of a folder of logs and whether it is known: file, version, supported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [version_of(source, content.split(b"\n", HEAD_LINES[source])[: HEAD_LINES[source]]) for content in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string()), pa.array([supported(source, v) for v in found], pa.bool_())], names=["file", "version", "supported"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "file string, version string, supported boolean")


def numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows of files with a sequence from 0 on within each stream: files by name, then the order within a file.

    A file's rows are numbered by themselves; what stands before a file is a sum over files.
    """
    sizes = rows.groupBy("stream", "file").agg(F.count(F.lit(1)).alias("n"))
    # a row a file: one task for a stream's files, not for its rows
    before = sizes.select("stream", "file", F.coalesce(F.sum("n").over(Window.partitionBy("stream").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("stream", "file").orderBy(*order))
    return rows.withColumn("nth", nth).join(before, ["stream", "file"]).withColumn("seq", F.col("before") + F.col("nth") - 1).drop("nth", "before")


def read_native(spark: SparkSession, path: str, source: str, machine: str) -> DataFrame:
    """Envelopes of a folder of native logs of one source; malformed lines and files of unknown versions are left out.

    A file's bytes are one row, and its records leave the task in blocks; lines without a time take the file's.
    """
    suffix, _ = FORMATS[source]
    rows = _files(spark, path).mapInArrow(lambda batches: _decode(batches, source), DECODED).where("kind <> 'malformed'")
    place = ("file", "offset", "sub")
    if source == "codex_cli":
        metas = rows.where("kind = 'session_start'").groupBy("file").agg(F.min_by(F.get_json_object("payload", "$.session_id"), F.struct("offset", "sub")).alias("own"))
        rows = rows.join(metas, "file", "left").withColumn("session_id", F.coalesce("own", F.lit(""))).drop("own")
    if source == "cowork":
        session = Window.partitionBy("session_id")
        lines = rows.select("session_id", "file", "offset", "lifecycle").distinct()
        first = lines.withColumn("first_real", F.min(F.when(~F.col("lifecycle"), F.struct("file", "offset"))).over(session))
        early = first.withColumn("early", F.struct("file", "offset") < F.col("first_real")).withColumn("early_lines", F.sum(F.col("early").cast("int")).over(session))
        kept = early.where(F.col("first_real").isNotNull() & (~F.col("early") | (F.col("early_lines") <= HEARTBEAT_LINES))).select("session_id", "file", "offset")
        rows = rows.join(kept, ["session_id", "file", "offset"], "left_semi").unionByName(rows.where("session_id = ''"))
    # one start for a session and one parent edge for a file: the first of each stays
    once = F.row_number().over(Window.partitionBy("session_id", "kind", F.get_json_object("payload", "$.subtype")).orderBy(*place))
    single = (F.col("kind") == "session_start") | F.coalesce(F.get_json_object("payload", "$.subtype") == "subagent_parent", F.lit(False))
    kept_rows = rows.where(~single).unionByName(rows.where(single & (F.col("session_id") != "")).withColumn("_n", once).where("_n = 1").drop("_n"))
    event_id = ulid(F.col("ts_ms"), F.concat_ws("\0", F.lit(suffix), "file", F.col("offset").cast("string"), F.col("sub").cast("string")))
    stamped = kept_rows.withColumn("stream", F.lit(f"edge-{machine}-{suffix}"))
    return numbered(stamped, ("offset", "sub")).select(F.lit(1).alias("v"), event_id.alias("event_id"), "stream", "seq", "ts", F.lit(source).alias("source"), "session_id", "kind", "payload", F.lit("").alias("rollup_dim"), "file", "sub")


_DEVIN_KINDS = {"user": "user_prompt", "user_message": "user_prompt", "prompt": "user_prompt", "assistant": "assistant_message", "assistant_message": "assistant_message", "message": "assistant_message", "tool_call": "tool_call", "tool_start": "tool_call", "tool_result": "tool_result", "tool_end": "tool_result", "thinking": "thinking", "reasoning": "thinking"}


def import_lines(lines: DataFrame, form: str, source: str, stream: str, campaign: str = "", role: str = "", actor: str = "") -> tuple[DataFrame, DataFrame]:
    """Foreign event lines (`line`, `n`) as envelopes, and the rejected ones with a reason. Forms: envelope, harness, devin.

    A campaign, role or actor that is given replaces what the lines say. Rejected lines are redacted before they are kept.
    """
    field = lambda *names: F.coalesce(*[F.when(F.get_json_object("line", f"$.{n}") != "", F.get_json_object("line", f"$.{n}")) for n in names])
    ts, session = field("ts", "timestamp", "created_at", "createdAt"), field("session_id", "sessionId")
    kind = field("kind", "type") if form == "devin" else field("kind")
    given = F.coalesce(F.from_json(F.get_json_object("line", "$.payload"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    if form == "harness":
        extra = F.map_filter(F.create_map(*[x for to, name in (("harness_run_id", "run_id"), ("campaign_id", "campaign_id"), ("campaign_role", "role"), ("backend", "backend"), ("repo", "repo"), ("candidate_sha", "candidate_sha")) for x in (F.lit(to), field(name))]), lambda k, v: v.isNotNull())
    elif form == "devin":
        extra = F.map_filter(F.create_map(F.lit("text"), F.when(~F.map_contains_key(given, "text"), field("text", "content", "message")), F.lit("devin_event_id"), field("event_id", "eventId", "id"), F.lit("repo"), field("repo", "repository")), lambda k, v: v.isNotNull())
        kinds = F.create_map(*[F.lit(x) for pair in _DEVIN_KINDS.items() for x in pair])
        kind = F.coalesce(F.try_element_at(kinds, F.coalesce(kind, F.lit(""))), F.lit("agent_meta"))
    else:
        extra = F.create_map().cast("map<string,string>")
    stamps = {"campaign_id": campaign, "campaign_role": role, "actor": actor}
    extra = F.map_concat(F.map_filter(extra, lambda k, v: ~k.isin([name for name, value in stamps.items() if value])), *[F.create_map(F.lit(name), F.lit(value)) for name, value in stamps.items() if value])
    merged = F.map_concat(F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)
    reason = (
        F.when(F.try_parse_json("line").isNull(), "not JSON")
        .when(F.lit(form == "envelope") & (F.coalesce(F.get_json_object("line", "$.v"), F.lit("1")) != "1"), "unsupported envelope version")
        .when(ts.isNull(), "missing ts").when(session.isNull(), "missing session_id").when(kind.isNull(), "missing kind").when(F.try_to_timestamp(ts).isNull(), "bad ts")
    )
    rows = lines.withColumns({"reason": reason, "ts": ts, "session_id": session, "kind": kind, "payload": F.to_json(merged) if form != "envelope" else F.get_json_object("line", "$.payload"), "foreign": field("event_id", "eventId", "id")})
    identity = F.when(F.col("foreign").isNotNull() & F.lit(form == "devin"), F.concat(F.lit(f"{source}\0foreign\0"), "foreign")).otherwise(F.concat_ws("\0", F.lit(source), "session_id", "kind", "payload"))
    minted = ulid(F.unix_millis(F.try_to_timestamp("ts")), identity)
    good = rows.where("reason IS NULL").select(F.lit(1).alias("v"), (minted if form == "devin" else F.coalesce("foreign", minted)).alias("event_id"), F.lit(stream).alias("stream"), F.col("n").alias("seq"), "ts", F.lit(source).alias("source"), "session_id", "kind", "payload", F.coalesce(F.get_json_object("payload", "$.campaign_id"), F.lit("")).alias("rollup_dim"))
    return good, rows.where("reason IS NOT NULL").select("n", "reason", redacted_text(F.col("line")).alias("line"))


def with_starts(events: DataFrame, actor: str = "") -> DataFrame:
    """Imported events with a synthetic start before the first event of each session that has none."""
    started = events.where("kind = 'session_start'").select("session_id").distinct()
    first = events.join(started, "session_id", "left_anti").groupBy("session_id").agg(F.min_by(F.struct(*events.columns), F.struct("ts", "seq")).alias("e")).select("e.*")
    value = lambda name: F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(""))
    payload = F.to_json(F.struct(value("repo").alias("cwd"), value("repo").alias("repo"), F.lit(actor).alias("actor"), F.col("rollup_dim").alias("campaign_id"), value("campaign_role").alias("campaign_role"), value("backend").alias("backend")))
    starts = first.withColumn("event_id", ulid(F.coalesce(F.unix_millis(F.try_to_timestamp("ts")), F.lit(0)), F.concat_ws("\0", "source", "session_id", F.lit("session_start")))).withColumn("payload", payload).withColumn("kind", F.lit("session_start")).withColumn("seq", F.col("seq") - 1)
    return events.unionByName(starts.select(*events.columns))


def new_only(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Imported events that aren't there yet; their sequence goes on from what is there."""
    last = existing.groupBy("stream").agg(F.max("seq").alias("last_seq"))
    fresh = events.join(existing.select("event_id"), "event_id", "left_anti").join(last, "stream", "left")
    nth = F.row_number().over(Window.partitionBy("stream", F.to_date("ts")).orderBy("seq"))
    return fresh.withColumn("seq", F.coalesce(F.col("last_seq") + 1, F.lit(0)) + nth - 1).drop("last_seq")


def tail_lines(spark: SparkSession, path: str, cursors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole lines that files gained since the last time, and the cursors to go on from.

    Lines are file, offset, line; cursors are file, offset (where the first line begins that wasn't whole) and size. A
    file that got shorter is read from its beginning. Write the lines first and the cursors then: what comes twice after
    a crash has the same offsets, and so the same ids.
    """
    files = _files(spark, path).select(F.col("path").alias("file"), "content")
    if cursors is not None:
        cursors = cursors.select("file", F.col("offset").alias("from"))
        cursors = F.broadcast(cursors) if cursors.count() <= BROADCAST_FILES else cursors  # so that contents aren't shuffled
    known = files.join(cursors, "file", "left") if cursors is not None else files.withColumn("from", F.lit(None).cast("long"))
    start = F.when(F.coalesce("from", F.lit(0)) <= F.octet_length("content"), F.coalesce("from", F.lit(0))).otherwise(0)
    fresh = known.select("file", "content", start.cast("long").alias("from"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, at in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), batch.column("from").to_pylist(), strict=True):
                offsets, found = [], []
                for line in content[at:].split(b"\n")[:-1]:
                    if line.strip():
                        offsets.append(at)
                        found.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(offsets, pa.int64()), pa.array(found, pa.string())], names=["file", "offset", "line"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, starts = batch.column("content").to_pylist(), batch.column("from").to_pylist()
            to = [max(at, content.rfind(b"\n") + 1) for content, at in zip(contents, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(to, pa.int64()), pa.array([len(c) for c in contents], pa.int64())], names=["file", "offset", "size"])

    return fresh.mapInArrow(lines, "file string, offset long, line string"), fresh.mapInArrow(ends, "file string, offset long, size long")
