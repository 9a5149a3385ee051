"""Execution traces: spans of calls and results, turns, asynchronous jobs, and the lists and searches over them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.render import duration, duration_label
from plumbline.operators.access import ReadScope, clamped, scope_filter
from plumbline.operators.sessions import repo_of, session_context
from plumbline.sources.envelopes import call_id, epoch_ms

TASK_SOURCE = "codex_cli"


def _gap_ms(first: Column, last: Column) -> Column:
    return F.greatest(epoch_ms(last) - epoch_ms(first), F.lit(0))


def spans(events: DataFrame) -> DataFrame:
    """Each tool call with the result that took it: the first of the results whose latest earlier call it is."""
    rows = events.where(F.col("kind").isin("tool_call", "tool_result") & (call_id() != ""))
    keyed = rows.withColumn("call", call_id())
    before = Window.partitionBy("session_id", "call").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    of_call = F.when(F.col("kind") == "tool_call", F.col("event_id"))
    results = keyed.withColumn("span_id", F.last(of_call, ignorenulls=True).over(before)).where((F.col("kind") == "tool_result") & F.col("span_id").isNotNull())
    output, code = T.result_output(), T.exit_code(T.result_output())
    first = results.withColumn("_nth", F.row_number().over(Window.partitionBy("session_id", "span_id").orderBy("ts", "ord"))).where("_nth = 1")
    taken = first.select(
        "session_id",
        "span_id",
        F.col("event_id").alias("result_id"),
        F.col("ts").alias("ended"),
        output.alias("output"),
        code.alias("exit_code"),
        T.result_status(F.col("p.is_error"), code, output).alias("status"),
        T.wall_time_ms(output).alias("wall_ms"),
        T.output_process_id(output).alias("output_process"),
    )
    body = T.tool_arguments()
    calls = keyed.where("kind = 'tool_call'").select(
        "session_id",
        F.col("event_id").alias("span_id"),
        "source",
        "day",
        "ord",
        F.col("ts").alias("started"),
        F.coalesce("p.name", F.lit("?")).alias("operation"),
        F.coalesce(F.get_json_object(body, "$.session_id"), F.lit("")).alias("input_process"),
        T.excerpt(F.when(T.tool_command() != "", T.tool_command()).otherwise(body), 512).alias("input"),
        (F.coalesce(F.get_json_object(body, "$.chars"), F.lit("")) != "").alias("has_data"),
    )
    joined = calls.join(taken, ["session_id", "span_id"], "left")
    gap = F.when(F.col("ended").isNotNull(), _gap_ms(F.col("started"), F.col("ended")))
    return joined.select(
        "span_id", "session_id", "source", "day", "ord", "operation", "started", F.coalesce("ended", F.lit("")).alias("ended"), "result_id",
        F.coalesce("status", F.lit("open")).alias("status"), "exit_code", F.coalesce("wall_ms", gap).alias("duration_ms"),
        F.when(F.col("wall_ms").isNotNull(), "reported").when(F.col("ended").isNotNull(), "event_gap").otherwise("").alias("duration_source"),
        F.when(F.col("input_process") != "", F.col("input_process")).otherwise(F.coalesce("output_process", F.lit(""))).alias("process_id"),
        "input", F.coalesce("output", F.lit("")).alias("output"), "has_data",
    )


def _prompt() -> Column:
    body = F.trim(F.coalesce(F.col("p.text"), F.lit("")))
    return (F.col("kind") == "user_prompt") & (body != "") & ~T.is_trace_noise(body)


def _turns(rows: DataFrame, found: DataFrame, no_gap_alone: bool) -> DataFrame:
    """Aggregate rows that carry `turn`; `closer` flags the closing record of a turn."""
    errors = found.select("session_id", F.col("span_id").alias("event_id"), F.lit(1).alias("is_span"), (F.col("status") == "error").cast("int").alias("is_error"))
    joined = rows.join(errors, ["session_id", "event_id"], "left")
    order = F.struct("ts", "ord")
    turns = joined.groupBy("session_id", "turn").agg(
        F.min_by("head", order).alias("turn_id"),
        F.min_by("source", order).alias("source"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.max_by("closing", order).alias("closing"),
        F.max_by(F.when(F.col("closer"), F.coalesce("p.duration_ms", "p.payload.duration_ms")), order).alias("reported"),
        F.count(F.lit(1)).alias("events"),
        F.count("is_span").alias("spans"),
        F.coalesce(F.sum("is_error"), F.lit(0)).alias("errors"),
        F.min_by(F.when(_prompt(), T.excerpt(F.col("p.text"), 220)), F.when(_prompt(), order)).alias("ask"),
        F.max("last_turn").alias("last_turn"),
    )
    last = F.col("turn") == F.col("last_turn")
    gap = _gap_ms(F.col("started"), F.col("ended"))
    alone = last & F.col("closing").isNull() & (F.col("events") == 1)
    return turns.select(
        "turn_id", "session_id", "source", "started", "ended",
        F.coalesce("closing", F.when(last, "open").otherwise("unknown")).alias("status"),
        F.coalesce("reported", F.when(alone, None).otherwise(gap) if no_gap_alone else gap).alias("duration_ms"),
        F.coalesce("ask", F.lit("")).alias("ask"), "events", "spans", "errors",
    )


def _task_rows(events: DataFrame) -> DataFrame:
    """Events in turns of the source that marks tasks: a start always opens one, a prompt where none is open, an end closes it."""
    rows = events.where((F.col("source") == TASK_SOURCE) & (F.coalesce("session_id", F.lit("")) != ""))
    start, end = F.coalesce(F.col("p.event_kind") == "task_started", F.lit(False)), F.coalesce(F.col("p.event_kind").isin("task_complete", "turn_aborted"), F.lit(False))
    session = Window.partitionBy("session_id").orderBy("ts", "ord")
    marked = rows.withColumns({"starts": start, "closer": end, "asks": _prompt()}).withColumn("segment", F.coalesce(F.sum(F.col("closer").cast("int")).over(session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    segment = Window.partitionBy("session_id", "segment").orderBy("ts", "ord")
    openable = (F.col("starts") | F.col("asks")).cast("int")
    earlier = F.coalesce(F.sum(openable).over(segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = marked.withColumn("opens", F.col("starts") | (F.col("asks") & (earlier == 0)))
    numbered = opened.withColumn("turn", F.sum(F.col("opens").cast("int")).over(session)).withColumn("inside", F.sum(F.col("opens").cast("int")).over(segment) > 0).where("inside")
    head = F.when(F.col("starts") & (F.coalesce("p.turn_id", F.lit("")) != ""), F.col("p.turn_id")).otherwise(F.col("event_id"))
    status = F.when(F.col("p.event_kind") == "task_complete", "ok").when(F.col("p.event_kind") == "turn_aborted", "aborted")
    return numbered.withColumns({"last_turn": F.max("turn").over(Window.partitionBy("session_id")), "head": head, "closing": status})


def _prompt_rows(events: DataFrame) -> DataFrame:
    """Events in turns of all other sources: a prompt always opens one, a reported duration or the session's end closes it."""
    rows = events.where((F.col("source") != TASK_SOURCE) & (F.coalesce("session_id", F.lit("")) != ""))
    closer = F.coalesce(F.col("p.subtype") == "turn_duration", F.lit(False)) | (F.col("kind") == "session_end")
    session = Window.partitionBy("session_id").orderBy("ts", "ord")
    marked = rows.withColumns({"asks": _prompt(), "closer": closer}).withColumn("turn", F.sum(F.col("asks").cast("int")).over(session)).where("turn > 0")
    turn = Window.partitionBy("session_id", "turn").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = marked.withColumn("closed", F.coalesce(F.sum(F.col("closer").cast("int")).over(turn), F.lit(0))).where("closed = 0")
    status = F.when(F.col("p.subtype") == "turn_duration", "ok").when(F.col("kind") == "session_end", "unknown")
    return kept.withColumns({"last_turn": F.max("turn").over(Window.partitionBy("session_id")), "head": F.col("event_id"), "closing": status})


def turns_task(events: DataFrame, found: DataFrame) -> DataFrame:
    """Turns of the source that marks tasks."""
    return _turns(_task_rows(events), found, True)


def turns_prompt(events: DataFrame, found: DataFrame) -> DataFrame:
    """Turns of all other sources."""
    return _turns(_prompt_rows(events), found, False)


def turns(events: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Turns of all sources."""
    found = spans(events) if found is None else found
    return turns_task(events, found).unionByName(turns_prompt(events, found))


def membership(events: DataFrame) -> DataFrame:
    """The turn of each event that is in one: session_id, event_id, turn_id."""
    of = lambda rows: rows.select("session_id", "event_id", F.first("head").over(Window.partitionBy("session_id", "turn").orderBy("ts", "ord")).alias("turn_id"))
    return of(_task_rows(events)).unionByName(of(_prompt_rows(events)))


def contexts(events: DataFrame, known: DataFrame) -> DataFrame:
    """Source, machine, repository, campaign and role of each session; the repository is that of its first cwd."""
    found = session_context(events)
    repos = repo_of(found, known)
    filled = [F.coalesce(name, F.lit("")).alias(name) for name in ("source", "machine", "repo", "campaign", "role")]
    return found.join(repos, "cwd", "left").select("session_id", *filled)


def in_context(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Spans, turns or jobs with the machine, repository, campaign and role of their session."""
    return rows.join(found.drop("source"), "session_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("machine", "repo", "campaign", "role")})


def spans_in_turns(found: DataFrame, members: DataFrame) -> DataFrame:
    """Spans with the turn that their call is in; empty if there is none."""
    of = members.select("session_id", F.col("event_id").alias("span_id"), "turn_id")
    return found.join(of, ["session_id", "span_id"], "left").withColumn("turn_id", F.coalesce("turn_id", F.lit("")))


def span_events(found: DataFrame) -> DataFrame:
    """Both events of each span: event_id, span_id, role (call or result)."""
    calls = found.select("session_id", F.col("span_id").alias("event_id"), "span_id", F.lit("call").alias("part"))
    return calls.unionByName(found.where("result_id IS NOT NULL").select("session_id", F.col("result_id").alias("event_id"), "span_id", F.lit("result").alias("part")))


def _in_order(column: str, order: Column) -> Column:
    """The distinct non-empty values of a column in the order of their first appearance."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct(order.alias("o"), F.col(column).alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def jobs(found: DataFrame) -> DataFrame:
    """Chains of spans of one process: a command that goes on running opens a job, writes to it join until one ends it.

    Spans that carry the turn they are in (`spans_in_turns`) give the job's turns as well.
    """
    return _job_rows(found)[0]


def job_spans(found: DataFrame) -> DataFrame:
    """The spans of each job: job_id, span_id, place (1 is the first)."""
    numbered = _job_rows(found)[1]
    job = Window.partitionBy("session_id", "process_id", "job").orderBy("started", "span_id")
    return numbered.select("session_id", "span_id", F.concat(F.lit("job:"), F.first("span_id").over(job)).alias("job_id"), F.row_number().over(job).alias("place"))


def _job_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs, and the spans that carry the number of their job."""
    status = F.when((F.col("operation") == "write_stdin") & (F.col("status") == "error") & F.col("exit_code").isNull() & F.lower("output").contains("write_stdin failed:"), "unknown").otherwise(F.col("status"))
    opens = (F.col("operation") == "exec_command") & (F.col("status") == "running")
    rows = found.where((F.col("source") == TASK_SOURCE) & (F.col("process_id") != "") & (opens | (F.col("operation") == "write_stdin"))).withColumn("opens", opens).withColumn("job_status", status)
    ends = (F.col("operation") == "write_stdin") & ~F.col("job_status").isin("running", "open", "unknown")
    chain = Window.partitionBy("session_id", "process_id").orderBy("started", "span_id")
    marked = rows.withColumn("segment", F.coalesce(F.sum(ends.cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.row_number().over(Window.partitionBy("session_id", "process_id", "segment").orderBy("started", "span_id")) == 1
    numbered = marked.withColumn("first", first).withColumn("job", F.sum((F.col("opens") | F.col("first")).cast("int")).over(chain))
    order, writes = F.struct("started", "span_id"), F.col("operation") == "write_stdin"
    ended = F.when(F.col("ended") != "", F.col("ended")).otherwise(F.col("started"))
    out = numbered.groupBy("session_id", "process_id", "job").agg(
        F.concat(F.lit("job:"), F.min_by("span_id", order)).alias("job_id"),
        F.min_by(F.when(F.col("opens"), "exact_process_session_id").otherwise("continuation_only"), order).alias("association"),
        F.min("started").alias("started"),
        F.max_by(ended, order).alias("ended"),
        F.max_by("job_status", order).alias("status"),
        F.count(F.lit(1)).alias("spans"),
        F.count_if(writes).alias("polls"),
        F.count_if(writes & F.col("has_data")).alias("stdin_writes"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.when(F.col("duration_source") == "reported", F.coalesce("duration_ms", F.lit(0))).otherwise(0)).alias("wait_ms"),
        F.min_by("input", order).alias("command"),
        F.coalesce(F.max_by(F.when(F.col("output") != "", F.col("output")), F.when(F.col("output") != "", order)), F.lit("")).alias("final_output"),
        *([_in_order("turn_id", order).alias("turn_ids")] if "turn_id" in found.columns else []),
    )
    return out.withColumn("elapsed_ms", _gap_ms(F.col("started"), F.col("ended"))).drop("job"), numbered


def trace_list(
    rows: DataFrame, entity: str, status: str = "", since: str = "", min_ms: int = 0, operation: str = "", has_errors: bool = False, source: str = "", sort: str = "recent", limit: int = 20, repo: str = "", machine: str = "", scope: ReadScope | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Filtered and sorted turns, spans or jobs; a missing duration counts as 0, spans ignore has_errors.

    Repository, machine and source are contained in a row's, whatever the case; a scope holds for a row's repository and
    source and its session's campaign and role (see `in_context`). For turns, an operation is that of one of their spans,
    which `found` has with their turn_id. At most 100 rows are listed.
    """
    if entity not in ("turns", "spans", "jobs"):
        raise ValueError("entity must be turns, spans or jobs")
    duration = F.coalesce(F.col("elapsed_ms" if entity == "jobs" else "duration_ms"), F.lit(0))
    if status:
        rows = rows.where(F.lower("status") == status.lower())
    for column, value in (("source", source), ("repo", repo), ("machine", machine)):
        if value and column in rows.columns:
            rows = rows.where(F.lower(column).contains(value.lower()))
    if scope is not None:
        rows = scope_filter(rows, scope)
    if since:
        rows = rows.where(F.col("started") >= since)
    if min_ms:
        rows = rows.where(duration >= min_ms)
    if operation and entity == "turns":
        if found is None:
            raise ValueError("turns are filtered by the operations of their spans")
        rows = turns_with_operation(rows, found, operation)
    elif operation:
        fields = ("operation", "input") if entity == "spans" else ("command", "process_id")
        rows = rows.where(T.any_of([F.lower(f).contains(operation.lower()) for f in fields]))
    if has_errors and entity != "spans":
        rows = rows.where("errors > 0")
    key = {"recent": [F.desc("started")], "duration": [F.desc(duration), F.desc("started")], "wait": [F.desc(F.col("wait_ms") if entity == "jobs" else duration), F.desc("started")]}[sort]
    identity = {"turns": "turn_id", "spans": "span_id", "jobs": "job_id"}[entity]
    return rows.orderBy(*key, identity).limit(clamped(limit, 1, 100))


def turns_with_operation(found_turns: DataFrame, found: DataFrame, operation: str) -> DataFrame:
    """Turns that hold a span of an operation; `found` are spans with their turn_id."""
    match = found.where((F.lower("operation").contains(operation.lower()) | F.lower("input").contains(operation.lower())) & (F.col("turn_id") != ""))
    return found_turns.join(match.select("session_id", "turn_id").distinct(), ["session_id", "turn_id"], "left_semi")


def summary(events: DataFrame) -> Column:
    """One line about an event."""
    said = T.excerpt(F.col("p.text"), 180)
    called = F.concat(F.coalesce("p.name", F.lit("?")), F.lit(" · "), T.excerpt(F.when(T.tool_command() != "", T.tool_command()).otherwise(T.tool_arguments()), 180))
    return (
        F.when(F.col("kind").isin("user_prompt", "assistant_message", "thinking"), said)
        .when(F.col("kind") == "tool_call", called)
        .when(F.col("kind") == "tool_result", T.excerpt(T.result_output(), 180))
        .when(F.col("kind") == "session_start", F.concat(F.lit("cwd="), F.coalesce("p.cwd", F.lit("")), F.lit(" source="), F.col("source")))
        .when(F.col("kind") == "session_end", F.concat(F.lit("reason="), F.coalesce("p.reason", F.lit(""))))
        .when(F.col("kind") == "attachment_ref", F.coalesce("p.local_path", "p.cwd", F.lit("attachment")))
        .otherwise(F.concat(F.coalesce(F.when(F.col("p.event_kind") != "", F.col("p.event_kind")), "p.subtype", F.lit("")), F.when(F.coalesce("p.duration_ms", "p.payload.duration_ms").isNotNull(), F.concat(F.lit(" · "), duration(F.coalesce("p.duration_ms", "p.payload.duration_ms")))).otherwise("")))
    )


def search_text(events: DataFrame) -> DataFrame:
    """Events with the text that a literal search looks through: 512 collapsed characters."""
    return events.withColumn("summary", summary(events)).withColumn("search_text", T.excerpt(F.concat_ws(" ", "kind", "source", "session_id", "summary", "payload"), 512))


def trace_search(events: DataFrame, needle: str, kind: str = "", limit: int = 20) -> DataFrame:
    """The newest events whose search text contains a needle, whatever the case."""
    rows = events.where(F.col("kind") == kind) if kind else events
    rows = search_text(rows).where(F.lower("search_text").contains(needle.lower()))
    return rows.orderBy(F.desc("ts"), F.desc("ord")).limit(limit)


def event_window(events: DataFrame, event_id: str, before: int, after: int) -> DataFrame:
    """An event and its neighbours in its session, by position."""
    session = events.where(F.col("event_id") == event_id).select("session_id")
    rows = events.join(session, "session_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "ord")))
    centre = rows.where(F.col("event_id") == event_id).select("session_id", F.col("pos").alias("centre"))
    near = rows.join(centre, "session_id").where(F.col("pos").between(F.col("centre") - before, F.col("centre") + after))
    return near.select("event_id", "session_id", "kind", (F.col("pos") - F.col("centre")).cast("long").alias("offset"))


def first_context_rows(events: DataFrame) -> DataFrame:
    """The first event of each kind in each session."""
    first = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("ts", "ord"))
    return events.where(F.col("session_id") != "").withColumn("_n", first).where("_n = 1").drop("_n")


#: Bounds of a window over raw events: days, events, bytes of payload, sessions. Beyond one of them nothing is returned.
MOST_DAYS, MOST_EVENTS, MOST_BYTES, MOST_SESSIONS = 7, 50_000, 64 << 20, 200


def window_bounds(since: str, until: str) -> tuple[str, str]:
    """The bounds of a window, if it is one of at most MOST_DAYS days."""
    first, last = (datetime.fromisoformat(t.replace("Z", "+00:00")) for t in (since, until))
    if first >= last:
        raise ValueError("the window must end after it begins")
    if last - first > timedelta(days=MOST_DAYS):
        raise ValueError(f"windows are limited to {MOST_DAYS} days")
    return since, until


def raw_window(events: DataFrame, since: str, until: str, streams: list[str] | None = None, kinds: list[str] | None = None, source: str = "", needle: str = "", session_ids: list[str] | None = None, id_prefixes: list[str] | None = None) -> DataFrame:
    """Events of a window of at most seven days; partition columns and the other filters reach the scan."""
    window_bounds(since, until)
    rows = events.where(F.col("day").between(since[:10], until[:10]) & (F.col("ts") >= since) & (F.col("ts") < until))
    for column, values in (("stream", streams), ("kind", kinds), ("session_id", session_ids)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if source:
        rows = rows.where(F.col("source").contains(source))
    if needle:
        rows = rows.where(F.lower("payload").contains(needle.lower()))
    if id_prefixes:
        rows = rows.where(T.any_of([F.col("event_id").startswith(prefix) for prefix in id_prefixes]))
    return rows


def within_caps(rows: DataFrame) -> DataFrame:
    """The rows of a window, unless they are more than a reader may take: then it fails as a whole, and no part comes.

    Counting stops one row beyond the cap.
    """
    some = rows.limit(MOST_EVENTS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions")).first()
    if some.n > MOST_EVENTS or some.bytes > MOST_BYTES:
        raise ValueError(f"the selection has more than {MOST_EVENTS} events or {MOST_BYTES} bytes")
    if some.sessions > MOST_SESSIONS:
        raise ValueError(f"the selection spans more than {MOST_SESSIONS} sessions")
    return rows


def streams_of(events: DataFrame, machine: str = "") -> list[str]:
    """The streams of machines whose name contains a text, whatever the case. There must be one."""
    names = events.select("stream").distinct().where(F.lower(T.machine_of_trace(F.col("stream"))).contains(machine.lower())).orderBy("stream")
    found = [row.stream for row in names.collect()]  # a row a machine and source
    if not found:
        raise ValueError("no stream of such a machine")
    return found


def expand_sessions(events: DataFrame, hits: DataFrame) -> DataFrame:
    """All events of the sessions that hits belong to."""
    return events.join(hits.where("session_id <> ''").select("session_id").distinct(), "session_id", "left_semi")


def significant() -> Column:
    """Events that a timeline shows."""
    marks = F.coalesce(F.col("p.subtype").isin("turn_duration", "compacted"), F.lit(False)) | F.coalesce(F.col("p.event_kind").isin("task_started", "task_complete", "turn_aborted", "context_compacted"), F.lit(False))
    return F.col("kind").isin("user_prompt", "assistant_message", "session_start", "session_end", "tool_call") | ((F.col("kind") == "agent_meta") & marks)


#: Rows of a timeline.
TIMELINE = 200


def timelines(events: DataFrame, members: DataFrame, found: DataFrame, limit: int = TIMELINE) -> DataFrame:
    """The significant events of each turn: turn_id, place, id, offset_ms (from the turn's first event), kind, summary.

    A call is a span, or the job that it opens in this turn; the job's other spans in the same turn are left out. `found`
    are spans with their turn_id. A turn shows its first `limit` rows.
    """
    in_turn = events.join(members, ["session_id", "event_id"])
    base = F.first("ts_ms").over(Window.partitionBy("session_id", "turn_id").orderBy("ts", "ord"))
    rows = in_turn.withColumn("offset_ms", F.greatest(F.coalesce("ts_ms", base) - F.coalesce(base, F.lit(0)), F.lit(0))).where(significant())
    parts = job_spans(found).join(found.select("session_id", "span_id", "turn_id"), ["session_id", "span_id"])
    heads = parts.where("place = 1").select("session_id", "job_id", F.col("turn_id").alias("head_turn"))
    collapsed = parts.where("place > 1").join(heads, ["session_id", "job_id"]).where("turn_id = head_turn AND turn_id <> ''").select("session_id", F.col("span_id").alias("event_id"))
    opened = jobs(found).select(
        "session_id", F.substring("job_id", 5, 1000).alias("event_id"), "job_id",
        F.concat(T.excerpt(F.col("command"), 120), F.lit(" → "), "status", F.lit(" · "), duration(F.col("elapsed_ms")), F.lit(" elapsed · "), duration(F.col("wait_ms")), F.lit(" reported-wait · "), F.col("polls").cast("string"), F.lit(" polls · "), F.col("errors").cast("string"), F.lit(" errors")).alias("job_line"),
    )
    opened = opened.join(found.where("turn_id <> ''").select("session_id", F.col("span_id").alias("event_id")), ["session_id", "event_id"], "left_semi")
    input_part = F.when(F.col("input") == "", "").otherwise(F.concat(F.lit(" · "), T.excerpt(F.col("input"), 140)))
    lines = found.select("session_id", F.col("span_id").alias("event_id"), F.concat("operation", F.lit(" → "), "status", F.lit(" · "), duration_label(F.col("duration_ms"), F.col("duration_source")), input_part).alias("span_line"))
    shown = rows.join(collapsed, ["session_id", "event_id"], "left_anti").join(lines, ["session_id", "event_id"], "left").join(opened, ["session_id", "event_id"], "left")
    place = F.row_number().over(Window.partitionBy("session_id", "turn_id").orderBy("ts", "ord"))
    kind = F.when(F.col("job_id").isNotNull(), "job").when(F.col("span_line").isNotNull(), "span").otherwise(F.col("kind"))
    out = shown.withColumn("place", place).where(F.col("place") <= limit)
    return out.select("session_id", "turn_id", "place", F.coalesce("job_id", "event_id").alias("id"), "offset_ms", kind.alias("kind"), F.coalesce("job_line", "span_line", summary(out)).alias("summary"))


def turn_timeline(events: DataFrame, members: DataFrame, found: DataFrame, turn_id: str, limit: int = TIMELINE) -> DataFrame:
    """The timeline of one turn; only its session is read."""
    own = members.where(F.col("turn_id") == turn_id)
    sessions = own.select("session_id").distinct()
    return timelines(events.join(sessions, "session_id", "left_semi"), own, found.join(sessions, "session_id", "left_semi"), limit)


def show(events: DataFrame, known: DataFrame, entity: str, key: str, before: int = 5, after: int = 5) -> DataFrame:
    """What there is to say about one turn, job, span, event or session.

    A turn has its timeline, a job its spans in order, a span or event its neighbours in the session, a session its turns.
    Neighbours are bounded by 100 on either side.
    """
    before, after = clamped(before, 0, 100), clamped(after, 0, 100)
    if entity == "session":
        own = events.where(F.col("session_id") == key)
        return in_context(turns(own), contexts(own, known)).orderBy("started", "turn_id")
    if entity in ("span", "event"):
        rows = event_window(events, key, before, after)
        return rows.join(events.select("event_id", "session_id", "ts", summary(events).alias("summary")), ["event_id", "session_id"]).orderBy("offset")
    members, found = membership(events), spans(events)
    if entity == "turn":
        return turn_timeline(events, members, spans_in_turns(found, members), key).orderBy("place")
    if entity == "job":
        return job_spans(found).where(F.col("job_id") == key).join(found, ["session_id", "span_id"]).orderBy("place")
    raise ValueError("entity must be turn, job, span, event or session")


def remote_trace(events: DataFrame, since: str, until: str, expand: bool = True, capped: bool = True, **filters) -> DataFrame:
    """The events that a reader of a remote table needs: those of a window that filters choose and, with `expand`, all of
    their sessions from a day before the window on, but no more than MOST_DAYS days back.

    Without it, their sessions' first start and first metadata come along, so that they can be told apart. Either selection
    is held to the caps of a reader who takes it into memory; without `capped` a table of any size comes as a whole.
    """
    held = within_caps if capped else lambda rows: rows
    first = held(raw_window(events, since, until, **filters))
    at = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))
    back = max(at(since) - timedelta(days=1), at(until) - timedelta(days=MOST_DAYS)).strftime("%Y-%m-%dT%H:%M:%SZ")
    context = raw_window(events, back, until)
    if expand:
        return held(expand_sessions(context, first))
    known = first_context_rows(expand_sessions(context.where(F.col("kind").isin("session_start", "agent_meta")), first))
    return known.join(first.select("event_id"), "event_id", "left_anti").unionByName(first)


def identities(events: DataFrame) -> DataFrame:
    """All ids that can be asked for: id, entity, and precedence where one id names several."""
    found = spans(events)
    of = lambda rows, column, n, entity: rows.select(F.col(column).alias("id"), F.lit(n).alias("precedence"), F.lit(entity).alias("entity"))
    sessions_of = events.where(F.coalesce("session_id", F.lit("")) != "").select("session_id").distinct()
    parts = [of(turns(events, found), "turn_id", 2, "turn"), of(found, "span_id", 3, "span"), of(sessions_of, "session_id", 4, "session"), of(events, "event_id", 5, "event")]
    out = of(jobs(found), "job_id", 1, "job")
    for part in parts:
        out = out.unionByName(part)
    return out


def resolve_prefix(ids: DataFrame, prefix: str, most: int = 8) -> DataFrame:
    """The entities whose id begins with a prefix of four characters or more: one is a hit, several are candidates."""
    if len(prefix) < 4:
        raise ValueError("a prefix needs four characters")
    return ids.where(F.col("id").startswith(prefix)).orderBy("precedence", "id").limit(most + 1)


def comparable(events: DataFrame, entity: str) -> tuple[DataFrame, str]:
    """The rows that can be compared, and their key: turns, spans or jobs; nothing else can."""
    found = spans(events)
    rows = {"turn": lambda: (turns(events, found), "turn_id"), "span": lambda: (found, "span_id"), "job": lambda: (jobs(found), "job_id")}
    if entity not in rows:
        raise ValueError("only turns, spans and jobs can be compared")
    return rows[entity]()


def trace_compare(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Fields in which two rows differ, over all fields of either."""
    fields = [c for c in rows.columns if c != key]

    def fields_of(value: str, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])
        return rows.where(F.col(key) == value).select(F.explode(pairs).alias("x")).select("x.*")

    both = fields_of(left, "left_value").join(fields_of(right, "right_value"), "field", "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def display_prefixes(ids: DataFrame, least: int = 8) -> DataFrame:
    """The shortest prefix, of `least` characters or more, that tells an id from its neighbours in order."""
    # ids that share more than `least` characters meet in one group, whose size is that of the collision
    groups = ids.select("id").distinct().withColumn("head", F.left("id", F.lit(least)))
    ordered = Window.partitionBy("head").orderBy("id")
    near = groups.withColumn("prev", F.lag("id").over(ordered)).withColumn("next", F.lead("id").over(ordered))

    def shared(other: str) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1)))
        return F.coalesce(F.array_max(F.filter(at, lambda n: F.left("id", n) == F.left(F.col(other), n))), F.lit(0))

    return near.select("id", F.left("id", F.greatest(F.lit(least), shared("prev") + 1, shared("next") + 1)).alias("prefix"))


def session_gaps(events: DataFrame, minutes: int) -> DataFrame:
    """Sessions cut where a user was idle for longer than `minutes`: session_end rows with reason idle."""
    rows = events.where("ts_ms IS NOT NULL")
    previous = F.lag("ts_ms").over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id"))
    fresh = rows.withColumn("fresh", F.coalesce((F.col("ts_ms") - previous > minutes * 60_000).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("nth", F.sum("fresh").over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id")))
    return numbered.groupBy("user_id", "nth").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.count(F.lit(1)).alias("events"))
