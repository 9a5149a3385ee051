"""Sessions, usage, days, tools and the activity views built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.session import written
from plumbline.sources.envelopes import call_id, epoch_ms

FILE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
_ORDER = ("ts", "ord")


def is_prompt() -> Column:
    """A prompt that asks for something: 12 bytes or more and no noise."""
    body = F.trim(F.coalesce(F.col("p.text"), F.lit("")))
    return (F.col("kind") == "user_prompt") & (F.octet_length(body) >= 12) & ~T.is_noise(body)


def linked_pr() -> Column:
    """The key of the pull request that a record names."""
    repo, number = F.regexp_extract("p.pr_url", "([^/]+)/pull/[0-9]+", 1), F.regexp_extract("p.pr_url", "/pull/([0-9]+)", 1)
    by_url = F.when(F.col("p.pr_url").isNotNull() & (number != ""), F.concat(F.lit("gh:"), repo, F.lit("#"), number))
    by_parts = F.when(F.col("p.pr_repository").isNotNull() & F.col("p.pr_number").isNotNull(), F.concat(F.lit("gh:"), F.element_at(F.split("p.pr_repository", "/"), -1), F.lit("#"), F.col("p.pr_number").cast("string")))
    return F.coalesce(by_url, by_parts)


def session_context(events: DataFrame) -> DataFrame:
    """First non-empty source, machine, campaign and role of each session, and its first cwd."""
    order = F.struct(*_ORDER)

    def first(value: Column) -> Column:
        return F.min(F.when(F.coalesce(value, F.lit("")) != "", F.struct(order.alias("o"), value.alias("v"))))["v"]

    return (
        events.where(F.coalesce("session_id", F.lit("")) != "")
        .groupBy("session_id")
        .agg(first(F.col("source")).alias("source"), first(T.machine_of_trace(F.col("stream"))).alias("machine"), first(F.col("p.cwd")).alias("cwd"), first(F.col("p.campaign_id")).alias("campaign"), first(F.col("p.campaign_role")).alias("role"))
    )


def repo_of(cwds: DataFrame, known: DataFrame, cwd: str = "cwd", repo: str = "repo") -> DataFrame:
    """The known repository of each distinct cwd: the first path segment that is one or extends one with '-'; the longest wins.

    `known` holds the configured repositories, one column `repo`: a dimension, joined by the segment and its prefixes, so
    that the join is by equality.
    """
    parts = cwds.select(cwd).where(F.col(cwd).isNotNull()).distinct().select(cwd, F.posexplode(F.split(cwd, "/")).alias("pos", "segment"))
    pieces = F.split("segment", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "-"))
    joined = parts.select(cwd, "pos", F.explode(prefixes).alias("candidate")).join(known.select(F.col(repo).alias("candidate")).distinct(), "candidate")
    best = joined.groupBy(cwd, "pos").agg(F.max_by("candidate", F.length("candidate")).alias(repo))
    return best.groupBy(cwd).agg(F.min_by(repo, "pos").alias(repo))


def duration_s(first: Column, last: Column) -> Column:
    """Whole seconds between two times, not below 0; 0 if one can't be read."""
    return F.coalesce(F.greatest(F.floor(epoch_ms(last) / 1000) - F.floor(epoch_ms(first) / 1000), F.lit(0)), F.lit(0)).cast("long")


def session_rollup(events: DataFrame) -> DataFrame:
    """Counts, bounds, first ask, files and linked pull request of each session."""
    order = F.struct(*_ORDER)
    first_by = lambda condition, value: F.min_by(F.when(condition, value), F.when(condition, order))
    token = T.file_token(F.col("p.local_path"))
    touched = (F.col("kind") == "attachment_ref") & F.col("p.tool_name").isin(*FILE_TOOLS) & token.isNotNull()
    start = F.col("kind") == "session_start"
    return (
        events.where(F.coalesce("session_id", F.lit("")) != "")
        .groupBy("session_id")
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.min_by("source", order).alias("source"),
            first_by(is_prompt(), T.excerpt(F.col("p.text"), 200)).alias("ask"),
            F.count_if(is_prompt()).alias("prompts"),
            F.count_if(F.col("kind") == "assistant_message").alias("assistant"),
            F.count_if(F.col("kind") == "thinking").alias("thinking"),
            duration_s(F.min("ts"), F.max("ts")).alias("duration_s"),
            F.count_if(F.col("kind") == "tool_call").alias("tools"),
            F.count_if((F.col("kind") == "tool_result") & F.coalesce(F.col("p.is_error"), F.lit(False))).alias("errors"),
            F.size(F.collect_set(F.when(touched, token))).cast("long").alias("files"),
            first_by(linked_pr().isNotNull(), linked_pr()).alias("linked"),
            F.max_by(F.when(start, F.col("p.cwd")), F.when(start, order)).alias("cwd"),
            F.max_by(F.when(start, F.col("p.actor")), F.when(start, order)).alias("actor"),
        )
    )


def usage_records(events: DataFrame, scope: list[str]) -> DataFrame:
    """Usage records, each msg_id once within `scope`; records without an id all count."""
    usage = events.where((F.col("kind") == "agent_meta") & (F.col("p.subtype") == "usage")).select(
        "session_id", "source", "day", "ts", "ord", F.coalesce("p.msg_id", F.lit("")).alias("msg_id"), F.coalesce("p.model", F.lit("?")).alias("model"), "p.usage.*"
    )
    key = F.when(F.col("msg_id") != "", F.col("msg_id")).otherwise(F.concat(F.lit("\0"), F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy(*scope, "_record").orderBy("ts", "ord")) == 1
    return usage.withColumn("_record", key).withColumn("_first", first).where("_first").drop("_first", "_record")


def _token_sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("in", "tok_in"), ("out", "tok_out"), ("cache_read", "cache_read"), ("cache_create", "cache_create"))]


def session_tokens(events: DataFrame) -> DataFrame:
    """Token totals of sessions that report usage turn by turn."""
    return usage_records(events, ["session_id"]).groupBy("session_id").agg(*_token_sums(), F.count(F.lit(1)).alias("turns"))


def session_models(events: DataFrame) -> DataFrame:
    """The same by model."""
    return usage_records(events, ["session_id"]).groupBy("session_id", "model").agg(*_token_sums(), F.count(F.lit(1)).alias("turns"))


def snapshots(events: DataFrame) -> DataFrame:
    """Cumulative token counts as they stand in the last snapshot of each session."""
    total = F.col("p.payload.info.total_token_usage")
    rows = events.where((F.col("p.event_kind") == "token_count") & total.isNotNull())
    last = rows.groupBy("session_id").agg(F.max_by(total, F.struct("ts", "ord")).alias("t"), F.max("day").alias("day"))
    cached = F.coalesce("t.cached_input_tokens", F.lit(0))
    return last.select("session_id", "day", F.greatest(F.coalesce("t.input_tokens", F.lit(0)) - cached, F.lit(0)).alias("tok_in"), F.coalesce("t.output_tokens", F.lit(0)).alias("tok_out"), cached.alias("cache_read"))


def usage_coverage(events: DataFrame) -> DataFrame:
    """Share of sessions with any usage, in whole percent."""
    sessions = events.where(F.coalesce("session_id", F.lit("")) != "").groupBy("session_id").agg(F.max(((F.col("p.subtype") == "usage") | (F.col("p.event_kind") == "token_count")).cast("int")).alias("has"))
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("has"), F.lit(0)).alias("with_usage")).withColumn("percent", F.when(F.col("sessions") > 0, F.floor(100 * F.col("with_usage") / F.col("sessions"))).otherwise(0))


def payload_chars() -> Column:
    """Characters of the first of input, arguments, action, content and output."""
    return F.coalesce(*[F.length(f"p.{c}") for c in ("input", "arguments", "action", "content", "output")], F.lit(0)).cast("long")


def calls_with_results(events: DataFrame, scope: list[str]) -> DataFrame:
    """Each result with the latest earlier call of its id within `scope`; a call may take several results."""
    rows = events.where(F.col("kind").isin("tool_call", "tool_result") & (call_id() != "")).select("session_id", "day", "ts", "ord", "kind", call_id().alias("call"), "p.name", "p.is_error", payload_chars().alias("chars"))
    before = Window.partitionBy(*scope, "call").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tool", F.when(F.col("kind") == "tool_call", F.coalesce("name", F.lit("?"))).otherwise(F.last(F.when(F.col("kind") == "tool_call", F.coalesce("name", F.lit("?"))), ignorenulls=True).over(before)))


def session_tool_mix(events: DataFrame) -> DataFrame:
    """Calls, errors and characters of each tool in each session."""
    rows = calls_with_results(events, ["session_id"]).where(F.col("tool").isNotNull())
    calls = F.col("kind") == "tool_call"
    return rows.groupBy("session_id", "tool").agg(F.count_if(calls).alias("calls"), F.count_if(~calls & F.coalesce("is_error", F.lit(False))).alias("errors"), F.sum("chars").alias("chars"))


def status_by_tool(events: DataFrame) -> DataFrame:
    """The fleet's tools: agents that use them, calls, errors, characters."""
    agents = events.groupBy("session_id").agg(F.min_by("source", F.struct(*_ORDER)).alias("source")).select("session_id", T.agent_label(F.col("source")).alias("agent"))
    mix = session_tool_mix(events).join(agents, "session_id")
    return mix.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_set("agent")), "+").alias("agents"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("chars").alias("chars"))


def day_stats(events: DataFrame) -> DataFrame:
    """Usage, calls and active sessions of each day; a msg_id counts on its first day only."""
    usage = usage_records(events, []).groupBy("day").agg(*_token_sums())
    last = snapshots(events).groupBy("day").agg(F.sum("tok_in").alias("tok_in"), F.sum("tok_out").alias("tok_out"), F.sum("cache_read").alias("cache_read"), F.lit(0).cast("long").alias("cache_create"))
    tokens = usage.unionByName(last).groupBy("day").agg(*[F.sum(c).alias(c) for c in ("tok_in", "tok_out", "cache_read", "cache_create")])
    active = events.groupBy("day").agg(F.count_if(F.col("kind") == "tool_call").alias("tools"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"))
    return active.join(tokens, "day", "full_outer").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tok_in", "tok_out", "cache_read", "cache_create", "tools", "sessions")])


def loc_by_day(items: DataFrame) -> DataFrame:
    """Lines added and deleted by merged pull requests, by day of merging."""
    return items.where("state = 'MERGED' AND merged_day IS NOT NULL").groupBy(F.col("merged_day").alias("day")).agg(F.coalesce(F.sum("additions"), F.lit(0)).alias("loc_add"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("loc_del"), F.count(F.lit(1)).alias("prs"))


def activity_by_day(days: DataFrame, loc: DataFrame, units: DataFrame) -> DataFrame:
    """Usage, merged lines and units side by side; a day with any of them has a row.

    Every unit with a day claims it, but only pull requests and issues are counted: sessions are in the usage.
    """
    claimed = units.where(F.to_date("day").isNotNull()).groupBy("day").agg(F.count_if(F.col("unit") == "pr").alias("prs"), F.count_if(F.col("unit") == "issue").alias("issues"))
    joined = days.join(loc.select("day", "loc_add", "loc_del"), "day", "full_outer").join(claimed, "day", "full_outer")
    return joined.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tok_in", "tok_out", "cache_read", "cache_create", "tools", "sessions", "loc_add", "loc_del", "prs", "issues")])


def monday_of(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", F.to_date(day)).cast("date")


def weekly_stats(days: DataFrame, weeks: int) -> DataFrame:
    """The last `weeks` Monday weeks up to the newest day with data, empty weeks included."""
    anchor = days.agg(monday_of(F.max("day")).alias("last"))
    grid = anchor.where("last IS NOT NULL").select(F.explode(F.sequence(F.date_sub("last", 7 * (weeks - 1)), F.col("last"), F.expr("interval 7 days"))).alias("week"))
    sums = days.groupBy(monday_of(F.col("day")).alias("week")).agg(*[F.sum(c).alias(c) for c in ("tok_in", "tok_out", "tools", "sessions")])
    return grid.join(sums, "week", "left").select(F.col("week").cast("string").alias("week"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tok_in", "tok_out", "tools", "sessions")])


def tokens_4w(days: DataFrame) -> DataFrame:
    """Token totals of the 28 days up to the newest day with data."""
    newest = days.agg(F.max("day").alias("newest"))
    recent = days.join(F.broadcast(newest), F.datediff(F.to_date("newest"), F.to_date("day")) < 28)  # one row
    return recent.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tok_in", "tok_out", "cache_read", "cache_create")])


def tool_names(events: DataFrame) -> DataFrame:
    """Distinct non-empty names of called tools."""
    return events.where((F.col("kind") == "tool_call") & (F.coalesce("p.name", F.lit("")) != "")).select(F.col("p.name").alias("tool")).distinct()


def tool_profile(events: DataFrame) -> DataFrame:
    """Calls, errors and exact result-size percentiles of each tool; results take their call once."""
    rows = calls_with_results(events, []).where(F.col("tool").isNotNull())
    window = Window.partitionBy("call", "tool").orderBy("ts", "ord")
    number = rows.withColumn("calls_before", F.sum((F.col("kind") == "tool_call").cast("int")).over(window))
    paired = number.withColumn("nth", F.row_number().over(Window.partitionBy("call", "tool", "calls_before", "kind").orderBy("ts", "ord"))).where("kind = 'tool_call' OR nth = 1")
    call, size = F.col("kind") == "tool_call", F.when(F.col("kind") == "tool_result", F.col("chars"))
    return paired.groupBy("tool").agg(
        F.count_if(call).alias("calls"),
        F.count_if(~call & F.coalesce("is_error", F.lit(False))).alias("errors"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN kind = 'tool_result' THEN chars END)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN kind = 'tool_result' THEN chars END)").alias("p95"),
        F.count_distinct("day").alias("days"),
        F.coalesce(F.sum(size), F.lit(0)).alias("result_chars"),
    )


def tool_times(events: DataFrame) -> DataFrame:
    """How long each tool's calls took where call and result have a time, and how long their arguments are.

    A result belongs to the latest call of its id and tool, which takes the first one. Percentiles are nearest ranks.
    """
    rows = calls_with_results(events, []).where(F.col("tool").isNotNull())
    window = Window.partitionBy("call", "tool").orderBy("ts", "ord")
    nth = rows.withColumn("calls_before", F.sum((F.col("kind") == "tool_call").cast("int")).over(window)).where("calls_before > 0")
    pairs = nth.groupBy("tool", "call", "calls_before").agg(
        F.min(F.when(F.col("kind") == "tool_call", epoch_ms(F.col("ts")))).alias("began"),
        F.min_by(F.when(F.col("kind") == "tool_result", epoch_ms(F.col("ts"))), F.when(F.col("kind") == "tool_result", F.struct("ts", "ord"))).alias("ended"),
    )
    taken = pairs.where("began IS NOT NULL AND ended IS NOT NULL").withColumn("ms", F.greatest(F.col("ended") - F.col("began"), F.lit(0)))
    ranks = lambda value, name: [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}_{name}") for p in (0.5, 0.95)]
    times = taken.groupBy("tool").agg(F.count(F.lit(1)).alias("timed"), *ranks("ms", "ms"))
    sizes = events.where(F.col("kind") == "tool_call").select(F.coalesce("p.name", F.lit("?")).alias("tool"), F.length(T.tool_arguments()).alias("size")).where("size IS NOT NULL")
    return times.join(sizes.groupBy("tool").agg(*ranks("size", "input")), "tool", "full_outer").withColumn("timed", F.coalesce("timed", F.lit(0)))


def tool_days(events: DataFrame) -> DataFrame:
    """Calls of each tool by day."""
    return events.where(F.col("kind") == "tool_call").groupBy(F.coalesce("p.name", F.lit("?")).alias("tool"), "day").agg(F.count(F.lit(1)).alias("calls"))


def tool_args(events: DataFrame) -> DataFrame:
    """The arguments of calls: tool, key, value as text."""
    body = T.tool_arguments()
    calls = events.where(F.col("kind") == "tool_call").select(F.coalesce("p.name", F.lit("?")).alias("tool"), F.from_json(body, "map<string,string>").alias("args"))
    return calls.select("tool", F.explode("args").alias("key", "value"))


def tool_arg_keys(events: DataFrame) -> DataFrame:
    """How often each argument is given."""
    return tool_args(events).groupBy("tool", "key").agg(F.count(F.lit(1)).alias("calls"))


def tool_arg_tops(events: DataFrame, kinds: int = 8, top: int = 3) -> DataFrame:
    """The commonest short values of arguments that have few distinct ones, some of them repeated."""
    counts = tool_args(events).where("length(value) <= 32").groupBy("tool", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("tool", "key").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).where((F.col("kinds") <= kinds) & (F.col("most") > 1)).select("tool", "key")
    rank = F.row_number().over(Window.partitionBy("tool", "key").orderBy(F.desc("n"), "value"))
    return counts.join(keys, ["tool", "key"]).withColumn("place", rank).where(F.col("place") <= top)


def last_samples(events: DataFrame, n: int = 3) -> DataFrame:
    """The last calls of each tool by arrival."""
    calls = events.where(F.col("kind") == "tool_call").select(F.coalesce("p.name", F.lit("?")).alias("tool"), "event_id", "ord")
    return calls.withColumn("place", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("ord")))).where(F.col("place") <= n).drop("ord")


#: What makes a session hard.
SIGNALS = ("thinking", "tools", "prompts", "duration_s")


def struggle(sessions: DataFrame) -> DataFrame:
    """The sum of a session's deviations from the means of SIGNALS, and its place among all sessions by that sum.

    Means, population deviations and places are over all sessions; those without prompts are left out at the end. Ties are
    broken by session_id.
    """
    sides = [x for name in SIGNALS for x in (F.avg(name).alias(f"mean_{name}"), F.greatest(F.stddev_pop(name), F.lit(1e-9)).alias(f"sd_{name}"))]
    deviation = reduce(lambda a, b: a + b, [(F.col(name) - F.col(f"mean_{name}")) / F.col(f"sd_{name}") for name in SIGNALS])
    scored = sessions.select("session_id", *SIGNALS).join(F.broadcast(sessions.agg(*sides))).select("session_id", F.round(deviation, 6).alias("score"), (F.col("prompts") > 0).alias("asked"))  # one row of statistics
    # range bounds are sampled anew by each reader, so the ranged rows are written once
    ranged = written(scored.repartitionByRange("score", "session_id").sortWithinPartitions("score", "session_id").withColumn("part", F.spark_partition_id()), "struggle")
    return _positions(ranged).where("asked").drop("asked")


def _positions(ranged: DataFrame) -> DataFrame:
    """(row number - 1) / (rows - 1) over rows that are range-partitioned and sorted: counts per part, then places in them."""
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    total = sizes.agg(F.sum("n").alias("total"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("score", "session_id"))).join(F.broadcast(offsets), "part").join(F.broadcast(total))
    return placed.select("session_id", "asked", "score", F.round((F.col("before") + F.col("place") - 1) / F.greatest(F.col("total") - 1, F.lit(1)), 6).alias("position"))


def longest_turns(events: DataFrame, k: int = 8, most: int = 600) -> DataFrame:
    """The k longest messages of each session by bytes, in the order in which they were written, each cut at `most` characters."""
    turns = events.where(F.col("kind").isin("user_prompt", "assistant_message") & (F.coalesce("p.text", F.lit("")) != "")).select("session_id", "event_id", "ord", F.octet_length("p.text").alias("bytes"), F.col("p.text").alias("text"))
    top = turns.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("bytes"), "ord"))).where(F.col("place") <= k)
    return top.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))).select("session_id", "event_id", "bytes", "nth", T.excerpt(F.col("text"), most).alias("text"))


def touched_files(events: DataFrame) -> DataFrame:
    """The distinct files that each session changed, in the order of their first change: session_id, touched."""
    token = T.file_token(F.col("p.local_path"))
    rows = events.where((F.col("kind") == "attachment_ref") & F.col("p.tool_name").isin(*FILE_TOOLS) & token.isNotNull() & (F.coalesce("session_id", F.lit("")) != ""))
    first = rows.groupBy("session_id", token.alias("file")).agg(F.min(F.struct(*_ORDER)).alias("at"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("touched"))
