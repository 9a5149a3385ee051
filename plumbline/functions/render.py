"""Column expressions for people: durations, token counts, meters and the lines of Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 52


def one_decimal(value: Column) -> Column:
    """A number of less than 2048 with one decimal, exact halves to the even digit, as C's printf writes it.

    The number's binary digits are taken apart, as rounding its decimal text would round twice.
    """
    whole = (value * float(1 << _BITS)).cast("long")
    high, low = F.shiftright(whole, _BITS), whole.bitwiseAND(F.lit((1 << _BITS) - 1))
    tenths, rest = high * 10 + F.shiftright(low * 10, _BITS), (low * 10).bitwiseAND(F.lit((1 << _BITS) - 1))
    half = F.lit(1 << (_BITS - 1))
    rounded = tenths + F.when((rest > half) | ((rest == half) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def duration(ms: Column) -> Column:
    """Milliseconds as ms, seconds, minutes or hours; a dash if unknown."""
    hours = F.when(ms < 2048 * 3_600_000, one_decimal(ms / 3_600_000.0)).otherwise(F.format_string("%.1f", ms / 3_600_000.0))
    return (
        F.when(ms.isNull(), "—")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(one_decimal(ms / 1000.0), F.lit("s")))
        .when(ms < 3_600_000, F.concat(one_decimal(ms / 60_000.0), F.lit("m")))
        .otherwise(F.concat(hours, F.lit("h")))
    )


def duration_label(ms: Column, source: Column) -> Column:
    """A duration and where it is from."""
    return F.concat(duration(ms), F.when(source == "reported", " reported").when(source == "event_gap", " event-gap").otherwise(""))


def offset(ms: Column) -> Column:
    """Minutes and seconds from a beginning."""
    seconds = F.floor(ms / 1000)
    two = lambda n: F.concat(F.when(n < 10, "0").otherwise(""), n.cast("string"))
    return F.concat(two(F.floor(seconds / 60)), F.lit(":"), two(seconds % 60))


def token_count(n: Column) -> Column:
    """A count as 999, 46.1k, 1.2M or 2.5B; a zero behind the point is left out."""

    def scaled(unit: float, suffix: str) -> Column:
        return F.concat(F.regexp_replace(one_decimal(n / unit), r"\.0$", ""), F.lit(suffix))

    billions = F.when(n < 2048 * 1_000_000_000, scaled(1e9, "B")).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", n / 1e9), r"\.0$", ""), F.lit("B")))
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, scaled(1e3, "k")).when(n < 1_000_000_000, scaled(1e6, "M")).otherwise(billions)


def meter(score: Column) -> Column:
    """Five dots for a score from 0 to 1."""
    filled = F.least(F.greatest(F.round(score * 5), F.lit(0)), F.lit(5)).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("●"), filled), F.repeat(F.lit("○"), F.lit(5) - filled), F.lit("]"))


def usage_line(tok_in: Column, tok_out: Column, cache_read: Column, cache_create: Column, turns: Column) -> Column:
    """The tokens of a session; null where none were recorded, as no number beats a made-up 0."""
    parts = [F.lit("tokens: "), token_count(tok_in), F.lit(" in · "), token_count(tok_out), F.lit(" out · "), token_count(cache_read), F.lit(" cache-read · "), token_count(cache_create), F.lit(" cache-write")]
    line = F.concat(*parts, F.when(turns > 0, F.concat(F.lit(" · "), turns.cast("string"), F.lit(" turns"))).otherwise(""))
    return F.when(has_usage(tok_in, tok_out, cache_read, cache_create), line)


def has_usage(*tokens: Column) -> Column:
    """Whether a session recorded any tokens."""
    total = F.lit(0)
    for column in tokens:
        total = total + F.coalesce(column, F.lit(0))
    return total > 0


def tools_line(tools: Column, errors: Column) -> Column:
    """The six tools with the most calls, how many more there are, and errors. `tools` are structs (tool, calls) in order."""
    shown = F.array_join(F.transform(F.slice(tools, 1, 6), lambda t: F.concat(t["tool"], F.lit("×"), t["calls"].cast("string"))), " · ")
    more = F.when(F.size(tools) > 6, F.concat(F.lit(" (+"), (F.size(tools) - 6).cast("string"), F.lit(" more)"))).otherwise("")
    failed = F.when(errors > 0, F.concat(F.lit(" · "), errors.cast("string"), F.lit(" errors"))).otherwise("")
    return F.when(F.size(tools) > 0, F.concat(F.lit("tools: "), shown, more, failed))


def or_dash(text: Column) -> Column:
    """A text, or a dash if it is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(text)


def short(key: Column) -> Column:
    """The first eight characters of an id."""
    return F.left(key, F.lit(8))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)^\s*(\S(?:[^\r\n]*\S)?)", 1)


# Lines of reports: each takes the columns of its operator and gives one column, `line`.


def work_lines(units: DataFrame) -> DataFrame:
    """Units of a feed: day, kind, title and outcome."""
    return units.select("key", F.concat(F.lit("- `"), "day", F.lit("` "), "unit", F.lit(" **"), F.col("title"), F.lit("** · "), F.col("outcome"), F.lit(" ["), short(F.col("key")), F.lit("]")).alias("line"))


def topic_lines(topics: DataFrame) -> DataFrame:
    """Topics: label, size, mix and last day."""
    mix = F.concat_ws(" · ", F.concat(F.col("sessions").cast("string"), F.lit(" sessions")), F.concat(F.col("prs").cast("string"), F.lit(" PRs")))
    return topics.select("topic", F.concat(F.lit("- **"), F.col("label"), F.lit("** · "), F.col("size").cast("string"), F.lit(" units · "), mix, F.lit(" · last "), F.col("last_active")).alias("line"))


def tally_lines(tallies: DataFrame, key: str) -> DataFrame:
    """Counts of a status report: documents, sessions, tokens and calls of each value."""
    return tallies.select(key, F.concat(F.lit("- "), or_dash(F.col(key)), F.lit(": "), F.col("docs").cast("string"), F.lit(" docs · "), F.col("sessions").cast("string"), F.lit(" sessions · "), token_count(F.col("tok_out")), F.lit(" tokens out · "), F.col("tools").cast("string"), F.lit(" tool calls")).alias("line"))


def week_lines(weeks: DataFrame) -> DataFrame:
    """Weeks of a statistics report."""
    return weeks.select("week", F.concat(F.lit("- `"), "week", F.lit("` "), token_count(F.col("tok_in")), F.lit(" in · "), token_count(F.col("tok_out")), F.lit(" out · "), F.col("tools").cast("string"), F.lit(" tool calls · "), F.col("sessions").cast("string"), F.lit(" sessions")).alias("line"))


def tool_lines(tools: DataFrame) -> DataFrame:
    """Tools: calls, errors and sizes of results."""
    size = F.concat(F.lit(" · result chars p50 "), F.col("p50").cast("string"), F.lit(", p95 "), F.col("p95").cast("string"))
    return tools.select("tool", F.concat(F.lit("- **"), F.col("tool"), F.lit("** · "), F.col("calls").cast("string"), F.lit(" calls · "), F.col("errors").cast("string"), F.lit(" errors"), F.coalesce(size, F.lit("")), F.lit(" · "), F.col("days").cast("string"), F.lit(" days")).alias("line"))


def machine_lines(machines: DataFrame) -> DataFrame:
    """Machines of the fleet."""
    state = F.when(F.col("quiet"), " · quiet").otherwise("")
    return machines.select("machine", F.concat(F.lit("- **"), F.col("machine"), F.lit("** · "), or_dash(F.col("sources")), F.lit(" · last "), F.substring("last_ts", 1, 10), F.lit(" · "), F.col("recent").cast("string"), F.lit(" events · v"), or_dash(F.col("version")), state).alias("line"))


def turn_lines(turns: DataFrame) -> DataFrame:
    """Turns: status, duration, spans, errors and what was asked."""
    return turns.select("turn_id", F.concat(F.lit("- ["), short(F.col("turn_id")), F.lit("] "), F.col("status"), F.lit(" · "), duration(F.col("duration_ms")), F.lit(" · "), F.col("spans").cast("string"), F.lit(" spans · "), F.col("errors").cast("string"), F.lit(" errors · "), or_dash(F.col("ask"))).alias("line"))


def span_lines(spans: DataFrame) -> DataFrame:
    """Spans: operation, status, duration and input."""
    return spans.select("span_id", F.concat(F.lit("- ["), short(F.col("span_id")), F.lit("] "), F.col("operation"), F.lit(" → "), F.col("status"), F.lit(" · "), duration_label(F.col("duration_ms"), F.col("duration_source")), F.lit(" · "), or_dash(F.col("input"))).alias("line"))


def job_lines(jobs: DataFrame) -> DataFrame:
    """Jobs: command, status, times, polls and errors."""
    return jobs.select("job_id", F.concat(F.lit("- ["), short(F.substring("job_id", 5, 1000)), F.lit("] "), F.col("command"), F.lit(" → "), F.col("status"), F.lit(" · "), duration(F.col("elapsed_ms")), F.lit(" elapsed · "), duration(F.col("wait_ms")), F.lit(" reported-wait · "), F.col("polls").cast("string"), F.lit(" polls · "), F.col("errors").cast("string"), F.lit(" errors")).alias("line"))


def session_lines(sessions: DataFrame) -> DataFrame:
    """Sessions: head, span of days, effort, counts, tokens, tools, linked item and files, each line where there is something."""
    return sessions.select(
        "session_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("session "), short(F.col("session_id")), F.lit(" · "), or_dash(F.col("repo"))),
            F.concat(F.lit("id: "), F.col("session_id")),
            F.concat(F.substring("started", 1, 10), F.lit(" → "), F.substring("ended", 1, 10)),
            F.concat(F.lit("effort "), meter(F.col("position"))),
            F.concat(F.col("prompts").cast("string"), F.lit(" prompts · "), F.col("assistant").cast("string"), F.lit(" assistant · "), F.col("thinking").cast("string"), F.lit(" thinking · "), F.col("tools").cast("string"), F.lit(" tool calls")),
            usage_line(F.col("tok_in"), F.col("tok_out"), F.col("cache_read"), F.col("cache_create"), F.col("usage_turns")),
            tools_line(F.col("tools_by_name"), F.col("errors")),
            F.concat(F.lit("linked PR: "), F.col("linked")),
            F.when(F.size("touched") > 0, F.concat(F.lit("files: "), F.array_join(F.slice("touched", 1, 10), ", "))),
        ).alias("line"),
    )


def item_lines(items: DataFrame) -> DataFrame:
    """Pull requests and issues: head, state, author, topic and the beginning of the text."""
    head = F.concat(F.col("kind"), F.lit(" "), F.col("repo"), F.lit("#"), F.col("number").cast("string"))
    return items.select("key", F.concat_ws("\n", head, F.concat(or_dash(F.col("state")), F.lit(" · "), or_dash(F.col("author"))), F.concat(F.lit("topic: "), F.col("topic_label")), first_line(F.col("text"))).alias("line"))
