"""Documents from events, capture boundary, recency cap and stable order."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.sessions import is_prompt
from plumbline.sources.envelopes import epoch_ms

DOC_CHARS, LEAST_BYTES = 6000, 12


def docs_from_events(events: DataFrame, local_actor: str = "") -> DataFrame:
    """Messages worth indexing, with the author of their session: the last non-empty actor of its starts."""
    body = F.trim(F.coalesce(F.col("p.text"), F.lit("")))
    wanted = is_prompt() | (F.col("kind").isin("assistant_message", "thinking") & (F.octet_length(body) >= LEAST_BYTES) & ~T.is_noise(body))
    starts = events.where((F.col("kind") == "session_start") & (F.coalesce("p.actor", F.lit("")) != ""))
    actors = starts.groupBy("session_id").agg(F.max_by("p.actor", F.struct("ts", "ord")).alias("author"))
    docs = events.where(wanted).select("event_id", "session_id", "source", "kind", "ts", "ord", F.left(body, F.lit(DOC_CHARS)).alias("text"))
    return docs.join(actors, "session_id", "left").withColumn("author", F.coalesce("author", F.lit(local_actor))).withColumn("chars", F.length("text").cast("long"))


def normal_since(raw: str, now: datetime | None = None) -> str:
    """A boundary given as 'now', a day or an RFC 3339 time, as UTC to the second."""
    if raw.lower() == "now":
        moment = now or datetime.now(UTC)
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw):
        moment = datetime.fromisoformat(raw).replace(tzinfo=UTC)
    else:
        moment = datetime.fromisoformat(raw)
        if moment.tzinfo is None:
            raise ValueError("a boundary is now, a day or an RFC 3339 time")
    return moment.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def capture_boundary(events: DataFrame, since: str) -> DataFrame:
    """Events at or after a moment; session starts and events whose time can't be read stay."""
    cut = epoch_ms(F.lit(since))
    return events.where((F.col("kind") == "session_start") | F.coalesce(F.col("ts_ms") >= cut, F.lit(True)))


def visible_sessions(events: DataFrame, since: str) -> DataFrame:
    """The events of sessions that keep something but their start behind the boundary."""
    kept = capture_boundary(events, since)
    seen = kept.where((F.col("kind") != "session_start") & (F.col("session_id") != "")).select("session_id").distinct()
    return kept.join(seen, "session_id", "left_semi")


def recency_cap(docs: DataFrame, cap: int) -> DataFrame:
    """All documents up to `cap`; beyond it the newest, a tenth fewer than the cap, so that it isn't hit again at once."""
    newest = docs.orderBy(F.desc("ts"), F.desc("ord")).limit(cap + 1).withColumn("_place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("ord"))))
    total = newest.agg(F.count(F.lit(1)).alias("_total"))  # the cap bounds what one task orders; nothing runs while the plan is built
    return newest.join(F.broadcast(total)).where((F.col("_total") <= cap) | (F.col("_place") <= cap - cap // 10)).drop("_place", "_total")


def stable_order(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The place of each current document: that of its content in the previous order, new ones behind in their order.

    Both have `hash` and `pos`; equal contents are matched in order of place.
    """
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("pos"))
    old = previous.select("hash", "pos").withColumn("nth", nth).withColumnRenamed("pos", "old_pos")
    matched = current.select("hash", "pos").withColumn("nth", nth).join(old, ["hash", "nth"], "left")
    return matched.select("hash", "pos", "old_pos", F.col("old_pos").isNull().alias("is_new"))


def departed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Contents of the previous order that are gone, as a multiset difference."""
    return previous.select("hash").exceptAll(current.select("hash"))


#: A patch is given up if more than one in so many documents departed.
PATCH_SHARE = 5


def reconciled(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What to do to an index: the old place of each document that departed, and how many stay. No row says: build anew.

    Both have hash and pos; the n-th of equal contents matches the n-th. Too many departures mean another corpus.
    """
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("pos"))
    old, new = (t.select("hash", "pos").withColumn("nth", nth) for t in (previous, current))
    marked = old.join(new.select("hash", "nth", F.lit(True).alias("stays")), ["hash", "nth"], "left")
    totals = marked.agg(F.count(F.lit(1)).alias("total"), F.count("stays").alias("survivors"))
    gone = marked.where("stays IS NULL").select(F.col("pos").alias("deleted"))
    return gone.join(F.broadcast(totals)).where((F.col("total") - F.col("survivors")) * PATCH_SHARE <= F.greatest(F.col("total"), F.lit(1))).select("deleted", "survivors")  # one row of totals


def all_docs(of_sessions: DataFrame, of_items: DataFrame) -> DataFrame:
    """Documents of sessions and of the forge as one table; what one side doesn't have is null."""
    return of_items.unionByName(of_sessions, allowMissingColumns=True)


def result_fields(events: DataFrame) -> DataFrame:
    """What tool results say of exit codes, times and running processes."""
    output = T.result_output()
    return events.where("kind = 'tool_result'").select("event_id", T.exit_code(output).alias("exit_code"), T.wall_time_ms(output).alias("wall_ms"), T.output_process_id(output).alias("process_id"))
