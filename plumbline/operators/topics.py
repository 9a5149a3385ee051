"""From communities to topics: size floor, outliers, produced pull requests, labels and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T


def session_text(summary: Column, repo: Column, files: Column) -> Column:
    """What is embedded of a session: its repository and files, capped for themselves, then its summary."""
    head = T.excerpt(F.concat_ws(" ", F.lit("Session:"), F.coalesce(repo, F.lit("")), F.array_join(F.slice(files, 1, 8), " ")), 320)
    return T.excerpt(F.concat(head, F.lit(" — "), summary), 500)


def cluster_inputs(sessions: DataFrame, items: DataFrame, summaries: DataFrame) -> DataFrame:
    """What is embedded of each unit with a summary: a session's repository and files before it, an item's text behind it."""
    known = summaries.where(F.coalesce("summary", F.lit("")) != "").select("key", "summary")
    of_sessions = sessions.join(known, "key").select("key", session_text(F.col("summary"), F.col("repo"), F.col("files")).alias("text"))
    of_items = items.join(known, "key").select("key", T.excerpt(F.concat_ws(" ", "summary", F.coalesce("body", F.lit(""))), 500).alias("text"))
    return of_sessions.unionByName(of_items)


def at_least(assigned: DataFrame, least: int = 3) -> DataFrame:
    """Members of communities of at least `least`; the others become unassigned (null). Topics are numbered by size."""
    sizes = assigned.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    # a row a community: one task orders what is far smaller than the members
    numbered = sizes.withColumn("topic", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)
    return assigned.join(numbered, "community", "left").select("key", "topic")


def reassigned(assigned: DataFrame, neighbours: DataFrame, linked: DataFrame, passes: int = 5) -> DataFrame:
    """Outliers moved to the topic of their nearest neighbour outside their own; each pass reads the assignment before it.

    A member moves if its best neighbour in another topic is nearer than its best one in its own. An unassigned row joins
    its nearest topic only if it is in `linked` (key), the rows that have a mutual neighbour. Passes end when nothing moves.
    """
    current = assigned.select("key", "topic").checkpoint()
    mutual = linked.select("key").distinct().withColumn("mutual", F.lit(True)).checkpoint()
    for _ in range(passes):
        step = _moved(current, neighbours, mutual).checkpoint()
        current = step.select("key", F.col("next").alias("topic"))
        if step.where(~F.col("topic").eqNullSafe(F.col("next"))).isEmpty():
            break
    return current


def _moved(current: DataFrame, neighbours: DataFrame, mutual: DataFrame) -> DataFrame:
    """One pass: key, topic, next."""
    votes = neighbours.where("src <> dst").join(current.select(F.col("key").alias("dst"), F.col("topic").alias("vote")), "dst").where("vote IS NOT NULL")
    seen = current.join(votes.withColumnRenamed("src", "key"), "key", "left")
    elsewhere = F.coalesce(F.col("vote") != F.col("topic"), F.col("vote").isNotNull())
    best = seen.groupBy("key", "topic").agg(
        F.coalesce(F.max(F.when(F.col("vote") == F.col("topic"), F.col("weight"))), F.lit(0.0)).alias("own"),
        F.min_by(F.when(elsewhere, F.struct("vote", "weight")), F.when(elsewhere, F.col("place"))).alias("other"),
    )
    joins = F.col("topic").isNull() & F.coalesce("mutual", F.lit(False))
    moves = F.col("topic").isNotNull() & (F.col("other.weight") > F.col("own"))
    return best.join(mutual, "key", "left").select("key", "topic", F.when(F.col("other").isNotNull() & (joins | moves), F.col("other.vote")).otherwise(F.col("topic")).alias("next"))


def snapped(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """Sessions that produced a pull request take its topic; `links` has (key, linked)."""
    of_linked = assigned.where("topic IS NOT NULL").select(F.col("key").alias("linked"), F.col("topic").alias("linked_topic"))
    target = links.join(of_linked, "linked").groupBy("key").agg(F.min("linked_topic").alias("linked_topic"))
    return assigned.join(target, "key", "left").select("key", F.coalesce("linked_topic", "topic").alias("topic"))


def labels(members: DataFrame) -> DataFrame:
    """Each topic's shortest non-empty summary, cut at 60 characters."""
    usable = members.where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    return usable.groupBy("topic").agg(F.min(F.struct(F.octet_length("summary").alias("n"), F.col("summary").alias("s")))["s"].alias("s")).select("topic", T.excerpt(F.col("s"), 60).alias("label"))


def containing(topics: DataFrame, members: DataFrame, needle: str) -> DataFrame:
    """Topics whose label or a member's title contains a text, whatever the case."""
    by_member = members.where(F.lower("title").contains(needle.lower())).select("topic").distinct().withColumn("_hit", F.lit(True))
    return topics.join(by_member, "topic", "left").where(F.coalesce("_hit", F.lower("label").contains(needle.lower()))).drop("_hit")


def name_gate(members: DataFrame, names: DataFrame, factor: float = 0.85, floor: float = 0.5, least: int = 5) -> DataFrame:
    """Whether a topic's name is as close to its members as they are to each other.

    Members and names have token matrices (`matrix`, `rows`). A member's coherence is its mean MaxSim with the others
    over its tokens; the limit is `factor` of the tenth percentile, at least `floor`, and `floor` for small topics.
    """
    joined = members.select("topic", "matrix", "rows").join(names.select("topic", F.col("matrix").alias("name_matrix"), F.col("rows").alias("name_rows")), "topic")

    def gate(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.array(m, float).reshape(n, -1) for m, n in zip(rows["matrix"], rows["rows"], strict=True)]
        name = np.array(rows["name_matrix"].iloc[0], float).reshape(rows["name_rows"].iloc[0], -1)
        match = lambda a, b: float((a @ b.T).max(axis=1).sum()) / len(a)
        score = float(np.mean([match(name, s) for s in sets]))
        limit = floor
        if len(sets) >= least:
            inner = sorted(float(np.mean([match(s, o) for j, o in enumerate(sets) if j != i])) for i, s in enumerate(sets))
            limit = max(floor, factor * inner[(10 * (len(inner) - 1) + 50) // 100])
        return pd.DataFrame({"topic": [rows["topic"].iloc[0]], "score": [round(score, 5)], "limit": [round(limit, 5)], "accepted": [score >= limit]})

    # a topic is a bounded group: units are capped, and a name is judged by all members of its topic
    return joined.groupBy("topic").applyInPandas(lambda rows: gate(rows), "topic long, score double, limit double, accepted boolean")


def json_lines(frame: DataFrame, kind: str) -> DataFrame:
    """Rows as result envelopes."""
    return frame.select(F.to_json(F.struct(F.lit(1).alias("v"), F.lit(kind).alias("kind"), F.struct("*").alias("data"))).alias("json"))


def markdown(frame: DataFrame, most: int = 50) -> str:
    """At most so many rows as a Markdown table; for looking at results, so it is collected."""

    def lines() -> Iterator[str]:
        yield "| " + " | ".join(frame.columns) + " |"
        yield "|" + "-|" * len(frame.columns)
        for row in frame.limit(most).collect():
            yield "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |"

    return "\n".join(lines())
