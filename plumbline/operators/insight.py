"""Views over documents and sessions: status, fleet coverage, scope, units, topics, terms, order and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T


def metadata_filter(rows: DataFrame, expression: str) -> DataFrame:
    """One column=value, split at the first equals sign; resolved before anything is ranked."""
    column, found, value = expression.partition("=")
    if not found or column.strip() not in rows.columns:
        raise ValueError("a filter is column=value")
    return rows.where(F.col(column.strip()).cast("string") == value.strip())


def status_by(rows: DataFrame, key: str) -> DataFrame:
    """Documents, documents of the forge and distinct sessions of each value of a column."""
    return rows.groupBy(F.coalesce(key, F.lit("")).alias(key)).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("source") == "github").alias("github_docs"), F.count_distinct("session_id").alias("sessions"))


def status_with_spend(rows: DataFrame, spend: DataFrame, key: str) -> DataFrame:
    """The same with tokens and calls folded from sessions; values that only sessions have are added."""
    joined = status_by(rows, key).join(spend.groupBy(F.coalesce(key, F.lit("")).alias(key)).agg(F.sum("tok_out").alias("tok_out"), F.sum("tools").alias("tools")), key, "full_outer")
    return joined.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "github_docs", "sessions", "tok_out", "tools")])


def fleet_machines(events: DataFrame, newest: str, quiet_days: int = 7, window_days: int = 30) -> DataFrame:
    """Each machine of the fleet: last event, sources, actors, version at its newest start, recent events, quietness."""
    rows = events.where(F.col("stream").rlike("^edge-.+-[^-]+$")).withColumn("machine", T.machine_of_fleet(F.col("stream")))
    start = F.col("kind") == "session_start"
    now = F.to_date(F.lit(newest))
    return rows.groupBy("machine").agg(
        F.max("ts").alias("last_ts"),
        F.array_join(F.array_sort(F.collect_set(T.agent_label(F.col("source")))), "+").alias("sources"),
        F.count_distinct(F.when(start, F.col("p.actor"))).alias("actors"),
        F.max_by(F.when(start, F.col("p.tracker_version")), F.when(start, F.struct("ts", "ord"))).alias("version"),
        F.count_if(F.to_date("day") > F.date_sub(now, window_days)).alias("recent"),
        (F.max(F.to_date("day")) < F.date_sub(now, quiet_days)).alias("quiet"),
    )


def tracked_actors(events: DataFrame) -> DataFrame:
    """The actors of session starts with the last time of their machine: actor, ts."""
    rows = events.where(F.col("stream").rlike("^edge-.+-[^-]+$")).withColumn("machine", T.machine_of_fleet(F.col("stream")))
    last = rows.groupBy("machine").agg(F.max("ts").alias("ts"))
    named = rows.where((F.col("kind") == "session_start") & (F.coalesce("p.actor", F.lit("")) != "")).select("machine", F.col("p.actor").alias("actor")).distinct()
    return named.join(last, "machine").select("actor", "ts")


def roster(events: DataFrame, authors: DataFrame, newest: str, since: str, members: DataFrame | None = None, ignored: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fleet: its machines, the share of active authors that are tracked, and those who aren't."""
    return fleet_machines(events, newest), *fleet_coverage(tracked_actors(events), authors, members, ignored, since)


def fleet_coverage(actors: DataFrame, authors: DataFrame, members: DataFrame | None = None, ignored: tuple[str, ...] = (), since: str = "") -> tuple[DataFrame, DataFrame]:
    """How many active authors are tracked, in whole percent, and which aren't. Logins compare whatever the case.

    `actors` has actor and the last time of a machine of theirs (ts), `authors` has author, ts and the agent that an item
    is attributed to. Only what is at or after `since` counts. An untracked author carries the agent of their first
    attributed item; the attributed ones come first in `place`.
    """
    tracked = actors.where((F.coalesce("actor", F.lit("")) != "") & (F.col("ts") >= since)).select(F.lower("actor").alias("login")).distinct()
    mentioned = F.coalesce("agent", F.lit("")) != ""
    recent = authors.where((F.coalesce("author", F.lit("")) != "") & (F.col("ts") >= since))
    active = recent.groupBy(F.lower("author").alias("login")).agg(F.count(F.lit(1)).alias("items"), F.min_by(F.when(mentioned, F.col("agent")), F.when(mentioned, F.struct("ts", "agent"))).alias("agent"))
    if ignored:
        active = active.where(~F.col("login").isin(*[x.lower() for x in ignored]))
    if members is not None:
        active = active.join(members.select(F.lower("login").alias("login")).distinct(), "login", "left_semi")
    else:
        active = active.where(~T.is_bot(F.col("login")))
    marked = active.join(tracked.withColumn("tracked", F.lit(1)), "login", "left")
    rate = marked.agg(F.count(F.lit(1)).alias("active"), F.count("tracked").alias("both")).withColumn("percent", F.when(F.col("active") > 0, F.expr("100 * both div active")).otherwise(0).cast("long"))
    untracked = active.join(tracked, "login", "left_anti").withColumn("agent", F.coalesce("agent", F.lit("")))
    return rate, untracked.withColumn("place", F.row_number().over(Window.orderBy(F.col("agent") == "", "login")))  # people, not rows of data


def units_feed(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions with prompts and the forge's items as one feed, newest first."""
    of_sessions = sessions.where("prompts > 0").select(
        F.col("session_id").alias("key"), F.lit("session").alias("unit"), F.substring("ended", 1, 10).alias("day"), F.coalesce("ask", F.lit("")).alias("title"),
        F.when(F.col("linked").isNotNull(), F.concat(F.lit("→ "), F.col("linked"))).when(F.col("files") > 0, F.concat(F.col("files"), F.lit(" files"))).otherwise(F.concat(F.col("prompts"), F.lit(" prompts"))).alias("outcome"),
    )
    of_items = items.select(F.concat(F.lit("gh:"), F.col("repo"), F.lit("#"), F.col("number")).alias("key"), F.lit("pr").alias("unit"), "day", "title", F.lower("state").alias("outcome"))
    return of_sessions.unionByName(of_items)


def topic_facets(units: DataFrame) -> DataFrame:
    """Each topic's size, span and mix of units."""
    return units.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("day").alias("first_day"), F.max("day").alias("last_active"), F.count_if(F.col("unit") == "session").alias("sessions"), F.count_if(F.col("unit") == "pr").alias("prs"))


def topic_activity(units: DataFrame, weeks: int) -> DataFrame:
    """Units of each topic in trailing weeks, counted back from its own newest day."""
    last = units.groupBy("topic").agg(F.max("day").alias("last_day"))
    aged = units.join(last, "topic").withColumn("week", F.floor(F.datediff(F.to_date("last_day"), F.to_date("day")) / 7).cast("int")).where(F.col("week") < weeks)
    return aged.groupBy("topic", "week").agg(F.count(F.lit(1)).alias("units"))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each key by frequency, ties by name."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value)))


def lineage(previous: DataFrame, current: DataFrame, least: float = 0.5) -> DataFrame:
    """The previous topic that each current one goes on from: the greatest Jaccard overlap of members of `least` or more.

    A previous topic goes on in one current topic only, the larger one. As a member is in one topic before and in one
    after, overlaps of a half or more meet only where two topics are the halves of one, so that one choice each way is
    what choosing topic by topic gives.
    """
    if least < 0.5:
        raise ValueError("overlaps below a half would have to be chosen one after the other")
    sizes = lambda t, n: t.groupBy("topic").agg(F.count(F.lit(1)).alias(n))
    both = current.select(F.col("topic").alias("new_topic"), "member").join(previous.select(F.col("topic").alias("old_topic"), "member"), "member").groupBy("new_topic", "old_topic").agg(F.count(F.lit(1)).alias("shared"))
    joined = both.join(sizes(current, "n_new").withColumnRenamed("topic", "new_topic"), "new_topic").join(sizes(previous, "n_old").withColumnRenamed("topic", "old_topic"), "old_topic")
    scored = joined.withColumn("jaccard", F.round(F.col("shared") / (F.col("n_new") + F.col("n_old") - F.col("shared")), 6)).where(F.col("jaccard") >= least)
    best = F.row_number().over(Window.partitionBy("new_topic").orderBy(F.desc("jaccard"), "old_topic"))
    first = F.row_number().over(Window.partitionBy("old_topic").orderBy(F.desc("n_new"), "new_topic"))
    chosen = scored.withColumn("_n", best).where("_n = 1").withColumn("_taken", first).where("_taken = 1")
    return chosen.select("new_topic", "old_topic", "jaccard")


def cluster_words(members: DataFrame) -> DataFrame:
    """The distinct content words of each member: cluster, member, word."""
    return members.select("cluster", "member", F.explode(T.content_words(F.col("text"))).alias("word"))


def cluster_idf(members: DataFrame) -> DataFrame:
    """Smoothed inverse cluster frequency of each word: ln((1 + N) / (1 + cf)) + 1."""
    total = members.agg(F.count_distinct("cluster").alias("n"))
    frequency = cluster_words(members).groupBy("word").agg(F.count_distinct("cluster").alias("cf"))
    return frequency.join(F.broadcast(total)).select("word", "cf", F.round(F.log((F.col("n") + 1) / (F.col("cf") + 1)) + 1, 6).alias("idf"))  # one row of totals


def cluster_terms(members: DataFrame, k: int) -> DataFrame:
    """The k most distinctive words of each cluster."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    frequency = cluster_words(members).groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("df"))
    scored = frequency.join(sizes, "cluster").join(cluster_idf(members), "word").withColumn("score", F.round(F.col("df") / F.col("n") * F.col("idf"), 6))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("cluster", "word", "score", "place")


def keyword_labels(members: DataFrame, k: int = 3) -> DataFrame:
    """Each cluster's top words as a label."""
    top = cluster_terms(members, k).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("top"))
    return top.select("cluster", F.array_join(F.transform("top", lambda x: x["word"]), " · ").alias("label"))


def related_terms(texts: DataFrame, most: int = 40) -> DataFrame:
    """The first distinct words of each query text, in order."""
    found = texts.select("key", F.posexplode(T.query_words(F.col("text"))).alias("pos", "word")).groupBy("key", "word").agg(F.min("pos").alias("pos"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where(F.col("place") <= most).select("key", "word", "place")


def manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What to do with each file so that the local side equals the remote one: add, replace, remove, keep."""
    joined = local.select("file", F.col("hash").alias("local_hash")).join(remote.select("file", F.col("hash").alias("remote_hash")), "file", "full_outer")
    return joined.select("file", F.when(F.col("local_hash").isNull(), "add").when(F.col("remote_hash").isNull(), "remove").when(F.col("local_hash") != F.col("remote_hash"), "replace").otherwise("keep").alias("action"))


def fresher_manifest(local: DataFrame, remote: DataFrame, local_at: str, remote_at: str) -> DataFrame:
    """What to do with each file so that the local side takes over a scrape that is newer than its own; else nothing."""
    actions = manifest_diff(local, remote).where("action <> 'keep'")
    return actions if remote_at > local_at else actions.limit(0)


def pending(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs whose key and input hash aren't in the cache."""
    return jobs.join(cache.select("key", "hash"), ["key", "hash"], "left_anti")


def upsert_merge(old: DataFrame, new: DataFrame, oldest: str) -> DataFrame:
    """A scrape folded into the items at hand: replaced by number, those from before `oldest` dropped."""
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy("repo", "number").orderBy(F.desc("batch")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n").where(F.col("created") >= oldest)


def hit_at(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Share of queries with a gold answer among the first k."""
    hits = ranked.where(F.col("place") <= k).join(gold, ["query", "answer"], "left_semi").select("query").distinct().withColumn("hit", F.lit(1))
    return gold.select("query").distinct().join(hits, "query", "left").agg(F.count(F.lit(1)).alias("queries"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("rate"))
