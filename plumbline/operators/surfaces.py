"""What a reader asks for: search, related, topics, recent, status, show, and the inputs of summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.encode import Encoder, encoded, hashing_encoder
from plumbline.functions.render import first_line
from plumbline.operators import insight, sessions, vectors
from plumbline.operators.access import ReadScope, clamped, needle_of, scope_filter

#: Words of a query that is made from recent work.
QUERY_WORDS = 40
#: What a filter may name.
RESULT_FIELDS = ("key", "score")


def search(units: DataFrame, query: np.ndarray, k: int = 5, expression: str = "", scope: ReadScope | None = None) -> DataFrame:
    """The k units of greatest MaxSim with a query matrix, among those that a filter and a scope allow: key, score.

    `units` have key, matrix, rows and the columns that filters name. What isn't allowed is left out before anything is
    scored, so k results come if there are as many.
    """
    if expression:
        units = insight.metadata_filter(units, expression)
    if scope is not None:
        units = scope_filter(units, scope)
    return vectors.maxsim_topk(units.select("key", "matrix", "rows"), query, clamped(k, 1, 100))


def query_matrix(spark: SparkSession, text: str, encoder: Encoder = hashing_encoder) -> np.ndarray:
    """The matrix of one query text."""
    row = encoded(spark.createDataFrame([(needle_of(text),)], "text string"), "text", encoder).first()
    return np.array(row.matrix, float).reshape(row.rows, -1)


def search_text(units: DataFrame, text: str, k: int = 5, expression: str = "", scope: ReadScope | None = None, encoder: Encoder = hashing_encoder) -> DataFrame:
    """`search` by a text over units with a `text`."""
    if expression:
        units = insight.metadata_filter(units, expression)
    if scope is not None:
        units = scope_filter(units, scope)
    return search(encoded(units, "text", encoder), query_matrix(units.sparkSession, text, encoder), k)


def recent_work(spark: SparkSession, subjects: str, files: str) -> list[str]:
    """The words of a query from commit subjects and changed files: of a path, its name up to the first point.

    Distinct words in the order of their first appearance, subjects first, at most QUERY_WORDS. The inputs are a commit
    log's, not data.
    """
    stem = F.regexp_extract("line", r"([^/]*)$", 1)
    stems = F.when(F.instr(stem, ".") > 0, F.regexp_extract(stem, r"^([^.]*)\.", 1)).otherwise(stem)
    rows = [(0, i, line) for i, line in enumerate(subjects.splitlines())] + [(1, i, line) for i, line in enumerate(files.splitlines())]
    lines = spark.createDataFrame(rows, "part int, n int, line string").withColumn("text", F.when(F.col("part") == 0, F.col("line")).otherwise(stems))
    found = lines.select("part", "n", F.posexplode(T.query_words(F.col("text"))).alias("pos", "word")).groupBy("word").agg(F.min(F.struct("part", "n", "pos")).alias("first"))
    return [r.word for r in found.orderBy("first").limit(QUERY_WORDS).collect()]


def related(units: DataFrame, subjects: str, files: str, k: int = 5, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Units near the work at hand: a search by its words, without a filter. Without words there are none."""
    words = recent_work(units.sparkSession, subjects, files)
    if not words:
        return units.select("key", F.lit(0.0).alias("score")).limit(0)
    return search_text(units, " ".join(words), k, encoder=encoder)


def cards(hits: DataFrame, units: DataFrame, most: int = 200) -> DataFrame:
    """Search hits with the beginning of their texts, best first."""
    joined = hits.join(units.select("key", T.excerpt(F.col("text"), most).alias("text")), "key")
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "key")))  # at most a hundred rows


# Units, topics and what belongs to them.


def with_topics(units: DataFrame, topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Units (key) with their topic and rank and their summary; an empty summary counts as none."""
    known = summaries.where(F.coalesce("summary", F.lit("")) != "").select("key", "summary")
    return units.join(topics.select("key", "topic", "rank"), "key", "left").join(known, "key", "left")


def items_as_units(items: DataFrame) -> DataFrame:
    """The forge's items as units: key, unit, day, repo, title, outcome, author, source."""
    key = F.concat(F.lit("gh:"), F.col("repo"), F.lit("#"), F.coalesce("number", F.lit(0)).cast("string"))
    title = F.concat(F.col("repo"), F.lit("#"), F.coalesce("number", F.lit(0)).cast("string"), F.lit(" "), first_line(F.col("text")))
    unit = F.when(F.col("kind") == "pull_request", "pr").when(F.col("kind") == "issue", "issue")
    return items.select(key.alias("key"), unit.alias("unit"), F.substring("ts", 1, 10).alias("day"), "repo", title.alias("title"), F.coalesce("state", F.lit("")).alias("outcome"), "author", "source").where("unit IS NOT NULL")


def _by_count(rows: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of each topic, most frequent first."""
    counts = rows.where(F.coalesce(column, F.lit("")) != "").groupBy("topic", column).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))))
    return counts.groupBy("topic").agg(F.transform(ordered, lambda x: x["v"]).alias(f"{column}s"))


def weekly_counts(units: DataFrame, weeks: int) -> DataFrame:
    """Units of each topic by week, counted back from its own newest day: an array of `weeks` counts, oldest first."""
    if weeks < 1:
        raise ValueError("there is a week at least")
    found = insight.topic_activity(units.where(F.to_date("day").isNotNull()), weeks)
    by_week = F.map_from_entries(F.collect_list(F.struct("week", "units")))
    counts = found.groupBy("topic").agg(by_week.alias("m")).select("topic", F.transform(F.sequence(F.lit(weeks - 1), F.lit(0)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0))).alias("activity"))
    empty = F.array_repeat(F.lit(0).cast("long"), weeks)
    return units.select("topic").distinct().join(counts, "topic", "left").select("topic", F.coalesce("activity", empty).alias("activity"))


def topic_units(units: DataFrame, labels: DataFrame, weeks: int = 12, scope: ReadScope | None = None) -> DataFrame:
    """Topics and what their units say: label, size, first and last day, mix, weekly activity, repositories and authors.

    A restricted scope takes its units alone and makes everything anew; as labels describe the whole topic, its label is
    then the title of its most central unit. `units` have topic, unit, day, repo, author, rank, title.
    """
    units = units.where("topic IS NOT NULL")
    if scope is not None and scope.restricted:
        units = scope_filter(units, scope)
        labels = units.groupBy("topic").agg(F.min_by("title", F.struct("rank", "title")).alias("label"))
    facets = units.groupBy("topic").agg(
        F.count(F.lit(1)).alias("size"), F.min("day").alias("first_day"), F.max("day").alias("last_active"), F.count_if(F.col("unit") == "session").alias("sessions"), F.count_if(F.col("unit") == "pr").alias("prs"), F.count_if(F.col("unit") == "issue").alias("issues")
    )
    joined = facets.join(weekly_counts(units, weeks), "topic").join(labels.select("topic", "label"), "topic", "left")
    for column in ("repo", "author"):
        joined = joined.join(_by_count(units, column), "topic", "left").withColumn(f"{column}s", F.coalesce(f"{column}s", F.array().cast("array<string>")))
    return joined.withColumn("label", F.coalesce("label", F.lit("")))


def topics(found: DataFrame, units: DataFrame, needle: str = "", limit: int = 12) -> DataFrame:
    """Topics whose label or a unit's title contains a text, those that were active last first, then the larger ones."""
    if needle:
        low = needle_of(needle).lower()
        by_unit = units.where(F.lower("title").contains(low)).select("topic").distinct().withColumn("_hit", F.lit(True))
        found = found.join(by_unit, "topic", "left").where(F.coalesce("_hit", F.lit(False)) | F.lower("label").contains(low)).drop("_hit")
    return found.orderBy(F.desc("last_active"), F.desc("size"), "topic").limit(clamped(limit, 1, 100))


def recent(units: DataFrame, repo: str = "", limit: int = 20, scope: ReadScope | None = None) -> DataFrame:
    """The newest units of a repository or of all; on one day sessions stand before items, then by key."""
    if repo:
        units = units.where(F.col("repo") == repo)
    if scope is not None:
        units = scope_filter(units, scope)
    return units.orderBy(F.desc("day"), F.col("unit") != "session", "key").limit(clamped(limit, 1, 100))


def sessions_in_order(rolled: DataFrame) -> DataFrame:
    """Sessions with prompts, those that ended last first."""
    return rolled.where("prompts > 0").orderBy(F.desc("ended"), "session_id")


def member_hashes(units: DataFrame) -> DataFrame:
    """Each topic's members' hashes, the most central first, without those that another unit stands for."""
    kept = units.where("topic IS NOT NULL AND NOT dup")
    return kept.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hash"))), lambda x: x["hash"]).alias("hashes"))


def day_strip(units: DataFrame, newest: str, days: int = 28) -> DataFrame:
    """Units of each topic on each of `days` days from the Monday three weeks before that of the newest day, oldest first."""
    start = F.date_sub(sessions.monday_of(F.lit(newest)), days - 7)
    aged = units.withColumn("slot", F.datediff(F.to_date("day"), start)).where(F.col("slot").between(0, days - 1))
    by_day = F.map_from_entries(F.collect_list(F.struct("slot", "n")))
    counts = aged.groupBy("topic", "slot").agg(F.count(F.lit(1)).alias("n")).groupBy("topic").agg(by_day.alias("m"))
    return counts.select("topic", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0))).alias("strip"))


def neighbour_dump(neighbours: DataFrame, assigned: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """Why a unit is where it is: the first neighbours of units whose key contains a text, with their topics."""
    wanted = neighbours.where(F.col("src").cast("string").contains(needle) & (F.col("place") <= most) & (F.col("src") != F.col("dst")))
    topic = lambda x: assigned.select(F.col("key").alias(x), F.col("topic").alias(f"{x}_topic"))
    return wanted.join(topic("src"), "src", "left").join(topic("dst"), "dst", "left").select("src", "src_topic", "place", "dst", "dst_topic", "weight")


def tool_suggestions(names: DataFrame, wanted: str, most: int = 5) -> DataFrame:
    """Tools of that name whatever the case, then those that begin with it: tool, place."""
    low = F.lower("tool")
    hits = names.where(low.startswith(wanted.lower()))
    return hits.withColumn("place", F.row_number().over(Window.orderBy(low != wanted.lower(), "tool"))).where(F.col("place") <= most)  # names, not rows of data


def tool(events: DataFrame, name: str) -> DataFrame:
    """The profile of one tool; no row if there is none of that name, for which `tool_suggestions` has others."""
    return sessions.tool_profile(events).where(F.col("tool") == name)


# Status and sessions in full.


def by_model(events: DataFrame) -> DataFrame:
    """Tokens and turns of each model over all sessions; cumulative snapshots name no model and count as their agent's."""
    turns = sessions.session_models(events)
    last = sessions.snapshots(events).select("session_id", F.lit("codex").alias("model"), "tok_in", "tok_out", "cache_read", F.lit(0).cast("long").alias("cache_create"), F.lit(0).cast("long").alias("turns"))
    own = turns.join(last.select("session_id"), "session_id", "left_anti").unionByName(last)
    return own.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tok_in", "tok_out", "cache_read", "cache_create", "turns")])


def status(docs: DataFrame) -> DataFrame:
    """One row on what there is: documents, items of the forge, sessions, the newest day."""
    sessions_seen = F.count_distinct(F.when((F.col("source") != "github") & (F.coalesce("session_id", F.lit("")) != ""), F.col("session_id")))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("source") == "github").alias("github"), sessions_seen.alias("sessions"), F.coalesce(F.substring(F.max("ts"), 1, 10), F.lit("")).alias("newest"))


def session_details(events: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions with everything that is told of one: the rollup, repository, campaign, files, tokens, tools and struggle."""
    rolled = sessions.session_rollup(events)
    context = sessions.session_context(events).select("session_id", "campaign", "role")
    repos = sessions.repo_of(rolled, known)
    tokens = sessions.session_tokens(events).withColumnRenamed("turns", "usage_turns")
    last = sessions.snapshots(events).select("session_id", "tok_in", "tok_out", "cache_read", F.lit(0).cast("long").alias("cache_create"), F.lit(0).cast("long").alias("usage_turns"))
    spent = tokens.join(last.select("session_id"), "session_id", "left_anti").unionByName(last, allowMissingColumns=True)
    mix = sessions.session_tool_mix(events).where("calls > 0")
    tools = mix.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool", "errors", "chars"))), lambda x: F.struct(x["tool"].alias("tool"), (-x["n"]).alias("calls"), x["errors"].alias("errors"), x["chars"].alias("chars"))).alias("tools_by_name"))
    joined = rolled.join(repos, "cwd", "left").join(context, "session_id", "left").join(spent, "session_id", "left").join(tools, "session_id", "left").join(sessions.touched_files(events), "session_id", "left").join(sessions.struggle(rolled), "session_id", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("tok_in", "tok_out", "cache_read", "cache_create", "usage_turns")}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("repo", "campaign", "role")}
    return joined.withColumns({**filled, **texts, "position": F.coalesce("position", F.lit(0.0)), "touched": F.coalesce("touched", F.array().cast("array<string>")), "tools_by_name": F.coalesce("tools_by_name", F.array().cast("array<struct<tool:string,calls:bigint,errors:bigint,chars:bigint>>"))})


def session_inputs(events: DataFrame, known: DataFrame, most_files: int = 12, most_turns: int = 8) -> DataFrame:
    """What a session's summary is made from: repository, ask, its first files and its longest messages in order."""
    rolled = sessions.session_rollup(events).where("prompts > 0")
    turns = sessions.longest_turns(events, most_turns).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("turns"))
    joined = rolled.join(sessions.repo_of(rolled, known), "cwd", "left").join(sessions.touched_files(events), "session_id", "left").join(turns, "session_id", "left")
    return joined.select("session_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("ask", F.lit("")).alias("ask"), F.slice(F.coalesce("touched", F.array().cast("array<string>")), 1, most_files).alias("files"), F.coalesce("turns", F.array().cast("array<string>")).alias("turns"))


def doc_inputs(items: DataFrame, most: int = 1500) -> DataFrame:
    """What an item's summary is made from: key, kind, repository, title and the beginning of its text."""
    kind = F.when(F.col("kind") == "pull_request", "pull request").when(F.col("kind") == "issue", "issue")
    key = F.concat(F.lit("gh:"), F.col("repo"), F.lit("#"), F.coalesce("number", F.lit(0)).cast("string"))
    return items.select(key.alias("key"), kind.alias("kind"), "repo", first_line(F.col("text")).alias("title"), T.excerpt(F.col("text"), most).alias("text")).where("kind IS NOT NULL")


def resolve(key: str, of_sessions: DataFrame, of_topics: DataFrame, items: DataFrame, most: int = 8) -> tuple[str, str]:
    """What an id names: ('item' | 'session' | 'topic', its key).

    `repo#n`, with or without gh:, is an item. Anything else needs four characters and is a session or topic: the one of
    that id, else the only one whose id begins with it. Otherwise the candidates are in the error.
    """
    key = key.strip().removeprefix("gh:")
    repo, at, number = key.rpartition("#")
    if at:
        if not number.lstrip("-").isdigit():
            raise ValueError(f"{key} names an item, but {number} is no number")
        if items.where((F.col("repo") == repo) & (F.col("number") == int(number)) & F.col("kind").isin("pull_request", "issue")).isEmpty():
            raise LookupError(f"there is no item {key}")
        return "item", f"gh:{key}"
    if len(key) < 4:
        raise ValueError("an id needs four characters")
    of = lambda rows, column, kind: rows.where(F.col(column).startswith(key)).select(F.col(column).cast("string").alias("id"), F.lit(kind).alias("kind"))
    hits = of(of_sessions, "session_id", "session").unionByName(of(of_topics, "key", "topic"))
    found = [(r.kind, r.id) for r in hits.orderBy(F.col("id") != key, "kind", "id").limit(most + 1).collect()]
    if found and found[0][1] == key:
        return found[0]
    if not found:
        raise LookupError(f"nothing matches {key}")
    if len(found) > 1:
        raise LookupError(f"{key} is ambiguous: " + ", ".join(f"{i} ({kind})" for kind, i in found[:most]))
    return found[0]


def show(key: str, details: DataFrame, found_topics: DataFrame, items: DataFrame, events: DataFrame, prompts: int = 8) -> tuple[str, DataFrame]:
    """What there is on one id: its kind and one row. A session's row has its first prompts as well."""
    kind, own = resolve(key, details, found_topics.withColumn("key", F.col("topic").cast("string")), items)
    if kind == "topic":
        return kind, found_topics.where(F.col("topic").cast("string") == own)
    if kind == "item":
        return kind, doc_inputs(items).where(F.col("key") == own)
    asked = events.where((F.col("session_id") == own) & sessions.is_prompt()).select("session_id", T.excerpt(F.col("p.text"), 200).alias("text"), "ts", "ord")
    first = asked.orderBy("ts", "ord").limit(prompts).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ord", "text"))), lambda x: x["text"]).alias("asked"))
    return kind, details.where(F.col("session_id") == own).join(first, "session_id", "left")


def observed(rows: DataFrame, operation: str, **counters: Column) -> tuple[DataFrame, object]:
    """Rows that count themselves while they are used, and what they counted: see `metrics_line`."""
    from pyspark.sql import Observation

    observation = Observation(operation)
    return rows.observe(observation, *[column.alias(name) for name, column in counters.items()]), observation


def metrics_line(operation: str, observation: object) -> str:
    """The counters of a finished operation as one line."""
    return f"[metrics {operation}] " + " ".join(f"{name}={value}" for name, value in observation.get.items())


def ingest_counters(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """How many lines came, weren't envelopes, were seen before, and are kept."""
    came = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("corrupt").isNotNull()).alias("failed"), F.count_if(F.col("corrupt").isNull() & (F.col("v") != 1)).alias("skipped"))
    left = kept.agg(F.count(F.lit(1)).alias("kept"))
    return came.join(F.broadcast(left)).withColumn("dropped", F.col("lines") - F.col("failed") - F.col("skipped") - F.col("kept"))  # single rows


def derived_pairs(details: DataFrame, summaries: DataFrame) -> DataFrame:
    """Queries with a known answer: what a session was about (its summary, else its ask; 12 bytes at least) and the pull
    request that it produced: query, answer."""
    known = summaries.where(F.octet_length("summary") >= 12).select(F.col("key").alias("session_id"), "summary")
    asked = F.when(F.octet_length("ask") >= 12, F.col("ask"))
    rows = details.where("linked IS NOT NULL AND prompts > 0").join(known, "session_id", "left")
    return rows.select("session_id", F.coalesce("summary", asked).alias("query"), F.col("linked").alias("answer")).where("query IS NOT NULL")


def eval_retrieval(units: DataFrame, pairs: DataFrame, k: int = 5, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Share of queries (query, text, answer) whose answer is among the first k units: queries, hits, rate.

    All queries are searched at once, in blocks of bounded bytes against all units. Units have a whole number as key.
    """
    found = encoded(units, "text", encoder).select("key", "matrix", "rows")
    asked = encoded(pairs.select("query", "text").distinct(), "text", encoder).select(F.col("query").alias("key"), "matrix", "rows")
    ranked = vectors.maxsim_search(found, asked, k).select("query", F.col("key").alias("answer"), "place")
    return insight.hit_at(ranked, pairs.select("query", "answer").distinct(), k)
