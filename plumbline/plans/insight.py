"""Queries over documents, the fleet, topics, terms and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import encode, naming, render
from plumbline.functions import text as T
from plumbline.operators import ingest, insight, sessions, surfaces, topics, vectors
from plumbline.operators.access import ReadScope, facet, role_matrix, scope_filter
from plumbline.plans.activity import _ROLLUP, _cut, _ev, _items as _pulls, _tokens
from plumbline.plans.adapter import envelopes
from plumbline.session import shared_folder
from plumbline.sources.tables import build_identity, sync_caches

NEWEST = "2024-01-31"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed texts: repository, author, kind, session and source of each."""
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", F.col("source").alias("repo"), F.concat(F.lit("user"), F.col("doc_id") % 20).alias("author"), F.when(F.col("doc_id") % 3 == 0, "pr").when(F.col("doc_id") % 3 == 1, "issue").otherwise("message").alias("kind"),
        F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("s"), F.floor(F.col("doc_id") / 9).cast("long"))).alias("session_id"), F.when(F.col("doc_id") % 3 < 2, "github").otherwise("claude_code").alias("source"),
        F.concat(F.lit("camp"), F.col("doc_id") % 4).alias("campaign"), F.when(F.col("doc_id") % 2 == 0, "writer").otherwise("reviewer").alias("role"),
    )


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("src"), F.col("user_id") % 30).alias("repo"), F.concat(F.lit("user"), F.col("user_id") % 25).alias("author"), F.floor("value").cast("long").alias("tok_out"), (F.col("event_type") == "click").cast("long").alias("tools"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _pulls(spark, sf_dir)
    return items.select((F.col("author_key") % 12).alias("topic"), F.when(F.col("number") % 3 == 0, "session").otherwise("pr").alias("unit"), F.col("merged_day").alias("day"), F.col("number").alias("member"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("cluster"), F.col("item_id").alias("member"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("community"))


def _query_matrix(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = _table(spark, sf_dir, "embeddings").where("vec_id < 3").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float)


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vectors.knn(_vectors(spark, sf_dir), k)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mutual_edges(_neighbours(spark, sf_dir, 6))


def _near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return vectors.near_duplicate_groups(_vectors(spark, sf_dir), 0.3)


def _near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return vectors.near_duplicate_classes(_vectors(spark, sf_dir), 0.3)


def _coverage(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    actors = insight.tracked_actors(envelopes(spark, sf_dir))
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    agent = F.when(F.col("o_orderkey") % 40 == 0, "cursor").when(F.col("o_orderkey") % 40 == 1, "aider")
    authors = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.upper("c_name").alias("author"), F.col("o_orderdate").cast("date").cast("string").alias("ts"), agent.alias("agent"))
    members = customers.where("c_acctbal > 0").select(F.col("c_name").alias("login"))
    return insight.fleet_coverage(actors, authors, members, ("customer#000000003",), "1995-06-01")[part]


def _repo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = sessions.session_rollup(envelopes(spark, sf_dir))
    return sessions.repo_of(rolled, _table(spark, sf_dir, "nation").select(F.col("n_name").alias("repo")))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    footer = F.when(F.col("doc_id") % 7 == 0, "\nCo-authored-by: Cursor Agent").when(F.col("doc_id") % 7 == 1, "\nGenerated with Aider").when(F.col("doc_id") % 7 == 2, "\nI like devin").otherwise("")
    login = F.when(F.col("doc_id") % 11 == 0, "Copilot[bot]").otherwise(F.col("author"))
    body = F.concat(F.lit("title"), footer)
    return d.select("doc_id", F.coalesce(T.detect_agent(body, login), F.lit("")).alias("agent"), T.is_bot(login).alias("bot"))


def _previous_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of topics before and after: one topic falls into halves, others lose some members."""
    v = _vectors(spark, sf_dir).where("key % 10 <> 0")
    old = v.select((F.col("community") + 100).alias("topic"), F.col("key").alias("member"))
    halves = F.when((F.col("community") == 1) & (F.col("key") % 2 == 0), F.col("community") + 50).otherwise(F.col("community"))
    return old, v.where("community = 1 OR key % 7 <> 0").select(halves.alias("topic"), F.col("key").alias("member"))


def _orders_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 5).alias("repo"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("date").cast("string").alias("created"))


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.col("doc_id").alias("pos"))
    return ingest.stable_order(d.where("pos % 5 <> 0"), d.where("pos % 4 <> 0"))


def _maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.maxsim_topk(vectors.matrices(_table(spark, sf_dir, "embeddings"), 4), _query_matrix(spark, sf_dir), 10)


def _maxsim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.matrices(_table(spark, sf_dir, "embeddings"), 4)
    return vectors.maxsim_search(found, found.where("key % 50 = 0"), 10)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _neighbours(spark, sf_dir, 5).select(F.col("src").alias("query"), F.col("dst").alias("answer"), "place")
    v = _vectors(spark, sf_dir).select("key", "community")
    mates = ranked.join(v.select(F.col("key").alias("query"), "community"), "query").join(v.select(F.col("key").alias("answer"), F.col("community").alias("c")), "answer")
    gold = mates.where("community = c").select("query", "answer").unionByName(v.select(F.col("key").alias("query"), F.lit(-1).cast("long").alias("answer")))  # every row asks; its answers are its community's
    return insight.hit_at(ranked, gold, 5)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the labelled communities; every 97th row is in a community of two, which is too small for one."""
    pairs = F.when(F.col("key") % 97 == 0, 1000 + F.floor(F.col("key") / 194).cast("long")).otherwise(F.col("community"))
    return topics.at_least(_vectors(spark, sf_dir).select("key", pairs.alias("community")))


def _reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    near = _neighbours(spark, sf_dir, 16).checkpoint()  # read by every pass
    edges = vectors.mutual_edges(near)
    return topics.reassigned(_assigned(spark, sf_dir), near, edges.select(F.col("src").alias("key")).union(edges.select("dst")))


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _vectors(spark, sf_dir).where("key % 9 = 0").select("key", (F.col("key") + 1).alias("linked"))
    return topics.snapped(_assigned(spark, sf_dir), links)


def _units_of_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of four tokens each; a third of them have been done once more, with matrices that differ a little."""
    found = vectors.matrices(_table(spark, sf_dir, "embeddings"), 4)
    again = found.where("key % 3 = 0").withColumn("factor", 0.93 + 0.01 * (F.col("key") % 7))
    again = again.select((F.col("key") + 1_000_000).alias("key"), F.transform("matrix", lambda x: x * F.col("factor") + 0.01).alias("matrix"), "rows")
    found = found.unionByName(again)
    base = F.col("key") % 1_000_000
    units = found.select("key", F.concat(F.lit("r"), base % 3).alias("repo"), (base % 2 == 0).alias("item"), F.when((F.col("key") >= 1_000_000) & (base % 2 == 1), F.concat(F.lit("gh:r#"), base)).alias("linked"))
    return found, units


def _duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return vectors.duplicate_units(*_units_of_tokens(spark, sf_dir))


def _knn_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    found, _ = _units_of_tokens(spark, sf_dir)
    return vectors.without_duplicates(vectors.maxsim_knn(found, 16), _duplicate_units(spark, sf_dir))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, units = _units_of_tokens(spark, sf_dir)
    scope = ReadScope(repos=("r0", "r2"), sources=("github",))
    rows = found.join(units, "key").withColumns({"source": F.when(F.col("item"), "github").otherwise("claude_code"), "kind": (F.col("key") % 4).cast("string")})
    return surfaces.search(rows, _query_matrix(spark, sf_dir), 7, "kind = 2", scope)


_SUBJECTS, _FILES = "fix: add the pack wheel\nround cart totals 2024", "src/auth/rate_limit.go\ndocs/Total-Cost.v2.md"


def _work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of work with topics."""
    o = _table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "session").when(F.col("o_orderkey") % 3 == 1, "pr").otherwise("issue")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_custkey") % 12 < 11, F.col("o_custkey") % 12).alias("topic"), kind.alias("unit"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("repo"),
        F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("author"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "claude_code").otherwise("github").alias("source"),
        F.concat(F.lit("camp"), F.col("o_custkey") % 3).alias("campaign"), F.lit("writer").alias("role"), (F.col("o_orderkey") % 6 == 0).alias("dup"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
    )


def _topic_units(spark: SparkSession, sf_dir: str, scope: ReadScope | None = None) -> DataFrame:
    units = _work_units(spark, sf_dir)
    labels = units.groupBy("topic").agg(F.concat(F.lit("label "), F.first("topic")).alias("label"))
    return surfaces.topic_units(units, labels, 6, scope)


def _flat(found: DataFrame) -> DataFrame:
    """Arrays as text."""
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("activity", "repos", "authors")})


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pull requests and issues of the forge."""
    d = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "pull_request").when(F.col("doc_id") % 3 == 1, "issue").otherwise("user_prompt")
    return d.select(F.col("source").alias("repo"), F.col("doc_id").alias("number"), kind.alias("kind"), "text", F.lit("OPEN").alias("state"), F.concat(F.lit("u"), F.col("doc_id") % 9).alias("author"), F.lit("github").alias("source"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("ts"))


def _with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = surfaces.items_as_units(_items(spark, sf_dir))
    number = F.regexp_extract("key", "#([0-9]+)$", 1).cast("long")
    found = units.select("key", (number % 7).alias("topic"), number.alias("rank")).where("topic < 6")
    summaries = units.select("key", F.when(number % 5 == 0, "").otherwise(F.concat(F.lit("about "), number)).alias("summary"))
    return surfaces.with_topics(units, found, summaries).select("key", "unit", "day", F.length("title").alias("title"), "topic", "rank", "summary")


def _reconciled(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.col("doc_id").alias("pos"))
    return ingest.reconciled(d, d.where(F.col("pos") % n != 0))


def _caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    side = lambda n: o.where(F.col("o_orderkey") % n != 0).select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % n).cast("string").alias("hash"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("v"), F.col("o_custkey"))).alias("value"))
    to_local, to_remote = sync_caches(side(3), side(4))
    return to_local.withColumn("to", F.lit("local")).unionByName(to_remote.withColumn("to", F.lit("remote")))


def _name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up verdicts on names, one a benchmark item."""
    b, n = _table(spark, sf_dir, "benchmark"), F.col("item_id")
    return b.select(
        F.concat(F.lit("Name-"), F.when(n % 2 == 0, "a").otherwise("1"), n % 40).alias("name"), ((n * 37 % 101) / 100.0).alias("score"), ((n * 53 % 89) / 100.0).alias("low"), (n % 9).alias("members"), (n % 6 != 0).alias("scored"), (n % 5 == 0).alias("is_fallback"),
        (n % 4 == 1).alias("rejected"), F.when(n % 3 == 0, "wrong").when(n % 3 == 1, "good").alias("rating"),
    )


def _finished_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = _table(spark, sf_dir, "benchmark"), F.col("item_id")
    raw = F.when(n % 4 == 0, "<think>x</think> \"ocr_adapterCluster\"").when(n % 4 == 1, "Name: a b c d e f g h i j").when(n % 4 == 2, "sie-web").otherwise("multi-GPU packing")
    summary = F.when(n % 3 == 0, F.lit("This theme focuses on packing the carts, and more")).when(n % 3 == 1, "short")
    return b.select("item_id", naming.finished_names(raw, summary, F.array(F.lit("ocr-adapter"), F.lit("packing"), F.lit("web")), F.array(F.lit("sie-web"))).alias("name"), naming.cleaned_summaries(summary).alias("summary"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("key", F.col("doc_id"))
    summaries = d.select("key", F.when(F.col("key") % 4 == 0, "").otherwise(F.concat(F.lit("about "), "key")).alias("summary"))
    chosen = d.where("kind = 'message'").select("key", "repo", F.array(F.lit("a.py"), F.concat("author", F.lit(".py"))).alias("files"))
    return topics.cluster_inputs(chosen, d.where("kind <> 'message'").select("key", F.col("text").alias("body")), summaries)


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.matrices(_table(spark, sf_dir, "embeddings"), 4).select((F.col("key") % 9).alias("topic"), "key", "matrix", "rows")
    return topics.name_gate(found, found.where("key < 9"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "status_by_kind": lambda s, d: _documents(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "kind"),
    "status_by_repo": lambda s, d: insight.status_with_spend(_documents(s, d), _spend(s, d), "repo"),
    "status_by_author": lambda s, d: insight.status_with_spend(_documents(s, d), _spend(s, d), "author"),
    "scope_filter": lambda s, d: scope_filter(_documents(s, d), ReadScope(repos=("src1", "src2", "src3"), campaigns=("camp0", "camp1"), sources=("github",))).select("doc_id", "repo", "campaign"),
    "metadata_filter": lambda s, d: insight.metadata_filter(_documents(s, d), "repo=src4").select("doc_id", "kind"),
    "fleet_machines": lambda s, d: insight.fleet_machines(envelopes(s, d), NEWEST),
    "fleet_coverage": lambda s, d: _coverage(s, d, 0),
    "fleet_untracked": lambda s, d: _coverage(s, d, 1),
    "repo_fold": _repo_fold,
    "agent_attribution": _attributed,
    "redact_text": lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(T.redacted(F.coalesce("text", F.lit("")))).alias("digest")),
    "units_feed": lambda s, d: insight.units_feed(sessions.session_rollup(envelopes(s, d)), _pulls(s, d).select((F.col("author_key") % 5).alias("repo"), "number", "state", F.col("merged_day").alias("day"), F.concat(F.lit("order "), F.col("number")).alias("title"))),
    "topic_facets": lambda s, d: insight.topic_facets(_units(s, d)),
    "topic_activity": lambda s, d: insight.topic_activity(_units(s, d), 8),
    "topic_days": lambda s, d: insight.most_frequent(_units(s, d), "topic", "day").where("place <= 3"),
    "topic_lineage_jaccard": lambda s, d: insight.lineage(*_previous_members(s, d)),
    "cluster_idf": lambda s, d: insight.cluster_idf(_members(s, d)),
    "cluster_terms": lambda s, d: insight.cluster_terms(_members(s, d), 5),
    "keyword_labels": lambda s, d: insight.keyword_labels(_members(s, d)),
    "related_query_terms": lambda s, d: insight.related_terms(_table(s, d, "benchmark").select(F.col("item_id").alias("key"), "text")),
    "manifest_diff": lambda s, d: insight.manifest_diff(_table(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("hash")), _table(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 1, 1).otherwise(0)).alias("hash"))),
    "pending_summaries": lambda s, d: insight.pending(_table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 7).alias("hash")), _table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 5).alias("hash"))),
    "upsert_merge": lambda s, d: insight.upsert_merge(_orders_as_items(s, d), _orders_as_items(s, d).where("number % 4 = 0").withColumn("state", F.lit("NEW")), "1996-01-01").select("repo", "number", "state", "created"),
    "stable_order": _stable,
    "departed_docs": lambda s, d: ingest.departed(_table(s, d, "documents").select(F.md5("text").alias("hash")), _table(s, d, "documents").where("doc_id % 3 = 0").select(F.md5("text").alias("hash"))).groupBy("hash").agg(F.count(F.lit(1)).alias("n")),
    "mean_pool": lambda s, d: vectors.mean_pool(vectors.matrices(_table(s, d, "embeddings"), 4)).select("key", F.round(F.col("pooled")[0], 5).alias("p0"), F.round(F.element_at("pooled", -1), 5).alias("p_last")),
    "maxsim_topk": _maxsim,
    "maxsim_topk_all": _maxsim_all,
    "knn_topk": lambda s, d: _neighbours(s, d, 4),
    "mutual_knn_edges": _edges,
    "near_dup_groups": _duplicate_units,
    "near_dup_vectors": _near_dup,
    "near_dup_classes": _near_dup_classes,
    "knn_two_stage": lambda s, d: vectors.maxsim_knn(_units_of_tokens(s, d)[0], 16),
    "knn_collapsed": _knn_collapsed,
    "neighbour_dump": lambda s, d: surfaces.neighbour_dump(_neighbours(s, d, 12), _assigned(s, d), "13"),
    "search": _search,
    "related": lambda s, d: surfaces.related(_table(s, d, "benchmark").select(F.col("item_id").alias("key"), "text"), _SUBJECTS, _FILES, 8),
    "embedding_blobs": lambda s, d: encode.from_blobs(encode.to_blobs(vectors.matrices(_table(s, d, "embeddings"), 4))).select("key", "rows", F.size("matrix").alias("values"), F.round(F.col("matrix")[0], 2).alias("first")),
    "eval_retrieval": lambda s, d: surfaces.eval_retrieval(_table(s, d, "benchmark").select(F.col("item_id").alias("key"), "text"), _table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text", F.col("item_id").alias("answer")), 3),
    "fresher_manifest": lambda s, d: insight.fresher_manifest(_table(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("hash")), _table(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 500).alias("hash")), "2024-01-01", "2024-01-02"),
    "recent_work": lambda s, d: s.createDataFrame(list(enumerate(surfaces.recent_work(s, _SUBJECTS, _FILES))), "place int, word string"),
    "topic_units": lambda s, d: _flat(_topic_units(s, d)),
    "topic_units_scoped": lambda s, d: _flat(_topic_units(s, d, ReadScope(repos=("r1", "r2", "r3"), sources=("github",)))),
    "topics": lambda s, d: surfaces.topics(_topic_units(s, d), _work_units(s, d), "ORDER 1", 7).select("topic", "label", "size", "last_active"),
    "topic_facet": lambda s, d: facet(_topic_units(s, d), "r3", "u2").select("topic"),
    "member_hashes": lambda s, d: surfaces.member_hashes(_work_units(s, d)).select("topic", F.size("hashes").alias("n"), F.md5(F.array_join("hashes", ",")).alias("digest")),
    "day_strip": lambda s, d: surfaces.day_strip(_work_units(s, d).where("topic IS NOT NULL"), "1998-07-30").select("topic", F.array_join(F.col("strip").cast("array<string>"), ",").alias("strip")),
    "recent": lambda s, d: surfaces.recent(_work_units(s, d), "r2", 60).select("key", "day", "unit"),
    "recent_scoped": lambda s, d: surfaces.recent(_work_units(s, d), limit=500, scope=ReadScope(campaigns=("camp1",), sources=("github",))).select("key", "campaign"),
    "status": lambda s, d: surfaces.status(_documents(s, d).withColumn("ts", F.lit(f"{NEWEST}T10:00:00Z"))),
    "doc_inputs": lambda s, d: surfaces.doc_inputs(_items(s, d)).select("key", "kind", F.md5("title").alias("title"), F.md5("text").alias("text")),
    "units_with_topics": _with_topics,
    "all_docs": lambda s, d: ingest.all_docs(_documents(s, d).where("kind = 'message'").select("doc_id", "session_id", "repo"), _items(s, d).where("kind <> 'user_prompt'").select(F.col("number").alias("doc_id"), "repo", "kind")),
    "reconciled": lambda s, d: _reconciled(s, d, 7),
    "cache_sync": _caches,
    "cluster_quality_report": lambda s, d: vectors.quality_report(vectors.cluster_quality(_neighbours(s, d, 16), _assigned(s, d).withColumnRenamed("topic", "community"))),
    "name_report": lambda s, d: naming.name_report(_name_rows(s, d)),
    "name_median_gate": lambda s, d: naming.rejected_by_median(_table(s, d, "benchmark").select(F.col("item_id").alias("topic"), ((F.col("item_id") * 37 % 101) / 100.0).alias("score"))),
    "name_sensitivity": lambda s, d: naming.rejects_at(_name_rows(s, d), 0.8),
    "gated_names": lambda s, d: naming.gated_names(_table(s, d, "benchmark").select(F.col("item_id").alias("topic"), F.concat(F.lit("n"), F.col("item_id") % 50).alias("name"), F.concat(F.lit("n"), F.col("item_id") % 49).alias("fallback")), _table(s, d, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").alias("topic"), (F.col("item_id") % 2 == 0).alias("accepted"))),
    "finished_names": _finished_names,
    "input_hash": lambda s, d: _table(s, d, "documents").select("doc_id", naming.input_hash("v3", F.col("source"), F.col("text")).alias("hash")),
    "role_matrix": lambda s, d: s.createDataFrame(role_matrix(), "role string, tool string, allowed boolean"),
    "build_identity": lambda s, d: build_identity(_table(s, d, "orders").withColumn("at", F.col("o_orderkey")), "at", ["o_orderkey", "o_custkey"]),
    "machine_lines": lambda s, d: render.machine_lines(insight.fleet_machines(envelopes(s, d), NEWEST)),
    "topic_lines": lambda s, d: render.topic_lines(_topic_units(s, d)),
    "tally_lines": lambda s, d: render.tally_lines(insight.status_with_spend(_documents(s, d), _spend(s, d), "repo"), "repo"),
    "modularity": lambda s, d: vectors.modularity(_edges(s, d), _vectors(s, d)),
    "centrality_rank": lambda s, d: vectors.centrality(_neighbours(s, d, 8), _vectors(s, d)),
    "cluster_quality": lambda s, d: vectors.cluster_quality(_neighbours(s, d, 16), _assigned(s, d).withColumnRenamed("topic", "community")),
    "louvain_topics": lambda s, d: vectors.louvain(_edges(s, d)),
    "hit_at_5": _hits,
    "cluster_inputs": _inputs,
    "topic_size_floor": _assigned,
    "topic_reassign": _reassigned,
    "topic_snap": _snapped,
    "topic_labels": lambda s, d: topics.labels(_members(s, d).select(F.col("cluster").alias("topic"), F.col("text").alias("summary"))),
    "topic_filter": lambda s, d: topics.containing(_members(s, d).groupBy(F.col("cluster").alias("topic")).agg(F.concat(F.lit("label "), F.first("cluster")).alias("label")), _members(s, d).select(F.col("cluster").alias("topic"), F.col("text").alias("title")), "THE"),
    "name_gate": _gate,
    "json_envelopes": lambda s, d: topics.json_lines(_documents(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("docs")), "status"),
}

_DOC = """WITH docs AS (SELECT doc_id, text, source AS repo, 'user' || (doc_id % 20) AS author, CASE doc_id % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'issue' ELSE 'message' END AS kind,
    CASE WHEN doc_id % 3 = 2 THEN 's' || (doc_id // 9) END AS session_id, CASE WHEN doc_id % 3 < 2 THEN 'github' ELSE 'claude_code' END AS src, 'camp' || (doc_id % 4) AS campaign FROM documents),
    spend AS (SELECT 'src' || (user_id % 30) AS repo, 'user' || (user_id % 25) AS author, CAST(floor(value) AS BIGINT) AS tok, (event_type = 'click')::BIGINT AS tool FROM events) """


def _status(key: str) -> str:
    return _DOC + f"""SELECT {key}, coalesce(docs, 0) AS docs, coalesce(github_docs, 0) AS github_docs, coalesce(sessions, 0) AS sessions, coalesce(tok_out, 0)::BIGINT AS tok_out, coalesce(tools, 0)::BIGINT AS tools FROM
        (SELECT {key}, count(*) AS docs, count(*) FILTER (src = 'github') AS github_docs, count(DISTINCT session_id) AS sessions FROM docs GROUP BY 1) FULL JOIN (SELECT {key}, sum(tok) AS tok_out, sum(tool) AS tools FROM spend GROUP BY 1) USING ({key})"""


_UNITS = "WITH units AS (SELECT o_custkey % 12 AS topic, CASE WHEN o_orderkey % 3 = 0 THEN 'session' ELSE 'pr' END AS unit, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders) "
_WORDS = (
    "WITH w AS (SELECT cluster, member, word FROM (SELECT DISTINCT item_id % 5 AS cluster, item_id AS member, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}-]+')) AS word FROM benchmark) WHERE octet_length(encode(word)) >= 3 AND regexp_matches(word, '\\p{L}') AND word NOT IN ("
    + ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    + ")), idf AS (SELECT word, count(DISTINCT cluster) AS cf, round(ln((1 + (SELECT count(DISTINCT item_id % 5) FROM benchmark)) / (1 + count(DISTINCT cluster))) + 1, 6) AS idf FROM w GROUP BY word), "
    "terms AS (SELECT cluster, word, round(count(*) / any_value(n) * any_value(idf), 6) AS score FROM w JOIN idf USING (word) JOIN (SELECT item_id % 5 AS cluster, count(*) AS n FROM benchmark GROUP BY 1) USING (cluster) GROUP BY cluster, word), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, word) AS place FROM terms) "
)
_KNN = "WITH v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS c FROM embeddings), pairs AS (SELECT a.key AS src, b.key AS dst, round(list_dot_product(a.e, b.e), 5) AS weight FROM v a JOIN v b ON a.key <> b.key), knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM pairs) "
_EDGES = _KNN + ", sc AS (SELECT src, dst, weight / best AS w FROM (SELECT *, max(weight) OVER (PARTITION BY src) AS best FROM knn WHERE place <= 6) WHERE best > 0 AND weight / best >= 0.6), edges AS (SELECT a.src, a.dst, round(a.w + b.w, 4) AS weight FROM sc a JOIN sc b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) "
_KNN16 = ", near AS (SELECT src, dst, weight, place FROM knn WHERE place <= 16) "
_FLOOR = ", a AS (SELECT vec_id AS key, CASE WHEN vec_id % 97 = 0 THEN 1000 + vec_id // 194 ELSE CAST(label AS BIGINT) END AS c FROM embeddings), sizes AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS topic FROM a GROUP BY c HAVING count(*) >= 3), assigned AS (SELECT key, topic FROM a LEFT JOIN sizes USING (c)) "
_PASSES = ", mutual AS (SELECT src AS key FROM edges UNION SELECT dst FROM edges)" + "".join(
    f""", v{n} AS (SELECT p.key, p.topic, coalesce(max(weight) FILTER (q.topic = p.topic), 0) AS own, arg_min(q.topic, place) FILTER (q.topic IS DISTINCT FROM p.topic) AS other, coalesce(arg_min(weight, place) FILTER (q.topic IS DISTINCT FROM p.topic), 0) AS away
        FROM {before} p LEFT JOIN (near JOIN {before} q ON q.key = near.dst AND q.topic IS NOT NULL) ON near.src = p.key GROUP BY 1, 2),
    p{n} AS (SELECT key, CASE WHEN other IS NOT NULL AND (topic IS NULL AND key IN (SELECT key FROM mutual) OR topic IS NOT NULL AND away > own) THEN other ELSE topic END AS topic FROM v{n})"""
    for n, before in enumerate(("assigned", "p0", "p1", "p2", "p3"))
)
_TOKENS = """WITH RECURSIVE f AS (SELECT vec_id, vec_id // 4 AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), tk AS (
    SELECT key, vec_id, e FROM f UNION ALL SELECT key + 1000000, vec_id, list_transform(e, lambda x: x * (0.93 + 0.01 * (key % 7)) + 0.01) FROM f WHERE key % 3 = 0
), un AS (SELECT DISTINCT key, 'r' || (key % 1000000 % 3) AS repo, key % 1000000 % 2 = 0 AS item, CASE WHEN key >= 1000000 AND key % 1000000 % 2 = 1 THEN 'gh:r#' || (key % 1000000) END AS linked FROM tk
), nr AS (SELECT key, count(*) AS n FROM tk GROUP BY key
), dupe AS (SELECT x.a, x.b FROM (SELECT a, b, avg(best) AS s FROM (SELECT x.key AS a, y.key AS b, x.vec_id, max(list_dot_product(x.e, y.e)) AS best FROM tk x JOIN un ux ON ux.key = x.key JOIN un uy ON uy.repo = ux.repo AND uy.item = ux.item AND uy.key <> ux.key JOIN tk y ON y.key = uy.key GROUP BY 1, 2, 3) GROUP BY 1, 2) x
    JOIN (SELECT a, b, avg(best) AS s FROM (SELECT x.key AS a, y.key AS b, x.vec_id, max(list_dot_product(x.e, y.e)) AS best FROM tk x JOIN un ux ON ux.key = x.key JOIN un uy ON uy.repo = ux.repo AND uy.item = ux.item AND uy.key <> ux.key JOIN tk y ON y.key = uy.key GROUP BY 1, 2, 3) GROUP BY 1, 2) y ON y.a = x.b AND y.b = x.a WHERE (x.s + y.s) / 2 >= 0.95
), reach AS (SELECT key AS a, key AS b FROM un UNION SELECT reach.a, dupe.b FROM reach JOIN dupe ON dupe.a = reach.b
), grp AS (SELECT a AS key, min(b) AS g FROM reach GROUP BY a
), reps AS (SELECT key, first_value(key) OVER (PARTITION BY g ORDER BY linked IS NULL, key) AS rep, count(*) OVER (PARTITION BY g) AS size FROM grp JOIN un USING (key)
), pooled AS (SELECT key, list(m ORDER BY i) AS m FROM (SELECT key, i, avg(e[i]) AS m FROM tk, range(1, 1 + (SELECT len(embedding) FROM embeddings LIMIT 1)) r(i) GROUP BY key, i) GROUP BY key
), unit AS (SELECT key, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM pooled
), cand AS (SELECT * FROM (SELECT a.key AS src, b.key AS dst, row_number() OVER (PARTITION BY a.key ORDER BY round(list_dot_product(a.m, b.m), 5) DESC, b.key) AS place FROM unit a JOIN unit b ON a.key <> b.key) WHERE place <= 64
), exact AS (SELECT src, dst, round(sum(best), 5) AS weight FROM (SELECT src, dst, x.vec_id, max(list_dot_product(x.e, y.e)) AS best FROM cand JOIN tk x ON x.key = src JOIN tk y ON y.key = dst GROUP BY 1, 2, 3) GROUP BY 1, 2
), two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM exact) WHERE place <= 16) """
_WORK = """WITH w AS (SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_custkey % 12 < 11 THEN o_custkey % 12 END AS topic, CASE o_orderkey % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'pr' ELSE 'issue' END AS unit, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'r' || (o_custkey % 5) AS repo, 'u' || (o_custkey % 7) AS author,
    o_orderkey AS rank, 'order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'claude_code' ELSE 'github' END AS source, 'camp' || (o_custkey % 3) AS campaign, o_orderkey % 6 = 0 AS dup FROM orders) """


def _topics_sql(scope: str, label: str) -> str:
    by = lambda c: f"(SELECT topic, string_agg(v, ',' ORDER BY n DESC, v) AS {c}s FROM (SELECT topic, {c} AS v, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)"
    return (
        _WORK
        + f""", u AS (SELECT * FROM w WHERE topic IS NOT NULL AND {scope}), wk AS (SELECT topic, wk, count(*) AS n FROM (SELECT topic, (max(CAST(day AS DATE)) OVER (PARTITION BY topic) - CAST(day AS DATE)) // 7 AS wk FROM u) WHERE wk < 6 GROUP BY 1, 2),
        act AS (SELECT t.topic, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY t.wk DESC) AS activity FROM (SELECT DISTINCT topic, x.wk FROM u, range(6) x(wk)) t LEFT JOIN wk ON wk.topic = t.topic AND wk.wk = t.wk GROUP BY 1),
        tu AS (SELECT topic, count(*) AS size, min(day) AS first_day, max(day) AS last_active, count(*) FILTER (unit = 'session') AS sessions, count(*) FILTER (unit = 'pr') AS prs, count(*) FILTER (unit = 'issue') AS issues, activity, {label} AS label, repos, authors
            FROM u JOIN act USING (topic) JOIN {by('repo')} USING (topic) JOIN {by('author')} USING (topic) GROUP BY topic, activity, repos, authors) """
    )


_ITEMS = "WITH it AS (SELECT source AS repo, doc_id AS number, CASE doc_id % 3 WHEN 0 THEN 'pull_request' WHEN 1 THEN 'issue' ELSE 'user_prompt' END AS kind, text FROM documents) "
_FIRST = "coalesce(nullif(regexp_extract(regexp_replace(coalesce(text, ''), '^\\s+', ''), '^[^\\r\\n]*', 0), ''), '')"
_PLACED = """, of AS (SELECT key, topic AS c FROM assigned WHERE topic IS NOT NULL), pl AS (SELECT o.key, o.c, coalesce(max(weight) FILTER (p.c = o.c), 0) AS own, coalesce(max(weight) FILTER (p.c <> o.c), 0) AS other, coalesce(max(weight), 0) AS top FROM of o LEFT JOIN near ON near.src = o.key LEFT JOIN of p ON p.key = near.dst GROUP BY 1, 2),
    vt AS (SELECT src AS key, p.c AS vote FROM near JOIN of p ON p.key = near.dst GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, p.c) = 1),
    qual AS (SELECT c AS community, count(*) AS rows, count(*) FILTER (other > own) AS misplaced, count(*) FILTER (vote <> c) AS outvoted, round(avg(own) / greatest((SELECT avg(top) FROM pl), 1e-6), 6) AS cohesion FROM pl LEFT JOIN vt USING (key) GROUP BY c) """
_NAMES = """WITH nm AS (SELECT *, count(*) OVER (PARTITION BY name) AS same, scored AND NOT is_fallback AS judged FROM (SELECT 'Name-' || CASE WHEN item_id % 2 = 0 THEN 'a' ELSE '1' END || (item_id % 40) AS name, (item_id * 37 % 101) / 100.0::DOUBLE AS score, (item_id * 53 % 89) / 100.0::DOUBLE AS low, item_id % 9 AS members, item_id % 6 <> 0 AS scored, item_id % 5 = 0 AS is_fallback,
    item_id % 4 = 1 AS rejected, CASE item_id % 3 WHEN 0 THEN 'wrong' WHEN 1 THEN 'good' END AS rating FROM benchmark)) """
_ACTORS = """, mc AS (SELECT *, regexp_extract(stream, '^edge-(.+)-([^-]+)$', 1) AS machine FROM e), actors AS (SELECT DISTINCT lower(payload->>'$.actor') AS login FROM mc JOIN (SELECT machine, max(ts) AS last_ts FROM mc GROUP BY 1) USING (machine) WHERE kind = 'session_start' AND coalesce(payload->>'$.actor', '') <> '' AND last_ts >= '1995-06-01'),
    au AS (SELECT lower(c_name) AS login, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ts, CASE o_orderkey % 40 WHEN 0 THEN 'cursor' WHEN 1 THEN 'aider' END AS agent FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND lower(c_name) <> 'customer#000000003' AND o_orderdate >= DATE '1995-06-01'),
    active AS (SELECT login, count(*) AS items, coalesce(arg_min(agent, (ts, agent)) FILTER (agent IS NOT NULL), '') AS agent FROM au GROUP BY 1) """


ORACLES: dict[str, str] = {
    "cluster_inputs": _DOC + f"""SELECT doc_id AS key, CASE WHEN kind = 'message' THEN {_cut("'Session: ' || repo || ' a.py ' || author || '.py — about ' || doc_id", 500)} ELSE {_cut("'about ' || doc_id || ' ' || coalesce(text, '')", 500)} END AS text FROM docs WHERE doc_id % 4 <> 0""",
    "topic_size_floor": "WITH x AS (SELECT 1)" + _FLOOR + "SELECT * FROM assigned",
    "topic_reassign": _EDGES + _KNN16 + _FLOOR + _PASSES + " SELECT * FROM p4",
    "topic_snap": "WITH x AS (SELECT 1)" + _FLOOR + "SELECT a1.key, coalesce(CASE WHEN a1.key % 9 = 0 THEN a2.topic END, a1.topic) AS topic FROM assigned a1 LEFT JOIN assigned a2 ON a2.key = a1.key + 1",
    "topic_labels": "SELECT topic, CASE WHEN length(s) > 60 THEN left(s, 60) || '…' ELSE s END AS label FROM (SELECT item_id % 5 AS topic, regexp_replace(trim(arg_min(text, (octet_length(encode(text)), text))), '\\s+', ' ', 'g') AS s FROM benchmark GROUP BY 1)",
    "topic_filter": "SELECT item_id % 5 AS topic, 'label ' || (item_id % 5) AS label FROM benchmark GROUP BY 1, 2 HAVING bool_or(contains(lower(text), 'the')) OR contains('label', 'the')",
    "json_envelopes": _DOC + "SELECT '{\"v\":1,\"kind\":\"status\",\"data\":{\"kind\":\"' || kind || '\",\"docs\":' || count(*) || '}}' AS json FROM docs GROUP BY kind",
    "status_by_kind": _DOC + "SELECT kind, count(*) AS docs FROM docs GROUP BY kind",
    "status_by_repo": _status("repo"),
    "status_by_author": _status("author"),
    "scope_filter": _DOC + "SELECT doc_id, repo, campaign FROM docs WHERE repo IN ('src1', 'src2', 'src3') AND campaign IN ('camp0', 'camp1') AND src = 'github'",
    "metadata_filter": _DOC + "SELECT doc_id, kind FROM docs WHERE repo = 'src4'",
    "fleet_machines": _ev(f"""SELECT regexp_extract(stream, '^edge-(.+)-([^-]+)$', 1) AS machine, max(ts) AS last_ts, string_agg(DISTINCT CASE source WHEN 'claude_code' THEN 'claude' WHEN 'codex_cli' THEN 'codex' ELSE split_part(source, '_', 1) END, '+' ORDER BY CASE source WHEN 'claude_code' THEN 'claude' WHEN 'codex_cli' THEN 'codex' ELSE split_part(source, '_', 1) END) AS sources, count(DISTINCT CASE WHEN kind = 'session_start' THEN payload->>'$.actor' END) AS actors,
        arg_max(payload->>'$.tracker_version', (ts, ord)) FILTER (kind = 'session_start') AS version, count(*) FILTER (CAST(day AS DATE) > DATE '{NEWEST}' - 30) AS recent, max(CAST(day AS DATE)) < DATE '{NEWEST}' - 7 AS quiet FROM e GROUP BY 1"""),
    "fleet_coverage": _ev(_ACTORS + "SELECT count(*) AS active, count(actors.login) AS both, (100 * count(actors.login) // count(*))::BIGINT AS percent FROM active LEFT JOIN actors USING (login)"),
    "fleet_untracked": _ev(_ACTORS + "SELECT login, items, agent, row_number() OVER (ORDER BY agent = '', login) AS place FROM active WHERE login NOT IN (SELECT login FROM actors)"),
    "repo_fold": _ev(_ROLLUP + ", seg AS (SELECT DISTINCT cwd, unnest(range(1, len(string_split(cwd, '/')) + 1)) AS pos FROM roll WHERE cwd IS NOT NULL), hit AS (SELECT cwd, pos, arg_max(n_name, length(n_name)) AS repo FROM seg JOIN nation ON string_split(cwd, '/')[pos] = n_name OR starts_with(string_split(cwd, '/')[pos], n_name || '-') GROUP BY 1, 2) SELECT cwd, arg_min(repo, pos) AS repo FROM hit GROUP BY cwd"),
    "agent_attribution": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'copilot' WHEN doc_id % 7 = 0 THEN 'cursor' WHEN doc_id % 7 = 1 THEN 'aider' ELSE '' END AS agent, doc_id % 11 = 0 AS bot FROM documents",
    "redact_text": "SELECT doc_id, md5(CASE WHEN length(t) > 32768 THEN left(t, 32768) || chr(10) || '[TRUNCATED]' ELSE t END) AS digest FROM (SELECT doc_id, "
    + "".join("regexp_replace(" for _ in T.SECRETS)
    + "coalesce(text, '')"
    + "".join(f", '{p}', '[REDACTED]', 'g')" for p in T.SECRETS)
    + " AS t FROM documents)",
    "units_feed": _ev(_ROLLUP + """SELECT session_id AS key, 'session' AS unit, substr(ended, 1, 10) AS day, coalesce(CASE WHEN length(whole) > 200 THEN left(whole, 200) || '…' ELSE whole END, '') AS title,
        CASE WHEN linked IS NOT NULL THEN '→ ' || linked WHEN files > 0 THEN files || ' files' ELSE prompts || ' prompts' END AS outcome FROM roll WHERE prompts > 0
        UNION ALL SELECT 'gh:' || (o_custkey % 5) || '#' || o_orderkey, 'pr', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'order ' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END FROM orders"""),
    "topic_facets": _UNITS + "SELECT topic, count(*) AS size, min(day) AS first_day, max(day) AS last_active, count(*) FILTER (unit = 'session') AS sessions, count(*) FILTER (unit = 'pr') AS prs FROM units GROUP BY topic",
    "topic_activity": _UNITS + "SELECT topic, week, count(*) AS units FROM (SELECT topic, CAST((max(CAST(day AS DATE)) OVER (PARTITION BY topic) - CAST(day AS DATE)) // 7 AS INT) AS week FROM units) WHERE week < 8 GROUP BY 1, 2",
    "topic_days": _UNITS + "SELECT topic, day, n, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, day) AS place FROM (SELECT topic, day, count(*) AS n FROM units GROUP BY 1, 2)) WHERE place <= 3",
    "topic_lineage_jaccard": """WITH o AS (SELECT label + 100 AS t, vec_id FROM embeddings WHERE vec_id % 10 <> 0), n AS (SELECT label + CASE WHEN label = 1 AND vec_id % 2 = 0 THEN 50 ELSE 0 END AS t, vec_id FROM embeddings WHERE vec_id % 10 <> 0 AND (label = 1 OR vec_id % 7 <> 0)),
        j AS (SELECT n.t AS new_topic, o.t AS old_topic, count(*) AS x FROM n JOIN o USING (vec_id) GROUP BY 1, 2), s AS (SELECT *, round(x / ((SELECT count(*) FROM n WHERE t = new_topic) + (SELECT count(*) FROM o WHERE t = old_topic) - x), 6) AS jaccard, (SELECT count(*) FROM n WHERE t = new_topic) AS size FROM j),
        best AS (SELECT * FROM s WHERE jaccard >= 0.5 QUALIFY row_number() OVER (PARTITION BY new_topic ORDER BY jaccard DESC, old_topic) = 1)
        SELECT new_topic, old_topic, jaccard FROM best QUALIFY row_number() OVER (PARTITION BY old_topic ORDER BY size DESC, new_topic) = 1""",
    "cluster_idf": _WORDS + "SELECT * FROM idf",
    "cluster_terms": _WORDS + "SELECT * FROM placed WHERE place <= 5",
    "keyword_labels": _WORDS + "SELECT cluster, string_agg(word, ' · ' ORDER BY place) AS label FROM placed WHERE place <= 3 GROUP BY cluster",
    "related_query_terms": "SELECT key, word, place FROM (SELECT key, word, row_number() OVER (PARTITION BY key ORDER BY min(pos)) AS place FROM (SELECT item_id AS key, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}-]+') AS ws FROM benchmark)) WHERE octet_length(encode(word)) >= 3 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ("
    + ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    + ") GROUP BY key, word) WHERE place <= 40",
    "manifest_diff": """SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'add' WHEN b.file IS NULL THEN 'remove' WHEN a.hash <> b.hash THEN 'replace' ELSE 'keep' END AS action
        FROM (SELECT o_orderkey AS file, o_custkey AS hash FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS file, o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS hash FROM orders WHERE o_orderkey % 4 <> 0) b ON a.file = b.file""",
    "pending_summaries": "SELECT o_orderkey AS key, o_custkey % 7 AS hash FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_custkey % 7 = o_custkey % 5)",
    "upsert_merge": "SELECT o_custkey % 5 AS repo, o_orderkey AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' ELSE o_orderstatus END AS state, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders WHERE o_orderdate >= DATE '1996-01-01'",
    "stable_order": """WITH d AS (SELECT md5(coalesce(text, '')) AS hash, doc_id AS pos FROM documents), o AS (SELECT hash, pos AS old_pos, row_number() OVER (PARTITION BY hash ORDER BY pos) AS nth FROM d WHERE pos % 5 <> 0), c AS (SELECT hash, pos, row_number() OVER (PARTITION BY hash ORDER BY pos) AS nth FROM d WHERE pos % 4 <> 0)
        SELECT c.hash, pos, old_pos, old_pos IS NULL AS is_new FROM c LEFT JOIN o USING (hash, nth)""",
    "departed_docs": "SELECT hash, n FROM (SELECT md5(text) AS hash, count(*) - count(*) FILTER (doc_id % 3 = 0) AS n FROM documents GROUP BY 1) WHERE n > 0",
    "mean_pool": """WITH p AS (SELECT vec_id // 4 AS key, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT key, i, avg(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT key, sqrt(sum(x * x)) AS norm, max(i) AS width FROM m GROUP BY 1)
        SELECT key, round(max(CASE WHEN i = 1 THEN x / norm END), 5) AS p0, round(max(CASE WHEN i = width THEN x / norm END), 5) AS p_last FROM m JOIN n USING (key) GROUP BY key""",
    "maxsim_topk": "WITH s AS (SELECT d.vec_id // 4 AS key, q.vec_id AS q, max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))) AS best FROM embeddings d, embeddings q WHERE q.vec_id < 3 GROUP BY 1, 2) SELECT key, round(sum(best), 5) AS score FROM s GROUP BY key ORDER BY score DESC, key LIMIT 10",
    "maxsim_topk_all": "WITH b AS (SELECT q.vec_id // 4 AS query, q.vec_id, d.vec_id // 4 AS key, max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))) AS best FROM embeddings d, embeddings q WHERE (q.vec_id // 4) % 50 = 0 GROUP BY 1, 2, 3), s AS (SELECT query, key, round(sum(best), 5) AS score FROM b GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM s) WHERE place <= 10",
    "knn_topk": _KNN + "SELECT * FROM knn WHERE place <= 4",
    "mutual_knn_edges": _EDGES + "SELECT * FROM edges",
    "modularity": _EDGES + """, ends AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), t AS (SELECT x.c, sum(weight) AS total, sum(CASE WHEN x.c = y.c THEN weight ELSE 0 END) AS inn FROM ends JOIN v x ON x.key = src JOIN v y ON y.key = dst GROUP BY 1)
        SELECT round(sum(inn / m2 - (total / m2) * (total / m2)), 6) AS modularity FROM t, (SELECT sum(total) AS m2 FROM t)""",
    "centrality_rank": _KNN + """, s AS (SELECT x.key, sum(CAST(round(weight * 100000) AS BIGINT))::BIGINT AS strength FROM knn JOIN v x ON x.key = src JOIN v y ON y.key = dst WHERE place <= 8 AND x.c = y.c GROUP BY 1)
        SELECT key, c AS community, coalesce(strength, 0) AS strength, row_number() OVER (PARTITION BY c ORDER BY coalesce(strength, 0) DESC, key) - 1 AS place FROM v LEFT JOIN s USING (key)""",
    "cluster_quality": _KNN + _KNN16 + _FLOOR + _PLACED + "SELECT community, rows, misplaced, outvoted, cohesion FROM qual",
    "cluster_quality_report": _KNN + _KNN16 + _FLOOR + _PLACED + """, med AS (SELECT coalesce(list(cohesion ORDER BY cohesion)[count(*) // 2 + 1], 0) AS m FROM qual WHERE rows >= 5)
        SELECT sum(rows)::BIGINT AS scored, sum(misplaced)::BIGINT AS misplaced, sum(outvoted)::BIGINT AS outvoted, any_value(m) AS cohesion_median, count(*) FILTER (rows >= 5 AND cohesion < 0.8 * m) AS grab_bags FROM qual, med""",
    "name_gate": """WITH tk AS (SELECT vec_id // 4 AS key, vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id // 4 % 9 AS topic FROM embeddings), mm AS (SELECT topic, ka, kb, avg(best) AS s FROM (SELECT a.topic, a.key AS ka, b.key AS kb, a.vec_id, max(list_dot_product(a.e, b.e)) AS best FROM tk a JOIN tk b ON a.topic = b.topic GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
        sc AS (SELECT topic, avg(s) AS score FROM mm WHERE ka = topic GROUP BY 1), li AS (SELECT topic, CASE WHEN count(*) < 5 THEN 0.5 ELSE greatest(0.5, 0.85 * list(c ORDER BY c)[(10 * (count(*) - 1) + 50) // 100 + 1]) END AS l FROM (SELECT topic, ka, avg(s) FILTER (ka <> kb) AS c FROM mm GROUP BY 1, 2) GROUP BY 1)
        SELECT topic, round(score, 5) AS score, round(l, 5) AS "limit", score >= l AS accepted FROM sc JOIN li USING (topic)""",
    "near_dup_groups": _TOKENS + "SELECT key, rep, size FROM reps",
    "near_dup_vectors": _KNN.replace("WITH v", "WITH RECURSIVE v") + ", l AS (SELECT src AS a, dst AS b FROM pairs WHERE weight >= 0.3), reach AS (SELECT a, b FROM l UNION SELECT r.a, e.b FROM reach r JOIN l e ON r.b = e.a) SELECT a AS key, least(a, min(b)) AS rep FROM reach GROUP BY a",
    "near_dup_classes": _KNN.replace("WITH v", "WITH RECURSIVE v") + ", l AS (SELECT src AS a, dst AS b FROM pairs WHERE weight >= 0.3), reach AS (SELECT key AS a, key AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN l e ON r.b = e.a) SELECT a AS key, min(b) AS rep FROM reach GROUP BY a",
    "knn_two_stage": _TOKENS + "SELECT * FROM two",
    "knn_collapsed": _TOKENS + "SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY place) AS place FROM two WHERE src IN (SELECT rep FROM reps) AND dst IN (SELECT rep FROM reps)",
    "neighbour_dump": _KNN + _FLOOR + "SELECT src, a.topic AS src_topic, place, dst, b.topic AS dst_topic, weight FROM knn LEFT JOIN assigned a ON a.key = src LEFT JOIN assigned b ON b.key = dst WHERE place <= 10 AND contains(src::VARCHAR, '13')",
    "search": _TOKENS + ", q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 3) SELECT key, round(sum(best), 5) AS score FROM (SELECT tk.key, q.vec_id, max(list_dot_product(q.e, tk.e)) AS best FROM tk JOIN un USING (key), q WHERE key % 4 = 2 AND repo IN ('r0', 'r2') AND item GROUP BY 1, 2) GROUP BY key ORDER BY score DESC, key LIMIT 7",
    "related": """WITH qw AS (SELECT unnest(['pack', 'wheel', 'round', 'cart', 'totals', 'rate', 'limit', 'total-cost']) AS w), dw AS (SELECT DISTINCT item_id AS key, regexp_replace(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}-]+')), '^-+|-+$', '', 'g') AS w FROM benchmark), dv AS (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM dw WHERE w <> '')),
        sim AS (SELECT qw.w AS q, dv.w AS d, sum(CASE WHEN (substr(md5(qw.w), j, 1) >= '8') = (substr(h, j, 1) >= '8') THEN 1 ELSE -1 END) / 32.0 AS s FROM qw, dv, range(1, 33) r(j) GROUP BY 1, 2)
        SELECT key, round(sum(best), 5) AS score FROM (SELECT key, q, max(s) AS best FROM dw JOIN sim ON d = w GROUP BY 1, 2) GROUP BY key ORDER BY score DESC, key LIMIT 8""",
    "embedding_blobs": "SELECT (vec_id // 4)::VARCHAR AS key, count(*) AS rows, (count(*) * any_value(len(embedding)))::INT AS values, round(arg_min(embedding[1], vec_id)::DOUBLE, 2) AS first FROM embeddings GROUP BY 1",
    "eval_retrieval": "SELECT count(*) AS queries, count(*) AS hits, 1.0::DOUBLE AS rate FROM benchmark",
    "fresher_manifest": """SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'add' WHEN b.file IS NULL THEN 'remove' ELSE 'replace' END AS action
        FROM (SELECT o_orderkey AS file, o_custkey AS hash FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS file, o_custkey % 500 AS hash FROM orders WHERE o_orderkey % 4 <> 0) b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.hash <> b.hash""",
    "recent_work": "SELECT (i - 1)::INT AS place, ['pack', 'wheel', 'round', 'cart', 'totals', 'rate', 'limit', 'total-cost'][i] AS word FROM range(1, 9) r(i)",
    "topic_units": _topics_sql("true", "'label ' || topic") + "SELECT * FROM tu",
    "topic_units_scoped": _topics_sql("repo IN ('r1', 'r2', 'r3') AND source = 'github'", "arg_min(title, rank)") + "SELECT * FROM tu",
    "topics": _topics_sql("true", "'label ' || topic") + "SELECT topic, label, size, last_active FROM tu WHERE topic IN (SELECT topic FROM u WHERE contains(lower(title), 'order 1')) OR contains(label, 'order 1') ORDER BY last_active DESC, size DESC, topic LIMIT 7",
    "topic_facet": _WORK + "SELECT topic FROM w WHERE topic IS NOT NULL GROUP BY topic HAVING bool_or(repo = 'r3') AND bool_or(author = 'u2')",
    "member_hashes": _WORK + "SELECT topic, count(*)::INT AS n, md5(string_agg(md5(key), ',' ORDER BY rank)) AS digest FROM w WHERE topic IS NOT NULL AND NOT dup GROUP BY topic",
    "day_strip": _WORK + "SELECT topic, string_agg(n::VARCHAR, ',' ORDER BY slot) AS strip FROM (SELECT t.topic, slot, count(w.key) AS n FROM (SELECT DISTINCT topic FROM w WHERE topic IS NOT NULL AND CAST(day AS DATE) BETWEEN DATE '1998-07-06' AND DATE '1998-08-02') t CROSS JOIN range(28) r(slot) LEFT JOIN w ON w.topic = t.topic AND CAST(w.day AS DATE) = DATE '1998-07-06' + slot::INT GROUP BY 1, 2) GROUP BY topic",
    "recent": _WORK + "SELECT key, day, unit FROM w WHERE repo = 'r2' ORDER BY day DESC, unit <> 'session', key LIMIT 60",
    "recent_scoped": _WORK + "SELECT key, campaign FROM w WHERE campaign = 'camp1' AND source = 'github' ORDER BY day DESC, unit <> 'session', key LIMIT 100",
    "status": _DOC + f"SELECT count(*) AS docs, count(*) FILTER (src = 'github') AS github, count(DISTINCT CASE WHEN src <> 'github' AND coalesce(session_id, '') <> '' THEN session_id END) AS sessions, '{NEWEST}' AS newest FROM docs",
    "doc_inputs": _ITEMS + f"SELECT 'gh:' || repo || '#' || number AS key, CASE kind WHEN 'issue' THEN 'issue' ELSE 'pull request' END AS kind, md5(rtrim({_FIRST})) AS title, md5({_cut('text', 1500)}) AS text FROM it WHERE kind <> 'user_prompt'",
    "units_with_topics": _ITEMS + f"SELECT 'gh:' || repo || '#' || number AS key, CASE kind WHEN 'issue' THEN 'issue' ELSE 'pr' END AS unit, '2024-01-' || lpad((number % 28 + 1)::VARCHAR, 2, '0') AS day, length(repo || '#' || number || ' ' || rtrim({_FIRST})) AS title, CASE WHEN number % 7 < 6 THEN number % 7 END AS topic, CASE WHEN number % 7 < 6 THEN number END AS rank, CASE WHEN number % 5 <> 0 THEN 'about ' || number END AS summary FROM it WHERE kind <> 'user_prompt'",
    "all_docs": _DOC + "SELECT doc_id, session_id, repo, NULL AS kind FROM docs WHERE kind = 'message' UNION ALL SELECT doc_id, NULL, repo, CASE kind WHEN 'pr' THEN 'pull_request' ELSE 'issue' END FROM docs WHERE kind <> 'message'",
    "reconciled": """WITH d AS (SELECT md5(coalesce(text, '')) AS hash, doc_id AS pos FROM documents), o AS (SELECT hash, pos, row_number() OVER (PARTITION BY hash ORDER BY pos) AS nth FROM d), c AS (SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY pos) AS nth FROM d WHERE pos % 7 <> 0), m AS (SELECT pos, c.hash IS NOT NULL AS stays FROM o LEFT JOIN c USING (hash, nth))
        SELECT pos AS deleted, (SELECT count(*) FROM m WHERE stays) AS survivors FROM m WHERE NOT stays AND 5 * (SELECT count(*) FROM m WHERE NOT stays) <= (SELECT count(*) FROM m)""",
    "cache_sync": """WITH a AS (SELECT o_orderkey AS key, (o_custkey % 3)::VARCHAR AS hash, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'v' || o_custkey END AS value FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS key, (o_custkey % 4)::VARCHAR AS hash, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'v' || o_custkey END AS value FROM orders WHERE o_orderkey % 4 <> 0)
        SELECT *, 'local' AS "to" FROM b WHERE value <> '' AND (key, hash) NOT IN (SELECT (key, hash) FROM a) UNION ALL SELECT *, 'remote' FROM a WHERE value <> '' AND (key, hash) NOT IN (SELECT (key, hash) FROM b)""",
    "name_report": _NAMES + """SELECT count(*) AS topics, count(*) FILTER (judged) AS scored, round(list(score ORDER BY score) FILTER (judged)[count(*) FILTER (judged) // 2 + 1], 6) AS score_median, round(list(low ORDER BY low) FILTER (judged)[count(*) FILTER (judged) // 2 + 1], 6) AS low_median,
        round(list(score / low ORDER BY score / low) FILTER (judged AND low > 0)[count(*) FILTER (judged AND low > 0) // 2 + 1], 6) AS ratio_median, count(*) FILTER (judged AND rejected) AS rejected, count(*) FILTER (is_fallback) AS fallbacks, count(*) FILTER (same > 1) AS shared, count(*) FILTER (contains(name, '-a')) AS slugs,
        count(*) FILTER (judged AND score < CASE WHEN members < 5 THEN 0.5 ELSE greatest(0.5, 0.7 * low) END) AS rejected_at_70, count(*) FILTER (judged AND score < CASE WHEN members < 5 THEN 0.5 ELSE greatest(0.5, 0.8 * low) END) AS rejected_at_80, count(*) FILTER (judged AND score < CASE WHEN members < 5 THEN 0.5 ELSE greatest(0.5, 0.9 * low) END) AS rejected_at_90,
        count(*) FILTER (judged AND rejected AND rating = 'wrong') AS true_rejections, count(*) FILTER (judged AND rejected AND rating = 'good') AS false_rejections, count(*) FILTER (judged AND NOT rejected AND rating = 'wrong') AS missed FROM nm""",
    "name_median_gate": "WITH s AS (SELECT item_id AS topic, (item_id * 37 % 101) / 100.0::DOUBLE AS score FROM benchmark) SELECT topic, score, (SELECT count(*) FROM s) >= 8 AND score < 0.6 * (SELECT list(score ORDER BY score)[count(*) // 2 + 1] FROM s) AS rejected FROM s",
    "name_sensitivity": _NAMES + "SELECT count(*) FILTER (score < CASE WHEN members < 5 THEN 0.5 ELSE greatest(0.5, 0.8 * low) END) AS rejected FROM nm",
    "gated_names": "SELECT item_id AS topic, CASE WHEN item_id % 3 <> 0 AND item_id % 2 <> 0 THEN 'n' || (item_id % 49) ELSE 'n' || (item_id % 50) END AS name, item_id % 3 <> 0 AND item_id % 2 <> 0 AND item_id % 49 <> item_id % 50 AS replaced FROM benchmark",
    "finished_names": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'OCR Adapter' WHEN 3 THEN 'Multi GPU Packing' ELSE CASE item_id % 3 WHEN 0 THEN 'This Theme Focuses on Packing the Carts' ELSE 'OCR-Adapter · Packing' END END AS name, CASE item_id % 3 WHEN 0 THEN 'Packing the carts, and more' ELSE '' END AS summary FROM benchmark",
    "input_hash": "SELECT doc_id, left(sha256('v3' || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')), 16) AS hash FROM documents",
    "role_matrix": "SELECT role, tool, role = 'operator' OR role = 'primary' AND tool IN ('search', 'related', 'topics', 'recent', 'status', 'show') OR role = 'investigator' AND tool NOT IN ('related', 'stats', 'tool') OR role = 'validator' AND tool NOT IN ('related', 'topics', 'recent', 'stats', 'tool') AS allowed FROM (SELECT unnest(['operator', 'primary', 'investigator', 'validator']) AS role), (SELECT unnest(['search', 'related', 'topics', 'recent', 'show', 'trace_list', 'trace_show', 'trace_search', 'trace_compare', 'status', 'stats', 'tool']) AS tool)",
    "build_identity": "SELECT sha256(string_agg(digest, ',' ORDER BY block)) AS build, sum(n)::BIGINT AS rows FROM (SELECT o_orderkey // 4096 AS block, sha256(string_agg(sha256(o_orderkey || chr(0) || o_custkey), ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1)",
    "topic_lines": _topics_sql("true", "'label ' || topic") + "SELECT topic, '- **' || label || '** · ' || size || ' units · ' || sessions || ' sessions · ' || prs || ' PRs · last ' || last_active AS line FROM tu",
    "tally_lines": f"SELECT repo, '- ' || CASE WHEN repo = '' THEN '—' ELSE repo END || ': ' || docs || ' docs · ' || sessions || ' sessions · ' || {_tokens('tok_out')} || ' tokens out · ' || tools || ' tool calls' AS line FROM ({_status('repo')})",
    "hit_at_5": _KNN + ", q AS (SELECT key, max((place <= 5 AND y.c = x.c)::INT) AS hit FROM v x JOIN knn ON src = x.key JOIN (SELECT key AS k2, c FROM v) y ON y.k2 = dst WHERE x.c IN (SELECT c FROM v GROUP BY c HAVING count(*) > 1) GROUP BY key) SELECT count(*) AS queries, sum(hit)::BIGINT AS hits, round(sum(hit) / count(*), 6) AS rate FROM q",
}
ORACLES["machine_lines"] = f"SELECT machine, '- **' || machine || '** · ' || sources || ' · last ' || substr(last_ts, 1, 10) || ' · ' || recent || ' events · v' || coalesce(version, '—') || CASE WHEN quiet THEN ' · quiet' ELSE '' END AS line FROM ({ORACLES['fleet_machines']})"
