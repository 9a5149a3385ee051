"""Search, show, access, redaction, names, caches and policies on small fixtures; scans counted in plans."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import encode, naming, redaction, render
from plumbline.operators import access, ingest, insight, surfaces, trace
from plumbline.plans import registry
from plumbline.sources import tables
from plumbline.streaming import ingest as streaming
from tests.test_trace import frame

SF = "/root/testdata/sf0.001"


def test_search_filters_before_it_ranks(spark):
    rows = [(i, "cart wheel" if i < 20 else "cart", "a" if i < 20 else "b") for i in range(40)]
    units = spark.createDataFrame(rows, "key long, text string, repo string")
    hits = surfaces.search_text(units, "cart wheel", 5, "repo = b").collect()
    assert len(hits) == 5 and all(r.key >= 20 for r in hits)
    hits = surfaces.search_text(units, "cart wheel", 3, scope=access.ReadScope(repos=("a",))).collect()
    assert [r.key for r in hits] == [0, 1, 2] and all(abs(r.score - 2) < 1e-5 for r in hits)
    assert surfaces.search_text(units, "cart wheel", 1000).count() == 40
    assert surfaces.cards(surfaces.search_text(units, "wheel", 2), units).count() == 2
    with pytest.raises(ValueError):
        surfaces.search_text(units, "x" * 5000)
    empty = encode.encoded(spark.createDataFrame([(" ,",)], "text string"), "text").first()
    assert empty.rows == 1 and set(empty.matrix) == {0.0}


def test_related_query(spark):
    subjects = "Fix the cart\nround the cart totals\n2024 sub-totals fix"
    files = "src/cart/rate_limit.rs\nREADME\n.github/workflows/ci-main.yml"
    assert surfaces.recent_work(spark, subjects, files) == ["cart", "round", "totals", "sub-totals", "rate", "limit", "readme", "ci-main"]
    units = spark.createDataFrame([(1, "rate limit"), (2, "weather")], "key long, text string")
    assert [r.key for r in surfaces.related(units, subjects, files, 1).collect()] == [1]
    assert surfaces.related(units, "fix 12", "", 1).count() == 0


def test_resolve(spark):
    sessions = spark.createDataFrame([("abcd1234",), ("abcd9999",), ("abcd",), ("zzzz1",)], "session_id string")
    topics = spark.createDataFrame([("qrst77",)], "key string")
    items = spark.createDataFrame([("shop", 7, "issue")], "repo string, number long, kind string")
    find = lambda key: surfaces.resolve(key, sessions, topics, items)
    assert find("gh:shop#7") == find("shop#7") == ("item", "gh:shop#7") and find("abcd") == ("session", "abcd") and find("qrst") == ("topic", "qrst77") and find(" zzzz1 ") == ("session", "zzzz1")
    for key, error in (("abc", ValueError), ("abcd1", None), ("shop#8", LookupError), ("shop#x", ValueError), ("none", LookupError), ("abcd9", None)):
        if error:
            with pytest.raises(error):
                find(key)
        else:
            assert find(key)[0] == "session"
    with pytest.raises(LookupError, match="ambiguous"):
        surfaces.resolve("abcd", sessions.where("session_id <> 'abcd'"), topics, items)


def test_show_a_session(spark):
    events = frame(spark, [("s1-long", "claude_code", "session_start", {"cwd": "/w/shop-fix/src"}), ("s1-long", "claude_code", "user_prompt", {"text": "please pack the round wheel"}), ("s1-long", "claude_code", "agent_meta", {"subtype": "usage", "msg_id": "m", "model": "x", "usage": {"in": 1500, "out": 2}}), ("s1-long", "claude_code", "tool_call", {"tool_use_id": "t", "name": "Edit"})])
    details = surfaces.session_details(events, spark.createDataFrame([("shop",)], "repo string"))
    topics = spark.createDataFrame([(1, "x")], "topic long, label string")
    items = spark.createDataFrame([("shop", 7, "issue", "Title\nbody")], "repo string, number long, kind string, text string")
    kind, row = surfaces.show("s1-l", details, topics, items, events)
    row = row.first()
    assert (kind, row.repo, row.tok_in, row.asked, row.tools_by_name[0].tool) == ("session", "shop", 1500, ["please pack the round wheel"], "Edit")
    line = render.session_lines(details).first().line
    assert "tokens: 1.5k in" in line and "effort [" in line and "tools: Edit×1" in line and "linked PR" not in line
    kind, row = surfaces.show("shop#7", details, topics, items, events)
    assert kind == "item" and row.first().title == "Title"


def test_only_allowed_repositories(spark):
    """Known only from a start that comes later, unknown, and without a session: what can't be told stays out."""
    events = frame(spark, [("a", "x", "user_prompt", {"text": "1"}), ("a", "x", "session_start", {"cwd": "/w/shop-fix"}), ("b", "x", "session_start", {"repo": "other", "cwd": "/w/shop"}), ("b", "x", "user_prompt", {"text": "2"}), ("c", "x", "user_prompt", {"text": "3"}), ("", "x", "session_start", {"cwd": "/w/shop"})])
    known = spark.createDataFrame([("shop",)], "repo string")
    assert {r.session_id for r in access.allowed_events(events, ["shop"], known).collect()} == {"a"}
    assert access.allowed_events(events, ["nowhere"], known).count() == 0 and access.allowed_events(events, [], known).count() == 6
    assert not access.may_call("primary", "trace_list") and access.may_call("operator", "tool") and not access.may_call("operator", "status", access.ReadScope(repos=("x",)))
    assert access.resolved_actor("", "rin@host", "u") == "rin" and access.resolved_actor() == "unknown"


def test_windows_and_caps(spark, monkeypatch):
    events = frame(spark, [(f"s{i % 5}", "x", "user_prompt", {"text": "abc"}) for i in range(30)])
    for since, until in (("2031-01-02T00:00:00Z", "2031-01-01T00:00:00Z"), ("2031-01-01T00:00:00Z", "2031-01-08T00:00:01Z")):
        with pytest.raises(ValueError):
            trace.raw_window(events, since, until)
    rows = trace.raw_window(events, "2031-01-01T00:00:00Z", "2031-01-08T00:00:00Z", id_prefixes=["x001"])
    assert trace.within_caps(rows).count() == 10
    for name, most in (("MOST_EVENTS", 9), ("MOST_BYTES", 50), ("MOST_SESSIONS", 4)):
        monkeypatch.setattr(trace, name, most)
        with pytest.raises(ValueError):
            trace.within_caps(rows)
        monkeypatch.undo()
    assert trace.streams_of(events, "BOX") == ["edge-box-a-codex"]
    with pytest.raises(ValueError):
        trace.streams_of(events, "nowhere")
    with pytest.raises(ValueError):
        trace.comparable(events, "event")


def test_redaction(spark):
    payload = {"text": "Bearer abcdefghijklmnop1", "a": [{"Client-Secret": {"deep": 1}}, "ghp_abcdefghijklmnop"], "input_token": 5, "my_token": "t", "token_count": 3, "secret": None, "n": 1.5}
    rows = spark.createDataFrame([(1, json.dumps(payload)), (2, "MY_SECRET=abc not json"), (3, None), (4, json.dumps("x" * 5000))], "id int, payload string")
    found = {r.id: r.payload for r in redaction.redacted_payloads(rows, profile="mcp-safe").collect()}
    assert json.loads(found[1]) == {"text": "[REDACTED]", "a": [{"Client-Secret": "[REDACTED]"}, "[REDACTED]"], "input_token": 5, "my_token": "[REDACTED]", "token_count": 3, "secret": None, "n": 1.5}
    assert found[2] == "[REDACTED] not json" and found[3] is None and json.loads(found[4]) == "x" * 4096 + "\n[TRUNCATED]"
    assert redaction.redacted_payloads(rows, profile="off").collect() == rows.collect()
    event = {"event_id": "sk-abcdefghijklmnop0123", "payload": {"password": "x"}}
    lines = spark.createDataFrame([(json.dumps(event),), ("  ",), ("Basic abcdefghijklmnop= broken",)], "line string")
    kept = [r.line for r in redaction.redacted_lines(lines).collect()]
    assert json.loads(kept[0]) == {"event_id": "sk-abcdefghijklmnop0123", "payload": {"password": "[REDACTED]"}} and kept[1:] == ["[REDACTED] broken"]
    with pytest.raises(ValueError):
        redaction.profile_named("loud")
    deep = "[" * 900 + '"sk-abcdefghijklmnop0123"' + "]" * 900
    assert "REDACTED" in json.dumps(redaction.clean_value(json.loads(deep), 100))


@pytest.mark.parametrize(
    ("raw", "name"),
    [("OcrAdapterCluster", "OCR Adapter"), ("msgpack-processing", "Msgpack Processing"), ("MULTI-GPU CLUSTER", "Multi GPU"), ("florence-2 for ColBERT", "Florence-2 for ColBERT"), ("<think>hm</think>\n\"sglang_router\"", "SGLang Router"), ("Keyphrase: x", ""), ("misc", ""), ("a b c d e f g h i j", ""), ("", ""), ("SIE-Server", "SIE Server"), ("GPT-5.5 in s3", "GPT-5.5 in S3")],
)
def test_names(raw, name):
    assert naming.clean_name(raw) == name


def test_name_rules():
    assert naming.clean_summary("This theme focuses on the project is about packing round carts") == "Packing round carts"
    assert naming.clean_summary("short") == "" and naming.clean_summary("repo: something that is long") == ""
    assert naming.summary_heading("Updating terraform configurations for the, and so on") == "Updating Terraform Configurations"
    assert naming.summary_heading("one") == "" and naming.grounded("Internal API", ["sie-internal"]) and not naming.grounded("Weather", ["sie-internal"])
    assert naming.finished_name("sie-web", "Packing the carts. More", ["web"], ["sie-web"]) == "Packing the Carts"
    assert naming.finished_name("x", None, ["sie", "packing", "carts"], ["sie-web"]) == "Packing · Carts"


def test_tables_that_follow_their_inputs(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/model"
    source.mkdir()
    (source / "a.txt").write_text("x")
    derive = lambda: {"t": spark.range(3)}
    again = lambda settings: tables.derive_if_changed(spark, root, [str(source)], settings, derive)
    assert again("1") and not again("1") and again("2")
    (source / "b.txt").write_text("y")
    assert again("2") and tables.current(spark, root)["t"].count() == 3
    assert len(list((tmp_path / "model").glob("current.json"))) == 1 and not list((tmp_path / "model").glob("_current*"))
    os.utime(source / "b.txt", (2_000_000_000, 2_000_000_000))
    assert tables.stale(spark, str(source), f"{tmp_path}/model/current.json") and not tables.stale(spark, str(source / "a.txt"), f"{tmp_path}/model/current.json")
    docs = tmp_path / "docs.jsonl"
    docs.write_text(json.dumps({"id": 1, "text": "t", "meta": {"repo": "shop", "labels": ["x"], "number": 3}}) + "\n")
    row = tables.read_docs(spark, str(docs)).first()
    assert (row.repo, row.labels, row.number) == ("shop", ["x"], 3)
    docs.write_text("{broken\n")
    with pytest.raises(Exception):
        tables.read_docs(spark, str(docs)).collect()
    events = spark.createDataFrame([("2031-01-01T00:00:00Z", "a", 1), ("2031-01-02T00:00:00Z", "b", 2)], "ts string, stream string, v long")
    tables.partitioned_events(events, f"{tmp_path}/raw")
    assert [r.v for r in tables.read_partitioned(spark, f"{tmp_path}/raw", ["b"], "2031-01-02", "2031-01-02").collect()] == [2]
    plan = tables.read_partitioned(spark, f"{tmp_path}/raw", ["b"], "2031-01-02")._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan


def test_policies_stay(spark, tmp_path):
    folder = f"{tmp_path}/checkpoint"
    streaming.ensure_policy(spark, folder, "standard", ["b", "a"])
    streaming.ensure_policy(spark, folder, "off", [])
    os.makedirs(f"{folder}/offsets")
    streaming.ensure_policy(spark, folder, "off", [])
    with pytest.raises(ValueError):
        streaming.ensure_policy(spark, folder, "standard", [])


def test_too_many_departures(spark):
    docs = spark.range(20).select(F.col("id").cast("string").alias("hash"), F.col("id").alias("pos"))
    assert sorted(r.deleted for r in ingest.reconciled(docs, docs.where("pos > 3")).collect()) == [0, 1, 2, 3]
    assert ingest.reconciled(docs, docs.where("pos > 4")).count() == 0


def test_timeline_of_a_turn(spark):
    """A job stands once with what became of it; its later writes in the same turn are left out, in other turns they stay."""
    call = lambda c, name, args: ("s", "codex_cli", "tool_call", {"call_id": c, "name": name, "arguments": json.dumps(args)})
    result = lambda c, text: ("s", "codex_cli", "tool_result", {"call_id": c, "output": text})
    meta = lambda kind, **more: ("s", "codex_cli", "agent_meta", {"event_kind": kind, **more})
    rows = [
        meta("task_started", turn_id="T1"), call("a", "exec_command", {"cmd": "make  all"}), result("a", "Wall time: 2 seconds Process running with session ID 7"), call("b", "write_stdin", {"session_id": 7}), result("b", "Process running with session ID 7"),
        call("c", "shell", {"cmd": "ls"}), meta("task_complete", duration_ms=90_000), meta("task_started", turn_id="T2"), call("d", "write_stdin", {"session_id": 7}), result("d", "Process exited with code 0"),
    ]
    events = frame(spark, rows)
    members = trace.membership(events)
    found = trace.spans_in_turns(trace.spans(events), members)
    first = [(r.id, r.kind, r.summary) for r in trace.turn_timeline(events, members, found, "T1").orderBy("place").collect()]
    assert first == [("x0000", "agent_meta", "task_started"), ("job:x0001", "job", "make all → ok · 8.0s elapsed · 2.0s reported-wait · 2 polls · 0 errors"), ("x0005", "span", "shell → open · — · ls"), ("x0006", "agent_meta", "task_complete · 1.5m")]
    second = [(r.id, r.kind) for r in trace.turn_timeline(events, members, found, "T2").orderBy("place").collect()]
    assert second == [("x0007", "agent_meta"), ("x0008", "span")]
    assert trace.jobs(found).first().turn_ids == ["T1", "T2"]


def test_metrics(spark):
    rows, observation = surfaces.observed(spark.range(7), "ingest", kept=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    rows.write.format("noop").mode("overwrite").save()
    assert surfaces.metrics_line("ingest", observation) == "[metrics ingest] kept=7 odd=3"


def test_activity_of_a_topic(spark):
    units = spark.createDataFrame([(1, "2031-01-20"), (1, "2031-01-14"), (1, "2031-01-13"), (1, "2030-01-01"), (2, "2031-01-01")], "topic long, day string")
    assert {r.topic: r.activity for r in surfaces.weekly_counts(units, 3).collect()} == {1: [0, 1, 2], 2: [0, 0, 1]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["struggle", "turns_task", "turns_prompt", "spans", "jobs", "trace_search", "session_rollup", "resolve_prefix"])
def test_few_scans(spark, name):
    """Events are parsed and deduplicated once; a query reads the store, and reads few times what it needs several times."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) <= (12 if name == "resolve_prefix" else 4) and "from_json" not in plan


def test_fleet_window(spark):
    actors = spark.createDataFrame([("Rin", "2031-01-05"), ("old", "2030-01-01")], "actor string, ts string")
    authors = spark.createDataFrame([("RIN", "2031-01-02", None), ("old", "2031-01-02", None), ("Sky", "2031-01-03", "cursor"), ("sky", "2031-01-02", None), ("abe", "2031-01-04", None), ("gone", "2030-12-01", "aider"), ("renovate", "2031-01-04", None)], "author string, ts string, agent string")
    rate, untracked = insight.fleet_coverage(actors, authors, since="2031-01-01")
    assert tuple(rate.first()) == (4, 1, 25)
    assert [(r.login, r.agent) for r in untracked.orderBy("place").collect()] == [("sky", "cursor"), ("abe", ""), ("old", "")]


def test_idle_sessions_share_state(spark, tmp_path):
    """Sessions end, go on and end again; state has a row for a group of sessions, not for each."""
    land, out, checkpoint = (str(tmp_path / name) for name in ("land", "out", "checkpoint"))
    line = lambda session, ts: {"session_id": session, "ts": f"2031-01-01T{ts}Z"}

    def arrive(name, rows):
        os.makedirs(land, exist_ok=True)
        with open(f"{land}/{name}.json", "w") as file:
            file.writelines(json.dumps(row) + "\n" for row in rows)
        query = streaming.append_to(streaming.idle_ends(streaming.stream_envelopes(spark, land)), out, checkpoint)
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    def ends():
        return sorted((r.session_id, r.ended_ms % 86_400_000 // 1000, r.events, r.reason) for r in spark.read.parquet(out).collect())

    first = [line(f"s{i}", "08:00:00") for i in range(3000)] + [line("s7", "08:00:30"), line("s8", "08:05:00"), line("", "08:00:00"), line("s9", "bad"), line("last", "08:11:00")]
    assert arrive("a", first) <= streaming.IDLE_BUCKETS
    done = [(f"s{i}", 28_800 + 30 * (i == 7), 1 + (i == 7), "idle") for i in range(3000) if i != 8]
    assert ends() == sorted(done)
    arrive("b", [line("s5", "08:12:00"), line("s8", "08:13:00"), line("s8", "08:14:00")])
    assert ends() == sorted(done)
    arrive("c", [line("far", "09:00:00")])
    assert ends() == sorted([*done, ("last", 29_460, 1, "idle"), ("s5", 29_520, 1, "idle"), ("s8", 29_640, 4, "idle")])


def arriving(spark, tmp_path, operator):
    """A function that lands a file, runs the stream over it and gives the rows of its state."""
    land, out, checkpoint = (str(tmp_path / name) for name in ("land", "out", "checkpoint"))

    def arrive(name, rows):
        os.makedirs(land, exist_ok=True)
        with open(f"{land}/{name}.json", "w") as file:
            file.writelines(json.dumps(dict(zip(("session_id", "event_id", "seq", "kind", "ts"), row, strict=True))) + "\n" for row in rows)
        query = streaming.append_to(operator(streaming.stream_envelopes(spark, land)), out, checkpoint)
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    return arrive, lambda: spark.read.parquet(out)


def test_sessions_at_the_boundary_share_state(spark, tmp_path):
    """Starts are staged over triggers; state has a row for a group of sessions, not for each."""
    arrive, out = arriving(spark, tmp_path, lambda stream: streaming.staged_boundary(stream, "2031-01-01T08:00:00Z"))
    old, new = "2031-01-01T07:00:00Z", "2031-01-01T09:00:00Z"
    many = [(f"s{i}", f"a{i}", 1, "session_start", old) for i in range(3000)]
    odd = [("end", "e1", 1, "session_start", old), ("end", "e2", 2, "session_end", old), ("one", "o3", 3, "tool_call", new), ("one", "o1", 1, "session_start", old), ("one", "o4", 4, "tool_call", old), (None, "n1", 1, "session_start", old), ("bad", "b1", 1, "tool_call", "never")]
    assert arrive("a", many + odd) <= streaming.IDLE_BUCKETS
    found = lambda: sorted((r.session_id or "", r.event_id) for r in out().collect())
    done = [("bad", "b1"), ("one", "o1"), ("one", "o3")]
    assert found() == done
    arrive("b", [(f"s{i}", f"b{i}", 3, "tool_call", new) for i in range(0, 3000, 2)] + [("s2", "c2", 2, "session_start", old), ("end", "e3", 3, "tool_call", new), ("one", "o5", 5, "session_start", old), ("bad", "b2", 2, "tool_call", new), (None, "n2", 2, "tool_call", new)])
    done += [(f"s{i}", f"b{i}") for i in range(0, 3000, 2)] + [(f"s{i}", f"a{i}" if i != 2 else "c2") for i in range(0, 3000, 2)] + [("end", "e3"), ("bad", "b2"), ("", "n1"), ("", "n2")]
    assert found() == sorted(done)
    arrive("c", [("s2", "d2", 4, "tool_call", new), ("s1", "d1", 4, "tool_call", new), ("one", "o6", 6, "tool_call", new)])
    assert found() == sorted([*done, ("s2", "d2"), ("s1", "a1"), ("s1", "d1"), ("one", "o6")])


def test_starts_of_sessions_share_state(spark, tmp_path):
    """One start a session over all triggers; state has a row for a group of sessions, not for each."""
    arrive, out = arriving(spark, tmp_path, streaming.first_starts)
    many = [(f"s{i}", f"a{i}-{n}", n, "session_start", "") for i in range(3000) for n in (2, 1)]
    assert arrive("a", [*many, ("s7", "t7", 3, "tool_call", ""), ("late", "l1", 1, "tool_call", ""), (None, "n", 1, "session_start", ""), ("", "m", 1, "session_start", "")]) <= streaming.IDLE_BUCKETS
    arrive("b", [("s7", "a7-0", 0, "session_start", ""), ("late", "l3", 3, "session_start", ""), ("late", "l2", 2, "session_start", ""), ("s7", "t8", 5, "tool_call", "")])
    wanted = [(f"s{i}", f"a{i}-1") for i in range(3000)] + [("s7", "t7"), ("s7", "t8"), ("late", "l1"), ("late", "l2")]
    assert sorted((r.session_id, r.event_id) for r in out().collect()) == sorted(wanted)
