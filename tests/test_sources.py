"""Scans, native logs, imports, tables and text functions on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ids
from plumbline.functions import text as T
from plumbline.operators import insight, vectors
from plumbline.operators.access import ReadScope, scope_filter
from plumbline.sources import native_logs, tables
from plumbline.sources.envelopes import dedup_events, malformed, read_envelopes, well_formed


def test_scan(spark, tmp_path):
    lines = [json.dumps({"event_id": e, "stream": "edge-box-a-claudecode", "seq": 0, "ts": "2031-03-04T08:00:00Z", "source": "claude_code", "session_id": "A", "kind": "user_prompt", "payload": {"text": "make it round"}}) for e in ("x1", "x2", "x2")]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, "not json at all"]) + "\n")
    rows = read_envelopes(spark, str(tmp_path))
    assert malformed(rows).first().malformed == 1
    kept = dedup_events(well_formed(rows))
    assert sorted(r.event_id for r in kept.collect()) == ["x1", "x2"]
    assert kept.where(F.get_json_object("payload", "$.text") == "make it round").count() == 2


def test_native_logs(spark, tmp_path):
    one = [
        {"type": "user", "sessionId": "S", "timestamp": "2031-01-01T00:00:00+01:00", "cwd": "/w", "version": "2.1.7", "message": {"content": "please pack the wheel"}},
        {"type": "assistant", "sessionId": "S", "timestamp": "2031-01-01T00:00:01Z", "message": {"id": "m", "model": "x", "usage": {"input_tokens": 3, "output_tokens": 2}, "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "/w/f"}}, {"type": "text", "text": "b"}]}},
        {"type": "user", "sessionId": "S", "timestamp": "bad", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": "ok", "is_error": True}]}},
        {"type": "assistant", "isSidechain": True, "agentId": "9", "sessionId": "S", "message": {"content": []}},
    ]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.jsonl").write_text("\n".join(map(json.dumps, one)) + "\n{broken\n" + '{"type":"user"')
    rows = native_logs.read_native(spark, str(tmp_path / "one"), "claude_code", "box-a").collect()
    kinds = sorted(r.kind for r in rows)
    assert kinds == sorted(["session_start", "user_prompt", "tool_call", "attachment_ref", "assistant_message", "agent_meta", "tool_result", "session_start", "agent_meta"])
    message = next(r for r in rows if r.kind == "assistant_message")
    assert json.loads(message.payload)["text"] == "a\n\nb" and len(message.event_id) == 26
    assert next(r for r in rows if r.kind == "user_prompt").ts == "2030-12-31T23:00:00.000Z"
    again = native_logs.read_native(spark, str(tmp_path / "one"), "claude_code", "box-a").collect()
    assert {r.event_id for r in rows} == {r.event_id for r in again} and sorted(r.seq for r in rows) == list(range(len(rows)))
    (tmp_path / "one" / "old.jsonl").write_text(json.dumps({**one[0], "version": "1.9"}) + "\n")
    found = {r.file.rsplit("/", 1)[1]: (r.version, r.supported) for r in native_logs.detect_versions(spark, str(tmp_path / "one"), "claude_code").collect()}
    assert found == {"a.jsonl": ("2.1.7", True), "old.jsonl": ("1.9", False)}
    assert native_logs.read_native(spark, str(tmp_path / "one"), "claude_code", "box-a").count() == len(rows)
    two = [{"type": "session_meta", "payload": {"id": "C", "cwd": "/w"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "apply_patch", "call_id": "k", "arguments": '{"path":"/w/p"}'}}, {"type": "event_msg", "payload": {"type": "task_started"}}]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.jsonl").write_text("\n".join(map(json.dumps, two)) + "\n")
    found = native_logs.read_native(spark, str(tmp_path / "two"), "codex_cli", "m").collect()
    assert {r.session_id for r in found} == {"C"} and sorted(r.kind for r in found) == ["agent_meta", "attachment_ref", "session_start", "tool_call"]
    (tmp_path / "three").mkdir()
    beat = [{"type": "system", "session_id": "H", "_audit_hmac": "x"}] * 3 + [{"type": "system", "session_id": "R"}, {"type": "user", "session_id": "R", "message": {"content": "hello there friend"}}]
    (tmp_path / "three" / "c.jsonl").write_text("\n".join(map(json.dumps, beat)) + "\n")
    found = native_logs.read_native(spark, str(tmp_path / "three"), "cowork", "m").collect()
    assert {r.session_id for r in found} == {"R"} and sorted(r.kind for r in found) == ["agent_meta", "session_start", "user_prompt"]


def plain_ulid(ms, key):
    """A ULID by whole numbers."""
    number = (max(0, ms) << 80) | int.from_bytes(hashlib.sha256(key.encode()).digest()[:10], "big")
    return "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[(number >> (5 * i)) & 31] for i in range(25, -1, -1))


def test_ulids(spark):
    keys = [(0, ""), (1, "a"), (1924992000000, "b\0c"), ((1 << 48) - 1, "é"), (-5, "x")]
    rows = spark.createDataFrame([(ms, k, i) for i, (ms, k) in enumerate(keys)], "ms long, k string, i int").select("i", ids.ulid(F.col("ms"), F.col("k")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: plain_ulid(ms, k) for i, (ms, k) in enumerate(keys)}


def test_growing_files(spark, tmp_path):
    """Whole lines only, each once, over three readings; a file that got shorter begins again."""
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text("one\ntwo\nthr")
    (root / "b.jsonl").write_text("x\n")

    def take(cursors):
        lines, ends = native_logs.tail_lines(spark, str(root), cursors)
        return sorted((r.offset, r.line) for r in lines.collect()), spark.createDataFrame(ends.collect(), ends.schema)

    lines, cursors = take(None)
    assert lines == [(0, "one"), (0, "x"), (4, "two")] and cursors.count() == 2
    (root / "a.jsonl").write_text("one\ntwo\nthree\n\nfour\n")
    lines, cursors = take(cursors)
    assert lines == [(8, "three"), (15, "four")]
    (root / "b.jsonl").write_text("")
    (root / "a.jsonl").write_text("new\n")
    lines, cursors = take(cursors)
    assert lines == [(0, "new")] and [r.offset for r in cursors.collect()] == [4]


def test_imports(spark):
    lines = ['{"ts":"2031-01-01T00:00:00Z","session_id":"S","kind":"tool_call","repo":"r","campaign_id":"c"}', '{"session_id":"S","kind":"x"}', "nope"]
    good, bad = native_logs.import_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, n long"), "harness", "harness", "edge-w-harness")
    assert [r.reason for r in bad.orderBy("n").collect()] == ["missing ts", "not JSON"]
    row = good.first()
    assert json.loads(row.payload) == {"repo": "r", "campaign_id": "c"} and row.rollup_dim == "c"
    stamped = native_logs.import_lines(spark.createDataFrame([(lines[0], 0)], "line string, n long"), "harness", "harness", "edge-w-harness", campaign="z", role="writer")[0].first()
    assert json.loads(stamped.payload) == {"repo": "r", "campaign_id": "z", "campaign_role": "writer"} and stamped.rollup_dim == "z"
    _, rejected = native_logs.import_lines(spark.createDataFrame([("Bearer abcdefghijklmnop not json", 0)], "line string, n long"), "harness", "harness", "edge-w-harness")
    assert rejected.first().line == "[REDACTED] not json"
    whole = native_logs.with_starts(good)
    assert sorted(r.kind for r in whole.collect()) == ["session_start", "tool_call"]
    assert native_logs.new_only(good, good).count() == 0
    devin = spark.createDataFrame([('{"createdAt":"2031-01-01T00:00:00Z","sessionId":"D","type":"user","message":"hi","id":"77"}', 0)], "line string, n long")
    row = native_logs.import_lines(devin, "devin", "devin", "edge-w-devin")[0].first()
    assert row.kind == "user_prompt" and json.loads(row.payload) == {"text": "hi", "devin_event_id": "77"}
    assert row.event_id == plain_ulid(1924992000000, "devin\0foreign\x0077")


def test_tables(spark, tmp_path):
    root = f"file://{tmp_path}/model"
    tables.publish(spark, root, "b1", {"a": spark.range(3)})
    tables.publish(spark, root, "b2", {"a": spark.range(5)})
    assert tables.current(spark, root)["a"].count() == 5
    store = f"file://{tmp_path}/store"
    tables.append_new(spark, store, spark.createDataFrame([("k", 1)], "key string, v long"), "key")
    tables.append_new(spark, store, spark.createDataFrame([("k", 2), ("n", 3)], "key string, v long"), "key")
    assert {r.key: r.v for r in spark.read.parquet(store).collect()} == {"k": 1, "n": 3}
    (tmp_path / "gh").mkdir()
    (tmp_path / "gh" / "shop__pr.json").write_text(json.dumps([{"number": 1, "title": "T", "body": "b", "author": {"login": "rin"}, "labels": [{"name": "x"}], "mergedAt": "2031-01-02T00:00:00Z"}, {"number": 2, "title": "", "body": " "}]))
    row = tables.read_items(spark, f"{tmp_path}/gh").collect()
    assert [(r.repo, r.kind, r.number, r.author, r.labels, r.merged_day) for r in row] == [("shop", "pr", 1, "rin", ["x"], "2031-01-02")]


@pytest.mark.parametrize(
    ("text", "code", "wall", "status"),
    [("Process exited with code -2", -2, None, "error"), ("Exit code 0 Wall time: 1.5 seconds", 0, 1500, "ok"), ('{"exit_code": 7, "wall_time_seconds": 2}', 7, 2000, "error"), ("cancelled by user", None, None, "aborted"), ("Script running with cell ID a-1", None, None, "running"), ("no active session", None, None, "error")],
)
def test_results(spark, text, code, wall, status):
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(T.exit_code(c).alias("code"), T.wall_time_ms(c).alias("wall"), T.result_status(F.lit(False), T.exit_code(c), c).alias("status")).first()
    assert (row.code, row.wall, row.status) == (code, wall, status)


def test_texts(spark):
    row = spark.createDataFrame([("  a  b\n c ", "/w/x/src/mod/f.py", "Bearer abcdefghijklmnop x", "T\nCo-Authored-By: Claude <x>", "dependabot[bot]")], "a string, p string, s string, b string, u string").select(
        T.excerpt(F.col("a"), 3).alias("e"), T.file_token(F.col("p")).alias("f"), T.redacted(F.col("s")).alias("r"), T.detect_agent(F.col("b"), F.col("u")).alias("g"), T.is_bot(F.col("u")).alias("bot")
    ).first()
    assert (row.e, row.f, row.r, row.g, row.bot) == ("a b…", "src/mod/f.py", "[REDACTED] x", "claude", True)


def test_scope_keeps_rows_hidden(spark):
    rows = spark.createDataFrame([("r1", "c1", "claude"), ("r1", None, "claude"), ("r2", "c1", "claude")], "repo string, campaign string, source string")
    scope = ReadScope(repos=("r1",), campaigns=("c1",))
    assert scope_filter(rows, scope).count() == 1
    assert scope_filter(rows, ReadScope()).count() == 3
    captured = spark.createDataFrame([("claude", "github"), ("", "claude"), (None, "github")], "capture_source string, source string")
    assert scope_filter(captured, ReadScope(sources=("claude",))).count() == 2
    with pytest.raises(ValueError):
        insight.metadata_filter(rows, "nothing")


def test_communities():
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    found = vectors.communities_of(8, [*clique(range(4)), *clique(range(4, 8)), (3, 4, 0.2)], 1.0)
    assert len(set(found[:4])) == 1 and len(set(found[4:])) == 1 and found[0] != found[7]
