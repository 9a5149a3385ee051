"""Spans, turns and jobs against state machines on random sequences, and single rules on small fixtures."""

import json
import random

import pytest

from plumbline.operators import ingest, sessions, trace
from plumbline.sources.envelopes import dedup_events, typed


def frame(spark, rows):
    """Envelopes from (session, kind, payload); the order is that of the list."""
    data = [(f"x{i:04d}", "edge-box-a-codex", i, f"2031-01-01T00:{i // 60:02d}:{i % 60:02d}Z", source, session, kind, json.dumps(payload), i) for i, (session, source, kind, payload) in enumerate(rows)]
    return typed(spark.createDataFrame(data, "event_id string, stream string, seq long, ts string, source string, session_id string, kind string, payload string, ord long"))


def random_rows(seed, source):
    draw, rows = random.Random(seed), []
    for _ in range(160):
        session = f"s{draw.randrange(3)}"
        what = draw.choice(["call", "result", "prompt", "noise", "start", "end", "abort", "closer", "other"])
        if what == "call":
            rows.append((session, source, "tool_call", {"call_id": f"c{draw.randrange(3)}", "name": draw.choice(["exec_command", "write_stdin"]), "arguments": json.dumps({"session_id": draw.randrange(2)})}))
        elif what == "result":
            rows.append((session, source, "tool_result", {"call_id": f"c{draw.randrange(3)}", "output": draw.choice(["Process running with session ID 1", "Process exited with code 0", "Process exited with code 3", "write_stdin failed: gone"])}))
        elif what == "prompt":
            rows.append((session, source, "user_prompt", {"text": "pack the wheel"}))
        elif what == "noise":
            rows.append((session, source, "user_prompt", {"text": "<system-reminder> tidy"}))
        elif what == "closer":
            rows.append((session, source, "agent_meta", {"subtype": "turn_duration", "duration_ms": 5}))
        elif what == "other":
            rows.append((session, source, "assistant_message", {"text": "done"}))
        else:
            rows.append((session, source, "agent_meta", {"event_kind": {"start": "task_started", "end": "task_complete", "abort": "turn_aborted"}[what]}))
    return rows


def paired(rows):
    """The latest unconsumed call of an id takes the first result after it."""
    open_calls, pairs = {}, {}
    for i, (session, _, kind, payload) in enumerate(rows):
        key = (session, payload.get("call_id"))
        if kind == "tool_call":
            open_calls[key] = f"x{i:04d}"
        elif kind == "tool_result" and key in open_calls:
            pairs[open_calls.pop(key)] = f"x{i:04d}"
    return pairs


@pytest.mark.parametrize("seed", range(2))
def test_spans(spark, seed):
    rows = random_rows(seed, "codex_cli")
    found = {r.span_id: r.result_id for r in trace.spans(frame(spark, rows)).collect()}
    pairs = paired(rows)
    assert found == {f"x{i:04d}": pairs.get(f"x{i:04d}") for i, r in enumerate(rows) if r[2] == "tool_call"}


def task_turns(rows):
    """Turns of the task source as (events, status) by session."""
    out = []
    for session in sorted({r[0] for r in rows}):
        own = [(i, r) for i, r in enumerate(rows) if r[0] == session]
        current = None
        for i, (_, _, kind, payload) in own:
            event = payload.get("event_kind")
            if event == "task_started":
                if current:
                    out.append((session, current, "unknown"))
                current = [i]
                continue
            real = kind == "user_prompt" and not payload["text"].startswith("<")
            if current is None and real:
                current = [i]
                continue
            if current is None:
                continue
            current.append(i)
            if event in ("task_complete", "turn_aborted"):
                out.append((session, current, "ok" if event == "task_complete" else "aborted"))
                current = None
        if current:
            out.append((session, current, "open"))
    return sorted((s, len(e), status) for s, e, status in out)


def prompt_turns(rows):
    """Turns of the other sources."""
    out = []
    for session in sorted({r[0] for r in rows}):
        current = None
        for i, (_, _, kind, payload) in [(i, r) for i, r in enumerate(rows) if r[0] == session]:
            if kind == "user_prompt" and not payload["text"].startswith("<"):
                if current:
                    out.append((session, len(current), "unknown"))
                current = [i]
            elif current:
                current.append(i)
                if payload.get("subtype") == "turn_duration":
                    out.append((session, len(current), "ok"))
                    current = None
        if current:
            out.append((session, len(current), "open"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_turns(spark, seed):
    rows = random_rows(seed, "codex_cli")
    events = frame(spark, rows)
    found = trace.turns_task(events, trace.spans(events)).collect()
    assert sorted((r.session_id, r.events, r.status) for r in found) == task_turns(rows)
    rows = random_rows(seed, "cowork")
    events = frame(spark, rows)
    found = trace.turns_prompt(events, trace.spans(events)).collect()
    assert sorted((r.session_id, r.events, r.status) for r in found) == prompt_turns(rows)


def test_jobs(spark):
    call = lambda c, name: ("s", "codex_cli", "tool_call", {"call_id": c, "name": name, "arguments": '{"cmd":"pack","session_id":7,"chars":"y"}'})
    result = lambda c, text: ("s", "codex_cli", "tool_result", {"call_id": c, "output": text})
    rows = [call("a", "exec_command"), result("a", "Wall time: 2 seconds Process running with session ID 7"), call("b", "write_stdin"), result("b", "write_stdin failed: lost"), call("c", "write_stdin"), result("c", "Process exited with code 0"), call("d", "write_stdin"), result("d", "Process exited with code 1")]
    jobs = {r.job_id: r for r in trace.jobs(trace.spans(frame(spark, rows))).collect()}
    first, second = jobs["job:x0000"], jobs["job:x0006"]
    assert (first.association, first.spans, first.polls, first.errors, first.status, first.wait_ms) == ("exact_process_session_id", 3, 2, 1, "ok", 2000)
    assert (second.association, second.status, second.stdin_writes) == ("continuation_only", "error", 1)


def test_tokens_and_dedup(spark):
    usage = lambda m, a, b: ("s", "claude_code", "agent_meta", {"subtype": "usage", "msg_id": m, "model": "m", "usage": {"in": a, "out": b, "cache_read": 50, "cache_create": 1}})
    events = frame(spark, [usage("p", 4, 2), usage("p", 4, 2), usage("q", 3, 1)])
    row = sessions.session_tokens(events).first()
    assert (row.tok_in, row.tok_out, row.cache_read, row.cache_create, row.turns) == (7, 3, 100, 2, 2)
    total = lambda a, b, c: ("t", "codex_cli", "agent_meta", {"event_kind": "token_count", "payload": {"info": {"total_token_usage": {"input_tokens": a, "cached_input_tokens": b, "output_tokens": c}}}})
    row = sessions.snapshots(frame(spark, [total(300, 100, 40), total(500, 180, 90)])).first()
    assert (row.tok_in, row.cache_read, row.tok_out) == (320, 180, 90)
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4), (None, 5)], "event_id string, ord long")
    assert sorted(r.ord for r in dedup_events(twice).collect()) == [1, 3, 4, 5]


def test_recency_cap_and_order(spark):
    docs = spark.createDataFrame([(f"d{i}", f"2031-01-{i + 1:02d}", i) for i in range(20)], "event_id string, ts string, ord long")
    assert ingest.recency_cap(docs, 20).count() == 20
    assert sorted(r.ord for r in ingest.recency_cap(docs, 10).collect()) == list(range(11, 20))
    old = spark.createDataFrame([("h", 0), ("k", 1), ("h", 2)], "hash string, pos long")
    new = spark.createDataFrame([("h", 0), ("h", 1), ("h", 2), ("n", 3)], "hash string, pos long")
    assert {r.pos: r.old_pos for r in ingest.stable_order(old, new).collect()} == {0: 0, 1: 2, 2: None, 3: None}
    assert [r.hash for r in ingest.departed(old, new).collect()] == ["k"]
