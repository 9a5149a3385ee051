"""Structured Streaming forms of the ingest: envelopes as they land, deduplicated, with idle sessions closed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.ids import session_end_id
from plumbline.sources.envelopes import ENVELOPE, epoch_ms


def stream_envelopes(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Envelopes of JSON-lines files as they are added; the checkpoint remembers which files were taken."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").json(path)


def deduplicated(stream: DataFrame, horizon: str | None = "30 days") -> DataFrame:
    """Each event_id once. State is kept for `horizon` of event time; None keeps it for ever, and no event is too late."""
    named = stream.where(F.coalesce("event_id", F.lit("")) != "")
    if horizon is None:
        return named.dropDuplicates(["event_id"])
    return named.withColumn("event_time", F.coalesce(F.try_to_timestamp("ts"), F.current_timestamp())).withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")


def append_to(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Start appending to Parquet: every interval, or once over all that is there."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: Groups of sessions that are tracked together: one call and one row of state for each, whatever the number of sessions.
IDLE_BUCKETS = 1024


def _bucket() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(IDLE_BUCKETS)).alias("bucket")


def _by_session(frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, list]:
    """The rows of a group's sessions, each session's in order of seq; the place of each row's session, and the sessions."""
    parts = [frame for frame in frames if len(frame)]
    if not parts:
        return pd.DataFrame(), np.zeros(0, np.int64), []
    rows = pd.concat(parts)
    codes, names = pd.factorize(rows["session_id"], use_na_sentinel=False)
    order = np.lexsort((rows["seq"].to_numpy(), codes))
    return rows.take(order), codes[order], [None if pd.isna(name) else name for name in names]


def _first(codes: np.ndarray, wanted: np.ndarray, sessions: int) -> np.ndarray:
    """The first wanted row of each session, or the number of rows."""
    first, places = np.full(sessions, len(codes)), np.flatnonzero(wanted)[::-1]
    first[codes[places]] = places  # backwards, so that the first one stays
    return first


def idle_ends(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """A session_end row for each session that is idle for longer than `minutes` of event time.

    A session that goes on afterwards ends again later. The time of the end is that of the last event. Sessions are
    tracked in IDLE_BUCKETS groups, whose state holds for each open session its last time, its events and when it is due.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        fresh: dict[str, tuple[int, int]] = {}
        for frame in [] if state.hasTimedOut else frames:
            found = frame.groupby("session_id")["ms"].agg(["max", "size"])
            for session, ms, n in zip(found.index.tolist(), found["max"].tolist(), found["size"].tolist(), strict=True):
                last, count = fresh.get(session) or held.get(session, (0, 0))[:2]
                fresh[session] = (max(last, int(ms)), count + n)
        ended = [(session, last, count) for session, (last, count, due) in held.items() if due < watermark and session not in fresh]
        for session, _, _ in ended:
            del held[session]
        held |= {session: (last, count, max(last + minutes * 60_000, watermark + 1)) for session, (last, count) in fresh.items()}
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(min(due for _, _, due in held.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [e[0] for e in ended], "ended_ms": [e[1] for e in ended], "events": [e[2] for e in ended], "reason": ["idle"] * len(ended)})

    timed = stream.where("session_id <> ''").withColumn("event_time", F.try_to_timestamp("ts")).where("event_time IS NOT NULL").withWatermark("event_time", "0 seconds").withColumn("ms", F.unix_millis("event_time"))
    rows = timed.select(_bucket(), "session_id", "event_time", "ms")
    return rows.groupBy("bucket").applyInPandasWithState(step, "session_id string, ended_ms long, events long, reason string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def session_ends(last: DataFrame, now_ms: int | None, minutes: int = 10, role: str = "", campaign: str = "") -> DataFrame:
    """session_end envelopes of open sessions (stream, source, session_id, ts, seq: of the last event).

    With a time, of those that have been idle for longer than `minutes` then; without one, of all, as at shutdown. The
    end has the time of the last activity and an id that is minted from it, so ends that two trackers see are one.
    """
    timed = last.withColumn("ms", F.unix_millis(F.try_to_timestamp("ts")))
    due = timed if now_ms is None else timed.where(F.lit(now_ms) - F.coalesce("ms", F.lit(0)) > minutes * 60_000)
    reason = F.lit("shutdown" if now_ms is None else "idle")
    payload = F.to_json(F.struct(reason.alias("reason"), *([F.lit(role).alias("campaign_role")] if role else [])))
    event_id = session_end_id(F.col("source"), F.col("session_id"), F.coalesce("ms", F.lit(0)), F.col("ts"))
    nth = F.row_number().over(Window.partitionBy("stream").orderBy("session_id"))  # open sessions of a stream
    return due.select(F.lit(1).alias("v"), event_id.alias("event_id"), "stream", (F.col("seq") + nth).alias("seq"), "ts", "source", "session_id", F.lit("session_end").alias("kind"), payload.alias("payload"), F.lit(campaign).alias("rollup_dim"))


def staged_boundary(stream: DataFrame, since: str, forget_after: str | None = None) -> DataFrame:
    """Events behind the capture boundary; a session's start from before it comes once the session crosses it.

    State holds the start of a session until then, for IDLE_BUCKETS groups of sessions. Events whose time can't be read are
    kept, as in the batch form. Rows of a session that come in one trigger are taken in their order whatever frames they
    come in. With `forget_after`, a session that is silent for so long in processing time is forgotten; it is staged anew if
    it goes on.
    """
    limit_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each session that crossed or has a start: that start (null if it crossed), and when it is forgotten
        known = {session: (held, due) for session, held, due in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if limit_ms else 0
        rows, codes, sessions = _by_session(iter(()) if state.hasTimedOut else frames)
        out = pd.DataFrame({"event_id": [], "session_id": []})
        if sessions:
            ids, kind, kept = rows["event_id"].to_numpy(), rows["kind"].to_numpy(), rows["kept"].to_numpy(bool)
            first = _first(codes, kept, len(sessions))
            marks = np.flatnonzero(np.isin(kind, ("session_start", "session_end")) & (np.arange(len(codes)) < first[codes]))  # before a session crosses
            last = np.full(len(sessions), -1)
            last[codes[marks]] = marks
            staged, owners = [], []
            for i, (session, crosses, mark) in enumerate(zip(sessions, (first < len(codes)).tolist(), last.tolist(), strict=True)):
                before = known.pop(session, None)
                crossed = before is not None and before[0] is None
                held = None if crossed else (ids[mark] if kind[mark] == "session_start" else None) if mark >= 0 else before and before[0]
                if crosses and held:
                    staged.append(held)
                    owners.append(i)
                if crossed or crosses or held:
                    known[session] = (None if crossed or crosses else held, now + (limit_ms or 0))
            places = np.concatenate([np.array(owners, np.int64), codes[kept]])
            order = np.argsort(places, kind="stable")
            out = pd.DataFrame({"event_id": np.concatenate([np.array(staged, object), ids[kept]])[order], "session_id": np.array(sessions, object)[places[order]]})
        seen = set(sessions)
        if limit_ms:
            known = {session: (held, due) for session, (held, due) in known.items() if due > now or session in seen}
        if known:
            state.update((json.dumps([(session, *entry) for session, entry in known.items()]),))
            if limit_ms:
                state.setTimeoutDuration(max(1, min(due for _, due in known.values()) - now))
        elif state.exists:
            state.remove()
        yield out

    moment = F.unix_millis(F.try_to_timestamp("ts"))
    rows = stream.select(_bucket(), "session_id", "event_id", "seq", "kind", F.coalesce(moment >= epoch_ms(F.lit(since)), F.lit(True)).alias("kept"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if limit_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("bucket").applyInPandasWithState(step, "event_id string, session_id string", "known string", "append", timeout)


def first_starts(stream: DataFrame) -> DataFrame:
    """Exactly one session_start for each session, whatever batch its records come in; all other events pass.

    Parsers say with every record that its session started, as they don't remember; state does, for IDLE_BUCKETS groups of
    sessions. Events: event_id, session_id, kind, seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, codes, sessions = _by_session(frames)
        if not sessions:
            return
        known = set(json.loads(state.get[0])) if state.exists else set()
        starts = (rows["kind"] == "session_start").to_numpy()
        first = _first(codes, starts, len(sessions))
        fresh = [i for i, (session, place) in enumerate(zip(sessions, first.tolist(), strict=True)) if place < len(codes) and session not in known]
        keep = ~starts
        keep[first[fresh]] = True
        if fresh:
            state.update((json.dumps([*known, *(sessions[i] for i in fresh)]),))
        yield rows[keep][["event_id", "session_id", "kind", "seq"]]

    rows = stream.where(F.coalesce("session_id", F.lit("")) != "").select(_bucket(), "event_id", "session_id", "kind", "seq")
    return rows.groupBy("bucket").applyInPandasWithState(step, "event_id string, session_id string, kind string, seq long", "started string", "append", GroupStateTimeout.NoTimeout)


def with_file_session(stream: DataFrame) -> DataFrame:
    """Records of files whose session is named by one record only: each gets its file's session, over all batches.

    Records (file, offset, kind, payload, session_id) that come before their file's session is known wait in the state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, waiting = state.get if state.exists else (None, "[]")
        parts = [frame for frame in frames if len(frame)]
        rows = pd.concat(parts).sort_values("offset") if parts else pd.DataFrame({"offset": [], "kind": [], "session_id": []})
        named = rows["session_id"][(rows["kind"] == "session_start").to_numpy(bool)]
        session = session or next((s for s in named if s), None)
        held = [*json.loads(waiting), *zip(rows["offset"].astype(int).tolist(), rows["kind"].tolist(), strict=True)]
        if session is None:
            state.update((None, json.dumps(held)))
            return
        state.update((session, "[]"))
        yield pd.DataFrame({"file": [key[0]] * len(held), "offset": [h[0] for h in held], "kind": [h[1] for h in held], "session_id": [session] * len(held)})

    rows = stream.select("file", "offset", "kind", F.coalesce("session_id", F.lit("")).alias("session_id"))
    return rows.groupBy("file").applyInPandasWithState(step, "file string, offset long, kind string, session_id string", "session string, waiting string", "append", GroupStateTimeout.NoTimeout)


def ensure_policy(spark: SparkSession, checkpoint: str, profile: str, repos: list[str]) -> None:
    """Note the redaction profile and the allowlist beside a checkpoint, and refuse others once something was taken.

    A checkpoint that was begun without a note stands for no redaction and no allowlist. What was written under one policy
    must not be mixed with another: use a new folder, or remove the checkpoint deliberately.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    note, offsets = (jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{name}") for name in ("policy.json", "offsets"))
    system = note.getFileSystem(conf)
    wanted = {"profile": profile, "repos": sorted(repos)}
    if system.exists(note):
        found = json.loads(spark.read.text(f"{checkpoint}/policy.json").first()[0])
    else:
        found = {"profile": "off", "repos": []}
    if system.exists(offsets) and found != wanted:
        raise ValueError(f"the checkpoint was begun with {found}; use a new folder for {wanted}")
    out = system.create(note, True)
    out.write(bytearray(json.dumps(wanted).encode()))
    out.close()
