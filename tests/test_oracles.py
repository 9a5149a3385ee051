"""Registered queries against DuckDB on the smallest tables."""

import os
import sys
from glob import glob
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def canonical(rows, columns):
    """Rows as sorted texts; whole floats like integers, others to six places."""

    def text(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.6f}"
        return str(v)

    return sorted(tuple(text(row[c]) for c in columns) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.sql(registry.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    expected = [dict(zip(wanted.columns, row, strict=True)) for row in wanted.fetchall()]
    assert canonical([row.asDict() for row in found.collect()], columns) == canonical(expected, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rows_only(spark):
    communities = registry.QUERIES["louvain_topics"](spark, SF)
    assert communities.count() > 0
    ends = registry.QUERIES["stream_idle_ends"](spark, SF)
    assert ends.where("reason <> 'idle' OR ended_ms IS NULL").count() == 0


@pytest.mark.parametrize("name", ["remote_trace", "remote_trace_contexts"])
def test_remote_traces_of_many_sessions(spark, tmp_path, name):
    """A table holds more sessions than a reader may take: all of them come."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-11 08:00:00' + to_seconds(i) AS ts, CAST(i % 300 * 36 AS BIGINT) AS user_id, CASE WHEN i < 300 THEN 'signup' ELSE 'view' END AS event_type, 1.0 AS value, '{{\"k\": ' || CASE WHEN i < 300 THEN 4 ELSE 1 END || '}}' AS props FROM range(900) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT CAST(1 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, 'hello' AS text) TO '{tmp_path}/conversations.parquet'")
    for table in ("events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    found = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    rows = canonical([row.asDict() for row in found.collect()], columns)
    assert len(rows) > 300 and rows == canonical([dict(zip(columns, row, strict=True)) for row in expected], columns)
