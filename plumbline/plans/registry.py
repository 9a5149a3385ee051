"""Names of the registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import activity, insight, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**activity.QUERIES, **insight.QUERIES, **streams.QUERIES}
ORACLES: dict[str, str] = {**activity.ORACLES, **insight.ORACLES, **streams.ORACLES}
