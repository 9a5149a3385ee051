"""Redaction of JSON payloads: secrets in texts, values of sensitive keys, at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import SECRETS, redacted

# How many characters a profile leaves of a text, and the keys whose values never stay.
PROFILES = {"off": None, "standard": 32 * 1024, "mcp_safe": 4 * 1024}
SENSITIVE = ("password", "passwd", "secret", "client_secret", "private_key", "access_token", "refresh_token", "authorization", "api_key", "apikey", "aws_secret_access_key", "aws_session_token")
SENSITIVE_ENDS = ("_token", "_secret", "_password")
HARMLESS = ("input_token", "output_token", "token_count", "max_token")

_PATTERNS = [re.compile(p) for p in SECRETS]


def profile_named(name: str) -> str:
    """A profile by any of its spellings."""
    found = name.strip().lower().replace("-", "_")
    if found not in PROFILES:
        raise ValueError("a profile is off, standard or mcp_safe")
    return found


def redacted_text(text: Column, profile: str = "standard") -> Column:
    """A text without secrets, cut at the profile's length."""
    return text if profile == "off" else redacted(text, PROFILES[profile])


def is_sensitive(key: str) -> bool:
    """Whether a key's value never stays."""
    name = key.lower().replace("-", "_").replace(".", "_")
    return name in SENSITIVE or name.endswith(SENSITIVE_ENDS) and name not in HARMLESS


def clean_text(text: str, most: int) -> str:
    """The same as `redacted_text` for one text."""
    for pattern in _PATTERNS:
        text = pattern.sub("[REDACTED]", text)
    return text if len(text) <= most else text[:most] + "\n[TRUNCATED]"


def clean_value(node: Any, most: int) -> Any:
    """A JSON value without secrets. Nesting is followed with a stack, so its depth doesn't matter."""
    root = [node]
    work: list[tuple[Any, Any]] = [(root, 0)]
    while work:
        holder, at = work.pop()
        value = holder[at]
        if isinstance(value, str):
            holder[at] = clean_text(value, most)
        elif isinstance(value, list):
            work += [(value, i) for i in range(len(value))]
        elif isinstance(value, dict):
            for key, item in value.items():
                if is_sensitive(key) and item is not None:
                    value[key] = "[REDACTED]"
                else:
                    work.append((value, key))
    return root[0]


def _rewritten(column: str, change: Callable[[str], str | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [None if text is None else change(text) for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def _compact(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def redacted_payloads(rows: DataFrame, column: str = "payload", profile: str = "standard") -> DataFrame:
    """Rows whose JSON column is redacted at any depth; text that isn't JSON is redacted as a text. Other columns stay."""
    profile = profile_named(profile)
    if profile == "off":
        return rows
    most = PROFILES[profile]

    def change(text: str) -> str:
        try:
            return _compact(clean_value(json.loads(text), most))
        except ValueError:
            return clean_text(text, most)

    return rows.mapInArrow(_rewritten(column, change), rows.schema)


def redacted_lines(lines: DataFrame, column: str = "line", profile: str = "standard") -> DataFrame:
    """Envelope lines whose payload is redacted and whose identity stays; lines that aren't JSON are redacted as texts.

    Blank lines go.
    """
    profile = profile_named(profile)
    if profile == "off":
        return lines
    most = PROFILES[profile]

    def change(text: str) -> str:
        try:
            event = json.loads(text)
        except ValueError:
            return clean_text(text, most).rstrip("\r\n")
        if isinstance(event, dict) and "payload" in event:
            event["payload"] = clean_value(event["payload"], most)
        return _compact(event)

    return lines.where(F.trim(F.regexp_replace(column, r"\s+", "")) != "").mapInArrow(_rewritten(column, change), lines.schema)
