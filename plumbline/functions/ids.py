"""ULIDs and lines of time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digits(number: Column, n: int) -> list[Column]:
    """The last n base-32 digits of a number."""
    return [F.substr(F.lit(CROCKFORD), (F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(n - 1, -1, -1)]


def ulid(ms: Column, key: Column) -> Column:
    """A ULID of a time and the first ten bytes of a key's SHA-256: 26 base-32 digits, the same for the same key."""
    digest = F.sha2(key, 256)
    high, low = (F.conv(F.substr(digest, F.lit(at), F.lit(10)), 16, 10).cast("long") for at in (1, 11))
    return F.concat(*_digits(F.greatest(ms, F.lit(0)).cast("long"), 10), *_digits(high, 8), *_digits(low, 8))


def session_end_id(source: Column, session_id: Column, ms: Column, ts: Column) -> Column:
    """The id of a session's end, from its last event: whoever sees that end mints the same one."""
    return ulid(ms, F.concat_ws("\0", source, F.lit("session_end"), session_id, ts))
