"""Exact deduplication by skew-safe combining, in DataFrame functions alone.

1. Each task combines its own rows of equal digest, salt and normalised text (the partial aggregation).
2. Rows are shuffled by digest, salt and text and combined: a text that a third of all rows share is spread over as
   many tasks as there are salts.
3. The salts' winners, at most one for each salt and text, are shuffled by digest and combined with the text compared
   again.

The winners' digests are then joined to the rows; should a digest belong to several texts, the texts are joined as well.
Digests of many rows are salted once more for that join; how many such digests there can be is bounded by the share of
the rows that makes a digest count as one. Salts depend on the partition a row comes from too, so that rows without an id
are spread.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .common import lookup

SALTS = 64
#: No document is longer than 2**31 characters, and ids have 64 bits: n * WEIGHT - id orders by length, then by least id.
WEIGHT = 10**20
NO_ID = (1 << 63) - 1


def sha256(text: Column) -> Column:
    """The digest by default."""
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents whose texts are equal once ASCII white space is deleted.

    Returns a row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, in
    lower-case hexadecimal). In a group, the row with the most code points stays, then the one of least doc_id; a null
    doc_id ranks last and is kept as null. Rows that repeat a doc_id and text count in group_size and share `kept`. Null
    and empty texts are equal; a text of any length is compared as a whole. An empty table gives no rows. The columns
    named in `carry` are returned as well, other columns of `docs` are ignored whatever their names. Texts are compared
    in full, whatever the digest: two texts of one digest stay apart.
    """
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
        .select("doc_id", *carry, normalised(F.col("text")).alias("body"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
        .select("doc_id", *carry, "body", digest(F.col("body")).alias("digest"), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).cast("int").alias("salt"), "n")
    )
    weight = F.lit(Decimal(WEIGHT)).cast("decimal(21,0)")
    rank = F.col("n").cast("decimal(10,0)") * weight - F.coalesce("doc_id", F.lit(NO_ID)).cast("decimal(19,0)")
    salted = rows.select("digest", "salt", "body", rank.alias("rank")).groupBy("digest", "salt", "body").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    combined = salted.repartition("digest").groupBy("digest", "body").agg(F.max("rank").alias("rank"), F.sum("size").alias("group_size"))
    length = F.floor((F.col("rank") + F.lit(Decimal(WEIGHT // 2)).cast("decimal(21,0)")) / weight)
    winner = (length.cast("decimal(10,0)") * weight - F.col("rank")).cast("long")
    groups = combined.withColumn("winner", winner).drop("rank")
    table = written(groups.select("digest", "winner", "group_size"), "exact-groups")
    text_sha256 = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("body", 256)
    rows = rows.drop("salt", "n")
    if table.groupBy("digest").count().where("count > 1").isEmpty():  # every digest has one text, so it stands for it
        joined = lookup(rows, table, ["digest"], "group_size")
    else:
        joined = lookup(rows, groups, ["digest", "body"], "group_size", hot_by=["digest"])
    return joined.select(
        "doc_id",
        *carry,
        F.when(F.col("winner") != NO_ID, F.col("winner")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("winner")).alias("kept"),
        text_sha256.alias("text_sha256"),
    )
