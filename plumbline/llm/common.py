"""What the corpus operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that cross to Python at once.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS or int(spark.conf.get(name, "10000")) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n; null ids fall in bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    """An Arrow schema from names and types."""
    return pa.schema(list(fields.items()))


def bounded_sample(frame: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those of the least hash of their key: the same ones whenever they are drawn.

    Rows beyond a share of the hashes go first, so that few are ordered. Equal keys are drawn in the order of the other
    columns.
    """
    total = frame.count()
    hashed = frame.withColumn("_draw", F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)))
    if total > most:
        hashed = hashed.where(F.col("_draw") < int(1.3 * most / total * (1 << 30)) + 1)
    return hashed.orderBy("_draw", key, *(name for name in frame.columns if name != key)).limit(most).drop("_draw")


#: A key of more than one in so many rows is salted in a lookup; there are fewer such keys than that.
HOT_SHARE = 1000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], size: str, salts: int = 64, by: str = "doc_id", how: str = "inner", hot_by: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Join rows to a table that has one row for each key and says how many rows have it.

    Keys of many rows are spread over `salts` tasks: their rows in the table are repeated for each salt. As each such key
    has more than one in HOT_SHARE of all rows, they are fewer than HOT_SHARE; a hash of each comes to the driver and
    stands in the plan. Where keys may be long, `hot_by` names those that decide it. Rows are salted by the column `by`
    and, as that may be null or repeat itself, by the partition they come from. `sizes` is a table of the keys and sizes
    alone, where one is at hand.
    """
    marked = hot_by or keys
    sizes = found if sizes is None else sizes
    sums = sizes if marked == keys else sizes.groupBy(*marked).agg(F.sum(size).alias(size))
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(1000, total // HOT_SHARE)
    hot = [row[0] for row in sums.where(F.col(size) > limit).select(F.xxhash64(*marked)).collect()] if total > limit else []
    if not hot:
        return rows.join(found, keys, how)
    is_hot = F.xxhash64(*marked).isin(hot)
    salt = F.pmod(F.xxhash64(by, *marked, F.spark_partition_id()), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    right = found.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Bytes that may be broadcast; more is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small(frame: DataFrame, row_bytes: str = "64") -> DataFrame:
    """The frame, marked for broadcasting if its rows come to at most BROADCAST_BYTES. It is measured: pass what is written."""
    total = frame.agg(F.coalesce(F.sum(F.expr(row_bytes).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame


#: Copies of a table's rows where a join that can't broadcast it may meet frequent keys.
SALTS = 16


def salted(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str, row_bytes: str = "64") -> DataFrame:
    """Join rows to a written table. If the table can't be broadcast, its rows are repeated for each salt, and the rows of
    a frequent key are spread over the salts by the column `by`."""
    side = small(table, row_bytes)
    if side is not table:
        return rows.join(side, keys, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
