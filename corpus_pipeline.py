"""The corpus pipeline: documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of `documents`.

Stages decide about rows, not about ids: rows of null or repeated doc_ids stay apart, an empty table gives an empty
one, and columns beyond those of `documents` are passed on, whatever their names. Null and empty texts have no letters,
so they end in the first stage; a text of any length is judged as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, exact_dedup, language_id, minhash_dedup, packing
from plumbline.llm.common import small, table
from plumbline.session import held, release, ship_package, written

#: No SQL form: the language model and the tokenizer can't be expressed. Tests hold the stages against brute force.
ORACLE_SQL = None

#: Parts of texts that the packing stage keeps the ids of, in each of two generations.
PACKING_CACHE = 100_000

#: The key of a row within a stage; a column of `documents` of that name would be hidden.
ROW = "_stage_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a key for each row, written so that a row has the same key whenever it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def one_of_each(rows: DataFrame, group: str) -> DataFrame:
    """The key of one row of each group: that of the least doc_id, null last, and of the least key among equal ids."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))
    return rows.groupBy(group).agg(F.min_by(ROW, order).alias(ROW)).select(ROW)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts and texts without letters."""
    ship_package(spark)
    return language_id.with_language(docs, language_id.learned(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are equal but for white space one stays: the longest, then that of the least doc_id."""
    ship_package(spark)
    rows = numbered(docs)
    found = exact_dedup.exact_groups(rows, carry=(ROW,)).where("kept")
    kept = written(one_of_each(found, "text_sha256"), "exact-kept")
    return rows.join(small(kept, "24"), ROW, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more of their five-word shingles, the one of least doc_id stays."""
    ship_package(spark)
    rows = numbered(docs)
    found = minhash_dedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), shingle=5, percent=80)
    linked = written(found.select(F.col("doc_id").alias(ROW), "component_id"), "near-components")
    kept = one_of_each(linked.join(rows.select(ROW, "doc_id"), ROW), "component_id")
    return rows.join(small(written(kept, "near-kept"), "24"), ROW, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ship_package(spark)
    rows = docs.withColumn(ROW, F.sha2(F.coalesce("text", F.lit("")), 256))  # equal texts are hit alike
    found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), carry=(ROW,))
    hit = written(found.where("n_hit > 0").select(ROW).distinct(), "contaminated")
    return rows.join(small(hit, "96"), ROW, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences."""
    ship_package(spark)
    return packing.packed(docs, cache_parts=PACKING_CACHE)  # the executors hold what earlier stages left


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns but the last is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), held()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, [*before, held()[-1]])  # a stage's own tables aren't needed once its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
