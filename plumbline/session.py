"""Session set-up and shared folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and ANSI left on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "plumbline_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(target)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (tests, local mode) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
        atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that weren't removed yet, in the order in which they were given out.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver ends or by `release`."""
    path = f"{shared_folder(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(lambda: release(spark, []))
    _scratch.append(path)
    return path


def held() -> list[str]:
    """The scratch paths there are."""
    return list(_scratch)


def release(spark: SparkSession, keep: list[str]) -> None:
    """Remove all scratch tables but those to keep: call it once nothing lazy reads the others."""
    for path in [p for p in _scratch if p not in keep]:
        _remove(spark, path)
        _scratch.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already: nothing is left to clean with
        pass


#: Narrow rows that go to one file where their number is known.
ROWS_PER_FILE = 50_000


def written(frame: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: the lineage ends there and survives lost executors.

    Where it is known about how many `rows` there are at most, they are written by as few tasks as get `per_file` each,
    not by one for each shuffle partition; all rows are written in any case.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    (frame if rows is None else frame.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
