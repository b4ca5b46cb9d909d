"""Tables written to the folder all machines share, to cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written so far and not yet cleared, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see; a temporary one only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "pulsegrid-checkpoints")
    return folder


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stored_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the application ends or by ``clear_tables``."""
    path = f"{shared_dir(spark).rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"
    store, place = _store(spark, path)
    store.deleteOnExit(place)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Spark's setting by which shuffle files go with the execution that made them; a stage that is asked for again is rerun.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict[str, list] = {}
_LOCK = threading.Lock()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        held = _CLEANING.setdefault(app, [0, spark.conf.get(_CLEAN, "false")])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_CLEAN, _CLEANING.pop(app)[1])


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. The table is deleted when the
    application ends, or before by ``clear_tables`` or ``release``.
    """
    spark = df.sparkSession
    path = stored_folder(spark)
    with brief_shuffles(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables; nothing that still reads them may follow."""
    for table in tables:
        spark, path = table.sparkSession, table._stored_at
        store, place = _store(spark, path)
        store.delete(place, True)
        store.cancelDeleteOnExit(place)
        _WRITTEN[spark.sparkContext.applicationId].remove(path)


#: Rows of a bucket of a table stored by unit, about; a unit is in one bucket whole.
BUCKET_ROWS = 250_000


def buckets(spark: SparkSession, rows: int) -> int:
    """How many parts hold so many rows, in full rounds of tasks, so that a task's share doesn't grow with the table."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (BUCKET_ROWS * cores)))


def materialise_by(df: DataFrame, unit: str, n: int) -> DataFrame:
    """``materialise`` in ``n`` buckets of ``unit``: windows and sums by unit then need no shuffle.

    ``df`` should come dealt by ``repartition(n, unit)``, so that each bucket is one file.
    """
    spark = df.sparkSession
    path = stored_folder(spark)
    name = "pulsegrid_" + uuid.uuid4().hex
    df.write.format("parquet").option("path", path).bucketBy(n, unit).saveAsTable(name)
    return spark.table(name)


#: Rows of a narrow table (keys and numbers) that may go to every machine, at most.
BROADCAST_ROWS = 1_000_000


def sized(narrow: DataFrame) -> DataFrame:
    """``narrow`` with a hint to send it to every machine where its rows are few enough; it is counted first."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def clear_tables(spark: SparkSession) -> int:
    """Delete all tables of this application; results that still read them must be stored before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        store, place = _store(spark, path)
        store.delete(place, True)
        store.cancelDeleteOnExit(place)
    return len(paths)
