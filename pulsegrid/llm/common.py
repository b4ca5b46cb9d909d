"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship
from ..tables import brief_shuffles, materialise, release, shared_dir

__all__ = ["brief_shuffles", "materialise", "release", "shared_dir"]

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of rows that go to a Python worker at a time, where the session doesn't say; texts may be of any length.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, and bound what a worker is given at once.

    Spark's own limits are 64 MB and 10,000 rows, of which a worker holds several copies. A
    limit set in the session stands.
    """
    _ship(spark)
    if spark.conf.get(_BATCHES, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def some_rows(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """About ``n`` rows of ``docs``, chosen by a hash of id and head of text; all where there are fewer.

    For fitting alone. Nothing is sorted or sent to the driver, and reruns choose the same.
    """
    share = n / max(1, docs.count())
    if share >= 1:
        return docs
    text = F.col(text_col)
    code = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text), F.substring(text, 1, 64), F.lit(17)), F.lit(1 << 30))
    return docs.where(code < int(share * (1 << 30)))


#: Rows of a narrow table (keys and numbers) that may go to every machine, at most.
BROADCAST_ROWS = 1_000_000


def sized(narrow: DataFrame) -> DataFrame:
    """``narrow`` with a hint to send it to every machine where its rows are few enough; it is counted first."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow
