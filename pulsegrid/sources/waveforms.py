"""Stored waveforms and raw rows behind single feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from ..operators.health import SEQ, U
from . import raw


def waveform(stored: DataFrame, unit: str, sequence: int) -> DataFrame:
    """The stored waveform of one row, by unit and sequence number; raises where there is none.

    Sequence numbers start anew for every unit, so both are needed.
    """
    found = stored.where((F.col(U) == unit) & (F.col(SEQ) == sequence))
    if found.isEmpty():
        raise FileNotFoundError(f"no stored waveform of {unit} #{sequence}")
    return found


def with_waveform(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose unit and sequence number have a stored waveform."""
    return rows.join(stored.select(U, SEQ).distinct(), [U, SEQ], "left_semi")


def columns_with(df: DataFrame, *prefixes: str) -> DataFrame:
    """The columns whose names start with one of the prefixes, in their order."""
    return df.select(*[f"`{c}`" for c in df.columns if c.startswith(prefixes)])


def read_again(spark: SparkSession, path: str, tolerance: float = 90.0) -> tuple[DataFrame, DataFrame | None]:
    """One acquisition file, and the temperature file of its folder nearest in time, if any is near enough."""
    acc = raw.read_acceleration(spark, path)
    folder = path.rsplit("/", 1)[0]
    temps = raw.file_indices(raw.list_files(spark, folder), "temp")
    if temps.isEmpty():
        return acc, None
    starts = raw.first_row_seconds(raw.read_temperature(spark, folder, raw.TEMP_FILES)).join(temps, "path")
    own = raw.first_row_seconds(acc).withColumn("unit", F.lit("here"))
    near = asof.nearest_within(own, starts.withColumn("unit", F.lit("here")), "unit", "seconds", "seconds", "file_index", tolerance).first()
    if near is None or near["nearest_index"] is None:
        return acc, None
    chosen = temps.where(F.col("file_index") == near["nearest_index"]).first()["path"]
    return acc, raw.read_temperature(spark, chosen)
