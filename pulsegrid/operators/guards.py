"""Checks that stop a job before it fits on the wrong rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROLES = ("learning", "college_run")
HOST_MARKERS = ("/home/", "/Users/", ":/Users", "C:/", "D:/", "/mnt/", "/media/")


class LeakageError(ValueError):
    """Rows of a role that must not be fitted on."""


class RefusedFit(ValueError):
    """The training rows don't separate healthy from failed."""


def foreign_roles(df: DataFrame, allowed: Iterable[str] = FIT_ROLES) -> DataFrame:
    """Distinct roles outside ``allowed``, a null role included."""
    return df.select("role").distinct().where(~F.coalesce(F.col("role").isin(list(allowed)), F.lit(False)))


def assert_no_leakage(df: DataFrame, allowed: Iterable[str] = FIT_ROLES) -> DataFrame:
    """``df`` itself; raises if a row has a role outside ``allowed``."""
    bad = [r["role"] for r in foreign_roles(df, allowed).limit(20).collect()]
    if bad:
        raise LeakageError(f"roles that must not be fitted on: {sorted(map(str, bad))}")
    return df


def assert_only_role(df: DataFrame, role: str) -> DataFrame:
    """``df`` itself; raises unless it has rows and ``role`` is their one role."""
    other = df.where(~F.col("role").eqNullSafe(F.lit(role))).select("role").take(1)
    if other or df.isEmpty():
        raise LeakageError(f"expected only {role} rows, found {other[0]['role'] if other else 'none'}")
    return df


def assert_same_dataset(df: DataFrame, params: DataFrame) -> DataFrame:
    """Refuse to apply a model to another data set than it was fitted on, however many there are."""
    ours, theirs = (x.select("dataset_id").distinct() for x in (df, params.withColumnRenamed("dataset_id", "__d").select(F.col("__d").alias("dataset_id"))))
    strange = ours.join(theirs.toDF("__fitted"), F.col("dataset_id").eqNullSafe(F.col("__fitted")), "left_anti").take(1)
    if strange:
        raise ValueError(f"not fitted on the data set {strange[0]['dataset_id']}")
    return df


def assert_order(params: DataFrame, low: str, high: str) -> DataFrame:
    """Parameter rows themselves; raises where ``low`` isn't below ``high`` or either is missing."""
    bad = params.where(~F.coalesce(F.col(low) < F.col(high), F.lit(False)) | F.isnan(low) | F.isnan(high)).limit(5).collect()
    if bad:
        raise RefusedFit(f"{low} must be below {high}: {[r.asDict() for r in bad]}")
    return params


def host_path_columns(df: DataFrame, markers: Iterable[str] = HOST_MARKERS) -> DataFrame:
    """``column, n``: string columns that hold a marker of a host path, in one pass."""
    cols = [c for c, t in df.dtypes if t == "string"]

    def hit(c: str) -> Column:
        path = F.translate(F.col(f"`{c}`"), "\\", "/")
        return F.coalesce(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(path, m)), F.lit(False))

    counts = df.agg(*[F.count_if(hit(c)).alias(c) for c in cols]) if cols else df.sparkSession.range(1).select()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in cols]) if cols else F.array().cast("array<struct<column:string,n:bigint>>")
    return counts.select(F.explode(pairs).alias("x")).select("x.column", "x.n").where("n > 0")


def assert_no_host_paths(df: DataFrame) -> DataFrame:
    bad = host_path_columns(df).collect()
    if bad:
        raise ValueError(f"host paths in {[r['column'] for r in bad]}")
    return df


def assert_chronological(folds: DataFrame) -> DataFrame:
    """Fold rows ``fold, train_last, test_first``: every train row lies before every test row."""
    bad = folds.where("train_last >= test_first").limit(5).collect()
    if bad:
        raise LeakageError(f"folds out of order: {[r.asDict() for r in bad]}")
    return folds
