"""Degradation stages: bands of the indicator, debounced, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise, sized
from .guards import assert_no_leakage, assert_order
from .health import EOL, N_REF, SEQ, SKIP, U, by_sequence, end_of_life
from .ranks import SortedCells

HEALTHY, DEGRADING, CRITICAL, UNKNOWN = "HEALTHY", "DEGRADING", "CRITICAL", "UNKNOWN"
PERSISTENCE, HEALTHY_QUANTILE = 5, 0.05


def fit_thresholds(df: DataFrame, hi: str = "hi", by: str | None = None, skip: int = SKIP, n_ref: int = N_REF, quantile: float = HEALTHY_QUANTILE, eol: float = EOL, check: bool = True) -> DataFrame:
    """``fold, hi_warn, hi_critical, n_units``: a low quantile of the early indicator, and the
    median over units of that at the end of life. Refuses folds where these don't part."""
    assert_no_leakage(df)
    rows = df.withColumn("fold", F.lit("all")) if by is None else df.withColumn("fold", F.col(by))
    rows = rows.withColumn("__p", F.row_number().over(by_sequence("fold", U)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("fold", U)))
    early = F.when(F.col("__n") <= skip, F.col("__p") < n_ref).otherwise(F.col("__p").between(skip, skip + n_ref - 1))
    warn = rows.where(early).groupBy("fold").agg(F.percentile(hi, F.lit(quantile)).alias("hi_warn"))
    last = rows.where(F.col("__p") >= F.col("__n") - end_of_life(F.col("__n"), eol)).groupBy("fold", U).agg(F.median(hi).alias("end"))
    critical = last.groupBy("fold").agg(F.median("end").alias("hi_critical"), F.count(F.lit(1)).alias("n_units"))
    params = warn.join(critical, "fold")
    return assert_order(params, "hi_critical", "hi_warn") if check else params


def fit_thresholds_without(df: DataFrame, unit: str, hi: str = "hi", skip: int = SKIP, n_ref: int = N_REF, quantile: float = HEALTHY_QUANTILE, eol: float = EOL, check: bool = True) -> DataFrame:
    """``fit_thresholds`` on all rows but those of each unit in turn, by subtraction.

    Only the early values and one value for each machine's end of life are sorted, once.
    """
    assert_no_leakage(df)
    rows = df.where(F.col(unit).isNotNull()).withColumn("__p", F.row_number().over(by_sequence()) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(U)))
    early = F.when(F.col("__n") <= skip, F.col("__p") < n_ref).otherwise(F.col("__p").between(skip, skip + n_ref - 1))
    last = rows.where(F.col("__p") >= F.col("__n") - end_of_life(F.col("__n"), eol)).groupBy(F.col(unit).alias("unit"), U).agg(F.median(hi).alias("v"))
    last = materialise(last)
    units = materialise(last.select("unit").distinct())
    first = materialise(rows.where(early).select(F.lit("early").alias("name"), F.col(unit).alias("unit"), F.col(hi).alias("v")))
    warn = SortedCells(first).quantiles_without(units, quantile)
    critical = SortedCells(last.select(F.lit("end").alias("name"), "unit", "v")).quantiles_without(units)
    machines = last.groupBy("unit").count()
    left = machines.select("unit", (F.sum("count").over(Window.partitionBy()) - F.col("count")).alias("n_units"))
    params = warn.select(F.col("unit").alias("fold"), F.col("value").alias("hi_warn")).join(critical.select(F.col("unit").alias("fold"), F.col("value").alias("hi_critical")), "fold")
    params = materialise(params.join(left.withColumnRenamed("unit", "fold"), "fold"))
    return assert_order(params, "hi_critical", "hi_warn") if check else params


def raw_stage(hi: Column, warn: Column, critical: Column) -> Column:
    """Band of a reading; null for a missing one."""
    known = hi.isNotNull() & ~F.isnan(hi)
    return F.when(known & (hi >= warn), HEALTHY).when(known & (hi >= critical), DEGRADING).when(known, CRITICAL)


def debounce(df: DataFrame, raw: str, k: int = PERSISTENCE, out: str = "stage", keys: tuple[str, ...] = (U,)) -> DataFrame:
    """Commit a change after ``k`` equal known readings in a row; the first one counts at once.

    Missing readings carry the state and don't break a run; before the first known reading
    the state is UNKNOWN. A row's state depends on rows up to it alone.
    """
    known = Window.partitionBy(*keys, F.col(raw).isNotNull()).orderBy(SEQ)
    changed = F.when(F.col(raw) == F.lag(raw).over(known), 0).otherwise(1)
    rows = df.withColumn("__nth", F.row_number().over(known)).withColumn("__new", changed).withColumn("__run", F.sum("__new").over(known))
    in_run = Window.partitionBy(*keys, F.col(raw).isNotNull(), "__run").orderBy(SEQ)
    rows = rows.withColumn("__in", F.row_number().over(in_run))
    commit = F.when(F.col(raw).isNotNull() & ((F.col("__nth") == 1) | (F.col("__in") == k)), F.col(raw))
    upto = by_sequence(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.coalesce(F.last(commit, ignorenulls=True).over(upto), F.lit(UNKNOWN))).drop("__nth", "__new", "__run", "__in")


def assign_stages(df: DataFrame, params: DataFrame, hi: str = "hi", by: str | None = None, k: int = PERSISTENCE, dealt: bool = False) -> DataFrame:
    """``df`` with ``raw_stage`` and ``stage``; ``dealt`` says that it is stored by unit."""
    rows = df.withColumn("__fold", F.lit("all") if by is None else F.col(by)).join(sized(params.select(F.col("fold").alias("__fold"), "hi_warn", "hi_critical")), "__fold")
    # All windows of a unit from one shuffle.
    rows = rows if dealt else rows.repartition(U)
    staged = debounce(rows.withColumn("raw_stage", raw_stage(F.col(hi), F.col("hi_warn"), F.col("hi_critical"))), "raw_stage", k)
    return staged.drop("__fold", "hi_warn", "hi_critical")


def summarize(df: DataFrame, stage: str = "stage") -> DataFrame:
    """By unit: shares of the stages, when CRITICAL first came and what life was left, reversions."""
    s = F.col(stage)
    severity = F.when(s == HEALTHY, 0).when(s == DEGRADING, 1).when(s == CRITICAL, 2).otherwise(-1)
    rows = df.withColumn("__v", severity).withColumn("__p", F.row_number().over(by_sequence()) - 1)
    rows = rows.withColumn("__back", (F.col("__v") < F.lag("__v").over(by_sequence())).cast("int"))
    n = F.count(F.lit(1))
    return rows.groupBy(U).agg(
        n.alias("n"),
        *[F.avg((s == x).cast("int")).alias(f"frac_{x.lower()}") for x in (HEALTHY, DEGRADING, CRITICAL)],
        (F.min(F.when(s == CRITICAL, F.col("__p"))) / n).alias("life_frac_at_first_critical"),
        F.min_by(F.when(s == CRITICAL, F.col("rul_seconds")), F.when(s == CRITICAL, F.col(SEQ))).alias("rul_at_first_critical_seconds"),
        F.coalesce(F.sum("__back"), F.lit(0)).alias("n_severity_reversions"),
    )
