"""Nearest-time joins and lookups between sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``keys, out``: the value in the first row of each group, by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(out))


#: Time buckets are so many tolerances wide, if the caller doesn't say.
BUCKET = 64.0


def nearest_within(left: DataFrame, right: DataFrame, unit: str, left_time: str, right_time: str, right_index: str, tolerance: float, bucket: float | None = None) -> DataFrame:
    """``left`` with ``nearest_index`` and ``gap`` of the right row of its unit nearest in time.

    Either direction; of equally near rows the lowest index; a gap over ``tolerance`` gives
    nulls, one equal to it matches. Times are numbers; left rows without a time or unit match
    nothing, right rows without a time, unit or index are matched by none.

    Distinct times of both sides are sorted by unit and time bucket (``bucket`` wide), and the
    last reading seen is carried along once forwards and once backwards, so the work grows
    with the rows whatever the unit's size. Over borders of buckets it is carried by a table of
    the buckets' first and last readings. No pair is ever formed.
    """
    width = float(bucket or (BUCKET * tolerance if 0 < tolerance < float("inf") else 86_400.0))

    def timed(df: DataFrame, time: str) -> DataFrame:
        rows = df.withColumns({"__u": F.col(unit), "__t": F.col(time).cast("double")})
        return rows.where(F.col("__u").isNotNull() & F.col("__t").isNotNull() & ~F.isnan("__t")).withColumn("__b", F.floor(F.col("__t") / width))

    points = timed(right, right_time).where(F.col(right_index).isNotNull()).groupBy("__u", "__b", "__t").agg(F.min(right_index).alias("__i"))
    asked = timed(left, left_time).select("__u", "__b", "__t").distinct()
    reading = F.struct("__t", "__i")
    edges = points.groupBy("__u", "__b").agg(F.min(reading).alias("first"), F.max(reading).alias("last"))
    buckets = asked.select("__u", "__b").distinct().join(edges, ["__u", "__b"], "full")
    carried = F.array(
        F.last("last", ignorenulls=True).over(Window.partitionBy("__u").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
        F.last("first", ignorenulls=True).over(Window.partitionBy("__u").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)),
    )
    over = buckets.withColumn("carried", carried).select("__u", "__b", F.explode("carried").alias("c")).where("c IS NOT NULL").select("__u", "__b", "c.*")
    both = asked.withColumn("__asked", F.lit(True)).unionByName(points.union(over.select(*points.columns)), allowMissingColumns=True)
    at = F.when(F.col("__i").isNotNull(), reading)
    near = []
    for order in (F.asc("__t"), F.desc("__t")):
        # Both frames grow row by row; those of equal times are seen together.
        found = F.last(at, ignorenulls=True).over(Window.partitionBy("__u", "__b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        near.append(F.when(found.isNotNull(), F.struct(F.abs(F.col("__t") - found["__t"]).alias("gap"), found["__i"].alias("index"))))
    met = both.withColumns({"__before": near[0], "__after": near[1]}).where("__asked").withColumn("__best", F.least("__before", "__after")).where(F.col("__best.gap") <= tolerance)
    named = met.select(F.col("__u").alias("__mu"), F.col("__t").alias("__mt"), F.col("__best.index").alias("nearest_index"), F.col("__best.gap").alias("gap"))
    # Times are distinct on the right side here: no row is multiplied.
    on = (F.col(f"`{unit}`") == F.col("__mu")) & (F.col(f"`{left_time}`").cast("double") == F.col("__mt"))
    return left.join(named, on, "left").select(*[F.col(f"`{c}`") for c in left.columns], "nearest_index", "gap")


def hidden_rul(test: DataFrame, full: DataFrame, label: str, seconds: float = 10.0) -> DataFrame:
    """``label, rul_seconds``: how many more files the full set has, times the interval."""
    a = test.groupBy(label).agg(F.count(F.lit(1)).alias("n_test"))
    b = full.groupBy(label).agg(F.count(F.lit(1)).alias("n_full"))
    return a.join(b, label).select(label, ((F.col("n_full") - F.col("n_test")) * seconds).alias("rul_seconds"))
