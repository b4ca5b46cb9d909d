"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. Whole epochs of a source come first; what is left of
its budget goes to the documents with the smallest exponential keys ``-ln(u) / quality``.
Which documents those are is settled by one threshold key for each source. It is found from
sums over narrow key ranges, so that no task ever holds a source: only the one range in
which the budget runs out is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, word_count

SEED = "mix-1"
RANGES = 4096


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def prose_quality(text: Column, size: Column) -> Column:
    """1.0 for texts whose words have 3 to 12 characters in the mean, else 0.5."""
    return F.when((size > 0) & F.length(text).between(3 * size, 12 * size), 1.0).otherwise(0.5)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` for each source.

    Sources in code-point order, null last, take the weights in turn. A target stops at
    ``max_epochs`` times its source; what is over goes to the others by weight. The level at
    which this settles is found in one pass, with sources in the order in which they fill.
    The table has one row for each source and is small next to the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_epochs))
    )
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - full) / F.sum("weight").over(after)
    levels = w.withColumn("level", level).withColumn("fills", F.col("cap") <= F.col("level") * F.col("weight"))
    # The first source that doesn't fill sets the level of all that follow.
    settled = F.min(F.when(~F.col("fills"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return levels.withColumn("at", settled.getField("level")).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target")
    )


def _plan(keyed: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target, epochs, last_key``: one row for each source."""
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    totals = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialise(
        source_targets(totals, weights, share, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranges.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "s")
    # The range in which the budget runs out; its documents alone are sorted.
    torn = (
        running.join(targets, F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        .select("s", F.col("range").alias("r"), (F.col("upto") - F.col("words")).alias("start"), "left")
    )
    inside = keyed.join(torn, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    by_key = inside.groupBy("source", "start", "left", "key").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        by_key.withColumn("end", F.col("start") + F.sum("words").over(so_far))
        .where(F.col("end") - F.col("words") / 2 <= F.col("left"))
        .groupBy(F.col("source").alias("s1"))
        .agg(F.max("key").alias("inside_key"))
    )
    low = keyed.join(torn, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") < F.col("r"))).groupBy(F.col("source").alias("s2")).agg(F.max("key").alias("low_key"))
    return (
        targets.join(last, F.col("source").eqNullSafe(F.col("s1")), "left")
        .join(low, F.col("source").eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "target", "epochs", F.coalesce("inside_key", "low_key", F.lit(-1.0)).alias("last_key"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    quality=prose_quality,
    seed: str = SEED,
    ranges: int = RANGES,
) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``; no row is lost.

    ``mix_copies`` is how often the mix takes the document whole; it may be 0. Each source's
    words miss its target by no more than half its document at the threshold. A null or
    empty text has size 0. A null source is a source of its own, last in order. Rows of one
    source that repeat an id (or have none) share a key and are taken together; where the
    budget ends among them, the miss is up to half of all of them. Reruns give the same result. Columns of ``docs`` named ``mix_...`` as above are replaced.
    """
    out = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*out)
    size = word_count(F.col(text_col))

    def with_key(df: DataFrame) -> DataFrame:
        key = -F.log(uniform(F.col(id_col), seed)) / quality(F.col(text_col), F.col("mix_size"))
        return df.withColumn("mix_size", size).withColumn("__mix_key", key)

    keyed = materialise(
        with_key(docs).select(
            F.col(source_col).alias("source"),
            F.col("mix_size").alias("size"),
            F.col("__mix_key").alias("key"),
            F.floor((1 - F.exp(-F.col("__mix_key"))) * F.lit(ranges)).cast("int").alias("range"),
        )
    )
    plan = materialise(_plan(keyed, weights, share, max_epochs)).select(
        F.col("source").alias("__mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("epochs").alias("__mix_epochs"),
        F.col("last_key").alias("__mix_last"),
    )
    copies = F.col("__mix_epochs") + F.when(F.col("__mix_key") <= F.col("__mix_last"), 1).otherwise(0)
    # A document can't be taken more often than the cap allows, whatever rounding does.
    return (
        with_key(docs)
        .join(plan, F.col(source_col).eqNullSafe(F.col("__mix_source")), "left")
        .withColumn("mix_copies", F.least(copies, F.lit(int(max_epochs))).cast("long"))
        .select(*[F.col(f"`{c}`") for c in docs.columns], *out)
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(16**13)}::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / CASE WHEN size > 0 AND chars BETWEEN 3 * size AND 12 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM k GROUP BY source
), lv AS (
  SELECT *, 3 * ss AS cap, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / w, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * ss / w, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), settled AS (
  SELECT arg_min(level, cap / w) AS stop FROM lv WHERE cap > level * w
), t AS (
  SELECT source, ss, CASE WHEN stop IS NULL THEN cap ELSE least(cap, stop * w) END AS target FROM lv, settled
), e AS (
  SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.*, e.ss, e.target, e.epochs, target - epochs * ss AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY k.source, key) AS words
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(size * least(3, epochs + CASE WHEN upto - words / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
