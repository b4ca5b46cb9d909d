"""Remaining useful life: mean-life baseline and tree ensemble, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip_low, condition_of, phm_score, seconds_between
from ..tables import buckets, materialise, release, stored_folder
from . import forest as merged_forest
from .guards import assert_no_leakage, assert_only_role
from .health import SEQ, U, candidate_features, folds_of

SEED = 42
TREES, DEPTH = 100, 10
#: Fits that run side by side where each is small; a fit of more rows fills the machines and their caches alone.
PARALLEL, SIDE_ROWS = 4, 1_000_000
#: A fit of more rows puts rows of equal bins together; bins of a feature, as the trees have them.
MERGE_ROWS, BINS = 1_000_000, 32
#: Merged rows (28 bytes each at 8 features) that go to every machine, at most; beyond, Spark fits its forest on them.
SENT_ROWS = 12_000_000
FOREST = "forest"


def unit_lives(df: DataFrame) -> DataFrame:
    """``unit, life, start``: longest remaining life and first time stamp of each unit."""
    return df.groupBy(U).agg(F.max("rul_seconds").alias("life"), F.min("event_timestamp").alias("start"))


def fit_naive(df: DataFrame, by: str | None = None) -> DataFrame:
    """``fold, mean_life``: mean over units of their longest remaining life."""
    rows = df.withColumn("fold", F.lit("all")) if by is None else df.withColumn("fold", F.col(by))
    return rows.groupBy("fold", U).agg(F.max("rul_seconds").alias("life")).groupBy("fold").agg(F.avg("life").alias("mean_life"))


def fit_naive_leave_one_out(df: DataFrame, by: str = U) -> DataFrame:
    """The same for each value of ``by`` left out: sums of all less those of its own, in one pass."""
    lives = df.groupBy(F.col(by).alias("fold"), F.col(U).alias("__u")).agg(F.max("rul_seconds").alias("life"))
    own = lives.groupBy("fold").agg(F.sum("life").alias("s"), F.count("life").alias("n"))
    whole = own.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    # The totals are one row.
    rest = own.crossJoin(F.broadcast(whole)).withColumn("m", F.col("all_n") - F.col("n"))
    return rest.where("m > 0").select("fold", ((F.col("all_s") - F.coalesce("s", F.lit(0.0))) / F.col("m")).alias("mean_life"))


def elapsed(df: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ``elapsed_seconds`` since the known start of a unit, else since its first row here."""
    known = starts.select(U, F.col("start").alias("__start"))
    own = F.min("event_timestamp").over(Window.partitionBy(U))
    return df.join(known, U, "left").withColumn("elapsed_seconds", seconds_between(F.col("event_timestamp"), F.coalesce("__start", own))).drop("__start")


def predict_naive(df: DataFrame, params: DataFrame, starts: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``predicted``: mean life less elapsed time, not below zero."""
    rows = elapsed(df, starts).withColumn("__fold", F.lit("all") if by is None else F.col(by))
    return rows.join(params.withColumnRenamed("fold", "__fold"), "__fold").withColumn("predicted", clip_low(F.col("mean_life") - F.col("elapsed_seconds"))).drop("__fold", "mean_life", "elapsed_seconds")


def prediction_rows(df: DataFrame, split: Column, model: str) -> DataFrame:
    """One tidy row for each held-out row."""
    return df.select(F.lit(model).alias("model"), split.alias("split"), U, SEQ, F.col("rul_seconds").alias("actual"), "predicted")


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Errors of ``predicted`` against ``actual`` by group; positive errors promise too much life."""
    e = F.col("predicted") - F.col("actual")
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_abs_error"), F.avg(e).alias("mean_signed_error"),
        F.count(F.lit(1)).alias("n"), F.count_if(e > 0).alias("n_over"), F.count_if(e < 0).alias("n_under"), F.avg((e > 0).cast("int")).alias("over_rate"),
    )


def metrics_by_fold_and_pooled(predictions: DataFrame) -> DataFrame:
    """The same by model and split, and by model alone (``split`` null), in one pass."""
    e = F.col("predicted") - F.col("actual")
    return predictions.groupingSets([["model", "split"], ["model"]], "model", "split").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_signed_error"), F.count(F.lit(1)).alias("n"))


def mean_fold_mae(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.groupBy("model").agg(F.avg("mae").alias("mean_mae"))


def best_model(fold_metrics: DataFrame) -> DataFrame:
    return mean_fold_mae(fold_metrics).agg(F.min_by("model", F.struct("mean_mae", "model")).alias("model"))


def lobo_naive(df: DataFrame, unit: str = U) -> DataFrame:
    """Held-out predictions of the baseline with each value of ``unit`` left out once: one plan.

    A held-out unit's start is the first time stamp of its own rows.
    """
    assert_no_leakage(df, ("learning",))
    nobody = df.select(U, F.col("event_timestamp").alias("start")).limit(0)
    return prediction_rows(predict_naive(df, fit_naive_leave_one_out(df, unit), nobody, by=unit), F.col(unit), "naive")


def lobo_trees(df: DataFrame, unit: str = U, drop: tuple[str, ...] = (), trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Held-out predictions of the trees, fitted once without each value of ``unit``.

    One fit a fold, each many passes over all other rows, so ``df`` should be stored; the number of folds is bounded.
    ``drop`` names columns that are no features (``unit`` itself never is one).
    """
    assert_no_leakage(df, ("learning",))
    rows = df.drop(*drop)

    def held_out(fold) -> DataFrame:
        model = fit_forest(rows.where(F.col(unit) != fold).drop(*{unit} - {U}), trees=trees, depth=depth)
        return prediction_rows(predict_forest(rows.where(F.col(unit) == fold), model), F.col(unit), FOREST)

    return _each_fold(held_out, folds_of(rows, unit), rows.count())


def _each_fold(fit: Callable[[object], DataFrame | None], folds: list, rows: int) -> DataFrame:
    """The union over the folds; a few small fits run side by side, as each is many short jobs."""
    with ThreadPoolExecutor(PARALLEL if rows <= SIDE_ROWS else 1) as pool:
        parts = [p for p in pool.map(fit, folds) if p is not None]
    if not parts:
        raise ValueError("no fold has rows to fit and to predict")
    return reduce(DataFrame.unionByName, parts)


def walk_forward_trees(df: DataFrame, folds: int = 4, drop: tuple[str, ...] = (), trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Held-out predictions of the trees over growing prefixes; fold i is fitted on the prefixes of all runs."""
    assert_no_leakage(df, ("college_run",))
    placed = _placed(df.drop(*drop), folds)
    # Every fold reads them several times.
    rows = _in_folds(materialise(placed) if df.count() > MERGE_ROWS else placed, folds)

    def held_out(i) -> DataFrame | None:
        own = rows.where(F.col("fold") == i)
        train, test = (own.where(F.col("part") == p).drop("fold", "part") for p in ("train", "test"))
        if train.isEmpty() or test.isEmpty():
            return None
        return prediction_rows(predict_forest(test, fit_forest(train, trees=trees, depth=depth)), F.lit(f"fold {i}"), FOREST)

    return _each_fold(held_out, list(range(1, folds)), rows.count())


def fold_edges(n: Column, folds: int) -> Column:
    """Ends of equal slices of n rows, cut down to whole rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(folds)), lambda i: F.floor(i * n / F.lit(folds)).cast("long"))


def _placed(df: DataFrame, folds: int) -> DataFrame:
    """Rows with their place in the run and the ends of its slices."""
    unit = Window.partitionBy(U)
    return df.withColumn("__p", F.row_number().over(Window.partitionBy(U).orderBy(SEQ)) - 1).withColumn("__e", fold_edges(F.count(F.lit(1)).over(unit), folds))


def _in_folds(placed: DataFrame, folds: int) -> DataFrame:
    rows = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds - 1))))
    low, high = F.element_at("__e", F.col("fold") + 1), F.element_at("__e", F.col("fold") + 2)
    part = F.when(F.col("__p") < low, "train").when(F.col("__p") < high, "test")
    return rows.withColumn("part", part).where(F.col("part").isNotNull() & (low >= 10) & (high > low)).drop("__p", "__e")


def walk_forward_folds(df: DataFrame, folds: int = 4) -> DataFrame:
    """Rows with ``fold, part``: fold i trains on the first i slices and tests on the next.

    A fold counts with at least one test row and ten training rows.
    """
    return _in_folds(_placed(df, folds), folds)


def walk_forward_naive(df: DataFrame, folds: int = 4) -> DataFrame:
    """Held-out predictions of the baseline over growing prefixes of each run."""
    assert_no_leakage(df, ("college_run",))
    rows = walk_forward_folds(df, folds)
    fitted = rows.where("part = 'train'").groupBy("fold", U).agg(F.max("rul_seconds").alias("mean_life"), F.min("event_timestamp").alias("start"))
    test = rows.where("part = 'test'").join(fitted, ["fold", U])
    predicted = clip_low(F.col("mean_life") - seconds_between(F.col("event_timestamp"), F.col("start")))
    return prediction_rows(test.withColumn("predicted", predicted), F.concat(F.lit("fold "), F.col("fold").cast("string")), "naive")


def last_rows(df: DataFrame) -> DataFrame:
    """The last row of each unit by sequence."""
    latest = Window.partitionBy(U).orderBy(F.desc(SEQ))
    return df.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r")


Predictor = Callable[[DataFrame], DataFrame]


def score_hidden_set(censored: DataFrame, truth: DataFrame, predictors: dict[str, Predictor], prefix: str = "") -> DataFrame:
    """One row for each model and unit with known truth, at the unit's last censored row.

    ``truth`` has ``label, actual`` and optionally ``variant``. Predictors see whole prefixes.
    """
    assert_only_role(censored, "test_censored")
    counts = censored.groupBy(U).agg(F.count(F.lit(1)).alias("n_censored"))
    keyed = truth.withColumn(U, F.concat(F.lit(prefix), F.col("label")))
    parts = []
    for name, predict in sorted(predictors.items()):
        ends = last_rows(predict(censored)).select(U, "predicted")
        parts.append(keyed.join(ends, U).join(counts, U).withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    error = 100.0 * (F.col("actual") - F.col("predicted")) / F.col("actual")
    return (
        out.withColumn("condition_id", condition_of(F.col("label")))
        .withColumn("error_seconds", F.col("predicted") - F.col("actual"))
        .withColumn("percent_error", F.when(F.col("actual") != 0, error))
        .withColumn("phm_score", phm_score(F.col("percent_error")))
    )


def summarize_hidden(scored: DataFrame, *by: str) -> DataFrame:
    e = F.col("error_seconds")
    return scored.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs("percent_error")).alias("mean_abs_percent_error"), F.avg("phm_score").alias("mean_score"), F.count(F.lit(1)).alias("n"), F.count_if(e > 0).alias("n_over"))


def resolve_truth(derived: DataFrame, official: DataFrame, exception: str | None = None, expected: float | None = None) -> DataFrame:
    """Official values, after checking them against derived ones.

    The two must agree on every label but ``exception``, whose derived value must be
    ``expected``; anything else raises.
    """
    both = derived.withColumnRenamed("rul_seconds", "d").join(official.withColumnRenamed("rul_seconds", "o"), "label", "full")
    off = both.where(~F.coalesce(F.col("d") == F.col("o"), F.lit(False)))
    bad = off.where((F.col("label") != F.lit(exception)) | ~F.coalesce(F.col("d") == F.lit(expected), F.lit(False))) if exception else off
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"truth tables disagree: {[r.asDict() for r in found]}")
    return official


# Trees


def fit_forest(df: DataFrame, trees: int = TREES, max_null_fraction: float = 0.2, depth: int = DEPTH) -> PipelineModel:
    """A seeded forest over the candidate columns; gaps filled with training medians.

    Up to ``MERGE_ROWS`` rows each tree takes a bootstrap of them. Beyond, each takes all rows
    (so do extremely randomised trees), and those of equal bins count as one weighted row.
    """
    assert_no_leakage(df)
    cols = candidate_features(df, max_null_fraction)
    filled = [f"__{c}" for c in cols]
    rows = df.withColumns({c: F.col(c).cast("double") for c in cols}).where("rul_seconds IS NOT NULL")
    imputer = Imputer(strategy="median", inputCols=cols, outputCols=filled, relativeError=0.0001)
    vectors = VectorAssembler(inputCols=filled, outputCol="__v")
    forest = RandomForestRegressor(featuresCol="__v", labelCol="rul_seconds", predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=512, maxBins=BINS)
    if rows.count() <= MERGE_ROWS:
        return Pipeline(stages=[imputer, vectors, forest]).fit(rows)
    return _fit_merged(rows, imputer, vectors, forest)


def _fit_merged(rows: DataFrame, imputer: Imputer, vectors: VectorAssembler, forest: RandomForestRegressor) -> PipelineModel:
    """The forest over all rows without a bootstrap, fitted on one weighted row for each combination of bins.

    Splits lie between bins, so rows of equal bins are never parted: a node's weights, mean and
    gains follow from their number and mean label. There are never more merged rows than rows.
    """
    spark, cols, filled = rows.sparkSession, imputer.getInputCols(), imputer.getOutputCols()
    cuts = rows.approxQuantile(cols, [k / BINS for k in range(1, BINS)], 0.0001)
    # The medians are among the cuts: the median of one row of them is that row.
    fills = imputer.fit(spark.createDataFrame([tuple(c[BINS // 2 - 1] if c else None for c in cuts)], ", ".join(f"`{c}` double" for c in cols)))
    edges = [np.unique([x for x in c if np.isfinite(x)] or [0.0]) for c in cuts]
    bins = [f"__bin{k}" for k in range(len(cols))]
    binned = Bucketizer(splitsArray=[[-np.inf, *e.tolist(), np.inf] for e in edges], inputCols=filled, outputCols=bins).transform(fills.transform(rows))
    y = F.col("rul_seconds")
    merged = materialise(binned.groupBy(*[F.col(b).cast("byte").alias(b) for b in bins]).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")))
    n = merged.count()
    if n <= SENT_ROWS:
        fitted = merged_forest.fit(spark, merged_forest.Merged.gather(merged, bins), edges, forest)
    else:
        weighted = merged.withColumns({"rul_seconds": F.col("total") / F.col("n"), "__rows": F.col("n").cast("double")}).repartition(buckets(spark, n))
        fitted = _split_by_values(spark, forest.copy().setBootstrap(False).setWeightCol("__rows").fit(vectors.copy().setInputCols(bins).transform(weighted)), edges)
    release(merged)
    return PipelineModel([fills, vectors, fitted])


def _split_by_values(spark: SparkSession, forest: RandomForestRegressionModel, edges: list[np.ndarray]) -> RandomForestRegressionModel:
    """The forest, fitted on numbers of bins, with its splits in terms of values: a bin's number is that of the edges up to the value."""
    path = stored_folder(spark)
    forest.write().save(f"{path}/bins")
    below = [(f, k, float(np.nextafter(x, -np.inf))) for f, e in enumerate(edges) for k, x in enumerate(e)]
    known = spark.createDataFrame(below, "f int, k long, below double")
    split = F.col("nodeData.split")
    # One row for each edge.
    nodes = spark.read.parquet(f"{path}/bins/data").join(F.broadcast(known), (split["featureIndex"] == F.col("f")) & (F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))) == F.col("k")), "left")
    moved = F.when(F.col("below").isNull(), split).otherwise(split.withField("leftCategoriesOrThreshold", F.array("below")))
    nodes.withColumn("nodeData", F.col("nodeData").withField("split", moved)).drop("f", "k", "below").write.parquet(f"{path}/values/data")
    spark.read.parquet(f"{path}/bins/treesMetadata").write.parquet(f"{path}/values/treesMetadata")
    spark.read.text(f"{path}/bins/metadata").write.text(f"{path}/values/metadata")
    return RandomForestRegressionModel.load(f"{path}/values")


def predict_forest(df: DataFrame, model: PipelineModel) -> DataFrame:
    cols = model.stages[0].getInputCols()
    return model.transform(df.withColumns({c: F.col(c).cast("double") for c in cols})).select(*df.columns, "predicted")


def mae_pivot(fold_metrics: DataFrame, models: list[str]) -> DataFrame:
    """Units down, models across, in hours."""
    return fold_metrics.groupBy("split").pivot("model", models).agg(F.first("mae") / 3600)


def worse_count(pivot: DataFrame, a: str, b: str) -> DataFrame:
    return pivot.agg(F.count_if(F.col(a) > F.col(b)).alias("n_worse"), F.count(F.lit(1)).alias("n"))
