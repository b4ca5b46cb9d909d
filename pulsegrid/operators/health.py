"""Health indicators: transparent, principal-component and reference-normalised.

Fitted state is a table with one row for each fold; a pooled fit is the fold ``all``. One plan
fits all folds of a leave-one-unit-out study at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip_low, corr_or_null, log_compress, logistic, row_mean, safe_divide
from ..tables import buckets, materialise, materialise_by, sized
from .guards import assert_no_leakage, assert_order
from .quantiles import exact_medians
from .ranks import SortedCells, average_ranks, moments_without, places, previous, quantiles, scores_by_fold, short_groups, window_rank

CONTRACT = (
    "acquisition_id", "dataset_id", "bearing_run_id", "role", "source_file_path", "sequence_index", "event_timestamp", "sample_rate_hz", "n_samples",
    "row_start", "row_end", "schema_version", "source_sha256", "code_version", "temp_available", "rul_seconds", "stage_label",
)
#: Never features either: what the health operators add.
DERIVED = ("health_indicator", "hi_degradation_score")
U, SEQ = "bearing_run_id", "sequence_index"
TRANSPARENT = ("vibration_x_rms", "vibration_y_rms", "vibration_x_kurtosis", "vibration_y_kurtosis")
LOGGED = ("vibration_x_kurtosis", "vibration_y_kurtosis")
REFERENCE = tuple(f"vibration_{c}_{f}" for f in ("rms", "peak_to_peak", "kurtosis", "crest_factor") for c in "xy")
SKIP, N_REF, SMOOTH, EOL = 10, 50, 11, 0.05
#: Folds of a study that refits a model for each, at most.
MAX_FOLDS = 64
#: Rows of the machines that are scored under all folds together, about.
BLOCK_ROWS = 20_000
#: Folds whose scales go to every machine (72 bytes each), at most.
MAX_SCALES = 100_000


def by_sequence(*keys: str):
    return Window.partitionBy(*(keys or (U,))).orderBy(SEQ)


def candidate_features(df: DataFrame, max_null_fraction: float = 1.0) -> list[str]:
    """Columns outside the contract; those with more nulls than the limit are left out (one pass)."""
    cols = [c for c in df.columns if c not in CONTRACT and c not in DERIVED]
    if max_null_fraction >= 1.0 or not cols:
        return cols
    share = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if share[c] is not None and share[c] <= max_null_fraction]


def null_fractions(df: DataFrame, cols: list[str]) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_fraction")) for c in cols])).alias("x")).select("x.*")


def healthy_mask(df: DataFrame, fraction: float) -> DataFrame:
    """``df`` with ``is_healthy``: the early ``fraction`` of each unit's sequence numbers."""
    if short_groups(df, [U]):
        cut = F.percentile(SEQ, F.lit(fraction)).over(Window.partitionBy(U))
        return df.withColumn("__cut", cut).where(F.col(U).isNotNull() & F.col("__cut").isNotNull()).withColumn("is_healthy", F.col(SEQ) <= F.col("__cut")).drop("__cut")
    cut = quantiles(df.select(U, SEQ), [U], SEQ, {"__cut": fraction})
    return df.join(sized(materialise(cut)), U).withColumn("is_healthy", F.col(SEQ) <= F.col("__cut")).drop("__cut")


def life_fraction(df: DataFrame) -> DataFrame:
    """``df`` with the life fraction by sequence value and by position; a unit may be of any length."""
    if short_groups(df, [U]):
        unit = Window.partitionBy(U)
        placed = df.withColumns({"__place": F.row_number().over(unit.orderBy(SEQ)) - 1, "__n": F.count(F.lit(1)).over(unit), "__last": F.max(SEQ).over(unit)})
    else:
        placed = places(df, [U], [SEQ], "__place").join(_lengths(df, (U,)), F.col(U).eqNullSafe(F.col("__u0")))
    by_value = safe_divide(F.col(SEQ).cast("double"), F.col("__last"))
    by_position = safe_divide(F.col("__place").cast("double"), F.col("__n") - 1)
    return placed.select(*df.columns, by_value.alias("life_by_value"), by_position.alias("life_by_position"))


def _lengths(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``__u<k>, __n, __last``: rows and last sequence number of each unit, a narrow table."""
    named = df.select(*[F.col(c).alias(f"__u{k}") for k, c in enumerate(keys)], SEQ)
    return sized(materialise(named.groupBy(*[f"__u{k}" for k in range(len(keys))]).agg(F.count(F.lit(1)).alias("__n"), F.max(SEQ).alias("__last"))))


# Transparent indicator


def fit_transparent(df: DataFrame, fraction: float = 0.1, features=TRANSPARENT) -> DataFrame:
    """One row: ``<feature>_mean, <feature>_std`` over the early rows; a zero spread counts as 1."""
    assert_no_leakage(df)
    early = healthy_mask(df, fraction).where("is_healthy")
    aggs = [x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))]
    raw = early.agg(*aggs)
    return raw.withColumns({f"{f}_std": F.when(F.col(f"{f}_std") == 0, 1.0).otherwise(F.col(f"{f}_std")) for f in features})


def apply_transparent(df: DataFrame, params: DataFrame, features=TRANSPARENT, out: str = "hi") -> DataFrame:
    """``1 / (1 + max(0, mean z))``: 1 when as the early rows, falling with the anomaly."""
    # The parameters are one row.
    z = [(F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std") for f in features]
    return df.crossJoin(F.broadcast(params)).withColumn(out, 1 / (1 + clip_low(row_mean(z)))).drop(*params.columns)


# Reference indicator


def centred_on_own_reference(df: DataFrame, features=REFERENCE, logged=LOGGED, skip: int = SKIP, n_ref: int = N_REF, keys: tuple[str, ...] = (U,)) -> DataFrame:
    """``df`` with ``c_<feature>``: the (log-compressed) feature less its unit's own early median.

    The reference is the rows at places [skip, skip + n_ref) of the unit, or its first n_ref
    rows where the unit ends before. Adds ``pos`` and ``n_unit``.
    """
    placed = df.withColumns({f"c_{f}": log_compress(F.col(f).cast("double")) if f in logged else F.col(f).cast("double") for f in features})
    placed = placed.withColumn("pos", F.row_number().over(by_sequence(*keys)) - 1).withColumn("n_unit", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    inside = F.when(F.col("n_unit") <= skip, F.col("pos") < n_ref).otherwise(F.col("pos").between(skip, skip + n_ref - 1))
    # Rows without a unit have no reference.
    own = inside & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    medians = placed.withColumns({f"r_{f}": F.median(F.when(own, F.col(f"c_{f}"))).over(Window.partitionBy(*keys)) for f in features})
    return medians.withColumns({f"c_{f}": F.col(f"c_{f}") - F.col(f"r_{f}") for f in features}).drop(*[f"r_{f}" for f in features])


def robust_scales(centred: DataFrame, by: str, features=REFERENCE) -> DataFrame:
    """``by, s_<feature>``: 1.4826 times the median absolute deviation; else the standard
    deviation where that is next to nothing; else 1."""
    cols = [f"c_{f}" for f in features]
    mid = materialise(exact_medians(centred, by, cols).toDF(by, *[f"m_{f}" for f in features]))
    # One row for each fold.
    off = centred.select(by, *cols).join(F.broadcast(mid), by)
    mad = exact_medians(off.select(by, *[F.abs(F.col(f"c_{f}") - F.col(f"m_{f}")).alias(f"a_{f}") for f in features]), by, [f"a_{f}" for f in features])
    spread = centred.groupBy(by).agg(*[F.stddev_pop(c).alias(f"d_{c[2:]}") for c in cols]).join(mad, by)
    return spread.select(
        by, *[F.when(1.4826 * F.col(f"a_{f}") > 1e-9, 1.4826 * F.col(f"a_{f}")).when(F.col(f"d_{f}") > 1e-9, F.col(f"d_{f}")).otherwise(1.0).alias(f"s_{f}") for f in features]
    )


def trailing_median(value: str, window) -> Column:
    """Median of the values known in a short frame: the middle of their sorted array."""
    known = F.sort_array(F.collect_list(value).over(window))
    middle = F.transform(F.array(known), lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2)
    return middle[0]


def fused_deviation(centred: DataFrame, scales: DataFrame, by: str, features=REFERENCE) -> DataFrame:
    """Adds ``fused``: the mean scaled deviation of a row."""
    fused = centred.join(sized(scales), by).withColumn("fused", row_mean([F.col(f"c_{f}") / F.col(f"s_{f}") for f in features]))
    return fused.drop(*[f"s_{f}" for f in features])


def degradation_score(centred: DataFrame, scales: DataFrame, by: str, features=REFERENCE, smooth: int = SMOOTH, keys: tuple[str, ...] = (U,)) -> DataFrame:
    """Adds ``score``: mean scaled deviation, then its median over the last ``smooth`` rows.

    Frames go by ``pos``, so rows that were left out of ``centred`` leave a gap.
    """
    trailing = Window.partitionBy(by, *keys).orderBy("pos").rangeBetween(-(smooth - 1), 0)
    return fused_deviation(centred, scales, by, features).withColumn("score", trailing_median("fused", trailing))


def end_of_life(n: Column, fraction: float) -> Column:
    """How many last rows of a unit of n count as its end of life."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(fraction))).cast("long")


def anchors(scored: DataFrame, by: str, skip: int = SKIP, n_ref: int = N_REF, eol: float = EOL, keys: tuple[str, ...] = (U,)) -> DataFrame:
    """``by, healthy, failure``: median score early in life, and median over units of that at its end."""
    last = F.col("pos") >= F.col("n_unit") - end_of_life(F.col("n_unit"), eol)
    units = materialise(scored.where(last).groupBy(by, *keys).agg(F.median("score").alias("end")))
    failure = exact_medians(units, by, ["end"]).toDF(by, "failure")
    healthy = exact_medians(scored.where(F.col("pos").between(skip, skip + n_ref - 1)), by, ["score"]).toDF(by, "healthy")
    return healthy.join(failure, by)


def _anchor_rows(centred: DataFrame, skip: int = SKIP, n_ref: int = N_REF, eol: float = EOL, smooth: int = SMOOTH) -> DataFrame:
    """The rows whose scores the anchors look at, and those that these scores look back on."""
    first_end = F.col("n_unit") - end_of_life(F.col("n_unit"), eol)
    return centred.where((F.col("pos") < skip + n_ref) | (F.col("pos") >= first_end - (smooth - 1)))


def _fit_centred(train: DataFrame, features=REFERENCE, check: bool = True) -> DataFrame:
    """Parameter rows from centred rows with a ``fold``; scores are worked out where anchors need them."""
    scales = materialise(robust_scales(train, "fold", features))
    scored = materialise(degradation_score(_anchor_rows(train), scales, "fold", features).select("fold", U, "pos", "n_unit", "score"))
    params = materialise(scales.join(anchors(scored, "fold"), "fold"))
    return assert_order(params, "healthy", "failure") if check else params


def fit_reference(df: DataFrame, features=REFERENCE, check: bool = True) -> DataFrame:
    """One parameter row ``fold, s_<feature>..., healthy, failure`` of the fold ``all``.

    Refuses foreign roles and units that don't end above their healthy score.
    """
    assert_no_leakage(df)
    return _fit_centred(materialise(centred_on_own_reference(df, features)).withColumn("fold", F.lit("all")), features, check)


def scales_without(centred: DataFrame, unit: str, features=REFERENCE) -> DataFrame:
    """``fold, s_<feature>``: ``robust_scales`` of all rows but those of each unit in turn, from one sort.

    A unit is a fold if there is another one; rows without a unit take part in no fit.
    """
    wide = centred.select(F.col(unit).alias("unit"), *[F.col(f"c_{f}").alias(f) for f in features])
    units = materialise(wide.select("unit").where("unit IS NOT NULL").distinct())
    cells = SortedCells(wide, list(features))
    middle = materialise(cells.quantiles_without(units).withColumnRenamed("value", "m"))
    away = cells.quantiles_without(units, around=middle)
    told = away.join(moments_without(wide, list(features)), ["name", "unit"], "full").groupBy(F.col("unit").alias("fold")).agg(
        *[F.max(F.when(F.col("name") == f, F.struct("value", "sd"))).alias(f"x_{f}") for f in features]
    )
    scaled = {f: 1.4826 * F.col(f"x_{f}.value") for f in features}
    wide = units.withColumnRenamed("unit", "fold").join(told, "fold", "left")
    out = wide.select("fold", *[F.when(x > 1e-9, x).when(F.col(f"x_{f}.sd") > 1e-9, F.col(f"x_{f}.sd")).otherwise(1.0).alias(f"s_{f}") for f, x in scaled.items()])
    return out if units.count() > 1 else out.limit(0)


def anchors_without(centred: DataFrame, scales: DataFrame, unit: str, features=REFERENCE, skip: int = SKIP, n_ref: int = N_REF, eol: float = EOL, smooth: int = SMOOTH) -> DataFrame:
    """``fold, healthy, failure`` of every fold, each under its own scales.

    Scores depend on the fold, so early rows and those of the end of life are scored under
    all scales but their own; a machine's rows of these two kinds must fit a task.
    """
    found = scales.limit(MAX_SCALES + 1).toArrow().to_pandas()
    if len(found) > MAX_SCALES:
        raise ValueError(f"over {MAX_SCALES} folds: group the units and leave out groups")
    cols = [f"c_{f}" for f in features]
    rows = _anchor_rows(centred.where(F.col(unit).isNotNull()), skip, n_ref, eol, smooth).select(F.col(unit).alias("__g"), F.col(U).alias("__u"), "pos", "n_unit", *cols)
    run = scores_by_fold(found["fold"].tolist(), found[[f"s_{f}" for f in features]].to_numpy(dtype=float), cols, skip, n_ref, smooth, lambda n: max(1, int(n * eol)))
    kind = scales.schema["fold"].dataType.simpleString()
    # With few folds a group holds several machines, as many as have about so many rows.
    block = F.col("__u") if len(found) > MAX_FOLDS else F.pmod(F.xxhash64("__u"), F.lit(-(-centred.count() // BLOCK_ROWS) or 1))
    scored = materialise(rows.withColumn("__b", block).groupBy("__g", "__b").applyInPandas(run, f"fold {kind}, end double, early array<double>"))
    failure = exact_medians(scored.select("fold", "end"), "fold", ["end"]).toDF("fold", "failure")
    healthy = exact_medians(scored.select("fold", F.explode("early").alias("score")), "fold", ["score"]).toDF("fold", "healthy")
    return healthy.join(failure, "fold")


def fit_leave_one_out(df: DataFrame, unit: str = U, features=REFERENCE, check: bool = True) -> DataFrame:
    """A parameter row for each value of ``unit``, fitted on all rows of the others.

    Rows are centred once (a unit's own reference doesn't depend on the fold) and sorted once;
    what a fold leaves out is subtracted from counts, so rows are not multiplied by folds.
    """
    assert_no_leakage(df)
    return _fit_without(materialise(centred_on_own_reference(df, features)), unit, features, check)


def _fit_without(centred: DataFrame, unit: str, features=REFERENCE, check: bool = True) -> DataFrame:
    scales = materialise(scales_without(centred, unit, features))
    params = materialise(scales.join(anchors_without(centred, scales, unit, features), "fold"))
    return assert_order(params, "healthy", "failure") if check else params


def apply_reference(df: DataFrame, params: DataFrame, by: str | None = None, features=REFERENCE, out: str = "hi") -> DataFrame:
    """Adds the indicator, strictly between 0 and 1; every unit is held against its own early rows."""
    rows = df.withColumn("fold", F.lit("all")) if by is None else df.withColumn("fold", F.col(by))
    return _apply_centred(centred_on_own_reference(rows, features), params, df.columns, features, out)


def _apply_centred(centred: DataFrame, params: DataFrame, columns: list[str], features=REFERENCE, out: str = "hi") -> DataFrame:
    scored = degradation_score(centred, params, "fold", features)
    hi = scored.withColumn(out, logistic(F.col("score"), F.col("healthy"), F.col("failure")))
    return hi.select(*columns, *[c for c in ("fold", "score", out) if c not in columns])


def folds_of(df: DataFrame, unit: str = U, most: int = MAX_FOLDS) -> list:
    """The folds of a leave-one-out study, in order; raises beyond ``most``."""
    found = [r[0] for r in df.select(unit).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} folds: a study refits for each, so group the units and leave out groups")
    return sorted(found, key=str)


def leave_one_out(df: DataFrame, unit: str = U) -> DataFrame:
    """Each row once for every other unit, the fold: the plain form that tests compare with.

    A study has ``MAX_FOLDS`` folds at most here. Fits take complements instead: sums and
    counts by subtraction (``ranks``), so rows are not multiplied.
    """
    folds_of(df, unit)
    folds = df.select(F.col(unit).alias("fold")).distinct()
    return df.join(F.broadcast(folds), F.col(unit) != F.col("fold"))


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameters as a small Parquet table; an earlier one is replaced."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def leave_one_out_reference(df: DataFrame, unit: str = U, check: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Fit without each unit in turn and apply to it; rows are centred once for both.

    ``keep`` names the columns of ``df`` to return, all by default.
    """
    assert_no_leakage(df)
    kept, n = list(keep or df.columns), buckets(df.sparkSession, df.count())
    # Dealt by machine once: all windows of a machine follow without a shuffle, here and over what is returned.
    centred = centred_on_own_reference(df.withColumn("fold", F.col(unit)).repartition(n, U))
    held = dict.fromkeys([*kept, U, SEQ, unit, "fold", "pos", "n_unit", *[f"c_{f}" for f in REFERENCE]])
    centred = materialise_by(centred.select(*held), U, n)
    found = _apply_centred(centred, _fit_without(centred, unit, check=check), kept)
    return materialise_by(found, U, n) if U in kept else materialise(found)


# Diagnostics


def ranked(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = (U,)) -> DataFrame:
    """Adds the average rank of a value within its unit; nulls have none."""
    return average_ranks(df, list(keys), value, out)


def evaluate(df: DataFrame, hi: str = "hi", keys: tuple[str, ...] = (U,)) -> DataFrame:
    """By unit: monotonicity, Pearson and Spearman correlation with the sequence, n."""
    narrow = df.select(*keys, hi, SEQ)
    if short_groups(narrow, list(keys)):
        rows = _in_windows(narrow, hi, keys)
    else:
        rows = ranked(ranked(previous(narrow, list(keys), [SEQ], hi, "__previous"), hi, "__rh", keys), SEQ, "__rs", keys)
    return rows.groupBy(*keys).agg(*_evaluated(hi))


def _in_windows(narrow: DataFrame, hi: str, keys: tuple[str, ...]) -> DataFrame:
    """Place, number of rows, value before and ranks within short units: one shuffle."""
    unit = Window.partitionBy(*keys)
    rows = narrow.withColumns({"__p": F.row_number().over(unit.orderBy(SEQ)) - 1, "__n": F.count(F.lit(1)).over(unit), "__previous": F.lag(hi).over(unit.orderBy(SEQ))})
    return rows.withColumns({"__rh": window_rank(list(keys), hi), "__rs": window_rank(list(keys), SEQ)})


def _evaluated(hi: str) -> list[Column]:
    return [
        F.abs(F.avg(F.signum(F.col(hi) - F.col("__previous")))).alias("monotonicity"), corr_or_null(F.col(hi), F.col(SEQ)).alias("trend_corr"),
        corr_or_null(F.col("__rh"), F.col("__rs")).alias("spearman"), F.count(F.lit(1)).alias("n"),
    ]


def diagnostics(df: DataFrame, hi: str = "hi", keys: tuple[str, ...] = (U,)) -> DataFrame:
    """By unit: range, share of pinned rows, early and final medians, usable range."""
    last = F.col("__p") >= F.col("__n") - F.greatest(F.lit(1), F.floor(F.col("__n") / 100))
    h = F.col(hi)
    shapes = [
        F.min(h).alias("hi_min"), F.max(h).alias("hi_max"),
        (100.0 * F.count_if(h >= 0.999) / F.count(F.lit(1))).alias("pct_at_one"), (100.0 * F.count_if(h <= 0.001) / F.count(F.lit(1))).alias("pct_at_zero"),
        F.median(F.when(F.col("__p").between(10, 59), h)).alias("hi_healthy_window"), F.median(F.when(last, h)).alias("hi_final_1pct"),
    ]
    if short_groups(df.select(*keys), list(keys)):
        known = df.select(*keys, hi, SEQ).dropna(subset=list(keys))
        usable = (F.percentile(h, F.lit(0.95)) - F.percentile(h, F.lit(0.05))).alias("usable_range_p05_p95")
        return _in_windows(known, hi, keys).groupBy(*keys).agg(*shapes, usable, *_evaluated(hi)).drop("trend_corr")
    narrow = materialise(df.select(*keys, hi, SEQ))
    rows = places(narrow, list(keys), [SEQ], "__p")
    rows = rows.join(_lengths(narrow, keys), [F.col(c).eqNullSafe(F.col(f"__u{k}")) for k, c in enumerate(keys)])
    shape = rows.groupBy(*keys).agg(*shapes)
    spread = quantiles(narrow, list(keys), hi, {"__p95": 0.95, "__p05": 0.05})
    usable = spread.select(*keys, (F.col("__p95") - F.col("__p05")).alias("usable_range_p05_p95"))
    return shape.join(usable, list(keys), "left").join(evaluate(narrow, hi, keys).drop("trend_corr"), list(keys))


def pinning_report(diagnosed: DataFrame, by: str = "hi_name") -> DataFrame:
    return diagnosed.groupBy(by).agg(F.avg("pct_at_one").alias("mean_pct_at_one"), F.max("pct_at_one").alias("worst_pct_at_one"), F.avg("usable_range_p05_p95").alias("mean_usable_range"), F.avg("spearman").alias("mean_spearman"), F.avg("monotonicity").alias("mean_monotonicity"))


def select_indicator(report: DataFrame, by: str = "hi_name", limit: float = 5.0) -> DataFrame:
    """The indicator that never pins much and trends most; raises where all pin."""
    chosen = report.where(F.col("worst_pct_at_one") < limit).agg(F.max_by(by, F.struct(F.abs("mean_spearman"), F.col(by))).alias("selected"))
    if chosen.first()["selected"] is None:
        raise ValueError("every indicator pins at one")
    return chosen


def feature_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, monotonicity, trendability, composite``, best first.

    By unit: mean sign of differences of the values in sequence, nulls left out, and the
    correlation with the life fraction by place; units of under three rows or without values
    are passed over. Over units: mean of the first, least of the second; 0 where none counts.
    """
    narrow = df.select(U, SEQ, *[F.col(f).cast("double").alias(f"v{k}") for k, f in enumerate(features)])
    before = by_sequence().rowsBetween(Window.unboundedPreceding, -1)
    steps = {f"d{k}": F.signum(F.col(f"v{k}") - F.last(f"v{k}", ignorenulls=True).over(before)) for k in range(len(features))}
    rows = life_fraction(narrow).where(F.col(U).isNotNull()).withColumns(steps)
    told = [
        F.struct(F.lit(f).alias("feature"), corr_or_null(F.col(f"v{k}"), F.col("life_by_position")).alias("c"), F.abs(F.avg(f"d{k}")).alias("mono"), F.count(f"v{k}").alias("n_known"))
        for k, f in enumerate(features)
    ]
    per_unit = rows.groupBy(U).agg(F.count(F.lit(1)).alias("n"), F.array(*told).alias("told")).where("n >= 3").select(F.explode("told").alias("x")).select("x.*").where("n_known > 0")
    out = per_unit.groupBy("feature").agg(F.avg("mono").alias("monotonicity"), F.min(F.abs("c")).alias("trendability"))
    every = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    out = every.join(out, "feature", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("monotonicity", "trendability")})
    return out.withColumn("composite", F.col("monotonicity") * F.col("trendability")).orderBy(F.desc("composite"), "feature")


# Principal-component indicator


class PcaIndicator:
    """A fitted pipeline and its orientation and range."""

    def __init__(self, features: list[str], stages: list, sign: float, low: float, high: float):
        self.features, self.stages, self.sign, self.low, self.high = features, stages, sign, low, high

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted stages as a pipeline, the rest as one row."""
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        rest = spark.createDataFrame([(self.features, self.sign, self.low, self.high)], "features array<string>, sign double, low double, high double")
        rest.write.mode("overwrite").parquet(f"{path}/rest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PcaIndicator:
        rest = spark.read.parquet(f"{path}/rest").first()
        return PcaIndicator(list(rest["features"]), PipelineModel.load(f"{path}/stages").stages, rest["sign"], rest["low"], rest["high"])


def fit_pca(df: DataFrame, top_k: int = 8, max_null_fraction: float = 0.2) -> PcaIndicator:
    """First principal component of the best-scored features, turned to fall with life."""
    return _fit_components(df, top_k, max_null_fraction, (U, SEQ))[0]


def fit_apply_pca(df: DataFrame, top_k: int = 8, max_null_fraction: float = 0.2, out: str = "hi", keep: tuple[str, ...] = (U, SEQ)) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``apply_pca(df, fit_pca(df))``: gaps are filled and components worked out once for both."""
    model, rows = _fit_components(df, top_k, max_null_fraction, tuple(dict.fromkeys([*keep, U, SEQ])))
    return rows.select(*keep, _between_ends(model).alias(out))


def _fit_components(df: DataFrame, top_k: int, max_null_fraction: float, keep: tuple[str, ...]) -> tuple[PcaIndicator, DataFrame]:
    """The model, and the columns ``keep`` of ``df`` with their component ``__pc``, stored."""
    assert_no_leakage(df)
    cols = candidate_features(df, max_null_fraction)
    best = [r["feature"] for r in feature_scores(df, cols).limit(top_k).collect()]
    prepared, stages = _prepare(df, best), []
    assembler = VectorAssembler(inputCols=best, outputCol="__v")
    scaler = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(assembler.transform(prepared))
    pca = PCA(k=1, inputCol="__s", outputCol="__p").fit(scaler.transform(assembler.transform(prepared)))
    stages = [assembler, scaler, pca]
    first = materialise(_component(prepared, stages).select(*keep, "__pc"))
    told = life_fraction(first.select(U, SEQ, "__pc")).agg(corr_or_null(F.col("__pc"), F.col("life_by_value")).alias("c"), F.min("__pc").alias("lo"), F.max("__pc").alias("hi")).first()
    sign = -1.0 if (told["c"] or 0) > 0 else 1.0
    low, high = sorted((sign * told["lo"], sign * told["hi"]))
    return PcaIndicator(best, stages, sign, low, high), first


def _between_ends(model: PcaIndicator) -> Column:
    """The component's place between the fitted ends, not clipped; null where these coincide."""
    span = model.high - model.low
    return (model.sign * F.col("__pc") - model.low) / span if span else F.lit(None).cast("double")


def _prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """Gaps filled with the median of the frame at hand; medians are looked for only where there are gaps."""
    cast = df.withColumns({f: F.col(f).cast("double") for f in features})
    told = cast.agg(*[F.max(F.col(f).isNull() | F.isnan(f)).alias(f) for f in features]).first()
    gaps = [f for f in features if told[f]]
    return Imputer(strategy="median", inputCols=gaps, outputCols=gaps, relativeError=0.0001).fit(cast).transform(cast) if gaps else cast


def _component(df: DataFrame, stages: list) -> DataFrame:
    return reduce(lambda d, s: s.transform(d), stages, df).withColumn("__pc", vector_to_array("__p")[0]).drop("__v", "__s", "__p")


def apply_pca(df: DataFrame, model: PcaIndicator, out: str = "hi") -> DataFrame:
    """Position between the fitted ends, not clipped; null where these coincide."""
    found = _component(_prepare(df, model.features), model.stages).withColumn(out, _between_ends(model))
    return found.select(*[c for c in df.columns if c not in model.features], *model.features, out)
