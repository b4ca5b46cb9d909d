"""Jobs that compose the operators: build features, train and freeze, evaluate, compare, export."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import base_name
from .operators import guards, health, rul, stages
from .sources import catalog as store
from .sources import features

#: The share of a run at which waveforms are picked for an export.
PICKS = (0.0, 0.02, 0.5, 0.9, 1.0)
CAVEAT = "The baseline's error on growing prefixes of one run is zero by construction: its formula is that of the label. It is no result to compare with."


def build_acquisitions(spark: SparkSession, catalog: store.Catalog, folders: dict[str, str], dataset: str = "femto", code_version: str = "") -> dict[str, str]:
    """One batch for each role, from the folder of its raw files; batch ids by role.

    All units of a role are one plan. A role without acquisitions gives no batch.
    """
    catalog.ensure_dataset(dataset)
    batches = {role: catalog.write_batch(features.acquisition_features(spark, root, role, code_version), dataset, code_version, empty_ok=True) for role, root in sorted(folders.items())}
    return {role: batch for role, batch in batches.items() if batch is not None}


def build_logs(spark: SparkSession, catalog: store.Catalog, root: str, dataset: str = "college", code_version: str = "", stride: int = 1, **options) -> str:
    """One batch of the windows of every ``stride``-th log file; its id."""
    catalog.ensure_dataset(dataset)
    return catalog.write_batch(features.log_features(spark, root, code_version, stride=stride, **options), dataset, code_version)


def train_and_freeze(learning: DataFrame, folder: str, fold_metrics: DataFrame | None = None, drop: tuple[str, ...] = (), trees: int = rul.TREES, depth: int = rul.DEPTH) -> str:
    """Fit baseline and trees on all learning rows and save both; returns the model selected.

    ``fold_metrics`` (an evaluation's ``model, mae``) selects the lower mean error; without
    them the trees are selected.
    """
    spark = learning.sparkSession
    guards.assert_no_leakage(learning, ("learning",))
    health.save_params(rul.fit_naive(learning), f"{folder}/naive")
    health.save_params(rul.unit_lives(learning).select(health.U, "start"), f"{folder}/starts")
    rul.fit_forest(learning.drop(*drop), trees=trees, depth=depth).write().overwrite().save(f"{folder}/{rul.FOREST}")
    selected = store.selected_model(None if fold_metrics is None else rul.mean_fold_mae(fold_metrics))
    store.write_metrics(spark.createDataFrame([(selected, "lower mean error over the folds")], "selected string, reason string"), f"{folder}/selected")
    return selected


def frozen(spark: SparkSession, folder: str) -> tuple[dict[str, rul.Predictor], str]:
    """The saved models as predictors of whole tables, and the name of the selected one."""
    params, starts = health.load_params(spark, f"{folder}/naive"), health.load_params(spark, f"{folder}/starts")
    forest = PipelineModel.load(f"{folder}/{rul.FOREST}")
    chosen = store.read_metrics(spark, f"{folder}/selected")
    return {"naive": lambda d: rul.predict_naive(d, params, starts), rul.FOREST: lambda d: rul.predict_forest(d, forest)}, chosen.first()["selected"] if chosen is not None else rul.FOREST


def evaluate(learning: DataFrame | None, runs: DataFrame | None = None, unit: str = health.U, drop: tuple[str, ...] = (), **size) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Both models in both studies: tables of the report, and the held-out predictions by study."""
    tables, predictions = {}, {}
    if learning is not None:
        predictions["femto"] = rul.lobo_naive(learning, unit).unionByName(rul.lobo_trees(learning, unit, drop, **size))
    if runs is not None:
        predictions["college"] = rul.walk_forward_naive(runs).unionByName(rul.walk_forward_trees(runs, drop=drop, **size))
    for name, rows in predictions.items():
        folds = rul.metrics(rows, "model", "split")
        tables |= {f"{name}_folds": folds, f"{name}_mean": rul.mean_fold_mae(folds), f"{name}_overall": rul.metrics(rows, "model")}
    if runs is not None:
        tables["college_caveat"] = runs.sparkSession.createDataFrame([(CAVEAT,)], "caveat string")
    return tables, predictions


def write_evaluation(tables: dict[str, DataFrame], predictions: dict[str, DataFrame], folder: str) -> None:
    store.write_document(tables, f"{folder}/rul_evaluation")
    store.write_predictions(predictions, f"{folder}/rul_predictions")


def compare_indicators(df: DataFrame, unit: str = health.U, check: bool = True) -> dict[str, DataFrame]:
    """All indicators side by side: by machine, on the whole with the selected one, and stages.

    The reference indicator counts as held out (fitted without each ``unit``); the others are
    fitted on all rows. Stages are those of the reference indicator, thresholds held out too.
    """
    df = health.materialise(df)
    transparent = health.apply_transparent(df, health.fit_transparent(df))
    own = [c for c in df.columns if c in (*health.CONTRACT, *health.REFERENCE)]
    component = health.apply_pca(df.select(*own), health.fit_pca(df.select(*own)))
    reference = health.materialise(health.leave_one_out_reference(df, unit, check))
    named = {"transparent": transparent, "component": component, "reference": reference}
    by_unit = None
    for name, rows in named.items():
        told = health.diagnostics(rows).withColumn("hi_name", F.lit(name))
        by_unit = told if by_unit is None else by_unit.unionByName(told)
    by_unit = health.materialise(by_unit)
    overall = health.pinning_report(by_unit)
    chosen = health.select_indicator(overall)
    held = reference.drop("fold")
    limits = stages.fit_thresholds_without(held, unit, check=check)
    staged = stages.summarize(stages.assign_stages(held, limits, by=unit))
    # The choice is one row.
    return {"indicators_by_unit": by_unit, "indicators": overall.crossJoin(F.broadcast(chosen)), "stages": staged, "thresholds": limits}


def picked_rows(df: DataFrame, fractions: tuple[float, ...] = PICKS) -> DataFrame:
    """Rows at fixed fractions of each run, each place once."""
    rows = df.withColumn("__p", F.row_number().over(health.by_sequence()) - 1)
    sizes = df.groupBy(health.U).agg(F.count(F.lit(1)).alias("__m"))
    wanted = F.array_distinct(F.array(*[F.least(F.floor(F.lit(f) * (F.col("__m") - 1)), F.col("__m") - 1) for f in fractions]))
    return rows.join(sizes, health.U).where(F.array_contains(wanted, F.col("__p").cast("long"))).drop("__p", "__m")


def deployment_subset(learning: DataFrame, other: DataFrame | None, units: list[str]) -> DataFrame:
    """All learning rows of the named units and picked rows of the other data set, with base names for paths.

    Raises where a column still holds a path of the machine that built the rows.
    """
    rows = learning.where((F.col("role") == "learning") & F.col(health.U).isin(units))
    if other is not None:
        rows = rows.unionByName(picked_rows(other), allowMissingColumns=True)
    return guards.assert_no_host_paths(rows.withColumn("source_file_path", base_name(F.col("source_file_path"))))
