from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_machines import _df, _runs
from test_sources import files  # noqa: F401

from pulsegrid import jobs
from pulsegrid.operators import guards, health, rul, spectral
from pulsegrid.operators.numbering import number_rows
from pulsegrid.sources import catalog, waveforms
from pulsegrid.tables import clear_tables, materialise

U, SEQ = health.U, health.SEQ
SMALL = {"trees": 8, "depth": 5}


def test_fitted_parameters_survive_saving(spark, tmp_path):
    df = _df(spark, _runs())
    params = health.fit_reference(df)
    health.save_params(params, str(tmp_path / "reference"))
    assert health.load_params(spark, str(tmp_path / "reference")).collect() == params.collect()
    model = health.fit_pca(df, top_k=4)
    model.save(spark, str(tmp_path / "pca"))
    a, b = ({(r[U], r[SEQ]): r["hi"] for r in health.apply_pca(df, m).collect()} for m in (model, health.PcaIndicator.load(spark, str(tmp_path / "pca"))))
    assert a == b and len(a) == 360


def test_batches_of_all_roles_and_logs(spark, files, tmp_path):  # noqa: F811
    store = catalog.Catalog(spark, str(tmp_path / "store")).create()
    assert store.latest_batch("femto", "learning") is None and store.list_batches() == []
    made = jobs.build_acquisitions(spark, store, {"learning": str(files / "set"), "test_censored": str(files / "set")})
    assert set(made) == {"learning", "test_censored"} and store.table("bearing_runs").count() == 4
    assert store.latest_batch("femto", "learning").endswith(made["learning"]) and store.latest_batch("femto", "test_censored").endswith(made["test_censored"])
    again = jobs.build_acquisitions(spark, store, {"learning": str(files / "set")})["learning"]
    assert again != made["learning"] and store.table("bearing_runs").count() == 4 and store.latest_batch("femto", "learning").endswith(again)
    logs = jobs.build_logs(spark, store, str(files / "logs"), stride=2, size=100)
    rows = spark.read.parquet(store.latest_batch("college", "college_run"))
    assert rows.count() == 9 and store.latest_batch("college", "college_run").endswith(logs)
    (tmp_path / "store" / "batches" / "gone").mkdir()
    missing = store.table("feature_batches").limit(1).withColumn("batch_id", F.lit("lost")).withColumn("path", F.lit("/nowhere/lost"))
    store.commit({"feature_batches": missing})
    listed = dict(store.list_batches())
    assert listed["/nowhere/lost"] == "unreadable" and sorted(listed.values()) == ["college_run", "learning", "learning", "test_censored", "unreadable"]


def test_evaluation_trains_both_models_and_freezes_the_better(spark, tmp_path):
    learning = _df(spark, _runs(n_units=3, n=60, offset=0.1)).withColumn("label", F.lit("x"))
    runs = learning.where(f"{U} = 'm0'").withColumn("role", F.lit("college_run"))
    tables, predictions = jobs.evaluate(learning, runs, drop=("label",), **SMALL)
    folds = {(r["model"], r["split"]): r["n"] for r in tables["femto_folds"].collect()}
    assert folds == {(m, f"m{k}"): 60 for m in ("naive", "forest") for k in range(3)}
    walks = {(r["model"], r["split"]): r["n"] for r in tables["college_folds"].collect()}
    assert walks == {(m, f"fold {k}"): 15 for m in ("naive", "forest") for k in (1, 2, 3)}
    jobs.write_evaluation(tables, predictions, str(tmp_path))
    back = catalog.read_predictions(spark, str(tmp_path / "rul_predictions"))
    assert back.groupBy("dataset_id", "model").count().count() == 4 and catalog.read_predictions(spark, str(tmp_path / "none")) is None
    document = catalog.read_document(spark, str(tmp_path / "rul_evaluation"), ("femto_folds", "femto_mean", "college_caveat", "nothing"))
    assert set(document) == {"femto_folds", "femto_mean", "college_caveat"}
    means = {r["model"]: r["mean_mae"] for r in document["femto_mean"].collect()}
    selected = jobs.train_and_freeze(learning, str(tmp_path / "models"), document["femto_folds"], ("label",), **SMALL)
    assert selected == min(means, key=means.get) and jobs.train_and_freeze(learning, str(tmp_path / "other"), drop=("label",), **SMALL) == "forest"
    predictors, chosen = jobs.frozen(spark, str(tmp_path / "models"))
    assert chosen == selected
    censored = _df(spark, [(f"Bearing1_{i}", "test_censored", *r[2:]) for i in (3, 4) for r in _runs(n_units=1, n=60, pieces=45)]).withColumn("label", F.lit("x"))
    truth = spark.createDataFrame([("Bearing1_3", 150.0), ("Bearing1_4", 150.0)], "label string, actual double")
    scored = {r["model"]: r["mae"] for r in rul.summarize_hidden(rul.score_hidden_set(censored.drop("label"), truth, predictors), "model").collect()}
    assert set(scored) == {"naive", "forest"} and scored["naive"] == 0 and scored["forest"] < 150
    with pytest.raises(guards.LeakageError):
        jobs.train_and_freeze(censored, str(tmp_path / "never"), drop=("label",))


def test_comparison_selects_an_indicator_that_never_pins(spark):
    out = jobs.compare_indicators(_df(spark, _runs(n_units=4, n=120, offset=0.3)))
    told = {r["hi_name"]: r for r in out["indicators"].collect()}
    assert set(told) == {"transparent", "component", "reference"} and {r["selected"] for r in told.values()} <= set(told)
    assert told["reference"]["worst_pct_at_one"] == 0 and out["stages"].count() == 4 and out["thresholds"].count() == 4
    pinned = out["indicators"].drop("selected").withColumn("worst_pct_at_one", F.lit(50.0))
    with pytest.raises(ValueError):
        health.select_indicator(pinned)


def test_folds_are_bounded_and_complements_equal_refits(spark):
    df = _df(spark, _runs(n_units=5, n=20)).withColumn("rul_seconds", F.col("rul_seconds") * (1 + F.ascii(F.substring(U, 2, 1))))
    want = {r["fold"]: r["mean_life"] for r in rul.fit_naive(health.leave_one_out(df), by="fold").collect()}
    got = {r["fold"]: r["mean_life"] for r in rul.fit_naive_leave_one_out(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError, match="folds"):
        health.folds_of(df, most=4)
    predicted = rul.lobo_trees(df, **SMALL)
    assert predicted.groupBy("split", U).count().where(F.col("split") == F.col(U)).count() == 5 and predicted.count() == 100


def test_export_and_waveforms(spark, files):  # noqa: F811
    rows = _df(spark, _runs(n_units=3, n=50)).withColumn("source_file_path", F.concat(F.lit("D:\\raw\\"), F.col(U), F.lit("\\acc.csv")))
    other = rows.where(f"{U} = 'm2'").withColumn("role", F.lit("college_run"))
    out = jobs.deployment_subset(rows, other, ["m0", "m1"]).collect()
    assert len(out) == 104 and {r["source_file_path"] for r in out} == {"acc.csv"}
    with pytest.raises(ValueError, match="host paths"):
        jobs.deployment_subset(rows.withColumn("note", F.lit("D:\\x")), None, ["m0"])
    stored = jobs.picked_rows(rows).select(U, SEQ, F.array(F.lit(1.0)).alias("vibration_x"))
    assert sorted(r[SEQ] for r in stored.where(f"{U} = 'm0'").collect()) == [0, 24, 44, 49]
    assert waveforms.with_waveform(rows, stored).count() == 12 and waveforms.waveform(stored, "m1", 24).count() == 1
    with pytest.raises(FileNotFoundError):
        waveforms.waveform(stored, "m1", 25)
    assert waveforms.columns_with(rows, "vibration_x", "role").columns == ["role", *[f for f in health.REFERENCE if "_x_" in f]]
    path = "file:" + str(files / "set" / "Bearing2_1" / "acc_00002.csv")
    acc, temp = waveforms.read_again(spark, path)
    assert acc.count() == 64 and temp.agg(F.avg("temperature_c")).first()[0] == 72.5
    assert waveforms.read_again(spark, path, tolerance=1.0)[1] is None


def test_numbers_by_bucket_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][rng.integers(0, 3)], int(rng.integers(0, 6)) if rng.random() < 0.9 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, b int, x int").repartition(5)
    got = {r["x"]: r["n"] for r in number_rows(df, ["g"], ["b"], ["x"], "n").collect()}
    seen: dict = {}
    for g, b, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        assert got[x] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    every = sorted(r["n"] for r in number_rows(df, [], ["g", "b"], ["x"], "n").collect())
    assert every == list(range(400))


def test_spectrum_prefix(spark):
    signal = [float(x) for x in np.sin(2 * np.pi * 5 * np.arange(64) / 64)]
    df = spark.createDataFrame([(1, signal), (2, [1.0]), (3, None)], "id int, s array<double>")
    got = spectral.spectrum_prefix(df, ["id"], "s", 64.0).collect()
    assert [r["k"] for r in got] == list(range(8)) and max(got, key=lambda r: r["magnitude"])["frequency"] == 5.0


def test_tables_are_cleared(spark):
    kept = materialise(spark.range(5))
    assert kept.count() == 5 and clear_tables(spark) >= 1
    with pytest.raises(Exception):
        kept.count()
    assert clear_tables(spark) == 0


def test_indicators_are_compared_over_stored_rows(spark, monkeypatch):
    seen = []

    def fit(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(jobs.health, "fit_transparent", fit)
    with pytest.raises(InterruptedError):
        jobs.compare_indicators(spark.range(20).selectExpr("id", "row_number() OVER (PARTITION BY id % 2 ORDER BY id) AS n"))
    assert len(seen) == 1 and "Window" not in seen[0]
