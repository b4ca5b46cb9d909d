from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import paths
from pulsegrid.sources import catalog, features, raw


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for unit, delimiter in (("Bearing1_1", ","), ("Bearing2_1", ";")):
        folder = root / "set" / unit
        folder.mkdir(parents=True)
        for k in (1, 2, 3):
            lines = [f"9,39,{38 + k},{i},{(i % 7) - 3}.5,{(i % 5) - 2}.25" for i in range(64)]
            (folder / f"acc_{k:05d}.csv").write_text("\n".join(lines) + "\n")
        (folder / "temp_00001.csv").write_text("\n".join(delimiter.join(["9", "40", "47", "5", f"{70 + i}.5"]) for i in range(5)) + "\n")
    logs = root / "logs"
    logs.mkdir()
    for hour, head in (("17", ""), ("18", "a,b,c,d\n")):
        body = "\n".join(f"{i % 9}.0,{i % 4}.0,{'NaN' if i % 10 == 0 else 80 + i % 3},25.0" for i in range(500))
        (logs / f"LogFile_2022-06-20-{hour}-00-31.csv").write_text(head + body + "\n")
    return root


def test_units_and_counts(spark, files):
    units = raw.discover_units(spark, str(files / "set"), "learning").collect()
    assert [(r["bearing_label"], r["condition_id"], r["role"]) for r in units] == [("Bearing1_1", 1, "learning"), ("Bearing2_1", 2, "learning")]
    counts = {r["bearing_label"]: (r["acc"], r["temp"]) for r in raw.file_counts(raw.list_files(spark, str(files / "set"))).collect()}
    assert counts == {"Bearing1_1": (3, 1), "Bearing2_1": (3, 1)}
    with pytest.raises(FileNotFoundError):
        raw.discover_units(spark, str(files / "logs"), "learning")


def test_rows_keep_file_order_across_blocks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(f"{i},0,0,0" for i in range(20000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = raw.read_logs(spark, str(tmp_path / "x.csv"))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where("vibration_x <> row_index").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_gaps_and_bad_rows(spark, files, tmp_path):
    rows = raw.read_logs(spark, str(files / "logs"))
    profile = raw.dropout_profile(rows, ["bearing_temp_c", "vibration_x"]).collect()
    assert [(r["bearing_temp_c"], r["vibration_x"], r["rows"]) for r in profile] == [(50, 0, 500)] * 2
    (tmp_path / "bad.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="malformed"):
        raw.read_acceleration(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "nan.csv").write_text("1,2,3,4,NaN,6\n")
    with pytest.raises(Exception, match="malformed"):
        raw.read_acceleration(spark, str(tmp_path / "nan.csv")).collect()
    (tmp_path / "one.csv").write_text("1 2 3\n")
    with pytest.raises(Exception, match="no delimiter"):
        raw.read_temperature(spark, str(tmp_path / "one.csv")).collect()


def test_log_names(spark, files, tmp_path):
    logs = raw.discover_logs(spark, str(files / "logs")).collect()
    assert [(r["file_seq"], r["event_timestamp"].hour) for r in logs] == [(0, 17), (1, 18)]
    (tmp_path / "notes.csv").write_text("1,2,3,4\n")
    (tmp_path / "old_LogFile_2022-06-21-17-00-31.csv").write_text("1,2,3,4\n")
    with pytest.raises(FileNotFoundError):
        raw.discover_logs(spark, str(tmp_path))
    with pytest.raises(Exception, match="not a log file name"):
        spark.createDataFrame([("old_LogFile_2022-06-21-17-00-31.csv",)], "p string").select(raw.log_time(F.col("p"))).collect()
    (tmp_path / "LogFile_bad.csv").write_text("1,2,3,4\n")
    with pytest.raises(Exception, match="not a log file name"):
        raw.discover_logs(spark, str(tmp_path))


def test_acquisition_features(spark, files):
    rows = features.acquisition_features(spark, str(files / "set"), "learning").orderBy("bearing_run_id", "sequence_index").collect()
    assert [(r["bearing_run_id"], r["sequence_index"], r["rul_seconds"]) for r in rows] == [(f"femto:{u}", i, 20.0 - 10 * i) for u in ("Bearing1_1", "Bearing2_1") for i in range(3)]
    assert all(r["temp_available"] and r["bearing_temp_slope"] == pytest.approx(1) and r["n_samples"] == 64 and len(r["source_sha256"]) == 64 for r in rows)
    assert len(rows[0].asDict()) == 17 + 44 + 5 and str(rows[0]["event_timestamp"]) == "1900-01-01 09:39:39"
    assert all(r["rul_seconds"] is None for r in features.acquisition_features(spark, str(files / "set"), "test_censored").collect())


def test_log_features_and_catalogue(spark, files, tmp_path):
    rows = features.log_features(spark, str(files / "logs"), size=100, file_seconds=78.125)
    assert len(rows.columns) == 17 + 44 + 15
    got = rows.orderBy("sequence_index").collect()
    assert [r["sequence_index"] for r in got] == list(range(18)) and [r["row_start"] for r in got][:3] == [0, 50, 100] and got[9]["row_start"] == 0
    cat = catalog.Catalog(spark, str(tmp_path / "store")).create()
    for _ in range(2):
        cat.ensure_dataset("college")
        cat.ensure_run("college:run", "college", "college_run")
    assert cat.table("datasets").count() == 1 and cat.table("bearing_runs").count() == 1
    first = cat.write_batch(rows, "college")
    second = cat.write_batch(rows.limit(3), "college")
    assert cat.latest_batch("college", "college_run").endswith(second) and cat.latest_batch("college", "learning") is None
    lines = cat.table("acquisitions").where(F.col("batch_id") == first)
    assert lines.count() == 18 and lines.agg(F.max("feature_row_index")).first()[0] == 17 and lines.first()["kind"] == "college_window"
    assert [r for _, r in cat.list_batches()] == ["college_run"] * 2
    with pytest.raises(ValueError):
        cat.write_batch(rows.limit(0), "college")


def test_a_failed_writer_shows_nothing(spark, files, tmp_path, monkeypatch):
    cat = catalog.Catalog(spark, str(tmp_path / "store")).create()
    rows = features.log_features(spark, str(files / "logs"), size=100, file_seconds=78.125)
    write = catalog.Catalog._write

    def fails(self, name, part):
        if name == "acquisitions":
            raise OSError("disk full")
        return write(self, name, part)

    monkeypatch.setattr(catalog.Catalog, "_write", fails)
    with pytest.raises(OSError, match="disk full"):
        cat.write_batch(rows, "college")
    monkeypatch.undo()
    assert [cat.table(t).count() for t in ("feature_batches", "acquisitions", "bearing_runs")] == [0, 0, 0]
    assert cat.list_batches() == [] and cat.latest_batch("college", "college_run") is None
    cat.write_batch(rows, "college")
    assert [cat.table(t).count() for t in ("feature_batches", "acquisitions", "bearing_runs")] == [1, 18, 1]


def test_keys_stay_unique_under_writers_at_once(spark, tmp_path):
    first = catalog.Catalog(spark, str(tmp_path / "store")).create()

    class Late(catalog.Catalog):
        """Looks at the catalogue, and then another writer commits."""

        late = True

        def _commits(self):
            seen = super()._commits()
            if self.late:
                self.late = False
                first.ensure_run("a", "set", "learning")
            return seen

    Late(spark, str(tmp_path / "store")).insert_absent("bearing_runs", spark.createDataFrame([("a", "other", "learning"), ("b", "set", "learning")], catalog.TABLES["bearing_runs"]))
    runs = sorted(tuple(r) for r in first.table("bearing_runs").collect())
    assert runs == [("a", "set", "learning"), ("b", "set", "learning")]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: catalog.Catalog(spark, str(tmp_path / "store")).ensure_dataset(f"d{k % 2}"), range(8)))
    assert sorted(r["dataset_id"] for r in first.table("datasets").collect()) == ["d0", "d1"]
    assert len(first._commits()) == 5


def test_raw_rows_are_scanned_once_and_not_shuffled(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{k},0,0,0,1.5,2.5\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = raw.read_acceleration(spark, str(tmp_path), "*.csv")
        got = rows.groupBy("path").agg(F.count_if(F.col("row_index") == F.col("hour")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
        assert [(r["right"], r["n"]) for r in got] == [(3000, 3000)] * 2
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "csv" not in plan and "Scan text" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_metric_documents(spark, tmp_path):
    assert catalog.selected_model(catalog.read_metrics(spark, str(tmp_path / "none"))) == "forest"
    catalog.write_metrics(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "model string, mean_mae double"), str(tmp_path / "m"))
    assert catalog.selected_model(catalog.read_metrics(spark, str(tmp_path / "m"))) == "b"


def test_paths_take_longest_end_and_decline_ties(spark):
    files = spark.createDataFrame([("/a/x/y/f.csv",), ("/a/z/y/f.csv",), ("/b/g.csv",)], "file string")
    stored = spark.createDataFrame([(1, "C:\\old\\x\\y\\f.csv"), (2, "/q/f.csv"), (3, "/q/g.csv"), (4, "/q/none"), (5, "")], "id int, path string")
    got = {r["id"]: r["resolved"] for r in paths.resolve(stored, files).collect()}
    assert got == {1: "/a/x/y/f.csv", 2: "/q/f.csv", 3: "/b/g.csv", 4: "/q/none", 5: ""}


def _resolved(path, files, depth=4):
    """The plain rule: every file is looked at."""
    cut = lambda p: [s for s in p.replace("\\", "/").split("/") if s]
    s = cut(path)
    for k in range(min(depth, len(s)), 0, -1):
        ends = [f for f in files if cut(f)[-k:] == s[-k:]]
        if ends:
            common = {f: len(set(s) & set(cut(f))) for f in ends}
            best = [f for f in ends if common[f] == max(common.values())]
            return best[0] if len(best) == 1 else path
    return path


def test_paths_equal_the_plain_rule(spark):
    rng = random.Random(9)
    some = lambda n: "/".join(rng.choice("abcd") for _ in range(n))
    files = sorted({f"/{some(rng.randint(0, 4))}/{rng.choice('fgh')}.csv" for _ in range(60)})
    stored = [f"{some(rng.randint(0, 5))}/{rng.choice('fghi')}.csv" for _ in range(200)] + [None, "", "/", "f.csv", "C:\\a\\b\\f.csv"]
    df = spark.createDataFrame(list(enumerate(stored)), "id int, path string")
    got = {r["id"]: r["resolved"] for r in paths.resolve(df, spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {i: None if p is None else _resolved(p, files) for i, p in enumerate(stored)}


def test_many_files_of_one_name_form_no_pairs(spark):
    n = 10_000
    files = spark.range(n).select(F.concat(F.lit("/lake/"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), F.lit("/unit"), F.col("id"), F.lit("/x/signal.csv")).alias("file"))
    stored = spark.range(n).select("id", F.concat(F.lit("D:\\old\\unit"), F.col("id"), F.lit("\\y\\signal.csv")).alias("path"))
    out = paths.resolve(stored, files)
    assert out.where(F.col("resolved").contains(F.concat(F.lit("/unit"), F.col("id"), F.lit("/")))).count() == n
    vague = spark.range(n).select("id", F.concat(F.lit("/even/"), F.col("id"), F.lit("/signal.csv")).alias("path"))
    assert paths.resolve(vague, files).where("resolved <> path").count() == 0
