"""From raw files to feature rows: one plan for all units, roles or log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds_between
from ..operators import asof, spectral, windowing
from ..tables import materialise, sized
from . import raw

SCHEMA_VERSION = "v1"
ACC_RATE = LOG_RATE = 25_600.0
TOLERANCE = 90.0
INTERVAL = 10.0
FILE_SECONDS = 78.125


def acquisition_features(spark: SparkSession, root: str, role: str, code_version: str = "") -> DataFrame:
    """One row for each acquisition file under ``root``, with the nearest temperature file's features.

    Units are numbered files in order; the remaining life of learning units counts files to
    the last by their numbers. A unit without a temperature file near has null temperatures.
    """
    files = raw.list_files(spark, root)
    accs, temps = raw.file_indices(files, "acc"), raw.file_indices(files, "temp")
    # Parsed rows are written by the reader; statistics, spectra and first rows read what they need.
    acc = raw.read_acceleration(spark, root, raw.ACC_FILES).join(sized(materialise(accs)), "path")
    keys = ["bearing_label", "file_index", "path"]
    renamed = acc.withColumnRenamed("accel_horizontal", "vibration_x").withColumnRenamed("accel_vertical", "vibration_y")
    rows = windowing.group_stats(renamed, keys, ["vibration_x", "vibration_y"])
    signals = materialise(spectral.gather_all(renamed, keys, "row_index", ["vibration_x", "vibration_y"]))
    for c in ("vibration_x", "vibration_y"):
        spec = spectral.spectral_features(signals, keys, c, ACC_RATE)
        rows = rows.join(spec.select(*keys, *[F.col(n).alias(f"{c}_{n}") for n in spec.columns if n not in keys]), keys)
    first = acc.groupBy(*keys).agg(F.min_by(F.struct("hour", "minute", "second"), "row_index").alias("t"))
    rows = rows.join(first, keys).withColumn("event_timestamp", raw.time_of_day(F.col("t.hour"), F.col("t.minute"), F.col("t.second"))).withColumn("seconds", F.col("t.hour") * 3600 + F.col("t.minute") * 60 + F.col("t.second")).drop("t")
    if not temps.isEmpty():
        temp = materialise(raw.read_temperature(spark, root, raw.TEMP_FILES).join(sized(materialise(temps)), "path"))
        index = temp.groupBy("bearing_label", "file_index").agg(F.min_by(F.col("hour") * 3600 + F.col("minute") * 60 + F.col("second"), "row_index").alias("seconds"))
        rows = asof.nearest_within(rows, index, "bearing_label", "seconds", "seconds", "file_index", TOLERANCE)
        stats = windowing.temperature_stats(temp, ["bearing_label", "file_index"], {"bearing_temp": F.col("temperature_c")}, "row_index").drop("n_samples").withColumnRenamed("file_index", "nearest_index")
        rows = rows.join(stats, ["bearing_label", "nearest_index"], "left").withColumn("temp_available", F.coalesce("temp_available", F.lit(False)))
    else:
        rows = rows.withColumns({f"bearing_temp_{k}": F.lit(None).cast("double") for k in ("mean", "min", "max", "std", "slope")} | {"temp_available": F.lit(False)})
    unit = Window.partitionBy("bearing_label")
    rul = F.when(F.lit(role == "learning"), (F.max("file_index").over(unit) - F.col("file_index")) * INTERVAL)
    out = rows.withColumn("sequence_index", (F.row_number().over(unit.orderBy("file_index")) - 1).cast("int")).withColumn("rul_seconds", rul)
    hashes = raw.file_hashes(spark, root, "*.csv").withColumnRenamed("sha256", "source_sha256")
    return _contract(out.join(hashes, "path"), "femto", F.concat(F.lit("femto:"), F.col("bearing_label")), role, ACC_RATE, code_version, ("bearing_label", "file_index", "path", "seconds", "nearest_index", "gap"))


def log_features(spark: SparkSession, root: str, code_version: str = "", size: int = 25_600, overlap: float = 0.5, stride: int = 1, rate: float = LOG_RATE, file_seconds: float = FILE_SECONDS) -> DataFrame:
    """One row for each complete window of the chosen log files; windows never cross files."""
    files = raw.every_kth(raw.discover_logs(spark, root), stride).withColumn("file_start", seconds_between(F.col("event_timestamp"), F.lit("1970-01-01").cast("timestamp_ntz")))
    # With a stride the other files aren't read at all: the names of the chosen ones are few.
    chosen = raw.read_logs(spark, root, raw.LOG_FILES) if stride == 1 else raw.read_logs(spark, [r["path"] for r in files.select("path").collect()])
    rows = materialise(chosen.join(sized(materialise(files.drop("event_timestamp"))), "path"))
    keys = ["path", "file_seq", "file_start"]
    stats = windowing.window_stats(rows, keys, ["vibration_x", "vibration_y"], size, overlap)
    signals = materialise(windowing.window_arrays(rows, keys, ["vibration_x", "vibration_y"], size, overlap))
    on = [*keys, "w"]
    for c in ("vibration_x", "vibration_y"):
        spec = spectral.spectral_features(signals, on, c, rate)
        stats = stats.join(spec.select(*on, *[F.col(n).alias(f"{c}_{n}") for n in spec.columns if n not in on]), on)
    b, a = F.col("bearing_temp_c"), F.col("ambient_temp_c")
    temps = windowing.windowed_temperatures(rows, keys, {"bearing_temp": b, "ambient_temp": a, "bearing_minus_ambient_temp": b - a}, size, overlap).drop("n_samples")
    timed = windowing.run_windows(stats.join(temps, on).withColumn("run", F.lit("college:run")), "run", "file_seq", "file_start", rate, file_seconds)
    timed = timed.withColumn("event_timestamp", F.timestamp_micros((F.col("event_seconds") * 1e6).cast("long")))
    hashes = raw.file_hashes(spark, root, "*.csv").withColumnRenamed("sha256", "source_sha256")
    return _contract(timed.join(hashes, "path"), "college", F.lit("college:run"), "college_run", rate, code_version, ("path", "file_seq", "file_start", "w", "run", "event_seconds"))


def _contract(rows: DataFrame, dataset: str, unit, role: str, rate: float, code_version: str, drop: tuple[str, ...]) -> DataFrame:
    """Contract columns first, then features in name order."""
    full = rows.withColumns(
        {
            "acquisition_id": F.uuid(), "dataset_id": F.lit(dataset), "bearing_run_id": unit, "role": F.lit(role), "source_file_path": F.col("path"), "sample_rate_hz": F.lit(rate),
            "schema_version": F.lit(SCHEMA_VERSION), "code_version": F.lit(code_version), "stage_label": F.lit(None).cast("string"),
        }
        | ({} if "row_start" in rows.columns else {"row_start": F.lit(None).cast("long"), "row_end": F.lit(None).cast("long")})
    )
    from ..operators.health import CONTRACT

    rest = sorted(c for c in full.columns if c not in CONTRACT and c not in drop)
    return full.select(*CONTRACT, *rest)
