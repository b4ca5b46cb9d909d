"""Queries on raw samples: windows, features, spectra, nearest-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, spectral, windowing
from . import views
from .views import RATE, SIZE, STEP, r, rounded, with_views

KEYS = ["unit", "file_seq"]
#: Bands for 64 Hz signals.
BANDS = (("low", 0.0, 4.0), ("mid", 4.0, 16.0), ("high", 16.0, 32.0))
TOLERANCE = 6 * 3600.0
FILE_SECONDS = views.FILE_ROWS / RATE


def _stats_sql(c: str) -> str:
    rms = f"sqrt(avg({c} * {c}))"
    flat = f"var_pop({c}) > 1e-24"
    parts = {
        "mean": f"avg({c})", "abs_mean": f"avg(abs({c}))", "rms": rms, "std": f"stddev_pop({c})", "var": f"var_pop({c})", "min": f"min({c})", "max": f"max({c})", "peak_to_peak": f"max({c}) - min({c})",
        "crest_factor": f"max(abs({c})) / nullif({rms}, 0)", "shape_factor": f"{rms} / nullif(avg(abs({c})), 0)", "impulse_factor": f"max(abs({c})) / nullif(avg(abs({c})), 0)",
        "clearance_factor": f"max(abs({c})) / nullif(power(avg(sqrt(abs({c}))), 2), 0)", "kurtosis": f"CASE WHEN {flat} THEN kurtosis_pop({c}) END",
        "skewness": f"CASE WHEN {flat} THEN skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0::DOUBLE)) END",
    }
    return ", ".join(f"{r(v)} AS {c}_{k}" for k, v in parts.items())


def _window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.window_stats(views.samples(spark, sf_dir), KEYS, ["x", "y"], SIZE, views.OVERLAP, row="file_row")


def w1_windows(spark, sf_dir):
    return _window_rows(spark, sf_dir).select(*KEYS, "w", "row_start", "row_end", "n_samples", F.col("x_mean").isNotNull().alias("any_x"))


W1 = f"""{with_views("win")} SELECT unit, file_seq, w, w * {STEP} AS row_start, w * {STEP} + {SIZE - 1} AS row_end, count(*) AS n_samples, bool_or(x IS NOT NULL) AS any_x
FROM win GROUP BY unit, file_seq, w HAVING count(*) = {SIZE}"""


def a01_a14_window_stats(spark, sf_dir):
    return rounded(_window_rows(spark, sf_dir).drop("row_start", "row_end"))


A01 = f"""{with_views("win")} SELECT unit, file_seq, w, count(*) AS n_samples, {_stats_sql("x")}, {_stats_sql("y")} FROM win GROUP BY unit, file_seq, w HAVING count(*) = {SIZE}"""


def w5_group_stats(spark, sf_dir):
    return rounded(windowing.group_stats(views.samples(spark, sf_dir), KEYS, ["x", "y"]))


W5 = f"""{with_views("samples")} SELECT unit, file_seq, count(*) AS n_samples, {_stats_sql("x")}, {_stats_sql("y")} FROM samples GROUP BY unit, file_seq"""


def w2_w4_run_windows(spark, sf_dir):
    files = _window_rows(spark, sf_dir).select(*KEYS, "w", "row_start").withColumn("file_start", F.col("file_seq") * FILE_SECONDS * 2)
    rows = windowing.run_windows(files, "unit", "file_seq", "file_start", RATE, FILE_SECONDS)
    return rounded(rows.select(*KEYS, "w", F.col("sequence_index").cast("long").alias("sequence_index"), "event_seconds", "rul_seconds"))


W2 = f"""{with_views("win")}, f AS (SELECT unit, file_seq, w, w * {STEP} AS row_start, file_seq * {FILE_SECONDS * 2}::DOUBLE AS file_start FROM win GROUP BY unit, file_seq, w HAVING count(*) = {SIZE})
SELECT unit, file_seq, w, row_number() OVER (PARTITION BY unit ORDER BY file_seq, w) - 1 AS sequence_index, {r(f"file_start + row_start / {RATE}::DOUBLE")} AS event_seconds,
{r(f"max(file_start) OVER (PARTITION BY unit) + {FILE_SECONDS}::DOUBLE - (file_start + row_start / {RATE}::DOUBLE)")} AS rul_seconds FROM f"""


def a24_a27_temperature(spark, sf_dir):
    """x as the bearing's temperature, y as the surroundings'."""
    values = {"bearing_temp": F.col("x"), "ambient_temp": F.col("y"), "bearing_minus_ambient_temp": F.col("x") - F.col("y")}
    return rounded(windowing.windowed_temperatures(views.samples(spark, sf_dir), KEYS, values, SIZE, views.OVERLAP, "file_row"))


def _temp_sql(name: str, v: str) -> str:
    parts = {"mean": f"avg({v})", "min": f"min({v})", "max": f"max({v})", "std": f"stddev_pop({v})", "slope": f"regr_slope({v}, k::DOUBLE)"}
    return ", ".join(f"{r(x)} AS {name}_{k}" for k, x in parts.items())


A24 = f"""{with_views("win")} SELECT unit, file_seq, w, count(*) AS n_samples, {_temp_sql("bearing_temp", "x")}, {_temp_sql("ambient_temp", "y")}, {_temp_sql("bearing_minus_ambient_temp", "(x - y)")},
bool_or(x IS NOT NULL) AS temp_available FROM win GROUP BY unit, file_seq, w HAVING count(*) = {SIZE}"""


def a15_a23_spectral_vectors(spark, sf_dir):
    return rounded(spectral.spectral_features(views.load(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", RATE, BANDS))


_SPECTRUM = """SELECT {keys}, k, k * {rate}::DOUBLE / n AS f, sqrt(re * re + im * im) AS mag FROM (
  SELECT {keys}, k, n, sum(v * cos(2 * pi() * k * i / n)) AS re, sum(v * sin(2 * pi() * k * i / n)) AS im
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM sig) GROUP BY {keys}, k, n)"""


def _spectral_sql(keys: str, digits: int = 4) -> str:
    parts = {
        "dominant_frequency_hz": "arg_min(f, CASE WHEN k > 0 THEN -round(mag, 7) END)", "spectral_centroid_hz": "sum(f * mag) / nullif(sum(mag), 0)",
        "spectral_entropy": "-sum(CASE WHEN mag > 0 THEN mag / total * log2(mag / total) END)", "frequency_rms_hz": "sqrt(sum(f * f * mag * mag) / nullif(sum(mag * mag), 0))", "total_spectral_energy": "sum(mag * mag)",
    } | {f"band_energy_frac_{name}": f"coalesce(sum(CASE WHEN f >= {low} AND f < {high} THEN mag * mag END), 0) / nullif(sum(mag * mag), 0)" for name, low, high in BANDS}
    return f"""spec AS ({_SPECTRUM.format(keys=keys, rate=RATE)}), tot AS (SELECT *, sum(mag) OVER (PARTITION BY {keys}) AS total FROM spec)
SELECT {keys}, {", ".join(f"{r(v, digits)} AS {k}" for k, v in parts.items())} FROM tot GROUP BY {keys}"""


A15 = f"""WITH sig AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), {_spectral_sql("vec_id")}"""


def a15_spectral_windows(spark, sf_dir):
    rows = windowing.window_arrays(views.samples(spark, sf_dir), KEYS, ["x"], SIZE, views.OVERLAP, "file_row")
    return rounded(spectral.spectral_features(rows, [*KEYS, "w"], "x", RATE, BANDS), 3)


A15W = f"""{with_views("win")}, full_w AS (SELECT *, count(*) OVER (PARTITION BY unit, file_seq, w) AS rows_ FROM win),
sig AS (SELECT unit, file_seq, w, x AS v, count(*) OVER (PARTITION BY unit, file_seq, w) AS n, row_number() OVER (PARTITION BY unit, file_seq, w ORDER BY k) - 1 AS i FROM full_w WHERE rows_ = {SIZE} AND x IS NOT NULL), {_spectral_sql("unit, file_seq, w", 3)}"""


def l8_spectrum_prefix(spark, sf_dir):
    return rounded(spectral.spectrum_prefix(views.load(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", RATE))


L8 = f"""WITH sig AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
spec AS ({_SPECTRUM.format(keys="vec_id, n", rate=RATE).replace("vec_id, n, k, n", "vec_id, n, k")}) SELECT vec_id, CAST(k AS INT) AS k, {r("f")} AS frequency, {r("mag")} AS magnitude FROM spec WHERE k < (n // 2 + 1) // 4"""


def s26_waveforms(spark, sf_dir):
    """Windows of 64 rows as arrays of floats; gaps keep their places."""
    rows = views.samples(spark, sf_dir).withColumn("w", F.floor(F.col("row_index") / SIZE).cast("long"))
    arrays = spectral.gather(rows, ["unit", "w"], "row_index", "x", "xs", "float").join(spectral.gather(rows, ["unit", "w"], "row_index", "y", "ys", "float"), ["unit", "w"])
    return arrays.select("unit", "w", F.size("xs").alias("n"), F.array_join(F.transform("ys", lambda v: v.cast("int").cast("string")), ",", "-").alias("ys"), F.size(F.filter("xs", lambda v: v.isNull())).alias("gaps"))


S26 = f"""{with_views("samples")} SELECT unit, row_index // {SIZE} AS w, CAST(count(*) AS INT) AS n, string_agg(coalesce(CAST(CAST(y AS INT) AS VARCHAR), '-'), ',' ORDER BY row_index) AS ys, CAST(count(*) - count(x) AS INT) AS gaps
FROM samples GROUP BY unit, row_index // {SIZE}"""


def s32_dropout_profile(spark, sf_dir):
    return views.samples(spark, sf_dir).groupBy(*KEYS).agg(F.count_if(F.col("x").isNull()).alias("x_missing"), F.count_if(F.col("y").isNull()).alias("y_missing"), F.count(F.lit(1)).alias("n"))


S32 = f"""{with_views("samples")} SELECT unit, file_seq, count(*) - count(x) AS x_missing, count(*) - count(y) AS y_missing, count(*) AS n FROM samples GROUP BY unit, file_seq"""


def s12_row_range(spark, sf_dir):
    return rounded(views.samples(spark, sf_dir).where("file_seq = 0 AND file_row BETWEEN 32 AND 95").select("unit", "file_row", "x", "y"))


S12 = f"""{with_views("samples")} SELECT unit, file_row, {r("x")} AS x, {r("y")} AS y FROM samples WHERE file_seq = 0 AND file_row BETWEEN 32 AND 95"""


def s25_strided_files(spark, sf_dir):
    return views.samples(spark, sf_dir).where("file_seq % 3 = 0").groupBy("unit").agg(F.count_distinct("file_seq").alias("files"), F.count(F.lit(1)).alias("n"))


S25 = f"""{with_views("samples")} SELECT unit, count(DISTINCT file_seq) AS files, count(*) AS n FROM samples WHERE file_seq % 3 = 0 GROUP BY unit"""


def l7_downsample(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    sizes = rows.groupBy("unit").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 200)).cast("long").alias("step"))
    return rounded(rows.join(sizes, "unit").where(F.col("row_index") % F.col("step") == 0).select("unit", "row_index", "x"))


L7 = f"""{with_views("samples")}, s AS (SELECT unit, greatest(1, count(*) // 200) AS step FROM samples GROUP BY unit) SELECT unit, row_index, {r("x")} AS x FROM samples JOIN s USING (unit) WHERE row_index % step = 0"""


def j1_nearest_within(spark, sf_dir):
    found = asof.nearest_within(views.reads(spark, sf_dir, "view"), views.reads(spark, sf_dir, "error"), "unit", "t", "t", "event_id", TOLERANCE)
    return found.select("event_id", "nearest_index", F.round(F.col("gap") + views.NUDGE, 3).alias("gap"))


J1 = f"""WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'), r AS (SELECT event_id AS ri, user_id, epoch_us(ts) / 1e6 AS rt FROM events WHERE event_type = 'error'),
m AS (SELECT l.event_id, ri, abs(t - rt) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(t - rt), ri) AS k FROM l LEFT JOIN r USING (user_id))
SELECT event_id, CASE WHEN gap <= {TOLERANCE} THEN ri END AS nearest_index, {r(f"CASE WHEN gap <= {TOLERANCE} THEN gap END", 3)} AS gap FROM m WHERE k = 1"""


def j2_first_row_lookup(spark, sf_dir):
    rows = asof.first_rows(views.samples(spark, sf_dir), KEYS, "file_row", "y", "first_y")
    return rows


J2 = f"""{with_views("samples")} SELECT unit, file_seq, y AS first_y FROM samples WHERE file_row = 0"""

QUERIES = {
    "w1_windows": (w1_windows, W1), "a01_a14_window_stats": (a01_a14_window_stats, A01), "w5_group_stats": (w5_group_stats, W5), "w2_w4_run_windows": (w2_w4_run_windows, W2),
    "a24_a27_temperature": (a24_a27_temperature, A24), "a15_a23_spectral_vectors": (a15_a23_spectral_vectors, A15), "a15_a23_spectral_windows": (a15_spectral_windows, A15W),
    "l8_spectrum_prefix": (l8_spectrum_prefix, L8), "s26_waveforms": (s26_waveforms, S26), "s32_dropout_profile": (s32_dropout_profile, S32), "s12_row_range": (s12_row_range, S12), "s25_strided_files": (s25_strided_files, S25),
    "l7_downsample": (l7_downsample, L7), "j1_nearest_within": (j1_nearest_within, J1), "j2_first_row_lookup": (j2_first_row_lookup, J2),
}
