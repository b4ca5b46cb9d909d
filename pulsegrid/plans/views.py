"""Condition-monitoring views over the given tables, in DataFrame form and as SQL.

``samples``: events as raw signals, one unit for each event type, in files of 512 rows.
``acq``: line items as acquisitions of one machine for each supplier, with growing damage.
``reads`` and ``temps``: two kinds of events as the two sides of a nearest-time join.
``batches``: orders as feature batches. ``paths``: page addresses as stored paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

FILE_ROWS, SIZE, OVERLAP, RATE = 512, 64, 0.5, 64.0
STEP = 32
DAY0 = -2208988800  # 1900-01-01 in seconds
#: Groups of machines that are left out in turn.
GROUPS = 6
#: Added before rounding, so that sums whose last bits differ don't fall on both sides of a tie.
NUDGE = 1.7e-6


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def r(expression: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + {NUDGE}::DOUBLE, {digits})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    # Numbered by day, so that no kind of event is sorted by one task.
    rows = number_rows(e, ["event_type"], [F.to_date("ts")], ["ts", "event_id"])
    return rows.select(
        F.col("event_type").alias("unit"), "row_index", F.floor(F.col("row_index") / FILE_ROWS).cast("long").alias("file_seq"), (F.col("row_index") % FILE_ROWS).alias("file_row"),
        F.when(F.col("event_id") % 97 != 0, F.col("value").cast("double")).alias("x"), F.get_json_object("props", "$.k").try_cast("double").alias("y"),
    )


def acq(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    unit = Window.partitionBy("l_suppkey")
    seq = F.row_number().over(unit.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    rows = li.withColumn("sequence_index", seq.cast("int")).withColumn("n", F.count(F.lit(1)).over(unit))
    life = F.col("sequence_index") / F.greatest(F.col("n") - 1, F.lit(1))
    rows = rows.withColumn("f", 1 + 3 * F.pow(F.greatest(F.lit(0.0), (life - 0.6) / 0.4), 2))
    q, p, d, t, f = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "f"))
    k = F.col("l_suppkey") % 5
    role = F.when(k < 3, "learning").when(k == 3, "test_censored").otherwise("full_test")
    group = F.floor(F.col("l_suppkey") / 5).cast("int")
    return rows.select(
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("bearing_run_id"),
        F.concat(F.lit("Bearing"), (1 + group % 3).cast("string"), F.lit("_"), group.cast("string")).alias("label"),
        F.concat(F.lit("g"), (group % GROUPS).cast("string")).alias("grp"), role.alias("role"), "sequence_index", F.timestamp_seconds(F.lit(DAY0) + 10 * F.col("sequence_index")).alias("event_timestamp"),
        F.when(role == "learning", 10.0 * (F.col("n") - 1 - F.col("sequence_index"))).alias("rul_seconds"),
        (q * f).alias("vibration_x_rms"), (p * f / 1000).alias("vibration_y_rms"), ((q + 100 * t) * f).alias("vibration_x_peak_to_peak"), ((p / 1000 + 100 * d) * f).alias("vibration_y_peak_to_peak"),
        (100 * d * f).alias("vibration_x_kurtosis"), (100 * t * f).alias("vibration_y_kurtosis"), ((1 + d) * f).alias("vibration_x_crest_factor"),
        F.when(F.col("sequence_index") % 53 != 7, (1 + t) * f).alias("vibration_y_crest_factor"),
    )


def reads(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(F.col("o_orderkey").alias("batch_id"), F.col("c_mktsegment").alias("dataset_id"), F.col("o_orderstatus").alias("role"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).cast("long").alias("created_at"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\data\\"), F.translate("url", "/", "\\"))).otherwise(F.concat(F.lit("/srv/data/"), F.col("url"))).alias("path"))


SQL = {
    "samples": f"""samples AS (SELECT unit, row_index, row_index // {FILE_ROWS} AS file_seq, row_index % {FILE_ROWS} AS file_row, x, y FROM (
        SELECT event_type AS unit, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index,
        CASE WHEN event_id % 97 <> 0 THEN value END AS x, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS y FROM events))""",
    "win": f"""win AS (SELECT unit, file_seq, w, file_row, file_row - w * {STEP} AS k, x, y FROM (
        SELECT *, unnest(range(greatest(0, (file_row - {SIZE - STEP}) // {STEP}), file_row // {STEP} + 1)) AS w FROM samples))""",
    "acq": f"""acq_o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sequence_index, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
      acq_f AS (SELECT *, 1 + 3 * power(greatest(0.0::DOUBLE, (sequence_index::DOUBLE / greatest(n - 1, 1) - 0.6::DOUBLE) / 0.4::DOUBLE), 2) AS f, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t,
        CASE WHEN l_suppkey % 5 < 3 THEN 'learning' WHEN l_suppkey % 5 = 3 THEN 'test_censored' ELSE 'full_test' END AS role FROM acq_o),
      acq AS (SELECT 'u' || l_suppkey AS bearing_run_id, l_suppkey, 'Bearing' || (1 + (l_suppkey // 5) % 3) || '_' || (l_suppkey // 5) AS label, 'g' || (l_suppkey // 5) % {GROUPS} AS grp, role, sequence_index, 10.0::DOUBLE * sequence_index AS ts,
        CASE WHEN role = 'learning' THEN 10.0::DOUBLE * (n - 1 - sequence_index) END AS rul_seconds, n,
        q * f AS vibration_x_rms, p * f / 1000 AS vibration_y_rms, (q + 100 * t) * f AS vibration_x_peak_to_peak, (p / 1000 + 100 * d) * f AS vibration_y_peak_to_peak,
        100 * d * f AS vibration_x_kurtosis, 100 * t * f AS vibration_y_kurtosis, (1 + d) * f AS vibration_x_crest_factor, CASE WHEN sequence_index % 53 <> 7 THEN (1 + t) * f END AS vibration_y_crest_factor FROM acq_f)""",
    "learn": "learn AS (SELECT * FROM acq WHERE role = 'learning')",
    "batches": """batches AS (SELECT o_orderkey AS batch_id, c_mktsegment AS dataset_id, o_orderstatus AS role, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "paths": r"""paths AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'C:\data\' || replace(url, '/', '\') ELSE '/srv/data/' || url END AS path FROM pages)""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they need."""
    needs = {"win": ["samples"], "learn": ["acq"]}
    order: list[str] = []
    for n in names:
        for m in [*needs.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "WITH " + ",\n".join(SQL[n] for n in order)
