"""Readers of raw files: acquisitions, temperatures and long log files.

Files are found with Spark's own listing and read with fixed schemas. Row numbers are rebuilt
from the place of each block in its file, so no file is read by one task alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import nan_to_null, seconds_of_day
from ..tables import materialise, sized

ACC = ("hour", "minute", "second", "microsecond", "accel_horizontal", "accel_vertical")
TEMP = ("hour", "minute", "second", "col4_raw", "temperature_c")
LOG = ("vibration_x", "vibration_y", "bearing_temp_c", "ambient_temp_c")
UNIT_PATTERN = r"/Bearing(\d+)_(\d+)/"
#: Name patterns of the files in a unit's folder, letter case ignored.
ACC_FILES, TEMP_FILES = "[aA][cC][cC]_*.[cC][sS][vV]", "[tT][eE][mM][pP]_*.[cC][sS][vV]"
LOG_FILES = "LogFile_*.csv"


def _schema(names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path``: files under ``root`` whose names match, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def discover_units(spark: SparkSession, root: str, role: str) -> DataFrame:
    """``bearing_label, condition_id, role``: unit folders ``BearingC_N`` that hold files; raises where none is."""
    c, n = F.regexp_extract("path", UNIT_PATTERN, 1), F.regexp_extract("path", UNIT_PATTERN, 2)
    units = list_files(spark, root).where(c != "").select(F.concat(F.lit("Bearing"), c, F.lit("_"), n).alias("bearing_label"), c.cast("int").alias("condition_id"), F.lit(role).alias("role")).distinct()
    if not units.take(1):
        raise FileNotFoundError(f"no unit folders under {root}")
    return units.orderBy("bearing_label")


def file_indices(files: DataFrame, prefix: str) -> DataFrame:
    """``bearing_label, file_index, path`` of ``prefix_NNNNN.csv``, letter case ignored."""
    index = F.regexp_extract("path", rf"(?i)/{prefix}_(\d+)\.csv$", 1)
    label = F.regexp_extract("path", r"/(Bearing\d+_\d+)/", 1)
    return files.where(index != "").select(label.alias("bearing_label"), index.cast("int").alias("file_index"), "path")


def file_counts(files: DataFrame) -> DataFrame:
    """Acquisition and temperature files of each unit, side by side."""
    kinds = file_indices(files, "acc").withColumn("kind", F.lit("acc")).unionByName(file_indices(files, "temp").withColumn("kind", F.lit("temp")))
    return kinds.groupBy("bearing_label").pivot("kind", ["acc", "temp"]).agg(F.count(F.lit(1))).na.fill(0)


def _scan(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """``value, path, __block, __scan``: lines with their block and a number that grows along the scan."""
    reader = spark.read if pattern is None else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__scan"))


def with_row_index(scanned: DataFrame, scan: str = "__scan", path: str = "path", block: str = "__block") -> DataFrame:
    """Adds ``row_index``, from 0 in file order.

    ``scan`` is monotonically_increasing_id() taken at the scan; within a block it grows by
    one a row, so a block's rows are numbered from its smallest and blocks by running counts.
    The rows are written once, so that files are scanned once; the counts come from the
    written columns and go to every machine (a row for each block, counted first), so rows
    are not shuffled.
    """
    written = materialise(scanned)
    blocks = written.groupBy(path, block).agg(F.min(scan).alias("__low"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(blocks.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).select(path, block, "__low", "__offset"))
    return written.join(sized(offsets), [path, block]).withColumn("row_index", F.col("__offset") + F.col(scan) - F.col("__low")).drop("__low", "__offset", scan, block)


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """``value, path, row_index``: lines of text files with their places.

    With a ``pattern``, of all files below ``paths`` whose names match.
    """
    return with_row_index(_scan(spark, paths, pattern))


def first_lines(lines: DataFrame) -> DataFrame:
    return lines.where("row_index = 0").select("path", F.col("value").alias("first_line"))


def delimiter_of(line: Column) -> Column:
    """``;`` where it is more frequent than ``,``; else ``,`` if there is one; else an error."""
    semicolons, commas = F.regexp_count(line, F.lit(";")), F.regexp_count(line, F.lit(","))
    return F.when(semicolons > commas, ";").when(commas > 0, ",").otherwise(F.raise_error(F.concat(F.lit("no delimiter in: "), line)).cast("string"))


def is_header(line: Column, width: int = len(LOG)) -> Column:
    """True unless the line is exactly ``width`` numbers."""
    parts = F.split(line, ",")
    return (F.size(parts) != width) | F.exists(parts, lambda p: F.trim(p).try_cast("double").isNull())


def _parse(lines: DataFrame, names: tuple[str, ...], delimiter: Column, keep_nan: bool) -> DataFrame:
    """Columns of numbers; a line of another width or with anything else in it raises."""
    parts = F.transform(F.split("value", delimiter), lambda p: F.trim(p).try_cast("double"))
    wrong = (F.size("__parts") != len(names)) | F.exists("__parts", lambda p: p.isNull() if keep_nan else p.isNull() | F.isnan(p))
    bad = F.raise_error(F.concat(F.lit("malformed row in "), F.col("path"), F.lit(": "), F.col("value")))
    checked = lines.withColumn("__parts", parts).withColumn("__parts", F.when(wrong, bad.cast("array<double>")).otherwise(F.col("__parts")))
    value = (lambda k: nan_to_null(F.col("__parts")[k])) if keep_nan else (lambda k: F.col("__parts")[k])
    rest = [c for c in ("row_index", "__block", "__scan") if c in lines.columns]
    return checked.select("path", *rest, *[value(k).alias(n) for k, n in enumerate(names)])


def read_acceleration(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Six numbers a row; a missing or NaN value raises and names the file."""
    return with_row_index(_parse(_scan(spark, paths, pattern), ACC, F.lit(","), keep_nan=False))


def read_temperature(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Five numbers a row, with the delimiter each file's first line shows."""
    lines = read_lines(spark, paths, pattern)
    kinds = materialise(first_lines(lines).select("path", delimiter_of(F.col("first_line")).alias("__delimiter")))
    return _parse(lines.join(sized(kinds), "path"), TEMP, F.col("__delimiter"), keep_nan=False)


def read_logs(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Four numbers a row, header dropped where there is one; NaN becomes null, and rows are numbered without the header."""
    lines = read_lines(spark, paths, pattern)
    headed = materialise(first_lines(lines).select("path", is_header(F.col("first_line")).alias("__headed")))
    body = lines.join(sized(headed), "path").where(~F.col("__headed") | (F.col("row_index") > 0)).withColumn("row_index", F.col("row_index") - F.col("__headed").cast("int"))
    return _parse(body, LOG, F.lit(","), keep_nan=True)


def log_time(path: Column) -> Column:
    """Time in a name ``LogFile_YYYY-MM-DD-HH-MM-SS.csv``; any other name raises."""
    text = F.regexp_extract(path, r"(?:^|/)LogFile_(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})\.csv$", 1)
    bad = F.raise_error(F.concat(F.lit("not a log file name: "), path)).cast("string")
    return F.to_timestamp_ntz(F.when(text == "", bad).otherwise(text), F.lit("yyyy-MM-dd-HH-mm-ss"))


def discover_logs(spark: SparkSession, root: str) -> DataFrame:
    """``path, event_timestamp, file_seq`` in time order, from 0; raises where there is none."""
    files = list_files(spark, root, LOG_FILES).select("path", log_time(F.col("path")).alias("event_timestamp"))
    # Every name is looked at, so a wrong one raises here.
    if files.agg(F.max("event_timestamp")).first()[0] is None:
        raise FileNotFoundError(f"no log files under {root}")
    return files.withColumn("file_seq", F.row_number().over(Window.orderBy("event_timestamp", "path")) - 1)


def every_kth(files: DataFrame, k: int) -> DataFrame:
    return files.where(F.col("file_seq") % k == 0)


def first_row_seconds(rows: DataFrame) -> DataFrame:
    """``path, seconds``: second of the day of each file's first row."""
    return rows.groupBy("path").agg(F.min_by(seconds_of_day(F.col("hour"), F.col("minute"), F.col("second")), "row_index").alias("seconds"))


def time_of_day(hour: Column, minute: Column, second: Column) -> Column:
    """A time stamp on the placeholder day 1900-01-01; fractions are left out."""
    day = F.lit(-2208988800)
    return F.timestamp_seconds(day + seconds_of_day(hour, minute, second).cast("long"))


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, sha256`` of each file's content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def dropout_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells of each column by file."""
    return rows.groupBy("path").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count(F.lit(1)).alias("rows"))
