"""The catalogue: feature batches, their lineage and the choice among them."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import number_rows

TABLES = {
    "schema_version": "version string",
    "datasets": "dataset_id string",
    "bearing_runs": "bearing_run_id string, dataset_id string, role string",
    "feature_batches": "batch_id string, dataset_id string, path string, n_rows long, sha256 string, code_version string, created_at timestamp",
    "acquisitions": "acquisition_id string, bearing_run_id string, role string, sequence_index int, event_timestamp timestamp, sample_rate_hz double, n_samples long, row_start long, row_end long, source_file_path string, source_sha256 string, schema_version string, temp_available boolean, kind string, batch_id string, feature_row_index long",
}
LINEAGE = ("acquisition_id", "bearing_run_id", "role", "sequence_index", "event_timestamp", "sample_rate_hz", "n_samples", "row_start", "row_end", "source_file_path", "source_sha256", "schema_version", "temp_available")


#: Tables in which a key stands once, whoever writes it.
UNIQUE = {"schema_version": ["version"], "datasets": ["dataset_id"], "bearing_runs": ["bearing_run_id", "role"]}
#: Tries to commit beside other writers before giving up.
TRIES = 20


class Catalog:
    """Parquet tables under one folder, changed by commits.

    A commit writes folders of new rows and then one numbered file that names them all. Readers
    look at the folders that commits name, so they see all of a commit or nothing, and what a
    failed writer left behind is never read. A number is taken once: of two writers the second
    finds it taken, looks again at what is there, and tries the next. That keeps keys unique.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _jvm_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commits(self) -> list[tuple[int, dict[str, str]]]:
        """Number and folders of each commit: a short line for each, however many rows it has."""
        log = self._jvm_path(f"{self.root}/catalog/commits")
        store = log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(log) or not len(store.listStatus(log)):
            return []
        lines = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.root}/catalog/commits").select("value", F.col("_metadata.file_name").alias("name")).collect()
        return sorted((int(r["name"].removesuffix(".json")), json.loads(r["value"])) for r in lines)

    def _take(self, number: int, folders: dict[str, str]) -> bool:
        """Make commit ``number`` appear at once and whole; False if another writer has it.

        The file is written aside and renamed without overwriting, which file systems of
        clusters do in one step.
        """
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        to, aside = self._jvm_path(f"{self.root}/catalog/commits/{number:012d}.json"), self._jvm_path(f"{self.root}/catalog/aside/{uuid.uuid4().hex}")
        store = to.getFileSystem(conf)
        store.mkdirs(to.getParent())
        out = store.create(aside, False)
        out.write(json.dumps(folders).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(aside, to, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            store.delete(aside, False)
            return False
        return True

    def commit(self, rows: dict[str, DataFrame]) -> None:
        """Append rows to several tables at once; keys that a table of ``UNIQUE`` holds already are left out."""
        written: dict[str, str] = {}
        for name, part in rows.items():
            if name not in UNIQUE:
                written[name] = self._write(name, part)
        for _ in range(TRIES):
            before = self._commits()
            new = {}
            for name, part in rows.items():
                if name in UNIQUE:
                    missing = absent(part, self._read(name, before), UNIQUE[name])
                    if not missing.isEmpty():
                        new[name] = self._write(name, missing)
            if not written and not new:
                return
            if self._take(before[-1][0] + 1 if before else 1, written | new):
                return
        raise RuntimeError(f"another writer was faster {TRIES} times")

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"catalog/{name}/{uuid.uuid4().hex}"
        kinds = T.StructType.fromDDL(TABLES[name])
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(f"{self.root}/{folder}")
        return folder

    def _read(self, name: str, commits: list[tuple[int, dict[str, str]]]) -> DataFrame:
        folders = [f"{self.root}/{folders[name]}" for _, folders in commits if name in folders]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def create(self, version: str = "v1") -> Catalog:
        self.commit({"schema_version": self.spark.createDataFrame([(version,)], TABLES["schema_version"])})
        return self

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._commits())

    def insert_absent(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys the table doesn't hold yet; those it holds are never changed."""
        self.commit({name: rows})

    def ensure_dataset(self, dataset: str) -> None:
        self.insert_absent("datasets", self.spark.createDataFrame([(dataset,)], TABLES["datasets"]))

    def ensure_run(self, run: str, dataset: str, role: str) -> None:
        self.insert_absent("bearing_runs", self.spark.createDataFrame([(run, dataset, role)], TABLES["bearing_runs"]))

    def write_batch(self, rows: DataFrame, dataset: str, code_version: str = "", empty_ok: bool = False) -> str | None:
        """Write an immutable batch, its lineage and its runs; returns its id.

        The plan of ``rows`` runs once: everything else is taken from what was written, and one
        commit shows it all. An empty batch raises, or gives None with ``empty_ok``.
        """
        batch = uuid.uuid4().hex
        path = f"{self.root}/batches/{batch}"
        rows.write.partitionBy("dataset_id", "role").parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        if kept.isEmpty():
            place = self._jvm_path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            if empty_ok:
                return None
            raise ValueError("an empty batch is not written")
        digest = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("h"))
        whole = digest.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("sha256"))
        n = kept.agg(F.count(F.lit(1)).alias("n_rows"))
        named = {"batch_id": F.lit(batch), "dataset_id": F.lit(dataset), "path": F.lit(path), "code_version": F.lit(code_version), "created_at": F.current_timestamp()}
        runs = kept.select("bearing_run_id", F.lit(dataset).alias("dataset_id"), "role").distinct()
        self.commit({"feature_batches": n.crossJoin(whole).withColumns(named), "acquisitions": lineage(kept, batch), "bearing_runs": runs})
        return batch

    def latest_batch(self, dataset: str, role: str) -> str | None:
        """Path of the newest batch of a data set whose rows hold the role; None if none does."""
        batches = self.table("feature_batches").where(F.col("dataset_id") == dataset)
        held = batches.drop("role").join(self.roles_of_batches(), "batch_id")
        newest = latest_by_role(held).where(F.col("role") == role).select("batch_id")
        found = batches.join(newest, "batch_id", "left_semi").select("path").take(1)
        return found[0]["path"] if found else None

    def roles_of_batches(self) -> DataFrame:
        """``batch_id, role`` of all batches that can be read: one plan that opens footers alone.

        Both stand in the files' places; a missing or broken file gives no row.
        """
        reader = self.spark.read.schema("acquisition_id string").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        try:
            places = reader.parquet(f"{self.root}/batches").select(F.col("_metadata.file_path").alias("place"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch_id string, role string")
        role = F.url_decode(F.regexp_extract("place", "/role=([^/]+)/", 1))
        found = places.select(F.regexp_extract("place", "/batches/([^/]+)/", 1).alias("batch_id"), role.alias("role"))
        return found.where("role NOT IN ('', '__HIVE_DEFAULT_PARTITION__')").distinct()

    def list_batches(self) -> list[tuple[str, str]]:
        """``path, roles`` newest first; ``unreadable`` where a batch can't be read."""
        roles = self.roles_of_batches().groupBy("batch_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"))
        listed = self.table("feature_batches").join(roles, "batch_id", "left").orderBy(F.desc("created_at"), F.desc("batch_id"))
        return [(r["path"], r["roles"]) for r in listed.select("path", F.coalesce("roles", F.lit("unreadable")).alias("roles")).toLocalIterator()]


def absent(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def batch_roles(spark: SparkSession, path: str) -> set[str]:
    """Distinct roles of a batch, from that one column."""
    return {r["role"] for r in spark.read.parquet(path).select("role").where("role IS NOT NULL").distinct().collect()}


def kind_of(dataset: Column) -> Column:
    return F.when(dataset == "college", "college_window").otherwise("femto_acquisition")


def lineage(rows: DataFrame, batch: str) -> DataFrame:
    """Contract columns of a batch with kind, batch id and row number from 0 in unit order."""
    placed = number_rows(rows, [], ["bearing_run_id", "role"], ["sequence_index"], "feature_row_index")
    return placed.select(*LINEAGE, kind_of(F.col("dataset_id")).alias("kind"), F.lit(batch).alias("batch_id"), "feature_row_index")


def latest_by_role(batches: DataFrame) -> DataFrame:
    """``dataset_id, role, batch_id``: newest batch that holds each role; of equal times the highest id."""
    return batches.where("role IS NOT NULL").groupBy("dataset_id", "role").agg(F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("batch_id"))


def preferred(batches: DataFrame, role: str) -> DataFrame:
    """By data set, the newest batch with the preferred role, else the newest."""
    rank = F.struct((F.coalesce(F.col("role"), F.lit("")) == role).alias("has"), "created_at", "batch_id")
    return batches.groupBy("dataset_id").agg(F.max_by("batch_id", rank).alias("batch_id"))


def roles_listing(batches: DataFrame, by: str) -> DataFrame:
    return batches.groupBy(by).agg(F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"), F.count(F.lit(1)).alias("n"))


def same_roles(batches: DataFrame, expected: list[str]) -> DataFrame:
    """By data set: roles missing from and in excess of those expected, and whether the sets are equal."""
    want = F.array_sort(F.array(*[F.lit(x) for x in expected]))
    have = batches.groupBy("dataset_id").agg(F.array_sort(F.collect_set("role")).alias("have"))
    return have.select("dataset_id", F.array_join(F.array_sort(F.array_except(want, "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("have", want)), ",").alias("extra"), (F.col("have") == want).alias("equal"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line a row; the tables are small."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """A report of several small tables, each under its name."""
    for name, rows in tables.items():
        write_metrics(rows, f"{path}/{name}")


def read_document(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a report that are there."""
    found = {name: read_metrics(spark, f"{path}/{name}") for name in names}
    return {name: rows for name, rows in found.items() if rows is not None}


def write_predictions(parts: dict[str, DataFrame], path: str) -> None:
    """Held-out predictions of several data sets as one Parquet table with their ``dataset_id``."""
    out = None
    for dataset, rows in sorted(parts.items()):
        named = rows.withColumn("dataset_id", F.lit(dataset))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("there are no predictions to write")
    out.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    return _optional(lambda: spark.read.parquet(path))


def _optional(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The document, or None where there is none."""
    return _optional(lambda: spark.read.option("multiLine", False).json(path))


def selected_model(metrics: DataFrame | None, default: str = "forest") -> str:
    """The model with the least mean error, or the default without metrics."""
    if metrics is None:
        return default
    best = metrics.agg(F.min_by("model", F.struct("mean_mae", "model")).alias("m")).first()["m"]
    return best or default
