"""Exact de-duplication by sorting content.

Rows are range-partitioned by the head of the normalised text and a hash of all of it, on
splitters that Spark samples. An external sort inside each range puts equal texts side by
side; every text is compared in full with its neighbour, and where they differ a new run
begins. A text that a bounded sample finds often gets a salt, so that it is dealt to many
ranges: the first rows of its runs, one for each salt, are put side by side in a second,
small sort and compared in the same way, which carries the survivor across splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table

HEAD = 32
SALTS = 256
#: About so many rows tell which texts are frequent; a text found so often among them is salted.
SAMPLE, OFTEN = 131_072, 16


def _best(name: str, keep: str) -> Column:
    return F.col(name).desc_nulls_last() if keep == "largest" else F.col(name).asc_nulls_last()


def _runs(rows: DataFrame, by: list[str], keep: str, size: Column, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds the number of the run of equal ``norm`` inside ``by``, the row's place in it, its best id and size."""
    order = Window.partitionBy(*by).orderBy("norm", _best("id", keep), *then)
    differs = ~F.col("norm").eqNullSafe(F.lag("norm").over(order))
    numbered = rows.withColumn("run", F.sum(F.when(differs, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "run")
    pick = F.max if keep == "largest" else F.min
    return numbered.withColumns({"nth": F.row_number().over(run.orderBy(_best("id", keep), *then)), "keep_id": pick("id").over(run), "size": F.sum(size).over(run)})


def _dealt(docs: DataFrame, id_col: str, text_col: str, normalise, salts: int, often: int) -> DataFrame:
    """``row, id, norm, head, code, salt`` in ranges of the last three; texts are normalised after the shuffle again."""
    norm = normalise(F.coalesce(F.col("row")[text_col], F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("code", F.xxhash64(norm))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    seen = rows.where(F.rand(5) < share).groupBy("code").count().where(F.col("count") >= often)
    salt = F.when(F.col("count").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col("row")[id_col], F.spark_partition_id()), F.lit(salts)))
    # The sample bounds the list of frequent texts, so it may go to every machine.
    salted = rows.join(F.broadcast(seen), "code", "left").select("row", F.substring(norm, 1, HEAD).alias("head"), "code", salt.cast("int").alias("salt"))
    return salted.repartitionByRange("head", "code", "salt").select("*", F.col("row")[id_col].alias("id"), norm.alias("norm"))


def _check(keep: str) -> None:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=lower_ascii,
    salts: int = SALTS,
    often: int = OFTEN,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the survivor of a group: the ``smallest`` or the ``largest`` id. A null
    text equals the empty text. A null id is kept only in a group without other ids. Rows
    that repeat an id with the same text all name it as their survivor, and the first
    among them alone is marked kept. Further columns of ``docs`` play no part; an empty
    table gives an empty result.
    """
    _check(keep)
    place = ["head", "code", "salt", "run"]
    dealt = _dealt(docs.select(id_col, text_col), id_col, text_col, normalise, salts, often).select("id", "norm", "head", "code", "salt")
    sha = F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")
    # Texts end here, but for the first rows of salted runs.
    carried = F.when((F.col("salt") > 0) & (F.col("nth") == 1), F.col("norm")).alias("norm")
    rows = materialise(_runs(dealt, place[:3], keep, F.lit(1)).select("id", *place, "nth", "keep_id", "size", sha, carried))
    alone = rows.where("salt = 0").select("id", "keep_id", F.col("size").alias("group_size"), (F.col("nth") == 1).alias("kept"), "text_sha256")
    firsts = rows.where("salt > 0 AND nth = 1").select("id", "norm", "head", "code", "salt", F.col("run").alias("own_run"), F.col("size").alias("own_size"))
    joined = _runs(firsts, ["head", "code"], keep, F.col("own_size"), ("salt", "own_run"))
    groups = joined.select("head", "code", "salt", F.col("own_run").alias("run"), F.col("keep_id").alias("g_keep"), F.col("size").alias("g_size"), (F.col("nth") == 1).alias("g_first"))
    split = rows.where("salt > 0").join(groups, place)
    return alone.union(split.select("id", "g_keep", "g_size", F.col("g_first") & (F.col("nth") == 1), "text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", salts: int = SALTS, often: int = OFTEN) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; all columns stay.

    Rows that repeat both id and text collapse to one. Rows without an id are told apart by
    nothing but their text, and one stays where the text has no row with an id.
    """
    _check(keep)
    numbered = _runs(_dealt(docs, id_col, text_col, lower_ascii, salts, often), ["head", "code", "salt"], keep, F.lit(1)).where("nth = 1")
    firsts = materialise(numbered.select("row", "id", "head", "code", "salt", F.when(F.col("salt") > 0, F.col("norm")).alias("norm")))
    split = _runs(firsts.where("salt > 0"), ["head", "code"], keep, F.lit(1), ("salt",)).where("nth = 1")
    return firsts.where("salt = 0").select("row").union(split.select("row")).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
