"""Stored paths resolved against known files, by an index of the files' ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import posix_path
from ..tables import materialise

DEPTH = 4


def _segments(path: Column) -> Column:
    return F.filter(F.split(posix_path(path), "/"), lambda s: s != "")


def _ends(rows: DataFrame, segments: str, k: int) -> DataFrame:
    """Rows of ``k`` segments or more, with their last ``k`` as ``tail``."""
    return rows.where(F.size(segments) >= k).withColumn("tail", F.array_join(F.slice(segments, -k, k), "/"))


def _profiles(rows: DataFrame, marks: DataFrame, item: str) -> DataFrame:
    """``tail, item, profile``: which of a tail's marks each item holds; those it shares with nobody play no part."""
    held = rows.select("tail", item, F.explode("segments").alias("mark")).join(marks, ["tail", "mark"])
    found = held.groupBy("tail", item).agg(F.array_sort(F.collect_list("mark")).alias("profile"))
    return rows.select("tail", item).join(found, ["tail", item], "left").withColumn("profile", F.coalesce("profile", F.array().cast("array<string>")))


def _most_in_common(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``path, found``: of the files with a path's tail, the one with most segments in common; null for a tie.

    ``asked`` has ``tail, path, segments`` and ``known`` ``tail, file, segments``. Segments that
    all files of a tail have, or no path, tell nothing. By the others files fall into a few
    kinds, and so do paths; kinds are compared, never a path with each file of its name.
    """
    files_of = known.groupBy("tail").agg(F.count(F.lit(1)).alias("all"))
    there = known.select("tail", F.explode("segments").alias("mark")).groupBy("tail", "mark").agg(F.count(F.lit(1)).alias("n")).join(files_of, "tail").where("n < all")
    named = asked.select("tail", F.explode("segments").alias("mark")).distinct()
    marks = materialise(there.select("tail", "mark").join(named, ["tail", "mark"]))
    kinds = _profiles(known, marks, "file").groupBy("tail", F.col("profile").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    kinds = materialise(kinds)
    paths = materialise(_profiles(asked, marks, "path"))
    wanted = paths.select("tail", "profile").distinct()
    shared = wanted.withColumn("mark", F.explode("profile")).join(kinds.withColumn("mark", F.explode("kind")), ["tail", "mark"])
    met = shared.groupBy("tail", "profile", "kind", "n", "file").agg(F.count(F.lit(1)).alias("common"))
    best = met.withColumn("r", F.rank().over(Window.partitionBy("tail", "profile").orderBy(F.desc("common")))).where("r = 1")
    # Files of several kinds, or several of one kind, are a tie; so are all where nothing is in common.
    single = best.groupBy("tail", "profile").agg(F.sum("n").alias("n"), F.min("file").alias("file")).where("n = 1")
    return paths.join(single.select("tail", "profile", "file"), ["tail", "profile"], "left").select("path", F.col("file").alias("found"))


def resolve(stored: DataFrame, files: DataFrame, path: str = "path", file: str = "file", depth: int = DEPTH) -> DataFrame:
    """``stored`` with ``resolved``: the known file that shares the longest end with each path.

    Ends of four segments down to one are looked up in an index of the files' ends, longest
    first; only paths without a match go on to the next. Of files with equally long ends the
    one with most segments in common wins; a tie leaves the path as it is, as does no match.
    """
    left = materialise(stored.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct().withColumn("segments", F.array_distinct(_segments(F.col("path")))).withColumn("s", _segments(F.col("path"))))
    known = materialise(files.select(F.col(file).alias("file")).where("file IS NOT NULL").distinct().withColumn("s", _segments(F.col("file"))).withColumn("segments", F.array_distinct("s")))
    levels = [_ends(known, "s", k).withColumn("tail", F.concat(F.lit(f"{k}:"), "tail")) for k in range(depth, 0, -1)]
    met = None
    for k, ends in zip(range(depth, 0, -1), levels, strict=True):
        index = ends.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("one"))
        # An end stands once in the index, so no path is multiplied.
        asked = materialise(_ends(left, "s", k).withColumn("tail", F.concat(F.lit(f"{k}:"), "tail")).join(index, "tail", "left"))
        short = left.where(F.size("s") < k)
        left = asked.where("n IS NULL").select("path", "segments", "s").union(short.select("path", "segments", "s"))
        met = asked.where("n > 0") if met is None else met.union(asked.where("n > 0"))
    several = met.where("n > 1").select("tail", "path", "segments")
    every = reduce(DataFrame.union, [x.select("tail", "file", "segments") for x in levels])
    compared = _most_in_common(several, every.join(several.select("tail").distinct(), "tail", "left_semi"))
    found = met.where("n = 1").select("path", F.col("one").alias("found")).union(compared)
    chosen = found.where("found IS NOT NULL").select(F.col("path").alias("__path"), F.col("found").alias("__file"))
    return stored.join(chosen, F.col(path) == F.col("__path"), "left").withColumn("resolved", F.coalesce("__file", path)).drop("__path", "__file")
