"""Spans of pattern matches in whole texts, with code-point positions, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: What grows by appending is built in pieces of so many: no array is copied once for each of its elements.
PIECE = 256


def pieces(items: Column, size: int = PIECE) -> Column:
    """An array cut into arrays of at most ``size``; one empty piece for an empty array."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, F.lit(size)))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a one-element array binds it to a name."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: an array of ``start, end, value``, end exclusive.

    What lies between the matches (a split) and the matches themselves add up to positions,
    first inside pieces of the matches, then over the pieces. ``gate`` is a cheap condition
    without which there can be no match.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(values)), values, lambda gap, v: F.struct(gap.alias("gap"), v.alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(acc: Column, step: Column) -> Column:
        start = acc["at"] + step["gap"]
        end = start + F.length(step["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value")))).alias("found"))

    def shifted(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, by: F.transform(p["found"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))))

    placed = once(steps, lambda s: F.transform(pieces(s), lambda piece: F.aggregate(piece, zero, add)))
    if gate is None:
        gate = text.rlike(pattern)
    return F.when(gate, once(placed, shifted)).otherwise(F.array().cast(SPAN))


def named(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the order of kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in the order of kinds, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(span: Column, in_order: Column) -> Column:
    """Whether a span overlaps one of ``in_order``: a column of spans that don't overlap each other, by start.

    Of those that start before the span ends the last one reaches furthest; a search by halves finds it.
    """
    n = F.size(in_order)
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)
    zero = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        before = F.get(in_order, mid)["start"] < span["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & before, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, mid).otherwise(acc["high"]).alias("high"))

    return F.aggregate(rounds, zero, halve, lambda acc: (acc["low"] > 0) & (F.get(in_order, acc["low"] - 1)["end"] > span["start"]))
