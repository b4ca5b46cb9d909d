"""Secret scans: fixed formats, and random strings found by two character Markov models.

One model is trained on labelled random strings, one on ordinary identifiers. Random strings
are made by rule (base64, letters and digits, one case or both), as no corpus holds labels;
ordinary ones are identifiers joined from words of the corpus and, made by rule, what people
also write with digits: dates, times, versions, UUIDs, numbered names, filler. A candidate is
a long run of token characters; where the mean log-likelihood ratio of its character pairs
passes a limit set on held-out samples, it is a secret. All of it is built from DataFrame
functions; the samples are bounded, the scan is not.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import some_rows, table
from .spans import joined, matches, named, overlaps

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Numbers alone are left to the scan for personal data.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
#: Characters with a state of their own; all others share state 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_/+="
STATES = len(ALPHABET) + 1
#: Documents that identifiers are joined from, identifiers taken of them, and strings made of either class, about.
SAMPLE_DOCS, SAMPLE_STRINGS, MADE = 2_000, 20_000, 6_000
#: Shortest candidate.
LEAST = 16
#: Words of made identifiers.
NAMES = (
    "backup", "build", "class", "client", "config", "data", "default", "error", "example", "export", "factory", "file", "handler", "index",
    "job", "log", "manager", "model", "module", "node", "number", "object", "order", "page", "process", "record", "release", "report",
    "request", "response", "run", "server", "service", "session", "snapshot", "source", "system", "table", "test", "user", "value", "version",
)
#: Share of held-out ordinary identifiers that may pass for random.
FALSE_ALARMS = 0.0005
#: Weight of single characters in the chance of a pair, in pairs seen.
BACKOFF = 4.0


@dataclass(frozen=True)
class MarkovModel:
    """``ratios``: log-likelihood ratio of each character pair, row by row; ``limit``: of the mean."""

    ratios: tuple[float, ...]
    limit: float


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of ``start, end, value`` of the fixed formats, by kind."""
    assign = matches(text, ASSIGN, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6),
        "access": F.filter(access, lambda s: F.length(s["value"]) >= 20),
        "hex": matches(text, HEX),
    }


def _pairs(value: Column) -> Column:
    """States of adjacent characters, as one number for each pair."""

    def state(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))

    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: state(i) * STATES + state(i + 1))


def mean_ratio(value: Column, ratios: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio, random against ordinary, of a string of two characters or more."""
    table_ = F.from_json(F.lit(str(list(ratios))), "array<double>")
    total = F.aggregate(_pairs(value), F.lit(0.0), lambda acc, p: acc + F.element_at(table_, p + 1))
    return total / F.greatest(F.length(value) - 1, F.lit(1))


def _pick(code: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(code, F.lit(len(values))).cast("int") + 1)


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """``v``: random strings of 16 to 40 characters, in four alphabets by turns."""
    code = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 512)
    full = F.rtrim(F.base64(F.unhex(code)), F.lit("="))
    mixed = F.translate(full, "+/", "")
    kinds = F.array(full, mixed, F.upper(mixed), F.lower(mixed))
    size = LEAST + F.pmod(F.xxhash64("id"), F.lit(25)).cast("int")
    return spark.range(n).select(F.substring(F.element_at(kinds, F.pmod("id", F.lit(4)).cast("int") + 1), F.lit(1), size).alias("v"))


def ordinary_strings(spark: SparkSession, n: int) -> DataFrame:
    """``v``: identifiers with digits that are no secrets, in ten forms by turns."""
    hexes = F.sha2(F.concat(F.lit("ordinary "), F.col("id").cast("string")), 256)
    uuid = F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    at = F.timestamp_seconds(F.lit(946_684_800) + F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)))
    a, b, c = (_pick(F.xxhash64("id", F.lit(k)), NAMES) for k in (1, 2, 3))
    few = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(100)).cast("string")
    mark = _pick(F.xxhash64("id", F.lit(5)), tuple("xaX-_=0*"))
    forms = F.array(
        uuid, F.upper(uuid),
        F.concat_ws("-", F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'"), a),
        F.concat_ws("_", a, F.date_format(at, "yyyyMMdd_HHmmss")),
        F.concat_ws("-", a, b, F.concat(F.lit("v"), few), few, F.date_format(at, "yyyy-MM-dd")),
        F.concat(a, F.initcap(b), F.initcap(c), few),
        F.concat_ws("/", a, b, F.concat(F.initcap(c), F.initcap(a))),
        F.concat_ws("_", F.upper(a), F.upper(b), F.upper(c), few),
        F.concat(a, F.repeat(mark, 12 + few.cast("int") % 20), a),
        F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), few),
    )
    return spark.range(n).select(F.element_at(forms, F.pmod("id", F.lit(10)).cast("int") + 1).alias("v"))


def corpus_identifiers(docs: DataFrame, text_col: str) -> DataFrame:
    """``v``: identifiers joined from neighbouring words of the texts, one in seven places."""
    words = docs.select(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[A-Za-z]{2,40}"), F.lit(0)).alias("w")).where("size(w) > 2")
    triples = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(7)), lambda i: F.struct(F.col("w")[i].alias("a"), F.col("w")[i + 1].alias("b"), F.col("w")[i + 2].alias("c")))).alias("x"))
    a, b, c = F.col("x.a"), F.col("x.b"), F.col("x.c")
    code = F.xxhash64(a, b, c)
    few = F.pmod(F.xxhash64(b, c), F.lit(10_000)).cast("string")
    forms = F.array(
        F.lower(F.concat_ws("_", a, b, c)), F.concat(F.lower(a), F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, few), F.concat_ws("/", a, b, c),
        F.upper(F.concat_ws("_", a, b)), a, F.concat(a, few, F.lit("_"), b),
    )
    return triples.select(F.element_at(forms, F.pmod(code, F.lit(7)).cast("int") + 1).alias("v"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: int = MADE) -> MarkovModel:
    """Fit both models on four fifths of the samples and set the limit on the rest.

    ``MADE`` strings of either class are made; about ``SAMPLE_STRINGS`` identifiers come from
    about ``SAMPLE_DOCS`` documents. A table without words leaves the made ones.
    """
    spark = docs.sparkSession
    own = corpus_identifiers(some_rows(docs, id_col, text_col, SAMPLE_DOCS), text_col).distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE_STRINGS)
    parts = [(random_strings(spark, made), "random"), (ordinary_strings(spark, made), "ordinary"), (own, "ordinary")]
    samples = None
    for strings, name in parts:
        part = strings.select(F.lit(name).alias("kind"), "v", (F.pmod(F.xxhash64("v", F.lit(9)), F.lit(5)) == 0).alias("held"))
        samples = part if samples is None else samples.union(part)
    samples = samples.cache()
    counts = samples.where("NOT held AND length(v) > 1").select("kind", F.explode(_pairs(F.col("v"))).alias("pair")).groupBy("kind", "pair").count().collect()
    seen = {(r["kind"], r["pair"]): r["count"] for r in counts}

    def chance(kind: str) -> list[float]:
        """Pair probabilities; a pair seldom seen leans on how frequent its second character is."""
        pairs = [[seen.get((kind, a * STATES + b), 0) for b in range(STATES)] for a in range(STATES)]
        single = [sum(row[b] for row in pairs) + 0.5 for b in range(STATES)]
        back = [x / sum(single) for x in single]
        return [(n + BACKOFF * p) / (sum(row) + BACKOFF) for row in pairs for n, p in zip(row, back, strict=True)]

    ratios = tuple(round(math.log(p / q), 6) for p, q in zip(chance("random"), chance("ordinary"), strict=True))
    held = samples.where(F.col("held") & (F.length("v") >= LEAST)).select("kind", mean_ratio(F.col("v"), ratios).alias("r"))
    tail = held.groupBy("kind").agg(F.percentile("r", F.lit(1 - FALSE_ALARMS)).alias("high"), F.percentile("r", F.lit(0.02)).alias("low")).collect()
    samples.unpersist()
    at = {r["kind"]: r for r in tail}
    # Between the tails of the two classes where they leave room, else at that of the ordinary.
    high, low = at["ordinary"]["high"], at["random"]["low"]
    return MarkovModel(ratios, float(max(high, (high + low) / 2)))


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, arrays of spans ``assign, access, hex, markov``: one row per row of ``docs``.

    A null text is the empty one and has no spans. Random strings that overlap a span of a
    fixed format are left to it. Repeated rows and null ids each give a row; other columns
    play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "t", *[spans.alias(kind) for kind, spans in base_spans(F.col("t")).items()])
    extra = F.filter(matches(F.col("t"), CANDIDATE), lambda s: (mean_ratio(s["value"], model.ratios) > model.limit))
    taken = lambda s: F.coalesce(*[F.when(overlaps(s, F.col(k)), F.lit(True)) for k in ("assign", "access", "hex")], F.lit(False))
    return rows.withColumn("extra", extra).withColumn("markov", F.filter("extra", lambda s: ~taken(s))).drop("t", "extra")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    spans = {k: named(F.col(k), k, i) for i, k in enumerate(KINDS)}
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(joined(F.concat(*[spans[k] for k in KINDS[:3]])), "UTF-8"), 256).alias("base_sha256"),
        joined(F.concat(*spans.values())).alias("spans"),
    )
