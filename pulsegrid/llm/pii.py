"""Personal data: fixed formats, and candidates that gradient-boosted trees accept.

Generators propose spans generously, and they may overlap. Boosted trees score each from its
format and its surroundings. No labels exist for personal data outside the fixed formats, so
they are made: addresses and numbers of the fixed formats, made by rule and found in a bounded
sample of documents, are rewritten into forms people also use (``joe [at] site [dot] com``,
numbers without ``+``, defanged addresses, regrouped cards), and into look-alikes that are none
(failed check digits, dates, versions, MAC addresses, order numbers). The generators run over
the rewritten snippets; a candidate is positive if it is the rewritten span, of its kind. On the
held-out part each kind gets the lowest threshold that keeps the precision asked for. The
trees are applied to every candidate as a plain expression, in the row of its document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import some_rows, table
from .spans import joined, matches, named, once, overlaps, pieces

KINDS = ("email", "ip", "card", "phone")
#: Each says the same as the plain pattern of its kind, without trying again inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_AT, _DOT = r"(?:@|[\[(]at[\])])", r"(?:\.|[\[(]dot[\])])"
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+{_AT}\x20?+[A-Za-z0-9-]++(?:\x20?+{_DOT}\x20?+[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:(?:[.,-]|\[\.\]|[\[(]dot[\])])[0-9]{1,3}+){3}+(?::[0-9]{1,5}+)?+|[0-9a-fA-F]{1,4}+(?::[0-9a-fA-F]{0,4}+){2,7}+)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]?+[0-9]){11,22}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\+?+\(?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,16}+(?![0-9A-Za-z])",
}
CONTEXT = r"(?i)mail|contact|write|phone|tel|call|fax|mobile|card|visa|pay|account|host|server|address|\bip\b"
OTHERWISE = r"(?i)order|invoice|version|release|build|isbn|serial|ticket|item|part|ref|page|date|price|total|\bid\b|\bno\b"
BEFORE = 24
#: Seeds made by rule; documents, and seeds out of them, about.
MADE, SAMPLE_DOCS, SAMPLE = 4_000, 20_000, 4_000
TREES, DEPTH = 20, 4
PRECISION = 0.95
_BY_KIND = {
    "email": ("write to ", "mail me: ", "contact ", "e-mail address ", ""),
    "ip": ("from host ", "server ", "the ip ", "address ", ""),
    "card": ("card ", "pay with visa ", "account ", "charged to ", ""),
    "phone": ("call me at ", "phone: ", "tel. ", "mobile ", ""),
}
_PLAIN = ("order no ", "invoice ", "version ", "isbn ", "serial ", "on date ", "the ", "total ", "")


@dataclass(frozen=True)
class Boosted:
    """Trees ``(feature, cut, low, high)`` or leaf values, with weights; thresholds by kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, features: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            at, cut, low, high = node
            return F.when(features[at] <= cut, walk(low)).otherwise(walk(high))

        return sum((w * walk(t) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))

    def probability(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(features)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0)))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of ``start, end, value`` of the fixed formats, by kind."""
    has_digit = text.rlike("[0-9]")
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(matches(text, CARD, has_digit), lambda s: F.length(_digits(s["value"])).between(12, 19) & luhn(_digits(s["value"]))),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    }


def _features(text: Column, span: Column, kind: int) -> Column:
    value = span["value"]
    only = _digits(value)
    digits = F.length(only)
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]+", ""))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    before = F.substring(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    after = F.substring(text, span["end"] + 1, F.lit(1))

    def size(x: Column) -> Column:
        return F.coalesce(x, F.lit(0))

    numbers = [
        F.lit(kind), F.length(value), digits, letters, F.length(value) - digits - letters, F.size(groups),
        size(F.array_max(sizes)), size(F.array_min(sizes)), size(F.get(sizes, F.lit(0))), size(F.get(sizes, F.size(sizes) - 1)),
        F.startswith(value, F.lit("+")), F.contains(value, F.lit("@")), F.size(F.split(value, r"\.")) - 1, F.size(F.split(value, ":")) - 1,
        value.rlike(r"[\[(](?:at|dot|\.)[\])]"), value.rlike(r"\([0-9]"), value.rlike(r"[./-]"), F.coalesce(F.substring(only, 1, 1).try_cast("int"), F.lit(-1)),
        digits.between(12, 19) & luhn(only), (F.size(groups) == 4) & F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)),
        value.rlike(r"^(?:[12][0-9]{3}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][12][0-9]{3})"), value.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){2,}"),
        before.rlike(CONTEXT), before.rlike(OTHERWISE), (before == "") | before.rlike(r"\s$"), (after == "") | after.rlike(r"[\s.,;:!?)]"),
    ]
    return F.array(*[x.cast("double") for x in numbers])


def candidates(text: Column) -> Column:
    """All proposed spans: an array of ``start, rank, end, kind, features``."""

    def of(rank: int, kind: str) -> Column:
        gate = text.rlike(r"[0-9]|@|[\[(]at[\])]") & text.rlike(GENERATORS[kind])
        return F.transform(
            matches(text, GENERATORS[kind], gate),
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _features(text, s, rank).alias("features")),
        )

    return F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)])


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "t", *[spans.alias(kind) for kind, spans in base_spans(F.col("t")).items()])
    return rows.select("id", *KINDS, candidates(F.col("t")).alias("proposed"))


def _tree(lines: list[str]):
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    at, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)
    return int(at), float(cut), low, _tree(lines)


def boosted(fitted: GBTClassificationModel) -> Boosted:
    """The fitted trees as nested tuples, without thresholds."""
    trees = tuple(_tree([x for x in t.toDebugString.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]) for t in fitted.trees)
    return Boosted(trees, tuple(fitted.treeWeights))


def _pick(code: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(code, F.lit(len(values))).cast("int") + 1)


def _number(digits: int, *salt) -> Column:
    return F.lpad(F.pmod(F.xxhash64(*salt), F.lit(10**digits)).cast("string"), digits, "0")


def made_seeds(spark: SparkSession, n: int) -> DataFrame:
    """``kind, value, before, after``: spans of the fixed formats, made by rule."""
    i = F.col("id")
    names = ("joe", "ann.lee", "info", "m_kraus", "sales", "r.ito", "office", "li-wei", "x", "support")
    email = F.concat(_pick(F.xxhash64(i), names), F.when(i % 3 == 0, _number(2, i)).otherwise(""), F.lit("@"), _pick(F.xxhash64(i, F.lit(1)), ("mail", "site", "host-7", "uni", "acme")), F.lit("."), _pick(F.xxhash64(i, F.lit(2)), ("com", "org", "de", "co.uk", "example.net")))
    ip = F.concat_ws(".", *[F.pmod(F.xxhash64(i, F.lit(k)), F.lit(256)).cast("string") for k in range(4)])
    head = F.concat(_pick(F.xxhash64(i, F.lit(8)), ("4", "51", "37", "6011", "2")), _number(14, i, F.lit(3)))
    head = F.substring(head, F.lit(1), _pick(F.xxhash64(i, F.lit(4)), ("15", "15", "15", "14", "12")).cast("int"))
    card = F.concat(head, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: luhn(F.concat(head, d)))[0])
    phone = F.concat(F.lit("+"), _pick(F.xxhash64(i, F.lit(6)), ("1 (", "49 (", "33 (", "44 (", "1-", "81 ", "7.")), _number(3, i, F.lit(5)), _pick(F.xxhash64(i, F.lit(6)), (") ", ") ", ") ", ") ", "-", " ", ".")), _number(3, i, F.lit(7)), _pick(F.xxhash64(i, F.lit(6)), ("-", " ", "-", " ", "-", " ", ".")), _number(4, i, F.lit(9)))
    value = F.element_at(F.array(email, ip, card, phone), F.pmod(i, F.lit(4)).cast("int") + 1)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod(i, F.lit(4)).cast("int") + 1)
    return spark.range(n).select(kind.alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("before"), _pick(F.xxhash64(i, F.lit(10)), ("", ".", ", then", " and", ") now", " x")).alias("after"))


def corpus_seeds(docs: DataFrame, text_col: str) -> DataFrame:
    """The same for the spans of the fixed formats in ``docs``, with the text around them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("t"))
    rows = rows.select("t", *[spans.alias(k) for k, spans in base_spans(F.col("t")).items()]).where(" OR ".join(f"size({k}) > 0" for k in KINDS))

    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    every = F.concat(*[of(k) for k in KINDS])
    found = rows.select("t", F.explode(every).alias("x")).select("t", "x.kind", "x.s")
    before = F.substring(F.col("t"), F.greatest(F.col("s.start") - BEFORE + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(BEFORE)))
    return found.select("kind", "s.value", before.alias("before"), F.substring(F.col("t"), F.col("s.end") + 1, F.lit(BEFORE)).alias("after"))


def _rewritten(kind: Column, v: Column) -> Column:
    """``value, good`` of all rewritings of a span: those that are personal data and those that aren't."""
    only, code = _digits(v), F.xxhash64(v)
    parts = F.split(v, "@")
    local, host = parts[0], F.get(parts, F.lit(1))

    def spelt(at: str, dot: str) -> Column:
        return F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))

    octets = F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    pairs = [F.lower(F.hex(octets[k] * 256 + octets[k + 1])) for k in (0, 2)]
    wrong = F.concat(F.substring(only, F.lit(1), F.length(only) - 1), F.pmod(F.substring(only, -1, 1).cast("int") + 1 + F.pmod(code, F.lit(9)).cast("int"), F.lit(10)).cast("string"))

    def grouped(x: Column, mark: str) -> Column:
        return F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{mark}")

    bare = F.regexp_replace(v, r"^\+", "")
    short = F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]*(?=[(0-9])", "")
    day = F.date_format(F.timestamp_seconds(F.lit(946_684_800) + F.pmod(code, F.lit(1_000_000_000))), "yyyy-MM-dd")
    good = {
        "email": [spelt(" [at] ", " [dot] "), spelt(" (at) ", " (dot) "), spelt("[at]", "."), spelt(" (at) ", "."), spelt("[at]", "[dot]")],
        "ip": [F.replace(v, F.lit("."), F.lit("[.]")), F.replace(v, F.lit("."), F.lit("[dot]")), F.concat(F.lit("2001:db8::"), pairs[0], F.lit(":"), pairs[1]), F.concat(F.lit("fe80:0:0:0:0:0:"), pairs[0], F.lit(":"), pairs[1])],
        "card": [grouped(only, "."), grouped(only, "/"), grouped(only, "_")],
        "phone": [bare, F.concat(F.lit("00"), bare), short, F.regexp_replace(F.regexp_replace(short, "[^0-9]+", "."), r"^\.", ""), F.regexp_replace(F.regexp_replace(short, "[^0-9]+", "-"), "^-", "")],
    }
    bad = {
        "email": [F.concat(local, F.lit(" (at) "), _number(1, code), F.lit("."), _number(2, code)), F.concat(local, F.lit(" [at] "), _number(2, code), F.lit(" [dot] "), _number(2, code))],
        "ip": [
            F.regexp_replace(v, r"^[0-9]+", "3" + "0" * 2), F.replace(v, F.lit("."), F.lit(",")), F.replace(v, F.lit("."), F.lit("-")), F.concat_ws("-", day, F.lpad(F.pmod(code, F.lit(24)).cast("string"), 2, "0")),
            F.concat_ws(":", *[F.lpad(F.lower(F.hex(o)), 2, "0") for o in (octets[0], octets[1], octets[2], octets[3], octets[0], octets[2])]), F.concat_ws(":", *[F.lpad(F.pmod(octets[k], F.lit(60)).cast("string"), 2, "0") for k in range(3)]),
        ],
        "card": [grouped(wrong, "."), grouped(wrong, "/"), grouped(wrong, "_"), grouped(wrong, " "), wrong, F.concat(F.lit("978-3-"), F.substring(only, 1, 2), F.lit("-"), F.substring(only, 3, 6), F.lit("-"), F.substring(only, 9, 1))],
        "phone": [only, F.substring(only, 1, 8), day, F.date_format(F.timestamp_seconds(F.lit(946_684_800) + F.pmod(code, F.lit(1_000_000_000))), "dd.MM.yyyy HH.mm"), F.concat_ws(".", F.substring(only, 1, 7), F.substring(only, 8, 2)), F.concat_ws("-", F.substring(only, 1, 4), F.substring(only, 5, 4)), F.concat_ws("/", F.substring(only, 1, 6), F.substring(only, 7, 4))],
    }
    out = None
    for k in KINDS:
        made = F.array(*[F.struct(x.alias("value"), F.lit(g).alias("good")) for g, xs in ((True, good[k]), (False, bad[k])) for x in xs])
        out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
    return out


def labelled_candidates(seeds: DataFrame) -> DataFrame:
    """``kind, features, label, held``: what the generators propose in the rewritten snippets.

    Seeds without text before them get a cue that suits the label, a plain one or none. All
    rewritings of a seed are held out together.
    """
    rows = seeds.select("kind", "before", "after", F.col("value").alias("seed"), F.posexplode(_rewritten(F.col("kind"), F.col("value"))).alias("nth", "x")).select("*", "x.value", "x.good").where("value IS NOT NULL")
    code = F.xxhash64("seed", "nth")
    cue = _pick(F.xxhash64("seed", "nth", F.lit(1)), _PLAIN)
    for k in KINDS:
        cue = F.when((F.col("kind") == k) & F.col("good") & (F.pmod(code, F.lit(10)) < 6), _pick(code, _BY_KIND[k])).otherwise(cue)
    cue = F.when(F.pmod(code, F.lit(10)) < 8, cue).otherwise(F.lit("the "))
    rows = rows.withColumn("lead", F.coalesce("before", cue)).withColumn("t", F.concat("lead", "value", "after"))
    start = F.length("lead")
    proposed = rows.select("kind", "good", start.alias("start"), (start + F.length("value")).alias("end"), F.length("value").alias("size"), (F.pmod(F.xxhash64("seed"), F.lit(5)) == 0).alias("held"), F.explode(candidates(F.col("t"))).alias("c"))
    shared = F.least("end", "c.end") - F.greatest("start", "c.start")
    meant = F.col("good") & (F.col("c.kind") == F.col("kind")) & (shared >= 0.8 * F.greatest("size", F.col("c.end") - F.col("c.start")))
    return proposed.select("c.kind", "c.features", meant.cast("double").alias("label"), "held")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: int = MADE) -> Boosted:
    """Fit on rewritings of ``MADE`` made seeds and of about ``SAMPLE`` found in ``SAMPLE_DOCS`` documents.

    A table without spans of the fixed formats leaves the made ones; for an empty table there is
    nothing to scan, and the model passes no candidate.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return Boosted()
    found = corpus_seeds(some_rows(docs, id_col, text_col, SAMPLE_DOCS), text_col).distinct().orderBy(F.xxhash64("value", "before"), "kind", "value", "before", "after").limit(SAMPLE)
    sample = labelled_candidates(made_seeds(spark, made).union(found)).withColumn("vector", array_to_vector("features")).cache()
    try:
        fitted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(sample.where("NOT held"))
        model = boosted(fitted)
        scored = sample.where("held").select("kind", "label", F.round(model.probability(F.col("features")), 4).alias("p")).groupBy("kind", "p").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("kind").orderBy(F.desc("p"))
        precise = scored.withColumn("precision", F.sum("hits").over(above) / F.sum("n").over(above)).where((F.col("precision") >= PRECISION) & (F.col("p") >= 0.5))
        return Boosted(model.trees, model.weights, {r["kind"]: r["cut"] for r in precise.groupBy("kind").agg(F.min("p").alias("cut")).collect()})
    finally:
        sample.unpersist()


def scan(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, arrays ``email, ip, card, phone`` of base spans and ``added``: one row per row.

    ``added`` holds the candidates that pass their kind's threshold and overlap no base span. A null text is the empty one and has no spans. Repeated rows and null ids
    each give a row; other columns play no part.
    """
    found = _with_spans(docs, id_col, text_col)
    if not model.thresholds:
        none = F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)])
        return found.withColumn("added", F.filter(none, lambda b: F.lit(False))).drop("proposed")
    cut = F.create_map(*[F.lit(x) for k in KINDS for x in (k, model.thresholds.get(k, 2.0))])
    passed = F.filter("proposed", lambda c: model.probability(c["features"]) >= cut[c["kind"]])
    taken = lambda c: F.coalesce(*[F.when(overlaps(c, F.col(k)), F.lit(True)) for k in KINDS], F.lit(False))
    fresh = F.filter("passed", lambda c: ~taken(c))
    added = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.withColumn("passed", passed).withColumn("added", added).drop("proposed", "passed")


def redact(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` with every span replaced by its kind in angle brackets; of overlapping
    spans the first to start stands for all. A null text gives the empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = scan(rows.select(F.struct("id", "t").alias("k"), F.col("t").alias("x")), model, "k", "x").select(F.col("id.id").alias("id"), F.col("id.t").alias("t"), *KINDS, "added")
    ordered = F.array_sort(F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)], F.col("added")))
    text = F.col("t")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    def put_piece(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(piece, start, put, lambda own: F.struct(own["at"].alias("at"), F.concat(acc["out"], own["out"]).alias("out")))

    done = F.aggregate(once(ordered, lambda spans: pieces(spans)), zero, put_piece, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select("id", done.alias("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    base = F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)])
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size("added").cast("long").alias("n_added"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.concat(base, "added")).alias("spans"),
    )
