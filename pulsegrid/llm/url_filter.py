"""URL filters: fixed rules first, then a tree of path templates for each host.

Segments of a path lose what varies: runs of digits become a mark, and words that are rare at
their place in their host become a wildcard. What is left makes a template, and the templates
of a host make a tree. Branches under one parent that go on alike (next segments, and share of
labelled pages that are bad) become one branch. A template whose labelled pages are mostly
bad is blocked; its purity is smoothed by that of its parents up to all hosts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sized, table

#: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A digit run, a wildcard for rare words, any segments of merged branches, and the end of a path.
DIGITS, RARE, ANY, END = "{d}", "{w}", "{*}", "{end}"
#: Words seen so often at their place stay as they are.
LITERAL_MIN = 20
#: Branches differ where shares are further apart than chance explains with this probability.
DELTA = 0.05
#: A parent's purity weighs as many labelled pages; below PURITY a template is blocked.
WEIGHT, PURITY = 8.0, 0.5
#: Rules that an expression may hold.
MAX_RULES = 1_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and where there is no ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits (ties: the longer host); null if none does.

    A rule fits its host and all hosts below it, where the path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an expression holds {MAX_RULES} at most")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def marked_path(path: Column) -> Column:
    """The path with its runs of digits marked; it begins with a slash unless it is empty."""
    return F.regexp_replace(path, "[0-9]+", DIGITS)


def _segments(path: str = "path") -> Column:
    """Segments and the end mark; an empty path has the end alone."""
    inner = F.split(F.substring(F.col(path), F.lit(2), F.length(path)), "/")
    return F.concat(F.when(F.col(path) == "", F.array().cast("array<string>")).otherwise(inner), F.array(F.lit(END)))


def _placed(paths: DataFrame) -> DataFrame:
    """``paths`` by segment: ``at``, ``segment`` and whether the segment before holds digits."""
    rows = paths.select("host", "path", "n", "known", "bad", _segments().alias("s"))
    before = lambda i: F.coalesce(F.get("s", i - 1), F.lit("")).contains(DIGITS)
    each = F.transform("s", lambda x, i: F.struct(i.alias("at"), x.alias("segment"), before(i).alias("after_digits")))
    return rows.select("host", "path", "n", "known", "bad", F.explode(each).alias("e")).select("host", "path", "n", "known", "bad", "e.*")


def templates(paths: DataFrame, literal_min: int = LITERAL_MIN) -> DataFrame:
    """``host, path, template``: the template (an array of segments) of each distinct marked path.

    ``paths`` has ``host, path, n, known, bad``: pages, labelled pages and bad ones by path. A
    segment without digits is kept where ``literal_min`` pages of the host have it at that
    place; else it is a wildcard, with its ending after the last dot.
    """
    placed = _placed(paths)
    place = ["host", "at", "segment", "after_digits"]
    words = placed.where((F.col("segment") != END) & ~F.col("segment").contains(DIGITS) & (F.col("segment") != ""))
    frequent = words.groupBy(*place).agg(F.sum("n").alias("seen")).where(F.col("seen") >= literal_min).select(*place, F.lit(True).alias("frequent"))
    # A host has a frequent word for every `literal_min` pages at most; it is counted before it is sent.
    told = placed.join(sized(materialise(frequent)), place, "left")
    ending = F.regexp_extract("segment", r"\.[A-Za-z0-9]{1,5}$", 0)
    fixed = (F.col("segment") == END) | (F.col("segment") == "") | F.col("segment").contains(DIGITS) | F.col("frequent")
    token = F.when(fixed, F.col("segment")).otherwise(F.concat(F.lit(RARE), ending))
    whole = told.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("at", token.alias("token")))).alias("t"))
    return whole.select("host", "path", _collapsed(F.col("t.token")).alias("template"))


def _collapsed(tokens: Column) -> Column:
    """A wildcard for words stands for any number of them in a row."""
    pairs = F.arrays_zip(tokens.alias("x"), F.concat(F.array(F.lit("")), F.slice(tokens, F.lit(1), F.size(tokens) - 1)).alias("y"))
    return F.transform(F.filter(pairs, lambda p: ~((p["x"] == RARE) & (p["y"] == RARE))), lambda p: p["x"])


def _nodes(counted: DataFrame) -> DataFrame:
    """``host, parent, token, n, known, bad`` of every node below the roots, by the code of its parent.

    ``counted`` has a row for each template. A node's code is that of the segments down to it.
    """
    steps = F.transform("template", lambda x, i: F.struct(F.xxhash64(F.slice("template", F.lit(1), i)).alias("parent"), x.alias("token"), F.xxhash64(F.slice("template", F.lit(1), i + 1)).alias("node")))
    rows = counted.select("host", "n", "known", "bad", F.explode(steps).alias("s"))
    return rows.groupBy("host", "s.parent", "s.token", "s.node").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))


def _apart(a: Column, n: Column, b: Column, m: Column, delta: float) -> Column:
    """Whether shares a of n and b of m differ by more than the bound of Hoeffding for ``delta``."""
    return F.abs(a / n - b / m) > math.sqrt(math.log(2 / delta) / 2) * (1 / F.sqrt(n) + 1 / F.sqrt(m))


def merged_branches(counted: DataFrame, delta: float = DELTA) -> DataFrame:
    """``host, parent, token``: branches that go on as their parent's branches do together.

    Each branch is held against all branches under its parent taken together, never against
    its siblings one by one: the shares of what follows it, and the share of its labelled
    pages that are bad. Ends are no branches, and a branch without siblings is not merged.
    """
    nodes = materialise(_nodes(counted))
    key = ["host", "parent"]
    branches = nodes.where(F.col("token") != END)
    pooled = branches.groupBy(*key).agg(F.sum("n").alias("p_n"), F.sum("known").alias("p_known"), F.sum("bad").alias("p_bad"), F.count(F.lit(1)).alias("siblings")).where("siblings > 1")
    # What follows: children of a branch, and the same under all branches of its parent.
    of = branches.join(pooled.select(*key), key).select("host", "parent", F.col("token").alias("branch"), F.col("node").alias("b_node"), F.col("n").alias("b_n"))
    follow = nodes.select(F.col("host").alias("f_host"), F.col("parent").alias("f_parent"), F.col("token").alias("next"), F.col("n").alias("f_n"))
    next_of = materialise(of.join(follow, (F.col("host") == F.col("f_host")) & (F.col("b_node") == F.col("f_parent"))).select(*key, "branch", "b_n", "next", "f_n"))
    together = next_of.groupBy(*key, "next").agg(F.sum("f_n").alias("t_n"))
    held = next_of.join(together, [*key, "next"]).join(pooled.select(*key, "p_n"), key)
    one = held.groupBy(*key, "branch").agg(
        F.max(_apart(F.col("f_n"), F.col("b_n"), F.col("t_n"), F.col("p_n"), delta)).alias("differs"),
        # What the branch lacks: the pool's share of all that follows it, less than one.
        (1 - F.sum("t_n") / F.max("p_n")).alias("missing"), F.max("b_n").alias("b_n"), F.max("p_n").alias("p_n"),
    )
    missing = F.col("missing") > math.sqrt(math.log(2 / delta) / 2) * (1 / F.sqrt("b_n") + 1 / F.sqrt("p_n"))
    alike = one.where(~F.col("differs") & ~missing).select(*key, F.col("branch").alias("token"))
    rates = branches.join(pooled, key).select(*key, "token", F.when((F.col("known") > 0) & (F.col("p_known") > 0), _apart(F.col("bad"), F.greatest("known", F.lit(1)), F.col("p_bad"), F.greatest("p_known", F.lit(1)), delta)).otherwise(False).alias("rate_differs"))
    found = materialise(alike.join(rates.where("NOT rate_differs"), [*key, "token"]).select(*key, "token"))
    # A branch alone has nothing to be merged with.
    return found.join(found.groupBy(*key).count().where("count > 1").select(*key), key)


def _merged(templated: DataFrame, delta: float) -> DataFrame:
    """``host, template, merged``: every template with its merged branches named alike."""
    joined = templated.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    joined = materialise(joined)
    alike = merged_branches(joined, delta).withColumn("alike", F.lit(True))
    steps = F.transform("template", lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.slice("template", F.lit(1), i)).alias("parent"), x.alias("token")))
    rows = joined.select("host", "template", F.explode(steps).alias("s")).select("host", "template", "s.*")
    told = rows.join(sized(alike), ["host", "parent", "token"], "left")
    whole = told.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("alike"), F.lit(ANY)).otherwise(F.col("token")).alias("token")))).alias("m"))
    return whole.select("host", "template", F.col("m.token").alias("merged"))


def purities(counted: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """``host, template, known, bad, purity``: the smoothed share of good ones among labelled pages.

    A node's share is that of its labelled pages together with ``weight`` pages that have the
    share of its parent; a host's parent is all hosts together. Without any label it is one.
    """
    nodes = _nodes(counted).select("host", "node", "known", "bad")
    roots = counted.groupBy("host").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).select("host", F.xxhash64(F.array().cast("array<string>")).alias("node"), "known", "bad")
    steps = F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("template", F.lit(1), i)).alias("node")))
    rows = counted.select("host", "template", F.explode(steps).alias("s")).select("host", "template", "s.*")
    path = rows.join(nodes.union(roots), ["host", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", "known", "bad"))).alias("path"))
    overall = counted.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("known")), F.lit(0.0)).alias("share"))
    smooth = F.aggregate("path", F.col("share"), lambda share, x: (x["bad"] + weight * share) / (x["known"] + weight))
    last = F.element_at("path", -1)
    # One row.
    return path.crossJoin(F.broadcast(overall)).select("host", "template", last["known"].alias("known"), last["bad"].alias("bad"), (1 - smooth).alias("purity"))


def judge_paths(paths: DataFrame, literal_min: int = LITERAL_MIN, delta: float = DELTA, weight: float = WEIGHT) -> DataFrame:
    """``host, path, template, known, bad, purity`` of each distinct marked path (``host, path, n, known, bad``)."""
    templated = materialise(templates(paths, literal_min).join(paths, ["host", "path"]))
    named = materialise(_merged(templated, delta))
    after = templated.join(named, ["host", "template"]).select("host", "path", F.col("merged").alias("template"), "n", "known", "bad")
    after = materialise(after)
    counted = after.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
    pure = materialise(purities(counted, weight))
    return after.select("host", "path", "template").join(pure, ["host", "template"])


def judge(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
    literal_min: int = LITERAL_MIN, delta: float = DELTA, weight: float = WEIGHT, purity: float = PURITY,
) -> DataFrame:
    """``id, host, path, rule, verdict, template, purity``: one row per row of ``pages``.

    ``labelled`` has ``url, bad`` (boolean), of pages in the table or others; rows with a null in
    either are passed over, repeated ones count as often. The rule's verdict stands where a rule fits; other pages are blocked
    where their template's smoothed purity is below ``purity``. Urls that are null or without
    ``://`` are one host without a path. Ids may be null or repeat; other columns play no part.
    All work on templates is on distinct paths; the pages themselves are read twice and never
    grouped by id. Where distinct paths are too many to be sent to every machine, pages meet
    them in a join that Spark splits where a path is frequent.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("whole")).withColumn("path", marked_path(F.col("whole")))
    l_host, l_path = host_and_path(F.col("url"))
    known = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(l_host.alias("host"), marked_path(l_path).alias("path"), F.lit(0).alias("n"), F.lit(1).alias("known"), F.col("bad").cast("int").alias("bad"))
    both = rows.select("host", "path", F.lit(1).alias("n"), F.lit(0).alias("known"), F.lit(0).alias("bad")).union(known)
    paths = both.groupBy("host", "path").agg(F.greatest(F.sum("n"), F.sum("known")).alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    paths = materialise(paths)
    told = judge_paths(paths, literal_min, delta, weight)
    told = materialise(told.select(F.col("host").alias("t_host"), F.col("path").alias("t_path"), F.concat(F.lit("/"), F.array_join(F.filter("template", lambda x: x != END), "/")).alias("template"), "purity"))
    judged = rows.join(sized(told), (F.col("host") == F.col("t_host")) & (F.col("path") == F.col("t_path")), "left")
    fits = fitting_rule(F.col("host"), F.col("whole"), rules)
    own = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return judged.withColumn("fits", fits).select("id", "host", F.col("whole").alias("path"), "fits.rule", F.coalesce("fits.verdict", own).alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of pages whose document is labelled: a page names its document by the last number of its path.

    Bad: the document is of low quality or toxic, by any of its labels.
    """
    _, path = host_and_path(F.col("url"))
    document = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)")
    named = pages.select("url", path.alias("path")).select("url", document.alias("doc")).where("doc IS NOT NULL")
    by_doc = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return named.join(by_doc, "doc").select("url", "bad")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
