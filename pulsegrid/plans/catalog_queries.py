"""Queries on batches, paths and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import base_name, phm_score, posix_path
from ..operators import guards, paths
from ..sources import catalog
from . import views
from .views import r, rounded, with_views


def l4_latest_by_role(spark, sf_dir):
    return catalog.latest_by_role(views.batches(spark, sf_dir))


L4 = f"{with_views('batches')} SELECT dataset_id, role, arg_max(batch_id, (created_at, batch_id)) AS batch_id FROM batches GROUP BY dataset_id, role"


def l9_preferred_batch(spark, sf_dir):
    return catalog.preferred(views.batches(spark, sf_dir), "P")


L9 = f"{with_views('batches')} SELECT dataset_id, arg_max(batch_id, (role = 'P', created_at, batch_id)) AS batch_id FROM batches GROUP BY dataset_id"


def s29_roles_listing(spark, sf_dir):
    rows = views.batches(spark, sf_dir).withColumn("day", F.col("created_at") - F.col("created_at") % 86400)
    return catalog.roles_listing(rows, "day")


S29 = f"{with_views('batches')} SELECT created_at - created_at % 86400 AS day, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n FROM batches GROUP BY 1"


def s15_u5_distinct_roles(spark, sf_dir):
    return views.batches(spark, sf_dir).select("dataset_id", "role").where("role IS NOT NULL").distinct()


S15 = f"{with_views('batches')} SELECT DISTINCT dataset_id, role FROM batches WHERE role IS NOT NULL"


def u3_u4_role_sets(spark, sf_dir):
    return catalog.same_roles(views.batches(spark, sf_dir), ["F", "O", "X"])


U3 = f"""{with_views('batches')}, h AS (SELECT dataset_id, list_sort(list_distinct(list(role))) AS have FROM batches GROUP BY dataset_id)
SELECT dataset_id, array_to_string([x FOR x IN ['F', 'O', 'X'] IF NOT list_contains(have, x)], ',') AS missing, array_to_string([x FOR x IN have IF NOT list_contains(['F', 'O', 'X'], x)], ',') AS extra, have = ['F', 'O', 'X'] AS equal FROM h"""


def s19_insert_absent(spark, sf_dir):
    """Segments of customers that no order has yet reached count as new."""
    rows = views.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    held = views.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return catalog.absent(rows, held, ["k"])


S19 = "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def s19_insert_new_pairs(spark, sf_dir):
    """Customers and states of orders since 1997 that no earlier order has: what an insert would add."""
    orders = views.load(spark, sf_dir, "orders")
    pairs = orders.select("o_custkey", "o_orderstatus")
    late = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    return catalog.absent(pairs.where(late), pairs.where(~late), ["o_custkey", "o_orderstatus"])


S19N = """SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"""


def s17_a48_lineage(spark, sf_dir):
    """Counts of lineage rows by unit, kind and role."""
    rows = views.acq(spark, sf_dir).withColumn("dataset_id", F.when(F.col("role") == "full_test", "college").otherwise("femto"))
    return rows.select("role", "bearing_run_id", catalog.kind_of(F.col("dataset_id")).alias("kind")).groupBy("role", "bearing_run_id", "kind").agg(F.count(F.lit(1)).alias("n"))


S17 = f"{with_views('acq')} SELECT role, bearing_run_id, CASE WHEN role = 'full_test' THEN 'college_window' ELSE 'femto_acquisition' END AS kind, count(*) AS n FROM acq GROUP BY ALL"


def j11_unprocessed(spark, sf_dir):
    """Orders without lines and the latest line of the rest: lineage joins with a null filter."""
    orders = views.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = views.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    customers = views.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = orders.join(lines, "o_orderkey", "left").join(customers, "o_custkey")
    return joined.groupBy("c_mktsegment").agg(F.count_if(F.col("n_lines").isNull()).alias("unprocessed"), F.sum("n_lines").alias("lines"))


J11 = """SELECT c_mktsegment, count(*) FILTER (n_lines IS NULL) AS unprocessed, CAST(sum(n_lines) AS BIGINT) AS lines FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY c_mktsegment"""


def p10_p12_paths(spark, sf_dir):
    p = F.col("path")
    return views.paths(spark, sf_dir).select("page_id", posix_path(p).alias("posix"), base_name(p).alias("name"))


P10 = rf"{with_views('paths')} SELECT page_id, replace(path, '\', '/') AS posix, list_last(string_split(replace(path, '\', '/'), '/')) AS name FROM paths"


def p11_host_paths(spark, sf_dir):
    return guards.host_path_columns(views.paths(spark, sf_dir), ("C:/", "/srv/", "/nowhere/"))


P11 = rf"{with_views('paths')} SELECT 'path' AS column, count(*) FILTER (contains(replace(path, '\', '/'), 'C:/') OR contains(replace(path, '\', '/'), '/srv/')) AS n FROM paths"


def _known(spark, sf_dir):
    """Copies of the pages under two roots; the second root lacks every third."""
    pages = views.load(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    a = pages.select(F.concat(F.lit("/lake/a/"), bare).alias("file"))
    b = pages.where("page_id % 3 > 0").select(F.concat(F.lit("/lake/b/"), bare).alias("file"))
    return a.union(b)


def p21_resolve_paths(spark, sf_dir):
    stored = views.paths(spark, sf_dir)
    return paths.resolve(stored, _known(spark, sf_dir)).select("page_id", "path", "resolved")


P21 = rf"""{with_views('paths')}, kn AS (SELECT DISTINCT file FROM (SELECT '/lake/a/' || regexp_replace(url, '^[a-z]+://', '') AS file FROM pages UNION ALL SELECT '/lake/b/' || regexp_replace(url, '^[a-z]+://', '') FROM pages WHERE page_id % 3 > 0)),
ps AS (SELECT DISTINCT path, [x FOR x IN string_split(replace(path, '\', '/'), '/') IF x <> ''] AS s FROM paths), ks AS (SELECT file, [x FOR x IN string_split(file, '/') IF x <> ''] AS f FROM kn),
pe AS (SELECT path, s, k, array_to_string(s[len(s) - k + 1:], '/') AS tail FROM (SELECT path, s, unnest(range(1, least(4, len(s)) + 1)) AS k FROM ps)),
ke AS (SELECT file, f, array_to_string(f[len(f) - k + 1:], '/') AS tail FROM (SELECT file, f, unnest(range(1, least(4, len(f)) + 1)) AS k FROM ks)),
rk AS (SELECT path, file, rank() OVER (PARTITION BY path ORDER BY k DESC, len(list_intersect(list_distinct(s), list_distinct(f))) DESC) AS r FROM pe JOIN ke USING (tail)),
bs AS (SELECT path, count(DISTINCT file) AS n, min(file) AS file FROM rk WHERE r = 1 GROUP BY path)
SELECT page_id, path, CASE WHEN n = 1 THEN file ELSE path END AS resolved FROM paths LEFT JOIN bs USING (path)"""


def s28_content_hash(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"))


S28 = "SELECT page_id, sha256(html) AS sha256 FROM pages"


def f3_phm_score(spark, sf_dir):
    """The challenge score over a range of errors drawn from the line items."""
    e = (F.col("l_quantity") - 25).cast("double")
    return rounded(views.load(spark, sf_dir, "lineitem").groupBy(e.alias("percent_error")).agg(F.count(F.lit(1)).alias("n")).withColumn("score", phm_score(F.col("percent_error"))))


F3 = f"SELECT {r('e')} AS percent_error, n, {r('CASE WHEN e <= 0 THEN power(2, e / 5) ELSE power(2, -e / 20) END')} AS score FROM (SELECT (l_quantity - 25)::DOUBLE AS e, count(*) AS n FROM lineitem GROUP BY 1)"


def u1_u2_unions(spark, sf_dir):
    """Acquisitions and samples as one feature table; columns of one side alone are null on the other."""
    a = views.acq(spark, sf_dir).select(F.col("bearing_run_id").alias("unit"), F.col("sequence_index").cast("long").alias("seq"), "vibration_x_rms")
    s = views.samples(spark, sf_dir).select("unit", F.col("row_index").alias("seq"), F.col("x").alias("ambient_temp"))
    both = a.unionByName(s, allowMissingColumns=True)
    return rounded(both.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg("vibration_x_rms").alias("rms"), F.avg("ambient_temp").alias("ambient")))


U1 = f"{with_views('acq', 'samples')} SELECT unit, count(*) AS n, {r('avg(a)')} AS rms, {r('avg(t)')} AS ambient FROM (SELECT bearing_run_id AS unit, vibration_x_rms AS a, NULL::DOUBLE AS t FROM acq UNION ALL SELECT unit, NULL, x FROM samples) GROUP BY unit"

QUERIES = {
    "l4_latest_by_role": (l4_latest_by_role, L4), "l9_preferred_batch": (l9_preferred_batch, L9), "s29_roles_listing": (s29_roles_listing, S29), "s15_u5_distinct_roles": (s15_u5_distinct_roles, S15), "u3_u4_role_sets": (u3_u4_role_sets, U3),
    "s19_insert_absent": (s19_insert_absent, S19), "s19_insert_new_pairs": (s19_insert_new_pairs, S19N), "s17_a48_lineage": (s17_a48_lineage, S17), "j11_unprocessed": (j11_unprocessed, J11), "p10_p12_paths": (p10_p12_paths, P10), "p11_host_paths": (p11_host_paths, P11),
    "p21_resolve_paths": (p21_resolve_paths, P21), "s28_content_hash": (s28_content_hash, S28), "f3_phm_score": (f3_phm_score, F3), "u1_u2_unions": (u1_u2_unions, U1),
}
