"""Reports against references: overlap of scans, map checks, identities, triples, vectors, fusion, lineage, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.evaluation import Invariant, ablation_cells, aligned, annotation_outcomes, banded, differences, identity_matches, identity_scores, invariant_findings, map_checks, match_annotations, metric_registry, overlap_report, pair_outcomes, plane_residuals, report_problems, rigid_alignment, triple_outcomes, vector_changes
from cairn.operators.evidence import hypotheses, weighted_support
from cairn.plans.evidence_queries import _SQL_CLAIMS, _claims
from cairn.plans.map_queries import _SQL_GRID
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EIGEN, SQL_ENTITY_POINTS, SQL_POINTS, entity_points, load, points

_SQL_RESIDUALS = f"""{SQL_ENTITY_POINTS}, n AS (SELECT p.entity AS earlier, q.entity AS later, p.point, p.x AS px, p.y AS py, p.z AS pz, q.x, q.y, q.z, row_number() OVER (PARTITION BY p.entity, p.point ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, q.point) AS r
  FROM ep p JOIN ep q ON q.entity = p.entity + 1 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 225), k AS (SELECT *, earlier * 100000000 + point AS g FROM n WHERE r <= 4), {SQL_EIGEN('k', 'g', 'pl')},
w AS (SELECT g, any_value(earlier) AS earlier, any_value(later) AS later, any_value(point) AS point, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz FROM k GROUP BY 1),
c3 AS (SELECT *, a1y * a2z - a1z * a2y AS nx, a1z * a2x - a1x * a2z AS ny, a1x * a2y - a1y * a2x AS nz FROM pl JOIN w USING (g) WHERE n = 4 AND xx + yy + zz > 0 AND e3 <= 0.02 * (xx + yy + zz)),
rs AS (SELECT earlier, later, point, abs((px - mx) * nx + (py - my) * ny + (pz - mz) * nz) AS residual FROM c3)"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity_points(spark, sf_dir).withColumnRenamed("entity", "scan")
    pairs = rows.select(F.col("scan").alias("earlier"), (F.col("scan") + 1).alias("later")).distinct()
    return plane_residuals(rows, pairs, 4, 15.0, 0.02)


@query("j3_plane_residuals", f"WITH {_SQL_RESIDUALS} SELECT earlier, later, point, round(residual, 3) AS residual FROM rs WHERE residual IS NOT NULL")
def j3_plane_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's points against planes through those of the next."""
    return _residuals(spark, sf_dir).withColumn("residual", F.round("residual", 3))


@query("j3_overlap_report", f"WITH {_SQL_RESIDUALS}, s AS (SELECT *, CASE WHEN earlier % 2 = 0 THEN 'corrected' ELSE 'unknown' END AS state FROM rs WHERE residual IS NOT NULL) SELECT state, count(*)::BIGINT AS correspondences, round(avg(residual), 3) AS mean, round(max(residual), 3) AS most, round(avg((residual > 0.05)::INT), 4) AS ghost_share FROM s GROUP BY ROLLUP (state)")
def j3_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = entity_points(spark, sf_dir).select(F.col("entity").alias("scan"), F.when(F.col("entity") % 2 == 0, "corrected").otherwise("unknown").alias("state")).distinct()
    return overlap_report(_residuals(spark, sf_dir), states, 0.05).select("state", "correspondences", F.round("mean", 3).alias("mean"), F.round("most", 3).alias("most"), F.round("ghost_share", 4).alias("ghost_share"))


@query(
    "j2_map_checks",
    f"""WITH {SQL_POINTS}, p AS (SELECT scan, CASE WHEN l = 'R' AND x = 7 THEN 'nan'::DOUBLE ELSE x END AS x, y, z, sqrt(x * x + y * y + z * z) AS r FROM (SELECT points.*, l_returnflag AS l FROM points JOIN (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS point, first(l_returnflag ORDER BY l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) USING (point))), s AS (SELECT s_suppkey AS scan FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT -1),
v AS (SELECT count(*) AS n FROM p WHERE NOT isnan(x) GROUP BY floor(x / 5), floor(y / 5), floor(z / 5))
SELECT unnest(['points', 'not_finite', 'outside_bounds', 'beyond_range', 'without_scan', 'scans_without_points', 'occupied_voxels', 'fullest_voxel']) AS "check", unnest([(SELECT count(*) FROM p), (SELECT count(*) FROM p WHERE isnan(x)), (SELECT count(*) FROM p WHERE NOT isnan(x) AND NOT (x BETWEEN 2 AND 48 AND y BETWEEN 0 AND 9)), (SELECT count(*) FROM p WHERE r > 45), (SELECT count(*) FROM p WHERE scan NOT IN (SELECT scan FROM s)),
  (SELECT count(*) FROM s WHERE scan NOT IN (SELECT scan FROM p)), (SELECT count(*) FROM v), (SELECT max(n) FROM v)])::BIGINT AS count""",
)
def j2_map_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which some are not finite, some beyond their range, some of scans that are not there."""
    flags = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point")).agg(F.min("l_returnflag").alias("flag"))
    rows = points(spark, sf_dir).join(flags, "point").withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    rows = rows.withColumn("x", F.when((F.col("flag") == "R") & (F.col("x") == 7), float("nan")).otherwise(F.col("x")))
    scans = load(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("scan")).unionByName(spark.range(-1, 0).select(F.col("id").alias("scan")))
    return map_checks(rows, scans, {"x": (2.0, 48.0), "y": (0.0, 9.0)}, 45.0, 5.0)


@query(
    "c21_identity_matches",
    """WITH o AS (SELECT DISTINCT o_custkey AS identity, o_orderkey AS sample FROM orders), h AS (SELECT l_orderkey AS sample, min(l_suppkey) AS entity FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
p AS (SELECT identity, entity, count(*) AS n FROM o LEFT JOIN h USING (sample) GROUP BY ALL)
SELECT identity, arg_min(entity, (-n, entity)) FILTER (entity IS NOT NULL) AS entity, count(entity)::BIGINT AS entities, coalesce(sum(n) FILTER (entity IS NULL), 0)::BIGINT AS unmatched, CASE count(entity) WHEN 0 THEN 'missed' WHEN 1 THEN 'matched' ELSE 'split' END AS outcome FROM p GROUP BY 1""",
)
def c21_identity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are identities that occur in their orders; the least supplier of an order's larger items holds it."""
    occurrences = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("identity"), F.col("o_orderkey").alias("sample"), F.lit(0).alias("region")).distinct()
    holders = load(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("sample")).agg(F.min("l_suppkey").alias("entity")).withColumn("region", F.lit(0))
    return identity_matches(occurrences, holders)


_SQL_PAIRED = "t AS (SELECT p_partkey AS a, p_partkey + 1 AS b, p_size % 3 = 0 AS same, CASE WHEN p_retailprice < 930 THEN 'match' WHEN p_retailprice < 970 THEN 'distinct' WHEN p_retailprice < 985 THEN 'unresolved' END AS decision, p_size <= 40 AS got FROM part), o AS (SELECT a, b, CASE WHEN same THEN CASE WHEN decision = 'match' THEN 'true_match' WHEN NOT got THEN 'missed_retrieval' WHEN decision = 'distinct' THEN 'missed_match' ELSE 'undecided' END ELSE CASE WHEN decision = 'match' THEN 'false_match' WHEN decision = 'distinct' OR NOT got THEN 'true_distinct' ELSE 'undecided_distinct' END END AS outcome FROM t)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), "p_size", "p_retailprice")
    price = F.col("p_retailprice")
    decided = rows.filter("p_retailprice < 985").select("a", "b", F.when(price < 930, "match").when(price < 970, "distinct").otherwise("unresolved").alias("decision"))
    return pair_outcomes(rows.select("a", "b", (F.col("p_size") % 3 == 0).alias("same")), decided, rows.filter("p_size <= 40"))


@query("j11_pair_outcomes", f"WITH {_SQL_PAIRED} SELECT a, b, outcome FROM o")
def j11_pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query("j11_identity_scores", f"WITH {_SQL_PAIRED}, n AS (SELECT count(*) FILTER (outcome = 'true_match') AS tm, count(*) FILTER (outcome = 'false_match') AS fm, count(*) FILTER (outcome = 'missed_retrieval') AS mr, count(*) FILTER (outcome IN ('true_match', 'missed_retrieval', 'missed_match', 'undecided')) AS same FROM o) SELECT round(tm / nullif(tm + fm, 0), 6) AS precision, round(tm / nullif(same, 0), 6) AS recall, round((same - mr) / nullif(same, 0), 6) AS retrieval_recall, fm::BIGINT AS false_matches FROM n")
def j11_identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_scores(_outcomes(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "retrieval_recall")], "false_matches")


@query(
    "j12_triple_outcomes",
    """WITH f AS (SELECT DISTINCT l_suppkey AS subject, l_returnflag AS predicate, l_partkey AS object, l_quantity > 25 AS holds FROM lineitem WHERE l_linestatus = 'F'), r AS (SELECT subject, predicate, object, bool_or(holds) AS holds FROM f GROUP BY ALL),
p AS (SELECT l_suppkey AS subject, l_returnflag AS predicate, l_partkey AS object, min(CASE WHEN l_discount < 0.04 THEN 'supported' WHEN l_discount < 0.08 THEN 'unresolved' ELSE 'rejected' END) AS state FROM lineitem WHERE l_tax > 0.01 GROUP BY ALL),
j AS (SELECT subject, predicate, object, CASE WHEN holds IS NULL THEN CASE WHEN state = 'supported' THEN 'unannotated' END WHEN holds THEN CASE WHEN state IS NULL THEN 'missed_candidate' WHEN state = 'supported' THEN 'true_positive' WHEN state = 'rejected' THEN 'missed_rejected' ELSE 'missed_unresolved' END
  ELSE CASE WHEN state = 'supported' THEN 'false_positive' WHEN state IS NULL OR state = 'rejected' THEN 'true_negative' ELSE 'undecided_negative' END END AS outcome FROM r FULL JOIN p USING (subject, predicate, object))
SELECT predicate, outcome, count(*)::BIGINT AS n FROM j WHERE outcome IS NOT NULL GROUP BY ALL""",
)
def j12_triple_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    named = items.withColumnsRenamed({"l_suppkey": "subject", "l_returnflag": "predicate", "l_partkey": "object"})
    keys = ["subject", "predicate", "object"]
    reference = named.filter("l_linestatus = 'F'").groupBy(*keys).agg(F.bool_or(F.col("l_quantity") > 25).alias("holds"))
    d = F.col("l_discount")
    said = named.filter("l_tax > 0.01").groupBy(*keys).agg(F.min(F.when(d < 0.04, "supported").when(d < 0.08, "unresolved").otherwise("rejected")).alias("state"))
    return triple_outcomes(reference, said).groupBy("predicate", "outcome").agg(F.count("*").alias("n"))


@query(
    "j9_vector_changes",
    """WITH v AS (SELECT e.vec_id AS centre, k AS variation, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + k / 100.0::DOUBLE) + k * 0.01::DOUBLE * (i % 3)) AS q, embedding::DOUBLE[] AS p FROM embeddings e, range(3) AS r(k)),
m AS (SELECT variation, list_max(list_transform(list_zip(p, q), lambda t: abs(t[1] - t[2]))) AS most, sqrt(list_sum(list_transform(list_zip(p, q), lambda t: (t[1] - t[2]) ** 2)) / list_dot_product(p, p)) AS rel, 1 - list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)) AS cos FROM v)
SELECT variation, count(*)::BIGINT AS centres, round(max(most), 6) AS max_abs_diff, round(avg(rel), 6) AS relative_change, round(avg(cos), 6) + 0.0 AS cosine_distance FROM m GROUP BY 1""",
)
def j9_vector_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against themselves, stretched and shifted a little, and against themselves as they are."""
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("centre"), F.col("embedding").cast("array<double>").alias("vector"))
    k = F.col("variation")
    varied = rows.withColumn("variation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("vector", F.transform("vector", lambda x, i: x * (1 + k / 100.0) + k * 0.01 * ((i + 1) % 3)))
    found = vector_changes(rows, varied)
    return found.select("variation", "centres", F.round("max_abs_diff", 6).alias("max_abs_diff"), F.round("relative_change", 6).alias("relative_change"), (F.round("cosine_distance", 6) + F.lit(0.0)).alias("cosine_distance"))


@query(
    "j10_fusion_outcomes",
    f"""WITH {_SQL_CLAIMS}, wf AS (SELECT support, key, observation, contribution, min(factor) AS w FROM c GROUP BY ALL), wm AS (SELECT support, key, observation, avg(w) AS w FROM wf GROUP BY ALL), ws AS (SELECT support, key, sum(w) AS weight FROM wm GROUP BY ALL),
l AS (SELECT *, max(weight) OVER (PARTITION BY support) - weight <= 0.05 AS near FROM ws), k AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY support) AS leaders FROM l), a AS (SELECT c_custkey AS support, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS key, c_acctbal FROM customer),
o AS (SELECT a.support, CASE WHEN c_acctbal >= 8000 THEN 2 WHEN c_acctbal >= 2000 THEN 1 ELSE 0 END AS band, CASE WHEN weight IS NULL THEN 'missing' WHEN NOT near THEN 'retained' WHEN leaders > 1 THEN 'tied' ELSE 'leading' END AS outcome FROM a LEFT JOIN k USING (support, key))
SELECT band, outcome, count(*)::BIGINT AS n FROM o GROUP BY ROLLUP (band, outcome)""",
)
def j10_fusion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an annotated label leads, ties, is kept or is missing, by band of balance, with totals."""
    people = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("support"), F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("key"), "c_acctbal")
    found = annotation_outcomes(people.select("support", "key"), weighted_support(_claims(spark, sf_dir)), 0.05)
    rows = found.join(people.select("support", banded(F.col("c_acctbal"), [2000.0, 8000.0]).alias("band")), "support")
    return rows.rollup("band", "outcome").agg(F.count("*").alias("n"))


@query(
    "j13_mapping_layers",
    f"""WITH {_SQL_CLAIMS}, s0 AS (SELECT o_custkey AS support, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), e AS (SELECT c_custkey AS entity, count(o_orderkey) FILTER (o_totalprice > 1000) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b, bool_or(c_acctbal < 0) AS negative FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
h0 AS (SELECT support, count(DISTINCT key) AS keys FROM c GROUP BY 1), j AS (SELECT coalesce(entity, s0.support) AS entity, e.n AS en, s0.n AS sn, e.a AS ea, s0.a AS sa, e.b AS eb, s0.b AS sb, negative, keys FROM e FULL JOIN s0 ON entity = s0.support LEFT JOIN h0 ON h0.support = s0.support)
SELECT layer, count(*)::BIGINT AS entities, count(*) FILTER (NOT ok)::BIGINT AS broken FROM (SELECT unnest(['contract', 'preservation', 'lineage', 'temporal', 'boundary']) AS layer, unnest([coalesce(en, 0) > 0, coalesce(en = sn, false), sn IS NOT NULL, coalesce(ea = sa AND eb = sb, false), NOT coalesce(negative, false) OR coalesce(keys, 0) > 0]) AS ok FROM j) GROUP BY 1""",
)
def j13_mapping_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities against the supports that they come from, layer by layer: geometry there, none lost, known support, same times, decided labels."""
    orders, people = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), load(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    s = orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("sn"), F.min("o_orderdate").alias("sa"), F.max("o_orderdate").alias("sb"))
    e = people.join(orders, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("entity")).agg(F.count_if(F.col("o_totalprice") > 1000).alias("en"), F.min("o_orderdate").alias("ea"), F.max("o_orderdate").alias("eb"), F.bool_or(F.col("c_acctbal") < 0).alias("negative"))
    keys = hypotheses(_claims(spark, sf_dir)).groupBy(F.col("support").alias("entity")).agg(F.count("*").alias("keys"))
    j = e.join(s, "entity", "full").join(keys, "entity", "left")
    layers = {"contract": F.expr("coalesce(en, 0) > 0"), "preservation": F.expr("coalesce(en = sn, false)"), "lineage": F.expr("sn IS NOT NULL"), "temporal": F.expr("coalesce(ea = sa AND eb = sb, false)"), "boundary": F.expr("NOT coalesce(negative, false) OR coalesce(keys, 0) > 0")}
    each = j.select(F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), ok.alias("ok")) for n, ok in layers.items()])))
    return each.groupBy("layer").agg(F.count("*").alias("entities"), F.count_if(~F.col("ok")).alias("broken"))


@query(
    "j15_cross_stage",
    """WITH p AS (SELECT DISTINCT l_partkey::VARCHAR AS v FROM lineitem), o AS (SELECT DISTINCT l_orderkey::VARCHAR AS v FROM lineitem), c AS (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders), d AS (SELECT DISTINCT doc_id::VARCHAR AS v FROM labels)
SELECT 'geometry_is_known' AS invariant, count(*)::BIGINT AS checked, count(*) FILTER (v NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 5))::BIGINT AS broken, min(v) FILTER (v NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 5)) AS example FROM p
UNION ALL SELECT 'observation_is_known', count(*), count(*) FILTER (v NOT IN (SELECT o_orderkey::VARCHAR FROM orders)), min(v) FILTER (v NOT IN (SELECT o_orderkey::VARCHAR FROM orders)) FROM o
UNION ALL SELECT 'entity_is_known', count(*), count(*) FILTER (v NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0)), min(v) FILTER (v NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0)) FROM c
UNION ALL SELECT 'annotation_is_known', count(*), count(*) FILTER (v NOT IN (SELECT doc_id::VARCHAR FROM documents)), min(v) FILTER (v NOT IN (SELECT doc_id::VARCHAR FROM documents)) FROM d""",
)
def j15_cross_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's references against what the stage before it has."""
    t = lambda name, *columns: load(spark, sf_dir, name, *columns)
    items = t("lineitem", "l_partkey", "l_orderkey")
    return invariant_findings([
        Invariant("geometry_is_known", items, "l_partkey", t("part", "p_partkey", "p_size").filter("p_size > 5"), "p_partkey"),
        Invariant("observation_is_known", items, "l_orderkey", t("orders", "o_orderkey"), "o_orderkey"),
        Invariant("entity_is_known", t("orders", "o_custkey"), "o_custkey", t("customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0"), "c_custkey"),
        Invariant("annotation_is_known", t("labels", "doc_id"), "doc_id", t("documents", "doc_id"), "doc_id"),
    ])


_SQL_REPORT = "r AS (SELECT s_suppkey, ['state.ate.rmse', 'region.iou.mean', 'entity.duplicate.rate', 'runtime.wall_time', 'no.such.metric'][s_nationkey % 5 + 1] AS metric, CASE WHEN s_nationkey < 12 THEN 'entity_resolution' ELSE 'state_estimation' END AS stage, CASE WHEN s_nationkey % 2 = 0 THEN 'ratio' ELSE 'meters' END AS unit, s_acctbal / 5000 AS value FROM supplier), k(metric, st, un) AS (VALUES ('state.ate.rmse', 'state_estimation', 'meters'), ('region.iou.mean', 'region_discovery', 'ratio'), ('entity.duplicate.rate', 'entity_resolution', 'ratio'), ('runtime.wall_time', 'any', 'seconds'))"


@query(
    "j19_report_problems",
    f"""WITH {_SQL_REPORT}, n AS (SELECT *, row_number() OVER (PARTITION BY metric, stage ORDER BY value) AS i FROM r),
p AS (SELECT metric, CASE WHEN un IS NULL THEN 'unknown_metric' WHEN st <> 'any' AND st <> stage THEN 'wrong_stage' WHEN un <> unit THEN 'wrong_unit' WHEN unit = 'ratio' AND NOT value BETWEEN 0 AND 1 OR unit <> 'ratio' AND value < 0 THEN 'out_of_range' WHEN i > 1 THEN 'repeated' END AS problem FROM n LEFT JOIN k USING (metric)) SELECT metric, problem, count(*)::BIGINT AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
)
def j19_report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report made of the suppliers against the registry."""
    rows = load(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal")
    names = F.array(*map(F.lit, ("state.ate.rmse", "region.iou.mean", "entity.duplicate.rate", "runtime.wall_time", "no.such.metric")))
    n = F.col("s_nationkey")
    report = rows.select(F.get(names, (n % 5).cast("int")).alias("metric"), F.when(n < 12, "entity_resolution").otherwise("state_estimation").alias("stage"), F.when(n % 2 == 0, "ratio").otherwise("meters").alias("unit"), (F.col("s_acctbal") / 5000).alias("value"))
    return report_problems(report, metric_registry(spark)).groupBy("metric", "problem").agg(F.count("*").alias("n"))


@query("j17_factorial_cells", "WITH f AS (SELECT DISTINCT o_orderstatus AS s FROM orders), p AS (SELECT DISTINCT o_orderpriority AS p FROM orders), r AS (SELECT r_name AS r FROM region) SELECT p AS priority, r AS region, s AS status FROM f, p, r WHERE NOT (s = 'F' AND p = '1-URGENT' AND r = (SELECT min(r_name) FROM region))")
def j17_factorial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three factors of the tables but the baseline."""
    cells = ablation_cells(_factors(spark, sf_dir), "full")
    return cells.select(*[F.col("cell")[n].alias(n) for n in ("priority", "region", "status")])


@query("j17_one_at_a_time", "WITH x AS (SELECT '1-URGENT' AS priority, (SELECT min(r_name) FROM region) AS region, 'F' AS status) SELECT p.o_orderpriority AS priority, region, status FROM x, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE o_orderpriority <> priority UNION ALL SELECT priority, r_name, status FROM x, region WHERE r_name <> x.region UNION ALL SELECT priority, region, o_orderstatus FROM x, (SELECT DISTINCT o_orderstatus FROM orders) WHERE o_orderstatus <> status")
def j17_one_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ablation_cells(_factors(spark, sf_dir), "one")
    return cells.select(*[F.col("cell")[n].alias(n) for n in ("priority", "region", "status")])


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, regions = load(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority"), load(spark, sf_dir, "region", "r_name")
    of = lambda df, column, name, base: df.select(F.lit(name).alias("factor"), F.col(column).alias("value")).distinct().withColumn("baseline", base)
    first = regions.agg(F.min("r_name").alias("r_name"))
    status, priority = of(orders, "o_orderstatus", "status", F.col("value") == "F"), of(orders, "o_orderpriority", "priority", F.col("value") == "1-URGENT")
    region = of(regions, "r_name", "region", F.lit(False)).join(first, F.col("value") == F.col("r_name"), "left").select("factor", "value", F.col("r_name").isNotNull().alias("baseline"))
    return status.unionByName(priority).unionByName(region)


@query("j21_reproducibility", f"WITH {_SQL_CLAIMS}, a AS (SELECT support, key, count(*) AS claims, count(DISTINCT observation) AS observations FROM c GROUP BY ALL), b AS (SELECT support, key, count(*) AS claims, count(DISTINCT observation) AS observations FROM c WHERE factor < 0.99 GROUP BY ALL) SELECT support, key, observations::BIGINT AS observations, 'first' AS side FROM (SELECT support, key, observations FROM a EXCEPT ALL SELECT support, key, observations FROM b) UNION ALL SELECT support, key, observations::BIGINT, 'second' FROM (SELECT support, key, observations FROM b EXCEPT ALL SELECT support, key, observations FROM a)")
def j21_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all claims against that without the weightiest: what differs, claims and spellings ignored."""
    claims = _claims(spark, sf_dir)
    return differences(hypotheses(claims), hypotheses(claims.filter("factor < 0.99")), ("label", "claims", "primary_observations"))


@query("j16_annotator_agreement")
def j16_annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two annotators matched one to one. The order decides, which SQL has not: tested against a plain loop."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    x, y = F.col("p_size").cast("double"), (F.col("p_retailprice") - 900) % 10
    box = lambda dx, dy: parts.select(F.expr("p_partkey div 20").alias("sample"), F.col("p_partkey").alias("region"), (x + dx).alias("min_x"), (y + dy).alias("min_y"), (x + dx + 12).alias("max_x"), (y + dy + 3).alias("max_y"))
    return match_annotations(box(0.0, 0.0), box(2.0, 0.5), 0.3)


@query("j1_aligned_error")
def j1_aligned_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned, shifted and disturbed, brought back to where they were. The decomposition is not SQL's: tested against the turn that was made."""
    rows = points(spark, sf_dir).select("point", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    moved = rows.withColumns({"x": F.col("rx") * 0.6 - F.col("ry") * 0.8 + 3, "y": F.col("rx") * 0.8 + F.col("ry") * 0.6 - 1, "z": F.col("rz") + F.sin(F.col("point")) / 10})
    found = aligned(moved, *rigid_alignment(moved))
    error = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 + (F.col("z") - F.col("rz")) ** 2)
    return found.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.round(F.max(error), 3).alias("most"))
