"""Entities compared: candidates, gates, channels, distances, splits and materialisation, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.channels import GeometryPolicy, SplitPolicy, blocked, box_measures, gates, geometry_findings, semantic_findings, semantic_sides, similarity_channel, split_candidates, status_of, support_distances
from cairn.operators.evidence import materialize
from cairn.operators.graphs import cut
from cairn.operators.spatial_joins import dealt, entity_candidates, gathered
from cairn.plans.registry import query
from cairn.plans.tables import SQL_ENTITY_BOXES, SQL_ENTITY_POINTS, entity_boxes, entity_points, load, micros, side

_BOX = [f"{m}_{a}" for a in "xyz" for m in ("min", "max")]
_DAY = 86_400_000_000

# entities with map, frame and time: of a part's items, the brands' first digit parts the maps
_SQL_PLACED = f"""{SQL_ENTITY_BOXES}, et AS (SELECT p_partkey // 8 AS entity, min(epoch_us(l_shipdate)) AS first_t, max(epoch_us(l_shipdate)) AS last_t, min(p_type) AS map FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1),
en AS (SELECT * FROM eb JOIN et USING (entity)),
cp AS (SELECT a.entity AS a, b.entity AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) AS apart,
  sqrt(greatest(0, a.min_x - b.max_x, b.min_x - a.max_x) ** 2 + greatest(0, a.min_y - b.max_y, b.min_y - a.max_y) ** 2 + greatest(0, a.min_z - b.max_z, b.min_z - a.max_z) ** 2) AS gap
  FROM en a JOIN en b ON a.entity < b.entity AND a.map = b.map AND greatest(a.first_t, b.first_t) - least(a.last_t, b.last_t) <= {30 * _DAY}),
ca AS (SELECT a, b, concat_ws(',', CASE WHEN apart <= 3 THEN 'near_centroids' END, CASE WHEN gap <= 0.05 THEN 'near_bounds' END) AS reasons FROM cp WHERE apart <= 3 OR gap <= 0.05)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate").select("l_partkey", micros("l_shipdate").alias("t"))
    parts = load(spark, sf_dir, "part", "p_partkey", "p_type")
    times = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.expr("p_partkey div 8").alias("entity")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("p_type").alias("map"))
    return entity_boxes(spark, sf_dir).join(times, "entity").withColumn("frame", F.lit("map"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_candidates(_placed(spark, sf_dir), 3.0, 0.05, 30 * _DAY)


@query("c13_entity_candidates", f"WITH {_SQL_PLACED} SELECT a, b, reasons FROM ca")
def c13_entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near by centroid or by box, on one map, and not too far apart in time."""
    return _pairs(spark, sf_dir).select("a", "b", F.array_join("reasons", ",").alias("reasons"))


@query("i1_comparison_gates", "WITH p AS (SELECT p_partkey AS a, p_partkey + 1 - (p_size = 1)::INT AS b, p_type AS ta FROM part) SELECT a, b, a <> b AS distinct_entities, ta = t.p_type AS same_map, true AS same_frame, NOT (a <> b AND ta = t.p_type) AS blocked FROM p JOIN part t ON t.p_partkey = b")
def i1_comparison_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the next, the smallest with themselves; types are the maps."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    first = parts.select(F.col("p_partkey").alias("a_entity"), F.col("p_type").alias("a_map"), F.lit("map").alias("a_frame"), (F.col("p_partkey") + 1 - (F.col("p_size") == 1).cast("int")).alias("b_entity"))
    both = first.join(parts.select(F.col("p_partkey").alias("b_entity"), F.col("p_type").alias("b_map"), F.lit("map").alias("b_frame")), "b_entity").withColumn("g", gates())
    return both.select(F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), *[F.col("g")[i]["passed"].alias(n) for i, n in enumerate(("distinct_entities", "same_map", "same_frame"))], blocked(F.col("g")).alias("blocked"))


_SQL_MEASURED = f"""{_SQL_PLACED}, o AS (SELECT ca.a, ca.b, greatest(0, least(x.max_x, y.max_x) - greatest(x.min_x, y.min_x)) * greatest(0, least(x.max_y, y.max_y) - greatest(x.min_y, y.min_y)) * greatest(0, least(x.max_z, y.max_z) - greatest(x.min_z, y.min_z)) AS both_,
  (x.max_x - x.min_x) * (x.max_y - x.min_y) * (x.max_z - x.min_z) AS va, (y.max_x - y.min_x) * (y.max_y - y.min_y) * (y.max_z - y.min_z) AS vb, gap,
  [[x.max_x - x.min_x, y.max_x - y.min_x], [x.max_y - x.min_y, y.max_y - y.min_y], [x.max_z - x.min_z, y.max_z - y.min_z]] AS e FROM ca JOIN cp USING (a, b) JOIN eb x ON x.entity = ca.a JOIN eb y ON y.entity = ca.b),
r AS (SELECT *, CASE WHEN va > 0 AND vb > 0 THEN both_ / (va + vb - both_) END AS iou, CASE WHEN va > 0 THEN both_ / va END AS share_a, CASE WHEN vb > 0 THEN both_ / vb END AS share_b,
  list_transform(e, lambda p: CASE WHEN list_max(p) = 0 THEN 1.0 WHEN list_min(p) > 0 THEN list_min(p) / list_max(p) END) AS q FROM o),
m AS (SELECT *, CASE WHEN q[1] IS NOT NULL AND q[2] IS NOT NULL AND q[3] IS NOT NULL THEN list_min(q) END AS ratio, coalesce(greatest(share_a, share_b) >= 0.8, false) AS inside FROM r)"""


@query(
    "i2_geometry_findings",
    f"""WITH {_SQL_MEASURED}, s AS (SELECT ca.a, ca.b, count(*) AS n FROM ca JOIN part p ON p.p_partkey // 8 = a JOIN part q ON q.p_partkey // 8 = b AND q.p_name = p.p_name AND q.p_brand = p.p_brand GROUP BY ALL),
f AS (SELECT a, b, CASE WHEN coalesce(n, 0) >= 1 THEN 'supports' ELSE 'neutral' END AS shared, CASE WHEN coalesce(iou, -1) >= 0.25 THEN 'supports' ELSE 'neutral' END AS overlap, CASE WHEN inside AND coalesce(ratio, 0) >= 0.5 THEN 'supports' ELSE 'neutral' END AS contained,
  CASE WHEN gap >= 0.5 THEN 'conflicts' ELSE 'neutral' END AS apart, CASE WHEN coalesce(ratio, 1) < 0.5 AND NOT inside THEN 'conflicts' ELSE 'neutral' END AS mismatch FROM m LEFT JOIN s USING (a, b))
SELECT a, b, concat_ws(',', shared, overlap, contained, apart, mismatch) AS findings, CASE WHEN 'conflicts' IN (apart, mismatch) THEN 'conflicts' WHEN 'supports' IN (shared, overlap, contained) THEN 'supports' ELSE 'neutral' END AS status FROM f""",
)
def i2_geometry_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules on boxes and shared support; parts of one name and brand count as shared."""
    pairs = _pairs(spark, sf_dir).select("a", "b")
    parts = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(F.expr("p_partkey div 8").alias("entity"), "p_name", "p_brand")
    common = pairs.join(parts.withColumnRenamed("entity", "a"), "a").join(parts.withColumnRenamed("entity", "b"), ["b", "p_name", "p_brand"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    boxes = entity_boxes(spark, sf_dir).select("entity", *_BOX)
    rows = pairs.join(side(boxes, "a_", "a"), "a").join(side(boxes, "b_", "b"), "b").withColumns(box_measures()).join(common, ["a", "b"], "left").withColumn("jaccard", F.coalesce("n", F.lit(0)).cast("double"))
    rows = rows.withColumn("f", geometry_findings(GeometryPolicy(jaccard=1.0)))
    return rows.select("a", "b", F.array_join(F.transform("f", lambda f: f["status"]), ",").alias("findings"), status_of(F.col("f")).alias("status"))


@query(
    "c18_support_distance",
    f"""WITH {_SQL_PLACED}, s AS (SELECT entity, x, y, z, point, (row_number() OVER (PARTITION BY entity ORDER BY point) - 1) AS i, count(*) OVER (PARTITION BY entity) AS n FROM ep),
k AS (SELECT * FROM s WHERE n <= 5 OR list_contains(list_transform(range(5), lambda j: round_even(j * (n - 1) / 4.0, 0)::INT), i::INT)),
d AS (SELECT ca.a, ca.b, p.point AS p, q.point AS q, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM ca JOIN k p ON p.entity = a JOIN k q ON q.entity = b),
x AS (SELECT a, b, avg(d) AS m, max(d) AS h FROM (SELECT a, b, p, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL), y AS (SELECT a, b, avg(d) AS m, max(d) AS h FROM (SELECT a, b, q, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL)
SELECT a, b, round(x.m, 6) AS a_to_b, round(y.m, 6) AS b_to_a, round(greatest(x.h, y.h), 6) AS hausdorff FROM x JOIN y USING (a, b)""",
)
def c18_support_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = support_distances(_pairs(spark, sf_dir).select("a", "b"), entity_points(spark, sf_dir), 5)
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("a_to_b", "b_to_a", "hausdorff")])


@query(
    "i3_semantic_channel",
    f"""WITH {_SQL_PLACED}, l AS (SELECT DISTINCT p_partkey // 8 AS entity, p_name AS label FROM part WHERE p_size > 10), u AS (SELECT entity, CASE WHEN count(*) <= 6 THEN 'unambiguous' ELSE 'ambiguous' END AS state FROM l GROUP BY 1),
v AS (SELECT DISTINCT p_partkey // 8 AS entity, p_brand AS name, lower(p_type) AS value FROM part),
g AS (SELECT a, b, bool_or(x.label = y.label) AS alike, bool_or((x.label = 'red widget' AND y.label = 'blue bolt') OR (x.label = 'blue bolt' AND y.label = 'red widget')) AS related FROM ca JOIN l x ON x.entity = a JOIN l y ON y.entity = b GROUP BY ALL),
h AS (SELECT a, b, bool_or(x.value <> y.value) AS differ FROM ca JOIN v x ON x.entity = a JOIN v y ON y.entity = b AND x.name = y.name GROUP BY ALL),
f AS (SELECT ca.a, ca.b, CASE WHEN alike IS NULL THEN NULL WHEN alike THEN 'supports' WHEN related THEN 'neutral' WHEN x.state = 'unambiguous' AND y.state = 'unambiguous' THEN 'conflicts' ELSE 'neutral' END AS label_finding, CASE WHEN alike IS NOT NULL AND differ IS NOT NULL THEN CASE WHEN differ THEN 'conflicts' ELSE 'neutral' END END AS attribute_finding
  FROM ca LEFT JOIN g USING (a, b) LEFT JOIN h USING (a, b) LEFT JOIN u x ON x.entity = ca.a LEFT JOIN u y ON y.entity = ca.b)
SELECT *, CASE WHEN label_finding IS NULL AND attribute_finding IS NULL THEN 'unavailable' WHEN 'conflicts' IN (coalesce(label_finding, ''), coalesce(attribute_finding, '')) THEN 'conflicts' WHEN label_finding = 'supports' THEN 'supports' ELSE 'neutral' END AS status FROM f""",
)
def i3_semantic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all but small parts are an entity's labels; of one brand's parts the types are the values of an attribute. Entities that are alike
    in all that is compared meet others once, and what is compared goes with them."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand", "p_type").withColumn("entity", F.expr("p_partkey div 8"))
    labels = parts.filter("p_size > 10").select("entity", F.col("p_name").alias("label")).distinct()
    states = labels.groupBy("entity").agg(F.when(F.count("*") <= 6, "unambiguous").otherwise("ambiguous").alias("state"))
    attributes = parts.select("entity", F.col("p_brand").alias("name"), F.col("p_type").alias("value"))
    sides = semantic_sides(labels, states, attributes, ["ancient"])
    alike = gathered(_placed(spark, sf_dir).join(sides.hint("merge"), "entity", "left"), "entity")
    alike = cut(alike.withColumnRenamed("entity", "entities").withColumn("entity", F.element_at("entities", 1)))
    pairs = entity_candidates(alike, 3.0, 0.05, 30 * _DAY, ("entities", *[c for c in sides.columns if c != "entity"]), themselves=True)
    found = dealt(pairs.select("a_entities", "b_entities", *semantic_findings([("red widget", "blue bolt")]), (F.col("a") == F.col("b")).alias("_own")), "a_entities", "b_entities")
    found = found.filter("NOT _own OR a_entities < b_entities").drop("_own")
    return found.withColumns({"a": F.least("a_entities", "b_entities"), "b": F.greatest("a_entities", "b_entities")}).select("a", "b", "label_finding", "attribute_finding", "status")


# vectors: of a label's vectors, five by five an entity, two spaces, observations in between
_SQL_FEATURES = """fe AS (SELECT vec_id // 5 AS entity, vec_id // 2 AS observation, CASE WHEN label = 3 THEN 'other' ELSE 'own' END AS space, embedding::DOUBLE[] AS vector FROM embeddings),
pr AS (SELECT a.entity AS a, a.entity + 1 AS b FROM (SELECT DISTINCT entity FROM fe) a)"""


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    features = rows.select(F.expr("vec_id div 5").alias("entity"), F.expr("vec_id div 2").alias("observation"), F.when(F.col("label") == 3, "other").otherwise("own").alias("space"), F.col("embedding").cast("array<double>").alias("vector"))
    return features, features.select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b")).distinct()


@query(
    "i5_appearance_channel",
    f"""WITH {_SQL_FEATURES}, w AS (SELECT entity, observation, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS v FROM fe WHERE space = 'own'), x AS (SELECT entity, observation, generate_subscripts(v, 1) AS i, unnest(v) AS e FROM w),
o AS (SELECT entity, observation, list(e ORDER BY i) AS v FROM (SELECT entity, observation, i, avg(e) AS e FROM x GROUP BY ALL) GROUP BY ALL), n AS (SELECT entity, observation, list_transform(v, lambda t: t / sqrt(list_dot_product(v, v))) AS v FROM o),
y AS (SELECT entity, generate_subscripts(v, 1) AS i, unnest(v) AS e FROM n), p AS (SELECT entity, list(e ORDER BY i) AS v FROM (SELECT entity, i, avg(e) AS e FROM y GROUP BY ALL) GROUP BY 1),
h AS (SELECT entity, bool_or(space = 'own') AS own FROM fe GROUP BY 1),
kk AS (SELECT a, b, min(list_cosine_similarity(u.v, w.v)) AS lo, max(list_cosine_similarity(u.v, w.v)) AS hi FROM pr JOIN n u ON u.entity = a JOIN n w ON w.entity = b GROUP BY ALL),
r AS (SELECT pr.a, pr.b, list_cosine_similarity(pa.v, pb.v) AS s, kk.lo, kk.hi, CASE WHEN ha.own IS NULL OR hb.own IS NULL THEN 'missing_evidence' WHEN NOT ha.own OR NOT hb.own THEN 'incompatible_domain' END AS reason
  FROM pr LEFT JOIN h ha ON ha.entity = pr.a LEFT JOIN h hb ON hb.entity = pr.b LEFT JOIN p pa ON pa.entity = pr.a LEFT JOIN p pb ON pb.entity = pr.b LEFT JOIN kk ON kk.a = pr.a AND kk.b = pr.b)
SELECT a, b, CASE WHEN reason IS NULL THEN round(s, 6) END AS similarity, CASE WHEN reason IS NULL THEN round(lo, 6) END AS pair_min, CASE WHEN reason IS NULL THEN round(hi, 6) END AS pair_max, reason,
  CASE WHEN reason IS NOT NULL THEN 'unavailable' WHEN s >= 0.2 THEN 'supports' WHEN s <= -0.1 THEN 'conflicts' ELSE 'neutral' END AS status FROM r""",
)
def i5_appearance_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity against the next; the last has no next, which is missing evidence."""
    features, pairs = _features(spark, sf_dir)
    found = similarity_channel(pairs, features, "own", 0.2, -0.1)
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("similarity", "pair_min", "pair_max")], "reason", "status")


@query(
    "i6_representation_channel",
    f"""WITH {_SQL_FEATURES}, x AS (SELECT entity, i, CASE WHEN e > -0.15 THEN e END AS e FROM (SELECT entity, unnest(vector) AS e, generate_subscripts(vector, 1) AS i FROM fe WHERE space = 'own')), p AS (SELECT entity, i, avg(e) AS e FROM x GROUP BY ALL), h AS (SELECT entity, bool_or(space = 'own') AS own FROM fe GROUP BY 1),
c AS (SELECT a, b, sum(u.e * v.e) / sqrt(sum(u.e ** 2) FILTER (v.e IS NOT NULL) * sum(v.e ** 2) FILTER (u.e IS NOT NULL)) AS s, count(u.e * v.e) / 64 AS share FROM pr JOIN p u ON u.entity = a JOIN p v ON v.entity = b AND u.i = v.i GROUP BY ALL),
r AS (SELECT pr.a, pr.b, c.s, CASE WHEN ha.own IS NULL OR hb.own IS NULL THEN 'missing_evidence' WHEN NOT ha.own OR NOT hb.own THEN 'incompatible_domain' WHEN c.s IS NULL OR share < 0.97 THEN 'insufficient_evidence' END AS reason
  FROM pr LEFT JOIN h ha ON ha.entity = pr.a LEFT JOIN h hb ON hb.entity = pr.b LEFT JOIN c ON c.a = pr.a AND c.b = pr.b)
SELECT a, b, CASE WHEN reason IS NULL THEN round(s, 6) END AS similarity, reason, CASE WHEN reason IS NOT NULL THEN 'unavailable' WHEN s >= 0.2 THEN 'supports' ELSE 'neutral' END AS status FROM r""",
)
def i6_representation_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components under -0.15 count as not defined; two prototypes must share 97 of a hundred."""
    features, pairs = _features(spark, sf_dir)
    features = features.withColumn("vector", F.transform("vector", lambda x: F.when(x > -0.15, x)))
    found = similarity_channel(pairs, features, "own", 0.2, by_observation=False, least_share=0.97)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"), "reason", "status")


@query(
    "i9_split_detection",
    f"""WITH RECURSIVE {SQL_ENTITY_POINTS}, l AS (SELECT p.point AS a, q.point AS b FROM ep p JOIN ep q ON p.entity = q.entity AND p.point <> q.point AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 100),
c(node, reach) AS (SELECT point, point FROM ep UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reach), k AS (SELECT node, min(reach) AS piece FROM c GROUP BY 1),
s AS (SELECT entity, piece, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM ep JOIN k ON node = point GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY entity) AS total FROM s), g AS (SELECT *, n >= 2 AND n / total >= 0.2 AS large FROM t),
d AS (SELECT p.entity, min(sqrt(greatest(0, p.x0 - q.x1, q.x0 - p.x1) ** 2 + greatest(0, p.y0 - q.y1, q.y0 - p.y1) ** 2 + greatest(0, p.z0 - q.z1, q.z0 - p.z1) ** 2)) AS gap FROM g p JOIN g q ON p.entity = q.entity AND p.piece < q.piece AND p.large AND q.large GROUP BY 1),
e AS (SELECT entity, count(*) AS pieces, count(*) FILTER (large) AS significant, max(n) / max(total) AS dominant FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT entity, pieces::BIGINT AS pieces, significant::BIGINT AS significant, round(gap, 6) AS gap, round(dominant, 6) AS dominant, CASE WHEN significant < 2 THEN 'rejected' WHEN gap < 13 OR dominant > 0.7 THEN 'unresolved' ELSE 'suggested' END AS status FROM e LEFT JOIN d USING (entity)""",
)
def i9_split_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_candidates(entity_points(spark, sf_dir), SplitPolicy(10.0, 2, 0.2, 13.0, 0.7))
    return found.select("entity", "pieces", "significant", F.round("gap", 6).alias("gap"), F.round("dominant", 6).alias("dominant"), "status")


@query(
    "i11_materialization",
    """WITH s AS (SELECT c_custkey AS support, count(o_orderkey) AS refs, count(k.l_orderkey) AS known, min(epoch_us(o_orderdate)) FILTER (o_orderstatus <> 'P') AS first_t, max(epoch_us(o_orderdate)) FILTER (o_orderstatus <> 'P') AS last_t, max(c_acctbal) AS label FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) k ON l_orderkey = o_orderkey GROUP BY 1)
SELECT support, CASE WHEN refs = 0 THEN 'empty_geometry' WHEN known < refs THEN 'unresolvable_geometry' WHEN first_t IS NULL OR last_t < first_t THEN 'invalid_temporal_evidence' WHEN label < 0 THEN 'invalid_entity' END AS rejection, CASE WHEN refs > 0 AND known = refs AND first_t IS NOT NULL AND label >= 0 THEN 'entity-' || support END AS entity FROM s""",
)
def i11_materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are supports, their orders the geometry; an order without items cannot be resolved, pending ones have no time."""
    customers, orders = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    items = load(spark, sf_dir, "lineitem", "l_orderkey").distinct()
    rows = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    t = F.when(F.col("o_orderstatus") != "P", micros("o_orderdate"))
    supports = rows.groupBy(F.col("c_custkey").alias("support")).agg(F.count("o_orderkey").alias("refs"), F.count("l_orderkey").alias("resolved"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), (F.max("c_acctbal") >= 0).alias("valid"))
    return materialize(supports)
