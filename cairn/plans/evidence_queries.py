"""Sets, graphs, hypotheses, decisions, labels, vectors and evaluation over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import at_least, cosine, label_key, quaternion_product, ramp, rotation_angle
from cairn.operators.evidence import channel_status, close_relations, demote_inconsistent, hypotheses, resolve, uncertainty, weighted_support
from cairn.operators.graphs import components, overlaps
from cairn.plans.registry import query
from cairn.plans.tables import load


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sets of parts."""
    return load(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("member"))


_SQL_OVERLAPS = """m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM m GROUP BY 1),
i AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM m x JOIN m y ON x.p = y.p AND x.s < y.s GROUP BY ALL),
o AS (SELECT a, b, shared, shared / (na.n + nb.n - shared) AS jaccard FROM i JOIN n na ON na.s = a JOIN n nb ON nb.s = b)"""


@query("c19_jaccard_pairs", f"WITH {_SQL_OVERLAPS} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM o WHERE jaccard >= 0.17")
def c19_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_members(spark, sf_dir), 0.17).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "g2_overlap_components",
    f"""WITH RECURSIVE {_SQL_OVERLAPS}, e AS (SELECT a, b FROM o WHERE jaccard >= 0.18 UNION SELECT b, a FROM o WHERE jaccard >= 0.18),
r(node, reach) AS (SELECT s, s FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY 1""",
)
def g2_overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return components(members.select(F.col("set").alias("node")), overlaps(members, 0.18).select("a", "b"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as supports, their order months as observations, priorities as labels; urgent ones are alternatives."""
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey", "o_totalprice")
    role = F.when(F.col("o_orderpriority").startswith("1"), "alternative").otherwise("primary")
    return o.select(
        F.col("o_custkey").alias("support"), F.date_trunc("month", "o_orderdate").cast("date").alias("observation"), label_key(F.substring("o_orderpriority", 3, 99)).alias("key"), F.col("o_orderpriority").alias("label"), role.alias("role"),
        F.col("o_orderkey").alias("contribution"), ramp(F.col("o_totalprice"), 1000.0, 200000.0).alias("factor"),
    )


_SQL_CLAIMS = r"""c AS (SELECT o_custkey AS support, date_trunc('month', o_orderdate)::DATE AS observation, trim(regexp_replace(lower(substr(o_orderpriority, 3)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, o_orderpriority AS label,
  CASE WHEN starts_with(o_orderpriority, '1') THEN 'alternative' ELSE 'primary' END AS role, o_orderkey AS contribution, greatest(0.0, least(1.0, (o_totalprice - 1000.0) / 199000.0)) AS factor FROM orders),
n AS (SELECT support, key, label, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT support, key, label, row_number() OVER (PARTITION BY support, key ORDER BY n DESC, label) AS r FROM n),
h AS (SELECT support, key, count(*)::BIGINT AS claims, count(DISTINCT observation)::BIGINT AS observations, count(DISTINCT observation) FILTER (role = 'primary')::BIGINT AS primary_observations FROM c GROUP BY ALL)"""


@query("d5_hypotheses", f"WITH {_SQL_CLAIMS} SELECT support, key, label, claims, observations, primary_observations FROM h JOIN s USING (support, key) WHERE r = 1")
def d5_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses(_claims(spark, sf_dir))


@query(
    "d6_uncertainty",
    f"""WITH {_SQL_CLAIMS}, l AS (SELECT *, max(observations) OVER (PARTITION BY support) AS lead FROM h),
u AS (SELECT support, count(*) AS n, count(*) FILTER (primary_observations > 0) AS p, sum(primary_observations) AS seen, count(*) FILTER (lead - observations <= 1) AS close FROM l GROUP BY 1)
SELECT support, 'contradiction' AS kind FROM u WHERE p >= 2 AND seen >= 2 UNION ALL SELECT support, 'ambiguity' FROM u WHERE n >= 2 AND NOT (p >= 2 AND seen >= 2) UNION ALL SELECT support, 'near_tie' FROM u WHERE close >= 2""",
)
def d6_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty(hypotheses(_claims(spark, sf_dir)), 1)


@query(
    "d7_quality_weighting",
    f"""WITH {_SQL_CLAIMS}, w AS (SELECT support, key, observation, contribution, min(factor) AS w FROM c GROUP BY ALL), m AS (SELECT support, key, observation, avg(w) AS w FROM w GROUP BY ALL)
SELECT support, key, round(sum(w), 6) AS weight, count(*)::BIGINT AS observations FROM m GROUP BY ALL""",
)
def d7_quality_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_support(_claims(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("d4_physical_groups", f"WITH {_SQL_CLAIMS} SELECT support, observation::VARCHAR AS observation, count(*)::BIGINT AS claims, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM c GROUP BY ALL")
def d4_physical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).groupBy("support", F.col("observation").cast("string").alias("observation")).agg(F.count("*").alias("claims"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def _findings() -> tuple[Column, Column, Column]:
    p, s = F.col("p_retailprice"), F.col("p_size")
    geometry = F.array_compact(F.array(F.when(s <= 20, "supports"), F.when(s >= 45, "conflicts"), F.when((s > 20) & (s < 45), "neutral")))
    semantic = F.array_compact(F.array(F.when(p < 930, "supports"), F.when(p > 960, "conflicts")))
    temporal = F.array_compact(F.array(F.when(F.col("p_partkey") % 7 == 0, "conflicts"), F.when(F.col("p_partkey") % 3 == 0, "supports")))
    return geometry, semantic, temporal


@query(
    "i8_staged_resolution",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'supports' WHEN p_size >= 45 THEN 'conflicts' ELSE 'neutral' END AS geometry,
  CASE WHEN p_retailprice > 960 THEN 'conflicts' WHEN p_retailprice < 930 THEN 'supports' ELSE 'unavailable' END AS semantic,
  CASE WHEN p_partkey % 7 = 0 THEN 'conflicts' WHEN p_partkey % 3 = 0 THEN 'supports' ELSE 'unavailable' END AS temporal FROM part),
v AS (SELECT *, (geometry = 'supports')::INT + (semantic = 'supports')::INT + (temporal = 'supports')::INT AS s, (geometry = 'conflicts')::INT + (semantic = 'conflicts')::INT + (temporal = 'conflicts')::INT AS c FROM f),
d AS (SELECT *, CASE WHEN s > 0 AND c > 0 THEN 'unresolved' WHEN geometry = 'supports' AND c = 0 AND s >= 2 THEN 'match' WHEN geometry = 'conflicts' AND s = 0 THEN 'distinct' ELSE 'unresolved' END AS decision FROM v)
SELECT p_partkey, geometry, semantic, temporal, decision, CASE WHEN s > 0 AND c > 0 THEN 'conflicting' WHEN decision = 'unresolved' THEN 'insufficient' END AS reason FROM d""",
)
def i8_staged_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    statuses = parts.select("p_partkey", *[channel_status(f).alias(n) for n, f in zip(("geometry", "semantic", "temporal"), _findings(), strict=True)])
    decision, reason = resolve(F.col("geometry"), [F.col("semantic"), F.col("temporal")], 2)
    return statuses.withColumn("decision", decision).withColumn("reason", reason)


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order are related, by the first one's return flag; those of large quantities are supported."""
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    flag = F.col("l_returnflag")
    first = items.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("subject"), F.when(flag == "A", "above").when(flag == "N", "inside").otherwise("next_to").alias("predicate"), F.when(F.col("l_quantity") >= 25, "supported").otherwise("unresolved").alias("state"))
    return first.join(items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("object")), ["l_orderkey", "l_linenumber"])


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).groupBy("subject", "predicate", "object").agg(F.min("state").alias("state"))


_SQL_FOLLOW = "fo AS (SELECT a.l_partkey AS subject, CASE a.l_returnflag WHEN 'A' THEN 'above' WHEN 'N' THEN 'inside' ELSE 'next_to' END AS predicate, b.l_partkey AS object, CASE WHEN a.l_quantity >= 25 THEN 'supported' ELSE 'unresolved' END AS state FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
_SQL_RELATIONS = f"{_SQL_FOLLOW}, r AS (SELECT subject, predicate, object, min(state) AS state FROM fo GROUP BY ALL)"
_INVERSE = {"above": "below", "inside": "contains", "next_to": "next_to"}


@query("g10_inverse_closure", f"WITH {_SQL_RELATIONS} SELECT subject, predicate, object, state FROM r UNION SELECT object, CASE predicate WHEN 'above' THEN 'below' WHEN 'inside' THEN 'contains' ELSE 'next_to' END, subject, state FROM r")
def g10_inverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_relations(_relations(spark, sf_dir), _INVERSE)


@query(
    "i16_relation_decision",
    f"WITH {_SQL_RELATIONS} SELECT subject, predicate, object, CASE WHEN state = 'supported' AND EXISTS (SELECT 1 FROM r o WHERE o.subject = r.object AND o.object = r.subject AND o.predicate = r.predicate AND o.state = 'supported') THEN 'unresolved' ELSE state END AS state FROM r",
)
def i16_relation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demote_inconsistent(_relations(spark, sf_dir))


@query("a16_adjacency_index", f"WITH {_SQL_RELATIONS} SELECT subject AS entity, count(*)::BIGINT AS as_subject, array_to_string(list_sort(list_distinct(list(object))), ',') AS objects FROM r GROUP BY 1")
def a16_adjacency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("as_subject"), F.array_join(F.array_sort(F.collect_set("object")).cast("array<string>"), ",").alias("objects"))


@query("b13_label_keys", r"SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM part")
def b13_label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part", "p_partkey", "p_type", "p_name").select("p_partkey", label_key(F.concat("p_type", F.lit(" / "), "p_name")).alias("key"))


@query("b16_tolerant_threshold", "SELECT p_partkey, CASE WHEN p_retailprice - 5 >= 950 THEN 'meets' WHEN p_retailprice + 5 < 950 THEN 'fails' ELSE 'within_tolerance' END AS verdict, round(greatest(0.0, least(1.0, (p_retailprice - 990) / (910 - 990))), 6) AS factor FROM part")
def b16_tolerant_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return load(spark, sf_dir, "part", "p_partkey", "p_retailprice").select("p_partkey", at_least(price, 950.0, 5.0).alias("verdict"), F.round(ramp(price, 990.0, 910.0), 6).alias("factor"))


@query(
    "d21_prototype_cosine",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS e FROM u), m AS (SELECT label, i, avg(e) AS e FROM x GROUP BY ALL), p AS (SELECT label, list(e ORDER BY i) AS p FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.p, b.p), 6) AS cosine FROM p a JOIN p b ON a.label < b.label""",
)
def d21_prototype_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors, their mean per label, and the cosine of all pairs of labels (a few, whatever the vectors)."""
    rows = load(spark, sf_dir, "embeddings", "label", "embedding").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    unit = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("n > 0")
    means = unit.select("label", F.posexplode("v").alias("i", "e"), "n").groupBy("label", "i").agg(F.avg(F.col("e") / F.col("n")).alias("e"))
    protos = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("p"))
    a, b = protos.select(F.col("label").alias("a"), F.col("p").alias("pa")), protos.select(F.col("label").alias("b"), F.col("p").alias("pb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("pa"), F.col("pb")), 6).alias("cosine"))


@query(
    "h1_rotation_angle",
    "SELECT p_partkey, round(2 * atan2(sin((p_size % 50) / 40.0) * 1.0, abs(cos((p_size % 50) / 40.0))), 6) AS angle FROM part",
)
def h1_rotation_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns by half the angle about one axis are the whole turn."""
    half = (F.col("p_size") % 50) / F.lit(80.0)
    q = (F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))
    x, y, z, w = quaternion_product(q, q)
    return load(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.round(rotation_angle((x, y, z, w)), 6).alias("angle"))


@query(
    "j8_banded_strata",
    """SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS band, l_returnflag, count(*)::BIGINT AS n, round(avg(l_discount), 6) AS mean FROM lineitem
GROUP BY ROLLUP (band, l_returnflag)""",
)
def j8_banded_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    band = F.when(q < 10, 0).when(q < 25, 1).when(q < 40, 2).otherwise(3)
    rows = load(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag", "l_discount").withColumn("band", band)
    return rows.rollup("band", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query(
    "j11_precision_recall",
    """WITH p AS (SELECT doc_id, quality = 1 AS truth, n_chars >= 600 AS predicted FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM p)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c""",
)
def j11_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates are null where nothing was counted."""
    pairs = load(spark, sf_dir, "documents", "doc_id", "n_chars").join(load(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    truth, said = F.col("quality") == 1, F.col("n_chars") >= 600
    c = pairs.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    return c.select("tp", "fp", "fn", F.round(F.expr("try_divide(tp, tp + fp)"), 6).alias("precision"), F.round(F.expr("try_divide(tp, tp + fn)"), 6).alias("recall"))


@query(
    "j18_arm_effects",
    """WITH m AS (SELECT l_shipmode_ AS stratum, avg(l_extendedprice) FILTER (arm = 0) AS base, avg(l_extendedprice) FILTER (arm = 1) AS variant, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1) AS n1
  FROM (SELECT l_linenumber AS l_shipmode_, l_orderkey % 2 AS arm, l_extendedprice FROM lineitem) GROUP BY 1)
SELECT stratum, round(variant - base, 4) AS change, CASE WHEN n0 < 30 OR n1 < 30 THEN 'not_comparable' WHEN abs(variant - base) <= 200 THEN 'unchanged' WHEN variant < base THEN 'improved' ELSE 'regressed' END AS effect FROM m""",
)
def j18_arm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem", "l_linenumber", "l_orderkey", "l_extendedprice").withColumn("arm", F.col("l_orderkey") % 2)
    mean, n = (lambda k: F.avg(F.when(F.col("arm") == k, F.col("l_extendedprice")))), (lambda k: F.count_if(F.col("arm") == k))
    m = rows.groupBy(F.col("l_linenumber").alias("stratum")).agg((mean(1) - mean(0)).alias("d"), n(0).alias("n0"), n(1).alias("n1"))
    effect = F.when((F.col("n0") < 30) | (F.col("n1") < 30), "not_comparable").when(F.abs("d") <= 200, "unchanged").when(F.col("d") < 0, "improved").otherwise("regressed")
    return m.select("stratum", F.round("d", 4).alias("change"), effect.alias("effect"))


@query("h8_set_digest", "SELECT l_suppkey AS entity, sha256(array_to_string(list_sort(list_distinct(list(l_partkey))), chr(10))) AS digest FROM lineitem GROUP BY 1")
def h8_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a set in whatever order it comes."""
    rows = load(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    return rows.groupBy(F.col("l_suppkey").alias("entity")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), "\n"), 256).alias("digest"))


@query("b5_referential_check", "SELECT DISTINCT l_suppkey AS unknown FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def b5_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0")
    rows = load(spark, sf_dir, "lineitem", "l_suppkey")
    return rows.join(known, rows["l_suppkey"] == known["s_suppkey"], "left_anti").select(F.col("l_suppkey").alias("unknown")).distinct()


@query("b7_admission_cascade", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'missing' WHEN o_totalprice < 5000 THEN 'too_small' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'bad_state' WHEN o_custkey % 11 = 0 THEN 'excluded' END AS reject_reason FROM orders")
def b7_admission_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that applies; null where admitted."""
    price = F.col("o_totalprice")
    reason = F.when(price.isNull(), "missing").when(price < 5000, "too_small").when(~F.col("o_orderstatus").isin("F", "O"), "bad_state").when(F.col("o_custkey") % 11 == 0, "excluded")
    return load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey").select("o_orderkey", reason.alias("reject_reason"))
