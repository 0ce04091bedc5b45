"""Errors, agreements and verdicts measured over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import at_least
from cairn.operators.spatial_joins import within_radius
from cairn.operators.time_joins import nearest_record
from cairn.plans.evidence_queries import _SQL_RELATIONS, _relations
from cairn.plans.registry import query
from cairn.plans.spatial_queries import _SQL_PARTS, _parts
from cairn.plans.tables import SQL_POINTS, events, load, points
from cairn.plans.time_queries import _PLACED, HOUR, _placed


@query(
    "b11_coordinate_chain",
    f"WITH {SQL_POINTS}, m AS (SELECT point, (x * 12 - 16 + 0.5) * 0.5 - 0.5 AS u, (y * 40 - 8 + 0.5) * 0.5 - 0.5 AS v FROM points) SELECT point, u, v, u >= -0.5 AND u < 255.5 AND v >= -0.5 AND v < 159.5 AS inside FROM m",
)
def b11_coordinate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pixels cropped, then halved about the pixels' centres; the prepared image's extent is half-open."""
    prepared = lambda raw, crop: (raw - crop + 0.5) * 0.5 - 0.5
    rows = points(spark, sf_dir).select("point", prepared(F.col("x") * 12, 16).alias("u"), prepared(F.col("y") * 40, 8).alias("v"))
    return rows.withColumn("inside", F.expr("u >= -0.5 AND u < 255.5 AND v >= -0.5 AND v < 159.5"))


@query("c14_canonical_pairs", f"WITH {_SQL_RELATIONS} SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM r WHERE subject <> object")
def c14_canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).filter("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


@query(
    "i14_evidence_status",
    """WITH v AS (SELECT p_partkey, p_size, CASE WHEN p_size - 2 >= 20 THEN 'meets' WHEN p_size + 2 < 20 THEN 'fails' ELSE 'within_tolerance' END AS s, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_retailprice - 3 >= 930 THEN 'meets' WHEN p_retailprice + 3 < 930 THEN 'fails' ELSE 'within_tolerance' END AS p FROM part),
e AS (SELECT *, CASE WHEN s = 'fails' OR coalesce(p, '') = 'fails' THEN 'conflicts' WHEN p IS NULL THEN 'unavailable' WHEN s = 'meets' AND p = 'meets' THEN 'supports' ELSE 'ambiguous' END AS d FROM v)
SELECT p_partkey, CASE WHEN d IN ('conflicts', 'supports') AND p_size < 5 THEN 'ambiguous' ELSE d END AS status FROM e""",
)
def i14_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any failure conflicts, a missing input is unavailable, all met support; sparse evidence decides nothing."""
    price = F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice"))
    rows = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", "p_size", F.array(at_least(F.col("p_size"), 20, 2), at_least(price, 930, 3)).alias("found"))
    any_ = lambda what: F.exists("found", lambda x: x.eqNullSafe(F.lit(what)))
    missing = F.exists("found", lambda x: x.isNull())
    decided = F.when(any_("fails"), "conflicts").when(missing, "unavailable").when(any_("within_tolerance"), "ambiguous").otherwise("supports")
    demoted = decided.isin("conflicts", "supports") & (F.col("p_size") < 5)
    return rows.select("p_partkey", F.when(demoted, "ambiguous").otherwise(decided).alias("status"))


@query(
    "j1_lookup_error",
    _PLACED
    + f""", d AS (SELECT query_id, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t - t0 ELSE t1 - t END AS delta, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN v0 ELSE v1 END AS v FROM p),
e AS (SELECT q.clock, abs(d.v - q.value) AS e FROM d JOIN q ON q.event_id = d.query_id WHERE delta <= {24 * HOUR}) SELECT clock, count(*)::BIGINT AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, quantile_disc(e, 0.95) AS p95, max(e) AS most FROM e GROUP BY 1""",
)
def j1_lookup_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each clock's values lie from those of the nearest record in reach."""
    found = nearest_record(_placed(spark, sf_dir), 24 * HOUR).filter("status = 'found'").select("query_id", F.col("value").alias("v"))
    own = events(spark, sf_dir).select(F.col("event_id").alias("query_id"), "clock", "value")
    rows = found.join(own, "query_id").select("clock", F.abs(F.col("v") - F.col("value")).alias("e"))
    return rows.groupBy("clock").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.avg("e"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY e)").alias("p95"), F.max("e").alias("most"))


_SQL_CLOUDS = f"{_SQL_PARTS}, g AS (SELECT s_suppkey AS point, s_nationkey * 2.0 AS x, 900 + s_acctbal / 100 AS y FROM supplier), n AS (SELECT DISTINCT p.point AS p, g.point AS g FROM p, g WHERE (p.x - g.x) ** 2 + (p.y - g.y) ** 2 <= 4.0)"


@query("j4_cloud_agreement", f"WITH {_SQL_CLOUDS} SELECT round((SELECT count(DISTINCT p) FROM n) / (SELECT count(*) FROM p), 6) AS accuracy, round((SELECT count(DISTINCT g) FROM n) / (SELECT count(*) FROM g), 6) AS completeness")
def j4_cloud_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of either cloud that have a point of the other within the radius."""
    found = _parts(spark, sf_dir)
    wanted = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_suppkey").alias("point"), (F.col("s_nationkey") * 2.0).alias("x"), (900 + F.col("s_acctbal") / 100).alias("y"))
    near = within_radius(wanted, found, 2.0, ("x", "y")).agg(F.countDistinct("point").alias("hit"), F.countDistinct("centre").alias("met"))
    sizes = found.agg(F.count("*").alias("of")).join(wanted.agg(F.count("*").alias("all")), how="cross")  # one row each
    return near.join(sizes, how="cross").select(F.round(F.expr("try_divide(hit, of)"), 6).alias("accuracy"), F.round(F.expr("try_divide(met, all)"), 6).alias("completeness"))


@query(
    "j5_mask_agreement",
    f"""WITH {SQL_POINTS}, a AS (SELECT DISTINCT scan AS frame, floor(x + 0.5)::BIGINT AS row, floor(y + 0.5)::BIGINT AS col FROM points), b AS (SELECT DISTINCT p_partkey // 20 AS frame, p_size::BIGINT AS row, floor(p_retailprice)::BIGINT % 11 AS col FROM part),
u AS (SELECT frame, row, col, a.frame IS NOT NULL AS ia, b.frame IS NOT NULL AS ib FROM a FULL JOIN b USING (frame, row, col))
SELECT frame, count(*) FILTER (ia AND ib)::BIGINT AS common, round(count(*) FILTER (ia AND ib) / count(*), 6) AS iou, round(2 * count(*) FILTER (ia AND ib) / (count(*) FILTER (ia) + count(*) FILTER (ib)), 6) AS dice FROM u GROUP BY 1""",
)
def j5_mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both masks' pixels in one aggregation by pixel, then one by frame."""
    pixel = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    a = points(spark, sf_dir).select(F.col("scan").alias("frame"), pixel("x").alias("row"), pixel("y").alias("col"), F.lit(True).alias("first"))
    b = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(F.expr("p_partkey div 20").alias("frame"), F.col("p_size").cast("long").alias("row"), (F.floor("p_retailprice") % 11).alias("col"), F.lit(False).alias("first"))
    u = a.unionByName(b).groupBy("frame", "row", "col").agg(F.bool_or("first").alias("ia"), F.bool_or(~F.col("first")).alias("ib"))
    both = F.count_if(F.col("ia") & F.col("ib"))
    return u.groupBy("frame").agg(both.alias("common"), F.round(both / F.count("*"), 6).alias("iou"), F.round(2 * both / (F.count_if("ia") + F.count_if("ib")), 6).alias("dice"))
