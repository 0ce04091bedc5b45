"""Scans, lookups and checks of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.evidence_queries import _SQL_RELATIONS, _relations
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EVENTS, SQL_POINTS, events, load, points
from cairn.sources.artifacts import content_digest, in_window, stale_zones, untiled
from cairn.sources.stores import by_key, pack_masks, record_table, unpack_masks, with_offsets


@query("a5_source_window", f"WITH {SQL_EVENTS} SELECT event_id, t, value FROM ev WHERE clock = 7 AND t >= 1704672000000000 AND t < 1705276800000000")
def a5_source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_window(events(spark, sf_dir), 7, 1704672000000000, 1705276800000000).select("event_id", "t", "value")


@query("a6_content_digest", "WITH d AS (SELECT sha256(text) AS d FROM documents), p AS (SELECT substr(d, 1, 4) AS p, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM d GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM p")
def a6_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digest(load(spark, sf_dir, "documents", "text"), F.sha2("text", 256))


@query("a8_positions", f"WITH {SQL_EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS position FROM ev) SELECT position, event_id, t FROM n JOIN (SELECT o_orderkey AS p FROM orders) ON p = position")
def a8_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by their place in the whole sequence, which is numbered over ranges, not in one task."""
    numbered = with_offsets(events(spark, sf_dir), ["t", "event_id"], F.lit(1), "position")
    return by_key(numbered, "position", load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("key"))).select("position", "event_id", "t")


@query("a16_record_index", """WITH r AS (SELECT s_suppkey::VARCHAR AS key, '{"s_acctbal":"' || printf('%.2f', s_acctbal) || '","s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}' AS line FROM supplier) SELECT key, coalesce(sum(strlen(line) + 1) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", strlen(line)::BIGINT AS length, sha256(line) AS digest FROM r""")
def a16_record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as canonical lines, and where each begins."""
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    return record_table(rows, "s_suppkey").select("key", "offset", "length", F.sha2("line", 256).alias("digest"))


@query("a20_mask_runs", "WITH p AS (SELECT DISTINCT p_brand AS mask, (p_size::BIGINT // 10) * 64 + (floor(p_retailprice) % 64)::BIGINT AS p FROM part), g AS (SELECT mask, p, p - row_number() OVER (PARTITION BY mask ORDER BY p) AS g FROM p), r AS (SELECT mask, min(p) AS start, count(*) AS length FROM g GROUP BY mask, g) SELECT mask, count(*)::BIGINT AS runs, sum(length)::BIGINT AS pixels, string_agg(start || '+' || length, ' ' ORDER BY start) AS packed FROM r GROUP BY 1")
def a20_mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks packed as runs; the pixels counted are those unpacked again."""
    pixels = load(spark, sf_dir, "part", "p_brand", "p_size", "p_retailprice").select(F.col("p_brand").alias("mask"), F.expr("p_size div 10").alias("row"), (F.floor("p_retailprice") % 64).alias("col"))
    packed = pack_masks(pixels, 64)
    again = unpack_masks(packed, 64).groupBy("mask").agg(F.count("*").alias("pixels"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["length"].cast("string"))), " ")
    return packed.join(again, "mask").select("mask", F.size("runs").cast("long").alias("runs"), "pixels", text.alias("packed"))


_SQL_RANGES = f"{SQL_POINTS}, n AS (SELECT scan % 10 AS map, scan, count(*) AS n FROM points GROUP BY ALL), g AS (SELECT map, scan, n, coalesce(sum(n) OVER (PARTITION BY map ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (scan % 7 = 3)::BIGINT AS first FROM n)"


@query("a9_tiling_check", f"WITH {_SQL_RANGES}, d AS (SELECT *, coalesce(lag(first + n) OVER (PARTITION BY map ORDER BY scan), 0) AS due FROM g) SELECT map, scan, first, n::BIGINT AS n, due::BIGINT AS due FROM d WHERE first <> due")
def a9_tiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of which some were moved by one."""
    sizes = points(spark, sf_dir).groupBy((F.col("scan") % 10).alias("map"), "scan").agg(F.count("*").alias("n"))
    before = Window.partitionBy("map").orderBy("scan").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")) + (F.col("scan") % 7 == 3).cast("long")
    return untiled(sizes.withColumn("first", first)).select("map", "scan", "first", "n", "due")


@query("a11_point_lookup", f"WITH {SQL_POINTS} SELECT o_custkey AS reference, point, scan, x, y, z FROM points JOIN orders ON point // 8 = o_orderkey AND point % 8 = 1")
def a11_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("reference"), (F.col("o_orderkey") * 8 + 1).alias("point"))
    return points(spark, sf_dir).join(refs, "point").select("reference", "point", "scan", "x", "y", "z")


@query("a13_stale_zones", f"WITH {SQL_POINTS} SELECT scan FROM points GROUP BY 1 HAVING max(x) <> 50 - (scan % 4 = 0)::INT")
def a13_stale_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against records that claim the whole range to 50, and one less for some scans."""
    rows = points(spark, sf_dir)
    recorded = rows.groupBy("scan").agg(F.min("x").alias("min_x")).withColumn("max_x", 50.0 - (F.col("scan") % 4 == 0).cast("int"))
    return stale_zones(rows, recorded)


@query("a15_relations_of", f"WITH {_SQL_RELATIONS} SELECT subject AS entity, 'subject' AS role, predicate, object AS other FROM r UNION ALL SELECT object, 'object', predicate, subject FROM r")
def a15_relations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's relations from both ends, from one read of them."""
    ends = F.array(*[F.struct(F.col(own).alias("entity"), F.lit(own).alias("role"), "predicate", F.col(other).alias("other")) for own, other in (("subject", "object"), ("object", "subject"))])
    return _relations(spark, sf_dir).select(F.inline(ends))
