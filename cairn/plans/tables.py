"""Driver tables as the data model's: line items as points, events as observations, part of each table as boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def micros(column: str) -> Column:
    """Microseconds since the epoch; these tables' timestamps have no zone and count as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: (order, line) is the point, the supplier its scan, the ship date its observation."""
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point"),
        F.col("l_suppkey").alias("scan"),
        micros("l_shipdate").alias("t"),
        F.col("l_shipdate").cast("date").alias("observation"),
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 100).alias("y"),
        (F.col("l_tax") * 100).alias("z"),
    )


SQL_POINTS = """points AS (
  SELECT l_orderkey * 8 + l_linenumber AS point, l_suppkey AS scan, epoch_us(l_shipdate) AS t, l_shipdate::DATE AS observation,
    l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the user is the clock, the type the modality."""
    rows = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return rows.select("event_id", F.col("user_id").alias("clock"), F.col("event_type").alias("modality"), micros("ts").alias("t"), "value")


SQL_EVENTS = "ev AS (SELECT event_id, user_id AS clock, event_type AS modality, epoch_us(ts) AS t, value FROM events)"


def entity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of entities, eight by eight: size, price and the name's length are the place."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice", "p_name")
    return parts.select(F.expr("p_partkey div 8").alias("entity"), F.col("p_partkey").alias("point"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.length("p_name").cast("double").alias("z"))


SQL_ENTITY_POINTS = "ep AS (SELECT p_partkey // 8 AS entity, p_partkey AS point, p_size::DOUBLE AS x, p_retailprice AS y, length(p_name)::DOUBLE AS z FROM part)"


def entity_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [f(F.col(a)).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return entity_points(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("points"), *box, *[F.avg(a).alias(f"c{a}") for a in "xyz"])


SQL_ENTITY_BOXES = f"{SQL_ENTITY_POINTS}, eb AS (SELECT entity, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ep GROUP BY 1)"


def side(df: DataFrame, prefix: str, name: str, key: str = "entity") -> DataFrame:
    """``df`` for one side of a pair: ``key`` as ``name``, every other column with the prefix."""
    return df.select(F.col(key).alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])


def SQL_EIGEN(points: str, key: str, name: str) -> str:  # noqa: N802
    """Of each group's points the population covariance's eigenvalues e1 >= e2 >= e3 (never below 0) and the axes a1 and a2, each with its
    largest component positive, as the CTE ``name``."""
    lead = lambda v: f"CASE WHEN abs({v}x) >= greatest(abs({v}y), abs({v}z)) THEN {v}x WHEN abs({v}y) >= abs({v}z) THEN {v}y ELSE {v}z END"

    def axis(n: int) -> str:
        e = f"e{n}"
        return f"""{name}_c{n} AS (SELECT *, [xy * yz - xz * (yy - {e}), xz * xy - (xx - {e}) * yz, (xx - {e}) * (yy - {e}) - xy * xy] AS p, [xy * (zz - {e}) - xz * yz, xz * xz - (xx - {e}) * (zz - {e}), (xx - {e}) * yz - xy * xz] AS q, [(yy - {e}) * (zz - {e}) - yz * yz, yz * xz - xy * (zz - {e}), xy * yz - (yy - {e}) * xz] AS r FROM {name}_{'e' if n == 1 else 'a1'}),
{name}_l{n} AS (SELECT *, list_dot_product(p, p) AS np, list_dot_product(q, q) AS nq, list_dot_product(r, r) AS nr FROM {name}_c{n}), {name}_m{n} AS (SELECT * EXCLUDE (p, q, r, np, nq, nr), CASE WHEN np >= greatest(nq, nr) THEN p WHEN nq >= nr THEN q ELSE r END AS w, sqrt(greatest(np, nq, nr)) AS len FROM {name}_l{n}),
{name}_u{n} AS (SELECT * EXCLUDE (w, len), CASE WHEN len > 0 THEN w[1] / len END AS vx, CASE WHEN len > 0 THEN w[2] / len END AS vy, CASE WHEN len > 0 THEN w[3] / len END AS vz FROM {name}_m{n}),
{name}_a{n} AS (SELECT * EXCLUDE (vx, vy, vz), vx * CASE WHEN {lead('v')} < 0 THEN -1 ELSE 1 END AS a{n}x, vy * CASE WHEN {lead('v')} < 0 THEN -1 ELSE 1 END AS a{n}y, vz * CASE WHEN {lead('v')} < 0 THEN -1 ELSE 1 END AS a{n}z FROM {name}_u{n})"""

    return f"""{name}_v AS (SELECT {key}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM {points} GROUP BY 1),
{name}_q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM {name}_v), {name}_s AS (SELECT *, sqrt(((xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS sp FROM {name}_q),
{name}_d AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN sp > 0 THEN ((xx - m) * ((yy - m) * (zz - m) - yz ** 2) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * sp ** 3) ELSE 1 END))) / 3 AS an FROM {name}_s),
{name}_f AS (SELECT *, m + 2 * sp * cos(an) AS e1, m + 2 * sp * cos(an + 2 * pi() / 3) AS e3_ FROM {name}_d), {name}_e AS (SELECT * EXCLUDE (e3_, sp, an, m), 3 * m - e1 - e3_ AS e2, e3_ AS e3 FROM {name}_f),
{axis(1)}, {axis(2)}, {name} AS (SELECT * FROM {name}_a2)"""
