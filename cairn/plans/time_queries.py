"""Time joins, clocks and windows over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.moments import exact_quantiles
from cairn.operators.time_joins import interpolated, nearest_record, nearest_within, neighbours_in_time, select_ids
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EVENTS, events, load

HOUR = 3_600_000_000


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("modality = 'purchase'")


@query(
    "c1_tolerance_sync",
    f"""WITH {SQL_EVENTS}, a AS (SELECT * FROM ev WHERE modality = 'purchase'), c AS (SELECT * FROM ev WHERE modality = 'view'),
m AS (SELECT a.event_id AS anchor_id, c.event_id AS candidate_id, c.t - a.t AS o, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(c.t - a.t), c.event_id) AS r
  FROM a JOIN c ON a.clock = c.clock AND abs(c.t - a.t) <= {2 * HOUR})
SELECT a.clock, a.event_id AS anchor_id, m.candidate_id, m.o AS offset, CASE WHEN m.candidate_id IS NOT NULL THEN 'matched'
  WHEN a.clock IN (SELECT clock FROM c) THEN 'outside_tolerance' WHEN (SELECT count(*) FROM c) > 0 THEN 'clock_id_mismatch' ELSE 'no_candidate' END AS status FROM a LEFT JOIN m ON m.anchor_id = a.event_id AND r = 1""",
)
def c1_tolerance_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir).select("clock", F.col("event_id").alias("anchor_id"), "t")
    views = events(spark, sf_dir).filter("modality = 'view'").select("clock", F.col("event_id").alias("candidate_id"), "t")
    return nearest_within(anchors, views, 2 * HOUR)


_PLACED = f"""WITH {SQL_EVENTS}, q AS (SELECT * FROM ev WHERE modality = 'click'), r AS (SELECT clock, t, max(value) AS v FROM ev WHERE modality = 'signup' GROUP BY ALL),
b AS (SELECT q.event_id AS query_id, q.t, r.t AS t0, r.v AS v0 FROM q ASOF LEFT JOIN r ON q.clock = r.clock AND q.t >= r.t),
f AS (SELECT q.event_id AS query_id, r.t AS t1, r.v AS v1 FROM q ASOF LEFT JOIN r ON q.clock = r.clock AND q.t <= r.t),
p AS (SELECT * FROM b JOIN f USING (query_id))"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return neighbours_in_time(rows.filter("modality = 'click'").select("clock", F.col("event_id").alias("query_id"), "t"), rows.filter("modality = 'signup'"), "value")


@query(
    "c2_asof_nearest",
    _PLACED
    + f""", d AS (SELECT *, t1 IS NULL OR t - t0 <= t1 - t AS first FROM p), e AS (SELECT *, CASE WHEN first THEN t - t0 ELSE t1 - t END AS delta FROM d)
SELECT query_id, CASE WHEN delta <= {24 * HOUR} THEN CASE WHEN first THEN v0 ELSE v1 END END AS value, CASE WHEN delta <= {24 * HOUR} THEN delta END AS delta,
  CASE WHEN delta <= {24 * HOUR} THEN 'found' ELSE 'out_of_range' END AS status FROM e""",
)
def c2_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_record(_placed(spark, sf_dir), 24 * HOUR)


@query(
    "c3_asof_interpolated",
    _PLACED
    + f""" SELECT query_id, round(CASE WHEN t0 = t THEN v0 WHEN t1 - t0 <= {72 * HOUR} THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS value,
  CASE WHEN t0 = t THEN 'exact' WHEN t0 IS NULL OR t1 IS NULL THEN 'out_of_range' WHEN t1 - t0 > {72 * HOUR} THEN 'interpolation_gap' ELSE 'interpolated' END AS status FROM p""",
)
def c3_asof_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated(_placed(spark, sf_dir), 72 * HOUR).withColumn("value", F.round("value", 6))


@query("b1_time_range", f"WITH {SQL_EVENTS} SELECT event_id, clock, t FROM ev WHERE t >= 1704672000000000 AND t < 1704758400000000")
def b1_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open [start, end)."""
    return events(spark, sf_dir).filter("t >= 1704672000000000 AND t < 1704758400000000").select("event_id", "clock", "t")


@query("b1_position_range", f"WITH {SQL_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY clock ORDER BY t, event_id) - 1 AS position FROM ev) SELECT clock, event_id, position FROM n WHERE position >= 10 AND position < 20")
def b1_position_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = (F.row_number().over(Window.partitionBy("clock").orderBy("t", "event_id")) - 1).cast("long")
    return events(spark, sf_dir).withColumn("position", position).filter("position >= 10 AND position < 20").select("clock", "event_id", "position")


@query("b2_clock_offset", f"WITH {SQL_EVENTS} SELECT event_id, t AS raw_t, t + (clock % 5) * 1000 AS t FROM ev")
def b2_clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("t").alias("raw_t"), (F.col("t") + (F.col("clock") % 5) * 1000).alias("t"))


@query("b4_ordering_check", f"WITH {SQL_EVENTS}, l AS (SELECT *, lag(t) OVER (PARTITION BY clock ORDER BY event_id) AS previous_t FROM ev) SELECT clock, event_id, t, previous_t FROM l WHERE t < previous_t")
def b4_ordering_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records earlier than the one before them on their clock, in the order of arrival."""
    before = F.lag("t").over(Window.partitionBy("clock").orderBy("event_id"))
    return events(spark, sf_dir).withColumn("previous_t", before).filter("t < previous_t").select("clock", "event_id", "t", "previous_t")


@query(
    "d14_clock_diagnostics",
    f"""WITH {SQL_EVENTS}, l AS (SELECT *, t < lag(t) OVER (PARTITION BY clock ORDER BY event_id) AS back FROM ev)
SELECT clock, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(max(abs(value)), 6) AS largest, count(*) FILTER (back)::BIGINT AS non_monotonic FROM l GROUP BY 1""",
)
def d14_clock_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("back", F.col("t") < F.lag("t").over(Window.partitionBy("clock").orderBy("event_id")))
    return rows.groupBy("clock").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.round(F.max(F.abs("value")), 6).alias("largest"), F.count_if("back").alias("non_monotonic"))


@query(
    "e1_motion_deltas",
    f"""WITH {SQL_EVENTS}, l AS (SELECT clock, event_id, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS distance FROM ev WINDOW w AS (PARTITION BY clock ORDER BY t, event_id))
SELECT clock, event_id, dt, round(distance, 6) AS distance, CASE WHEN dt > 0 THEN round(distance / dt * 1e9, 6) END AS speed FROM l WHERE dt IS NOT NULL""",
)
def e1_motion_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("clock").orderBy("t", "event_id")
    rows = events(spark, sf_dir).select("clock", "event_id", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.abs(F.col("value") - F.lag("value").over(w)).alias("distance"))
    return rows.filter("dt IS NOT NULL").select("clock", "event_id", "dt", F.round("distance", 6).alias("distance"), F.when(F.col("dt") > 0, F.round(F.col("distance") / F.col("dt") * 1e9, 6)).alias("speed"))


@query("e2_gaps", f"WITH {SQL_EVENTS}, l AS (SELECT clock, lag(t) OVER (PARTITION BY clock ORDER BY t, event_id) AS gap_start, t AS gap_end FROM ev) SELECT clock, gap_start, gap_end, gap_end - gap_start AS length FROM l WHERE gap_end - gap_start > {24 * HOUR}")
def e2_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("t").over(Window.partitionBy("clock").orderBy("t", "event_id"))
    rows = events(spark, sf_dir).select("clock", before.alias("gap_start"), F.col("t").alias("gap_end")).withColumn("length", F.col("gap_end") - F.col("gap_start"))
    return rows.filter(F.col("length") > 24 * HOUR)


@query("d11_order_statistics", f"WITH {SQL_EVENTS} SELECT modality, count(*)::BIGINT AS n, min(value) AS least, round(median(value), 6) AS middle, quantile_disc(value, 0.95) AS p95_rank, round(quantile_cont(value, 0.95), 6) AS p95_linear, max(value) AS most FROM ev GROUP BY 1")
def d11_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules for the 95th percentile: nearest rank (D11) and linear (D13)."""
    rows = events(spark, sf_dir)
    ranks = exact_quantiles(rows, "modality", "value", {"p95_rank": 0.95}, {"middle": 0.5, "p95_linear": 0.95})
    whole = rows.groupBy("modality").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return whole.join(ranks, "modality").select("modality", "n", "least", F.round("middle", 6).alias("middle"), "p95_rank", F.round("p95_linear", 6).alias("p95_linear"), "most")


@query("d15_sequence_summary", f"WITH {SQL_EVENTS} SELECT modality, count(*)::BIGINT AS n, count(DISTINCT clock)::BIGINT AS clocks, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY 1")
def d15_sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("modality").agg(F.count("*").alias("n"), F.countDistinct("clock").alias("clocks"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("b18_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS unavailable FROM events")
def b18_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", k.alias("k"), k.isNull().alias("unavailable"))


@query("b1_id_selection", f"WITH {SQL_EVENTS} SELECT event_id, clock, t FROM ev WHERE event_id IN (SELECT l_orderkey FROM lineitem) AND event_id < 1000")
def b1_id_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the ids asked for; an id that is not there would be an error."""
    rows = events(spark, sf_dir)
    ids = load(spark, sf_dir, "lineitem", "l_orderkey").filter("l_orderkey < 1000").select(F.col("l_orderkey").alias("event_id")).distinct()
    return select_ids(rows, ids, "event_id").select("event_id", "clock", "t")
