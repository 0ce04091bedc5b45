"""Windows, temporal state, channels, decisions and evaluation over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.evidence import hypotheses, uncertainty
from cairn.operators.moments import exact_quantiles
from cairn.operators.time_joins import nearest_record
from cairn.plans.evidence_queries import _INVERSE, _SQL_CLAIMS, _SQL_FOLLOW, _SQL_RELATIONS, _claims, _relations, _stated
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EVENTS, events, load
from cairn.plans.time_queries import _PLACED, HOUR, _placed


@query(
    "d8_support_summary",
    "SELECT o_custkey AS support, count(DISTINCT o_orderkey)::BIGINT AS refs, round(avg(o_totalprice), 4) AS centroid, min(o_totalprice) AS low, max(o_totalprice) AS high, epoch_us(min(o_orderdate)) AS first_t, epoch_us(max(o_orderdate)) AS last_t FROM orders GROUP BY 1",
)
def d8_support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rows.groupBy(F.col("o_custkey").alias("support")).agg(
        F.countDistinct("o_orderkey").alias("refs"), F.round(F.avg("o_totalprice"), 4).alias("centroid"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        t(F.min("o_orderdate")).alias("first_t"), t(F.max("o_orderdate")).alias("last_t"),
    )


@query(
    "d12_lookup_summary",
    _PLACED
    + f""", d AS (SELECT CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t - t0 ELSE t1 - t END AS delta FROM p), s AS (SELECT CASE WHEN delta <= {24 * HOUR} THEN 'found' ELSE 'out_of_range' END AS status, CASE WHEN delta <= {24 * HOUR} THEN delta END AS delta FROM d)
SELECT status, count(*)::BIGINT AS n, quantile_disc(delta, 0.5) AS middle_low, max(delta) AS most FROM s GROUP BY 1""",
)
def d12_lookup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower of the two middle deltas where their number is even."""
    found = nearest_record(_placed(spark, sf_dir), 24 * HOUR)
    middle = exact_quantiles(found, "status", "delta", {"middle_low": 0.5}).withColumn("middle_low", F.col("middle_low").cast("long"))
    return found.groupBy("status").agg(F.count("*").alias("n"), F.max("delta").alias("most")).join(middle, "status", "left")


@query(
    "d23_temporal_state",
    """WITH m AS (SELECT o_custkey AS entity, o_orderstatus AS source, date_trunc('month', o_orderdate) AS frame, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT entity, frame, max(n) AS n FROM m GROUP BY ALL)
SELECT entity, count(*)::BIGINT AS frames, sum(n)::BIGINT AS inferences, min(frame)::DATE AS first_seen, max(frame)::DATE AS last_seen FROM f GROUP BY 1""",
)
def d23_temporal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share a frame count once there, with the larger number."""
    frame = F.date_trunc("month", "o_orderdate").cast("date").alias("frame")
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate").groupBy(F.col("o_custkey").alias("entity"), "o_orderstatus", frame).agg(F.count("*").alias("n"))
    frames = rows.groupBy("entity", "frame").agg(F.max("n").alias("n"))
    return frames.groupBy("entity").agg(F.count("*").alias("frames"), F.sum("n").alias("inferences"), F.min("frame").alias("first_seen"), F.max("frame").alias("last_seen"))


@query("d24_merge_conflicts", "SELECT l_orderkey AS key, count(DISTINCT l_returnflag)::BIGINT AS contents, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' ELSE min(l_returnflag) END AS merged FROM lineitem GROUP BY 1")
def d24_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.countDistinct("l_returnflag")
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("key")).agg(n.alias("contents"), F.when(n > 1, "conflict").otherwise(F.min("l_returnflag")).alias("merged"))


@query("d25_rates", "SELECT c_nationkey, count(*)::BIGINT AS n, round(count(*) FILTER (c_acctbal > 0 AND c_mktsegment = 'BUILDING') / nullif(count(*) FILTER (c_mktsegment = 'BUILDING'), 0), 6) AS rate FROM customer GROUP BY 1")
def d25_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, not zero, where there is nothing to divide by."""
    own = F.col("c_mktsegment") == "BUILDING"
    rows = load(spark, sf_dir, "customer", "c_nationkey", "c_acctbal", "c_mktsegment")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(own & (F.col("c_acctbal") > 0)), F.count_if(own)), 6).alias("rate"))


@query(
    "e7_even_sampling",
    f"""WITH {SQL_EVENTS}, r AS (SELECT clock, event_id, row_number() OVER (PARTITION BY clock ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY clock) AS n FROM ev),
k AS (SELECT DISTINCT clock, round_even(j * (n - 1) / 4.0, 0)::BIGINT AS i FROM r, range(5) g(j)) SELECT clock, i AS position, event_id FROM r JOIN k USING (clock, i)""",
)
def e7_even_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records of each clock at even positions, halves rounded to even; all of fewer."""
    rows = events(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("clock").orderBy("t", "event_id")) - 1
    placed = rows.select("clock", "event_id", at.cast("long").alias("position"))
    wanted = rows.groupBy("clock").agg(F.count("*").alias("n")).select("clock", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.bround(j * (F.col("n") - 1) / 4.0, 0).cast("long")))).alias("position"))
    return placed.join(wanted, ["clock", "position"])


@query(
    "e8_relative_error",
    f"""WITH {SQL_EVENTS}, m AS (SELECT a.event_id, a.value AS va, b.value AS vb, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t - {24 * HOUR}), b.event_id) AS r FROM ev a JOIN ev b ON a.clock = b.clock AND abs(b.t - a.t - {24 * HOUR}) <= {2 * HOUR})
SELECT event_id, round(vb - va, 6) AS change FROM m WHERE r = 1""",
)
def e8_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change to the record nearest a day later, where one lies within two hours of that."""
    wide = 2 * HOUR
    rows = events(spark, sf_dir).select("clock", "event_id", "t", "value")
    target = rows.select("clock", "event_id", (F.col("t") + 24 * HOUR).alias("due"), F.col("value").alias("before"))
    target = target.withColumn("bucket", F.explode(F.expr(f"sequence(due div {wide} - 1, due div {wide} + 1)")))
    other = rows.select("clock", F.expr(f"t div {wide}").alias("bucket"), F.col("event_id").alias("other"), "t", "value")
    near = target.join(other, ["clock", "bucket"]).withColumn("off", F.abs(F.col("t") - F.col("due"))).filter(F.col("off") <= wide)
    best = near.groupBy("event_id").agg(F.min(F.struct("off", "other", (F.col("value") - F.col("before")).alias("change"))).alias("m"))
    return best.select("event_id", F.round("m.change", 6).alias("change"))


@query("e9_prefix_offsets", "WITH n AS (SELECT o_custkey, date_trunc('year', o_orderdate)::DATE AS year, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, year, n::BIGINT AS n, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n")
def e9_prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey", F.date_trunc("year", "o_orderdate").cast("date").alias("year")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("o_custkey").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


@query("e10_leaders", f"WITH {_SQL_CLAIMS}, l AS (SELECT support, key, observations, max(observations) OVER (PARTITION BY support) AS lead FROM h) SELECT support, string_agg(key, ',' ORDER BY key) AS leaders FROM l WHERE lead - observations <= 1 GROUP BY 1")
def e10_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hypotheses(_claims(spark, sf_dir)).withColumn("lead", F.max("observations").over(Window.partitionBy("support")))
    return found.filter("lead - observations <= 1").groupBy("support").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("leaders"))


@query("f1_duplicate_identities", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f1_duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


_SQL_SETS = "r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), n AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)"


@query("g1_set_operations", f"WITH {_SQL_SETS} SELECT l_partkey, 'both' AS held FROM (FROM r INTERSECT FROM n) UNION ALL SELECT l_partkey, 'first' FROM (FROM r EXCEPT FROM n) UNION ALL SELECT l_partkey, 'second' FROM (FROM n EXCEPT FROM r)")
def g1_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and both differences in one aggregation."""
    rows = load(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity").filter("l_quantity > 45 AND l_returnflag IN ('R', 'N')")
    seen = rows.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "N").alias("n"))
    return seen.select("l_partkey", F.when(F.col("r") & F.col("n"), "both").when(F.col("r"), "first").otherwise("second").alias("held"))


@query("g11_reference_triples", f"WITH {_SQL_FOLLOW}, e AS (SELECT subject, predicate, object, state FROM fo UNION ALL SELECT object, CASE predicate WHEN 'above' THEN 'below' WHEN 'inside' THEN 'contains' ELSE 'next_to' END, subject, state FROM fo) SELECT subject, predicate, object, CASE WHEN count(DISTINCT state) = 1 THEN min(state) END AS state, count(DISTINCT state) > 1 AS conflicting FROM e GROUP BY ALL")
def g11_reference_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their inverses; those with more than one status have none and are marked."""
    stated = _stated(spark, sf_dir)
    inverse = F.create_map(*[F.lit(x) for kv in _INVERSE.items() for x in kv])
    both = F.array(F.struct("subject", "predicate", "object"), F.struct(F.col("object").alias("subject"), inverse[F.col("predicate")].alias("predicate"), F.col("subject").alias("object")))
    one = F.min("state") == F.max("state")
    return stated.select("state", F.inline(both)).groupBy("subject", "predicate", "object").agg(F.when(one, F.min("state")).alias("state"), (~one).alias("conflicting"))


@query(
    "i4_temporal_channel",
    f"""WITH {SQL_EVENTS}, s AS (SELECT clock, modality, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY ALL)
SELECT a.clock, greatest(least(a.t1, b.t1) - greatest(a.t0, b.t0), 0) AS overlap, greatest(greatest(a.t0, b.t0) - least(a.t1, b.t1), 0) AS gap FROM s a JOIN s b ON a.clock = b.clock AND a.modality = 'click' AND b.modality = 'error'""",
)
def i4_temporal_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda kind, n: events(spark, sf_dir).filter(F.col("modality") == kind).groupBy("clock").agg(F.min("t").alias(f"{n}0"), F.max("t").alias(f"{n}1"))
    both = span("click", "a").join(span("error", "b"), "clock")
    return both.select("clock", F.expr("greatest(least(a1, b1) - greatest(a0, b0), 0L)").alias("overlap"), F.expr("greatest(greatest(a0, b0) - least(a1, b1), 0L)").alias("gap"))


@query(
    "i10_semantic_state",
    f"""WITH {_SQL_CLAIMS}, u AS (SELECT support, count(*) AS n, count(*) FILTER (primary_observations > 0) AS p, sum(primary_observations) AS seen, min(key) AS key FROM h GROUP BY 1)
SELECT support, CASE WHEN p >= 2 AND seen >= 2 THEN 'conflicting' WHEN n > 1 THEN 'ambiguous' ELSE 'unambiguous' END AS state, CASE WHEN n = 1 THEN key END AS class FROM u""",
)
def i10_semantic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hypotheses(_claims(spark, sf_dir))
    kinds = uncertainty(found, 1).groupBy("support").agg(F.bool_or(F.col("kind") == "contradiction").alias("against"))
    one = found.groupBy("support").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    state = F.when(F.col("against"), "conflicting").when(F.col("n") > 1, "ambiguous").otherwise("unambiguous")
    return one.join(kinds, "support", "left").select("support", state.alias("state"), F.when(F.col("n") == 1, F.col("key")).alias("class"))


@query(
    "i15_observation_channel",
    "WITH c AS (SELECT s_nationkey AS subject, c_nationkey AS object, count(*) FILTER (l_returnflag = 'R')::BIGINT AS denied, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS asserted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT *, CASE WHEN denied = 0 THEN 'supports' WHEN asserted = 0 THEN 'conflicts' ELSE 'ambiguous' END AS status FROM c",
)
def i15_observation_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
    s, o, c = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), load(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rows = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    no = F.col("l_returnflag") == "R"
    n = rows.groupBy(F.col("s_nationkey").alias("subject"), F.col("c_nationkey").alias("object")).agg(F.count_if(no).alias("denied"), F.count_if(~no).alias("asserted"))
    return n.withColumn("status", F.when(F.col("denied") == 0, "supports").when(F.col("asserted") == 0, "conflicts").otherwise("ambiguous"))


@query(
    "i18_offset_sweep",
    f"""WITH {SQL_EVENTS}, o(off) AS (VALUES (-10), (-5), (0), (5), (10)) SELECT off, count(*)::BIGINT AS n, round(avg(abs(value - off)), 6) AS mean, round(quantile_cont(abs(value - off), 0.95), 6) AS p95 FROM ev, o GROUP BY 1""",
)
def i18_offset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("value", F.explode(F.array(*map(F.lit, (-10, -5, 0, 5, 10)))).alias("off")).withColumn("r", F.abs(F.col("value") - F.col("off")))
    p95 = exact_quantiles(rows, "off", "r", {}, {"p95": 0.95}).withColumn("p95", F.round("p95", 6))
    return rows.groupBy("off").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean")).join(p95, "off")


@query(
    "j7_text_report",
    "SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS acceptable, count(*) FILTER (quality IS NULL)::BIGINT AS unmapped, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS rate, quantile_disc(n_chars, 0.95) AS p95 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def j7_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").join(load(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    good = F.count_if(F.col("quality") == 1)
    p95 = exact_quantiles(rows, "lang", "n_chars", {"p95": 0.95}).withColumn("p95", F.col("p95").cast("long"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), good.alias("acceptable"), F.count_if(F.col("quality").isNull()).alias("unmapped"), F.round(F.try_divide(good, F.count("quality")), 6).alias("rate")).join(p95, "lang", "left")


@query(
    "j12_relation_scores",
    f"""WITH {_SQL_RELATIONS}, c AS (SELECT predicate, count(*) FILTER (state = 'supported' AND subject < object)::BIGINT AS tp, count(*) FILTER (state = 'supported' AND subject >= object)::BIGINT AS fp, count(*) FILTER (state <> 'supported' AND subject < object)::BIGINT AS fn FROM r GROUP BY 1)
SELECT predicate, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def j12_relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per predicate, with (here) the pairs in ascending order as the reference."""
    said, true = F.col("state") == "supported", F.col("subject") < F.col("object")
    c = _relations(spark, sf_dir).groupBy("predicate").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    score = lambda n, d: F.round(F.expr(f"try_divide({n}, {d})"), 6)
    return c.select("predicate", "tp", "fp", "fn", score("tp", "tp + fp").alias("precision"), score("tp", "tp + fn").alias("recall"), score("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("j20_unmet_gates", "SELECT p_brand AS gate FROM part GROUP BY 1 HAVING p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) >= 25)")
def j20_unmet_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part", "p_brand", "p_size")
    met = parts.groupBy("p_brand").agg(F.avg("p_size").alias("mean")).filter("mean >= 25")
    return parts.select("p_brand").distinct().join(met, "p_brand", "left_anti").select(F.col("p_brand").alias("gate"))
