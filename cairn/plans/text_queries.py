"""Labels, texts, feature vectors and record checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.text import cut_by_tile, folded, parse_response, redact, redact_json, region_reasons, relation, rendered, tiles
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EVENTS, SQL_POINTS, events, load, points


@query(
    "b3_structural_problems",
    "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN length(p_name) > 11 THEN 'name' END, CASE WHEN p_retailprice > 980 THEN 'price' END) AS problems FROM part WHERE p_size < 5 OR length(p_name) > 11 OR p_retailprice > 980",
)
def b3_structural_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"size": F.col("p_size") < 5, "name": F.length("p_name") > 11, "price": F.col("p_retailprice") > 980}
    found = F.concat_ws("; ", *[F.when(rule, name) for name, rule in rules.items()])
    return load(spark, sf_dir, "part", "p_partkey", "p_size", "p_name", "p_retailprice").select("p_partkey", found.alias("problems")).filter("problems <> ''")


@query("b8_policy_states", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'warn' ELSE 'reject' END AS action FROM orders")
def b8_policy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = F.create_map(*[F.lit(x) for x in ("F", "accept", "O", "warn")])
    return load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", F.coalesce(policy[F.col("o_orderstatus")], F.lit("reject")).alias("action"))


@query(
    "b9_region_budget",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS frame, o_totalprice AS score, CASE WHEN o_totalprice < 20000 THEN 'too_small' WHEN o_totalprice > 450000 THEN 'too_large' END AS reason FROM orders)
SELECT frame, id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY frame, reason IS NULL ORDER BY score DESC, id) > 5 THEN 'over_budget' END AS reason FROM r""",
)
def b9_region_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a frame in the order of their scores; a rejected one takes no place of the budget of five."""
    size = F.col("o_totalprice")
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("why", F.when(size < 20000, "too_small").when(size > 450000, "too_large"))
    place = F.row_number().over(Window.partitionBy("o_custkey", F.col("why").isNull()).orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.select(F.col("o_custkey").alias("frame"), F.col("o_orderkey").alias("id"), F.coalesce("why", F.when(place > 5, "over_budget")).alias("reason"))


@query(
    "b10_tiling_plan",
    """WITH f AS (SELECT p_partkey, 200 + p_size * 20 AS width FROM part), t AS (SELECT p_partkey, width, unnest(range(0, CASE WHEN width <= 256 THEN 1 ELSE ceil((width - 256) / 192.0)::INT + 1 END)) AS tile FROM f)
SELECT p_partkey, tile::BIGINT AS tile, greatest(least(tile * 192, width - 256), 0)::BIGINT AS start, least(width, 256)::BIGINT AS length FROM t""",
)
def b10_tiling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 256 that overlap by 64, the last flush with the edge."""
    frames = load(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", (200 + F.col("p_size").cast("long") * 20).alias("width"))
    last = F.when(F.col("width") <= 256, F.lit(0)).otherwise(F.ceil((F.col("width") - 256) / 192.0)).cast("long")
    tiles = frames.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return tiles.select("p_partkey", "tile", F.expr("greatest(least(tile * 192, width - 256), 0L)").alias("start"), F.least("width", F.lit(256).cast("long")).alias("length"))


@query("b12_folded_labels", r"SELECT p_partkey, trim(regexp_replace(lower(p_type || '  ' || p_name), '\s+', ' ', 'g')) AS label FROM part")
def b12_folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part", "p_partkey", "p_type", "p_name").select("p_partkey", folded(F.concat("p_type", F.lit("  "), "p_name")).alias("label"))


@query(
    "b14_label_relation",
    """WITH n AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_name ELSE 'blue bolt' END AS b FROM part)
SELECT p_partkey, a, b, CASE WHEN a = b THEN 'same' WHEN split_part(a, ' ', 2) = b AND split_part(a, ' ', 1) IN ('red', 'small', 'blue') THEN 'refinement' WHEN a = 'red widget' AND b = 'blue bolt' THEN 'related' ELSE 'different' END AS relation FROM n""",
)
def b14_label_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    other = F.when(kind == 0, F.split_part(name, F.lit(" "), F.lit(2))).when(kind == 1, name).otherwise("blue bolt")
    rows = load(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", name.alias("a"), other.alias("b"))
    return rows.withColumn("relation", relation(F.col("a"), F.col("b"), ["red", "small", "blue"], [("red widget", "blue bolt")]))


@query("b15_canonical_predicates", r"SELECT o_orderkey, CASE regexp_replace(lower(substr(o_orderpriority, 3)), '[\s_-]+', '_', 'g') WHEN 'high' THEN 'HIGH' WHEN 'not_specified' THEN 'NONE' WHEN 'urgent' THEN 'URGENT' END AS predicate FROM orders")
def b15_canonical_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings without a canonical one are null."""
    canon = F.create_map(*[F.lit(x) for x in ("high", "HIGH", "not_specified", "NONE", "urgent", "URGENT")])
    word = F.regexp_replace(F.lower(F.substring("o_orderpriority", 3, 99)), r"[\s_\-]+", "_")
    return load(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", canon[word].alias("predicate"))


@query("b20_redaction", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[redacted]', 'g'), '[0-9]{3}-[0-9]{4}', '[redacted]', 'g')) AS digest FROM documents")
def b20_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(redact(F.col("text")), 256).alias("digest"))


_COMPARED = f"{SQL_EVENTS}, s AS (SELECT clock, min(t) FILTER (modality = 'view') AS v0, max(t) FILTER (modality = 'view') AS v1, min(t) FILTER (modality = 'click') AS c0, max(t) FILTER (modality = 'click') AS c1 FROM ev GROUP BY 1)"


@query("b21_clock_plausibility", f"WITH {_COMPARED} SELECT clock, CASE WHEN v0 IS NULL OR c0 IS NULL THEN 'missing' WHEN v0 <= c1 AND c0 <= v1 THEN 'plausible' ELSE 'disjoint' END AS verdict FROM s")
def b21_clock_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of a clock are plausible if their time ranges overlap."""
    at = lambda f, kind: f(F.when(F.col("modality") == kind, F.col("t")))
    s = events(spark, sf_dir).groupBy("clock").agg(at(F.min, "view").alias("v0"), at(F.max, "view").alias("v1"), at(F.min, "click").alias("c0"), at(F.max, "click").alias("c1"))
    return s.select("clock", F.when(F.expr("v0 IS NULL OR c0 IS NULL"), "missing").when(F.expr("v0 <= c1 AND c0 <= v1"), "plausible").otherwise("disjoint").alias("verdict"))


@query(
    "c20_statement_links",
    """WITH h AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS one FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT s_suppkey, CASE WHEN n = 1 THEN one END AS entity, CASE WHEN n IS NULL THEN 'no_holder' WHEN n > 1 THEN 'several_holders' ELSE 'linked' END AS status FROM supplier LEFT JOIN h ON s_nationkey = c_nationkey""",
)
def c20_statement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    holders = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("one"))
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(holders, "s_nationkey", "left")
    status = F.when(F.col("n").isNull(), "no_holder").when(F.col("n") > 1, "several_holders").otherwise("linked")
    return rows.select("s_suppkey", F.when(F.col("n") == 1, F.col("one")).alias("entity"), status.alias("status"))


@query("c22_missing_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def c22_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer", "c_custkey"), load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 400000")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti")


@query("c23_evidence_view", f"WITH {SQL_EVENTS}, r AS (SELECT clock, t // 86400000000 AS day, modality, count(*) AS n FROM ev GROUP BY ALL) SELECT clock, day, string_agg(modality || '=' || n, ',' ORDER BY modality) AS runs FROM r GROUP BY ALL")
def c23_evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run has on each observation, side by side."""
    runs = events(spark, sf_dir).groupBy("clock", F.expr("t div 86400000000").alias("day"), "modality").agg(F.count("*").alias("n"))
    return runs.groupBy("clock", "day").agg(F.array_join(F.array_sort(F.collect_list(F.concat("modality", F.lit("="), F.col("n").cast("string")))), ",").alias("runs"))


@query(
    "c25_adjacent_splits",
    f"WITH {SQL_EVENTS} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.clock = b.clock AND a.event_id % 3 <> b.event_id % 3 AND (a.t, a.event_id) < (b.t, b.event_id) AND b.t - a.t <= 1800000000",
)
def c25_adjacent_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one clock at most half an hour apart in different splits: buckets as wide as the window, the earlier
    record in its own and the next."""
    wide = 1_800_000_000
    rows = events(spark, sf_dir).select("clock", "event_id", "t", (F.col("event_id") % 3).alias("split"), F.expr(f"t div {wide}").alias("bucket"))
    early = rows.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1))).select("clock", "bucket", F.col("event_id").alias("a"), F.col("t").alias("ta"), F.col("split").alias("sa"))
    late = rows.withColumnRenamed("event_id", "b")
    return early.join(late, ["clock", "bucket"]).filter(F.expr(f"split <> sa AND t - ta <= {wide} AND (ta < t OR (ta = t AND a < b))")).select("a", "b")


_SQL_VECTORS = "x AS (SELECT vec_id, label, vec_id % 5 + 1 AS w, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS e FROM embeddings)"


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    return rows.select("vec_id", "label", (F.col("vec_id") % 5 + 1).alias("w"), F.posexplode("embedding").alias("dim", "e")).withColumn("e", F.col("e").cast("double"))


@query("d19_feature_pooling", f"WITH {_SQL_VECTORS} SELECT label, dim::BIGINT AS dim, round(sum(w * e) / sum(w), 6) AS mean FROM x GROUP BY ALL")
def d19_feature_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a region's vectors, each weighted by its share of the mask."""
    return _dims(spark, sf_dir).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.sum(F.col("w") * F.col("e")) / F.sum("w"), 6).alias("mean"))


@query("d22_masked_prototype", f"WITH {_SQL_VECTORS} SELECT label, dim::BIGINT AS dim, round(avg(e) FILTER (e > 0), 6) AS mean, count(*) FILTER (e > 0)::BIGINT AS defined FROM x GROUP BY ALL")
def d22_masked_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.when(F.col("e") > 0, F.col("e"))
    return _dims(spark, sf_dir).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(on), 6).alias("mean"), F.count(on).alias("defined"))


@query(
    "j6_feature_numerics",
    "SELECT label, count(*)::BIGINT AS n, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS shortest, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS longest, count(*) FILTER (len(embedding) <> 64)::BIGINT AS malformed FROM embeddings GROUP BY 1",
)
def j6_feature_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = load(spark, sf_dir, "embeddings", "label", "embedding").withColumn("norm", norm)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("norm"), 5).alias("shortest"), F.round(F.max("norm"), 5).alias("longest"), F.count_if(F.size("embedding") != 64).alias("malformed"))


@query(
    "i17_association_findings",
    f"""WITH {SQL_POINTS}, s AS (SELECT scan, count(*) AS n, quantile_disc(z, 0.95) AS p95, max(t) - min(t) AS span, avg((y > 9)::INT) AS invalid FROM points GROUP BY 1)
SELECT scan, concat_ws(',', CASE WHEN n < 500 THEN 'sparse' END, CASE WHEN p95 > 7 THEN 'residual' END, CASE WHEN span > 200000000000000 THEN 'window' END, CASE WHEN invalid > 0.1 THEN 'invalid_rate' END) AS findings FROM s""",
)
def i17_association_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY z)")
    s = points(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("n"), p95.alias("p95"), (F.max("t") - F.min("t")).alias("span"), F.avg((F.col("y") > 9).cast("int")).alias("invalid"))
    found = (F.when(F.col("n") < 500, "sparse"), F.when(F.col("p95") > 7, "residual"), F.when(F.col("span") > 200_000_000_000_000, "window"), F.when(F.col("invalid") > 0.1, "invalid_rate"))
    return s.select("scan", F.concat_ws(",", *found).alias("findings"))


@query("j16_reference_integrity", "SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_id, count(DISTINCT doc_id % 3)::BIGINT AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def j16_reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several records hold, and the splits they lie in."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.countDistinct(F.col("doc_id") % 3).alias("splits")).filter("copies > 1")


_SQL_ANSWERS = """an AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '```json' || chr(10) || '{"claims": [{"label": "' || event_type || '", "role": "primary", "confidence": ' || (value / 100)::DECIMAL(12, 4) || '}]}' || chr(10) || '```' WHEN 1 THEN '{"claims": [], "abstained": true}' WHEN 2 THEN '{"claims": [{"label": "a", "role": "primary"}, {"label": "b", "role": "primary"}]}'
  WHEN 3 THEN '{"claims": [], "note": 1}' WHEN 4 THEN 'I think it is a ' || event_type WHEN 5 THEN '{"claims": [{"label": " ", "role": "primary"}]}' WHEN 6 THEN '{"claims": [{"label": "a", "role": "alternative"}, {"label": "' || event_type || '", "role": "primary"}]}' WHEN 7 THEN '' ELSE '{"claims": []}' END AS answer, value FROM events)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", "event_id", "event_type", "value")
    k, kind = F.col("event_id") % 9, F.col("event_type")
    lit = F.lit
    answer = (
        F.when(k == 0, F.concat(lit('```json\n{"claims": [{"label": "'), kind, lit('", "role": "primary", "confidence": '), (F.col("value") / 100).cast("decimal(12,4)").cast("string"), lit("}]}\n```")))
        .when(k == 1, lit('{"claims": [], "abstained": true}')).when(k == 2, lit('{"claims": [{"label": "a", "role": "primary"}, {"label": "b", "role": "primary"}]}')).when(k == 3, lit('{"claims": [], "note": 1}'))
        .when(k == 4, F.concat(lit("I think it is a "), kind)).when(k == 5, lit('{"claims": [{"label": " ", "role": "primary"}]}')).when(k == 6, F.concat(lit('{"claims": [{"label": "a", "role": "alternative"}, {"label": "'), kind, lit('", "role": "primary"}]}')))
        .when(k == 7, lit("")).otherwise(lit('{"claims": []}'))
    )
    return rows.select("event_id", "value", answer.alias("answer"))


@query(
    "b18_strict_answers",
    f"""WITH {_SQL_ANSWERS} SELECT event_id, CASE event_id % 9 WHEN 0 THEN CASE WHEN value / 100 NOT BETWEEN 0 AND 1 THEN 'confidence' END WHEN 2 THEN 'not_one_primary' WHEN 3 THEN 'wrong_keys' WHEN 4 THEN 'not_json' WHEN 5 THEN 'wrong_claim' WHEN 7 THEN 'empty' WHEN 8 THEN 'no_claim' END AS problem,
  CASE WHEN event_id % 9 = 0 AND value / 100 BETWEEN 0 AND 1 THEN 1 WHEN event_id % 9 = 1 THEN 0 WHEN event_id % 9 = 6 THEN 2 END AS claims, sha256(answer) AS raw FROM an""",
)
def b18_strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without faults; the raw text is kept either way."""
    rows = _answers(spark, sf_dir).withColumn("p", parse_response(F.col("answer")))
    return rows.select("event_id", F.col("p.problem").alias("problem"), F.when(F.col("p.claims").isNotNull(), F.size("p.claims")).alias("claims"), F.sha2("answer", 256).alias("raw"))


@query("b19_prompts", "SELECT p_partkey, 'What is ' || p_name || ' of ' || p_brand || '? Answer as {\"claims\": [...]}.' AS prompt, sha256('What is {name} of {brand}? Answer as {{\"claims\": [...]}}.' || chr(1) || 'brand' || chr(2) || p_brand || chr(1) || 'name' || chr(2) || p_name) AS fingerprint FROM part")
def b19_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rendered('What is {name} of {brand}? Answer as {{"claims": [...]}}.', name=F.col("p_name"), brand=F.col("p_brand"))
    return load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", made.alias("m")).select("p_partkey", "m.prompt", "m.fingerprint")


@query("b20_json_redaction", """SELECT c_custkey, '{"name":"' || c_name || '","login":{"api_key":"[redacted]","tries":[{"my_token":"[redacted]","n":1}]},"mail":"[redacted]"}' AS config FROM customer""")
def b20_json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    text = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","login":{"api_key":"k'), F.col("c_acctbal").cast("string"), F.lit('","tries":[{"my_token":'), F.col("c_custkey").cast("string"), F.lit(',"n":1}]},"mail":"a'), F.col("c_custkey").cast("string"), F.lit('@example.com"}'))
    return rows.select("c_custkey", redact_json(text).alias("config"))


@query(
    "b9_region_reasons",
    "SELECT o_orderkey AS id, CASE WHEN area < 20000 THEN 'too_small' WHEN area > 450000 THEN 'too_large' WHEN valid / area < 0.5 THEN 'outside_valid_region' WHEN excluded / area > 0.2 THEN 'in_exclusion' END AS reason FROM (SELECT o_orderkey, o_totalprice AS area, coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'R'), 0) AS valid, coalesce(sum(l_extendedprice) FILTER (l_discount > 0.08), 0) AS excluded FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)",
)
def b9_region_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as regions: of their prices, that of items not returned lies in the valid region, that of discounted ones in an exclusion."""
    orders, items = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), load(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag", "l_discount")
    price, zero = F.col("l_extendedprice"), F.lit(0.0)
    sums = items.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") != "R", price)).alias("valid"), F.sum(F.when(F.col("l_discount") > 0.08, price)).alias("excluded"))
    rows = orders.join(sums, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = region_reasons(F.col("o_totalprice"), F.coalesce("valid", zero), F.coalesce("excluded", zero), 20000, 450000, 0.5, 0.2)
    return rows.select(F.col("o_orderkey").alias("id"), reason.alias("reason"))


@query(
    "b10_image_tiles",
    """WITH f AS (SELECT p_partkey AS frame, 200 + p_size * 20 AS w, 150 + p_size * 15 AS h FROM part), s AS (SELECT *, CASE WHEN w <= 256 THEN 0 ELSE ceil((w - 256) / 192.0)::INT END AS nx, CASE WHEN h <= 256 THEN 0 ELSE ceil((h - 256) / 192.0)::INT END AS ny FROM f),
t AS (SELECT frame, w, h, (j * (nx + 1) + i + 1)::INT AS tile, greatest(least(i * 192, w - 256), 0)::INT AS x, greatest(least(j * 192, h - 256), 0)::INT AS y, least(w, 256)::INT AS width, least(h, 256)::INT AS height FROM s, range(6) AS a(i), range(6) AS b(j) WHERE i <= nx AND j <= ny AND (nx > 0 OR ny > 0))
SELECT frame, tile, x, y, width, height, (100 >= width - 1 AND x + width < w) OR y > 0 AS cut FROM t UNION ALL SELECT frame, 0, 0, 0, w::INT, h::INT, false FROM f""",
)
def b10_image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image and its tiles, and whether a region from (5, 0) to (100, 20) of each may be cut by its edge."""
    size = F.col("p_size")
    frames = load(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("frame"), (200 + size * 20).alias("w"), (150 + size * 15).alias("h"))
    each = frames.select("frame", "w", "h", F.explode(tiles(F.col("w"), F.col("h"), 256, 64)).alias("t"))
    lit = F.lit
    return each.select("frame", "t.tile", "t.x", "t.y", "t.width", "t.height", cut_by_tile(lit(5), lit(100), lit(0), lit(20), F.col("t"), F.col("w"), F.col("h")).alias("cut"))
