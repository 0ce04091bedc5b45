"""Operators on rows small enough to work out by hand."""

import math
import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions.scalars import label_key
from cairn.operators import assembly, channels, evaluation, graphs, grids, moments, predicates, text
from cairn.operators.evidence import materialize
from cairn.operators.frames import FrameGraph, compose, invert
from cairn.operators.graphs import components, overlaps
from cairn.operators.spatial_joins import box_pairs, contact_pairs, dealt, entity_candidates, gathered, interval_pairs, min_filter, nearest_k, neighbourhoods, radius_components, within_radius
from cairn.operators.time_joins import interpolated, nearest_record, nearest_within, neighbours_in_time, select_ids, selection_identity, unmatched
from cairn.operators.voxel import inter_scan_voxels

XYZ = "x double, y double, z double"
BOX = ", ".join(f"{m}_{a} double" for a in "xyz" for m in ("min", "max"))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tolerance_join_ties_and_reasons(spark):
    anchors = spark.createDataFrame([("c", 1, 100), ("c", 2, 500), ("d", 3, 100)], "clock string, anchor_id long, t long")
    found = spark.createDataFrame([("c", 20, 95), ("c", 10, 105)], "clock string, candidate_id long, t long")
    out = {r["anchor_id"]: (r["candidate_id"], r["offset"], r["status"]) for r in nearest_within(anchors, found, 5).collect()}
    assert out == {1: (10, 5, "matched"), 2: (None, None, "outside_tolerance"), 3: (None, None, "clock_id_mismatch")}


def test_asof_prefers_the_earlier_and_refuses_gaps(spark):
    queries = spark.createDataFrame([("c", 1, 5), ("c", 2, -3), ("c", 3, -6), ("c", 4, 0)], "clock string, query_id long, t long")
    records = spark.createDataFrame([("c", 0, 1.0), ("c", 10, 3.0)], "clock string, t long, v double")
    placed = neighbours_in_time(queries, records, "v")
    assert rows(nearest_record(placed, 5), "query_id", "value", "status") == [(1, 1.0, "found"), (2, 1.0, "found"), (3, None, "out_of_range"), (4, 1.0, "found")]
    assert rows(interpolated(placed, 10), "query_id", "status") == [(1, "interpolated"), (2, "out_of_range"), (3, "out_of_range"), (4, "exact")]
    assert rows(interpolated(placed, 9), "query_id", "status")[0] == (1, "interpolation_gap")


def test_voxels_take_the_floor_of_negative_places(spark):
    points = spark.createDataFrame([(-0.1, 0.0, 0.0, 1, 1, 5), (0.1, 0.0, 0.0, 1, 1, 6), (0.2, 0.0, 0.0, 1, 1, 7)], "x double, y double, z double, scan int, observation int, t long")
    assert rows(inter_scan_voxels(points, 1.0), "vx", "point_count", "scan_count") == [(-1, 1, 1), (0, 2, 1)]


def test_window_minimum_sees_diagonal_neighbours(spark):
    cells = spark.createDataFrame([(1, 0, 0, 10.0), (1, 1, 1, 1.0), (2, 0, 1, 7.0)], "frame int, row long, col long, depth double")
    assert rows(min_filter(cells, 1), "frame", "row", "col", "window_min") == [(1, 0, 0, 1.0), (1, 1, 1, 1.0), (2, 0, 1, 7.0)]


def test_overlap_links_are_inclusive_and_chains_connect(spark):
    members = spark.createDataFrame([(0, x) for x in (1, 2, 3)] + [(1, x) for x in (2, 3, 4)] + [(2, 9)], "set int, member int")
    pairs = overlaps(members, 0.5)
    assert rows(pairs, "a", "b", "shared") == [(0, 1, 2)]
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node int")
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 29)], "a int, b int")
    assert rows(components(nodes, chain), "node", "component") == [(i, 0 if i < 30 else i) for i in range(40)]


def cloud(n, seed, side=10.0):
    rng = random.Random(seed)
    return [(i, *(rng.uniform(0, side) for _ in range(3))) for i in range(n)]


def far(p, q):
    return math.dist(p[1:], q[1:])


def test_candidates_without_an_anchor_say_why(spark):
    anchors = spark.createDataFrame([("c", 1, 100)], "clock string, anchor_id long, t long")
    found = spark.createDataFrame([("c", 20, 95), ("c", 10, 105), ("e", 30, 100)], "clock string, candidate_id long, t long")
    assert rows(unmatched(nearest_within(anchors, found, 5), anchors, found), "candidate_id", "reason") == [(20, "no_anchor_within_tolerance"), (30, "clock_id_mismatch")]
    assert rows(nearest_within(anchors, found.limit(0), 5), "status") == [("no_candidate",)] and nearest_within(anchors.limit(0), found, 5).count() == 0


def test_neighbours_in_time_equal_a_search_over_slots(spark):
    rng = random.Random(3)
    records = [(f"c{rng.randrange(3)}", rng.randrange(10_000), float(i)) for i in range(200)]
    queries = [(f"c{rng.randrange(4)}", i, rng.randrange(-50, 10_050)) for i in range(200)]
    q, r = spark.createDataFrame(queries, "clock string, query_id long, t long"), spark.createDataFrame(records, "clock string, t long, v double")
    for slots in (1, 7, 500):
        got = {x["query_id"]: (x["t0"], x["v0"], x["t1"], x["v1"]) for x in neighbours_in_time(q, r, "v", slots=slots).collect()}
        for clock, i, t in queries:
            own = [(at, v) for c, at, v in records if c == clock]
            t0, t1 = max((x for x, _ in own if x <= t), default=None), min((x for x, _ in own if x >= t), default=None)
            v = lambda at: max((w for x, w in own if x == at), default=None)  # noqa: B023, E731
            assert got[i] == (t0, v(t0), t1, v(t1))
    assert neighbours_in_time(q.limit(0), r, "v").count() == 0 and neighbours_in_time(q, r.limit(0), "v").count() == 200


def test_all_centres_keep_their_neighbours(spark):
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 500.0, 0.0)], "point long, x double, y double")
    assert nearest_k(few, few, 5, 1.0, ("x", "y")).count() == 9
    points = cloud(60, 1) + [(99, 400.0, 400.0, 400.0)]
    df = spark.createDataFrame(points, f"point long, {XYZ}")
    got = {}
    for r in nearest_k(df, df, 4, 0.5).collect():
        got.setdefault(r["centre"], {})[r["rank"]] = r["point"]
    assert got == {p[0]: dict(enumerate((q[0] for q in sorted(points, key=lambda q: (far(p, q) ** 2, q[0]))[:4]), 1)) for p in points}
    assert nearest_k(df, df.limit(0), 4, 0.5).count() == 0 and nearest_k(df.limit(0), df, 4, 0.5).count() == 0


def test_neighbourhoods_are_cut_by_rank(spark):
    df = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0)], f"point long, {XYZ}")
    got = rows(neighbourhoods(df.filter("point = 5"), df, 1.5, 2), "rank", "point", "candidates")
    assert got == [(1, 5, 3), (2, 1, 3)]


def test_radius_join_within_groups(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 1.0, 0.0, 0.0), ("b", 3, 0.5, 0.0, 0.0)], f"entity string, point long, {XYZ}")
    assert rows(within_radius(df, df, 1.0, group="entity").filter("centre < point"), "centre", "point") == [(1, 2)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_joins_and_components_are_never_broadcast(spark):
    """What a few cells or ids are before they are dealt out says nothing of what they are after."""
    df = spark.range(40).selectExpr("id AS point", "id % 2 AS entity", "id / 9D AS x", "0D AS y", "0D AS z")
    found = within_radius(df, df, 1.0, group="entity")
    assert "Broadcast" not in plan_of(found) and "Broadcast" not in plan_of(within_radius(df, df, 1.0))
    assert "Broadcast" not in plan_of(components(df.select(F.col("point").alias("node")), found.selectExpr("centre AS a", "point AS b")))


def test_radius_join_within_small_and_large_groups(spark):
    """A group of at most 27 points is one cell, larger ones have cells."""
    points = [(g, g * 1000 + i, *p[1:]) for g, n in ((1, 27), (2, 28), (3, 90)) for i, p in enumerate(cloud(n, g))]
    df = spark.createDataFrame(points, f"entity long, point long, {XYZ}")
    expect = sorted((p[1], q[1]) for p in points for q in points if p[0] == q[0] and far(p[1:], q[1:]) <= 2.0)
    assert rows(within_radius(df, df, 2.0, group="entity"), "centre", "point") == expect


def met_by(run, at="cairn.operators.spatial_joins.within_radius"):
    """What ``run()`` returns, and how many centres and points its radius joins were given at most."""
    seen = []
    with mock.patch(at, side_effect=lambda c, p, *a, **b: (seen.append((c.count(), p.count())), within_radius(c, p, *a, **b))[1]):
        out = run()
    return out, max(c for c, _ in seen), max(p for _, p in seen)


def copies(spark, n=300):
    """Points 0 to n - 1 at one place, n to n + 3 at others."""
    return spark.range(n + 4).selectExpr("id AS point", f"greatest(0, id - {n} + 1) * 1D AS x", "0D AS y", "0D AS z")


def test_nearest_of_many_copies_are_found_once(spark):
    df = copies(spark)
    got, centres, points = met_by(lambda: rows(nearest_k(df, df, 3, 1.0), "centre", "rank", "point"))
    assert centres == 5 and points == 7
    assert got[:3] == [(0, 1, 0), (0, 2, 1), (0, 3, 2)] and got[-3:] == [(303, 1, 303), (303, 2, 302), (303, 3, 301)] and len(got) == 304 * 3


def test_neighbourhoods_of_many_copies_are_found_once(spark):
    df = copies(spark)
    got, centres, points = met_by(lambda: rows(neighbourhoods(df, df, 1.0, 3), "centre", "rank", "point", "candidates"))
    assert centres == 5 and points == 5
    assert [r for r in got if r[0] == 7] == [(7, 1, 7, 301), (7, 2, 0, 301), (7, 3, 1, 301)] and [r for r in got if r[0] == 300] == [(300, 1, 300, 302), (300, 2, 0, 302), (300, 3, 1, 302)]


def test_components_of_many_copies_link_places(spark):
    nan = spark.createDataFrame([(900, float("nan"), 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], f"point long, {XYZ}")
    got, centres, points = met_by(lambda: dict(rows(radius_components(copies(spark).filter("point <> 301").unionByName(nan), 1.0), "node", "component")))
    assert centres == points == 4
    assert got == {**dict.fromkeys([*range(301)], 0), 302: 302, 303: 302, 900: 900, 901: 901}


def test_components_in_one_task_equal_those_in_rounds(spark):
    nodes = spark.range(40).selectExpr("id AS node")
    edges = spark.range(0, 36).filter("id % 9 <> 8").selectExpr("id + 1 AS a", "id AS b").unionByName(spark.range(77, 78).selectExpr("id AS a", "0L AS b"))
    with mock.patch.object(graphs, "ONE_TASK", -1):
        expect = rows(components(nodes, edges), "node", "component")
    with mock.patch.object(graphs, "ONE_TASK", 10**6):
        assert rows(components(nodes, edges, rounds=0), "node", "component") == expect == [(i, i // 9 * 9 if i < 36 else i) for i in range(40)]


def test_dense_components_are_joined_without_rounds(spark):
    """More edges than one task joins, but few nodes: each task gives on a forest, and no round is needed."""
    edges = spark.range(0, 4000, numPartitions=4).selectExpr("id % 40 AS a", "40 + id % 37 AS b").unionByName(spark.range(200, 300).selectExpr("id AS a", "id + 1 AS b"))
    with mock.patch.object(graphs, "ONE_TASK", 400), mock.patch.object(graphs, "_in_rounds", side_effect=AssertionError):
        got = dict(rows(components(spark.range(310).selectExpr("id AS node"), edges), "node", "component"))
    assert got == {i: 0 if i < 77 else 200 if 200 <= i <= 300 else i for i in range(310)}


@pytest.mark.parametrize(("one_task", "most_nodes"), [(3, 5), (1, 2), (60, 3), (500, 10**6)])
def test_forests_of_any_size_link_what_edges_link(spark, one_task, most_nodes):
    rng = random.Random(one_task)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    expect = {i: i for i in range(140)}
    for _ in range(140):
        for a, b in pairs:
            expect[a] = expect[b] = min(expect[a], expect[b])
    with mock.patch.object(graphs, "ONE_TASK", one_task), mock.patch.object(graphs, "MOST_NODES", most_nodes):
        edges = spark.createDataFrame([*pairs, (3, None), (7, 500)], "a long, b long").repartition(3)
        assert dict(rows(components(spark.range(140).selectExpr("id AS node"), edges), "node", "component")) == expect


def test_contacts_join_places(spark, tmp_path):
    from cairn.plans import shape_queries

    spark.range(200).selectExpr("id AS p_partkey", "concat('b', id % 2) AS p_brand", "1 AS p_size", "900D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got, centres, points = met_by(lambda: rows(shape_queries.c17_contacts(spark, str(tmp_path)), "a", "b", "nearest", "pairs", "contacts_a", "contacts_b"), "cairn.plans.shape_queries.within_radius")
    assert centres == points == 1 and got == [("b0", "b1", 0.0, 10_000, 100, 100)]


def test_radius_neighbours_join_places(spark, tmp_path):
    from cairn.plans import spatial_queries

    spark.range(600).selectExpr("id AS p_partkey", "CAST(id % 2 AS INT) AS p_size", "900D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got, centres, points = met_by(lambda: rows(spatial_queries.c11_radius_neighbours(spark, str(tmp_path)), "centre", "point", "d2"), "cairn.plans.spatial_queries.within_radius")
    assert centres == points == 2 and got == [(a, b, float((a - b) % 2)) for a in range(600) for b in range(600)]


def test_gathered_rows_are_dealt_with_all_their_keys(spark):
    df = spark.createDataFrame([(k, 1.0) for k in (5, 3, 3, None, 1)] + [(7, 2.0), (8, None)], "k long, x double")
    found = gathered(df, "k", most=2)
    assert sorted((r["k"] for r in found.filter("x = 1").collect()), key=str) == [[1, 3], [3, 5], [None]]
    assert sorted(map(str, dealt(found, "k").collect())) == sorted(map(str, df.collect()))


def some_boxes(seed, n=40, large=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        low, size = [rng.uniform(0, 20) for _ in range(3)], [rng.uniform(0, 40 if i < large else 1.5) for _ in range(3)]
        out.append((i, *[x for a, s in zip(low, size, strict=True) for x in (a, a + s)]))
    return out


def gap(p, q):
    return math.sqrt(sum(max(0, p[k] - q[k + 1], q[k] - p[k + 1]) ** 2 for k in (1, 3, 5)))


def test_box_joins_equal_all_pairs(spark):
    boxes = some_boxes(2)
    df = spark.createDataFrame(boxes, f"box long, {BOX}")
    pairs = [(p, q) for i, p in enumerate(boxes) for q in boxes[i + 1 :]]
    assert rows(box_pairs(df, 1.0, 2.0), "a", "b") == sorted((p[0], q[0]) for p, q in pairs if gap(p, q) <= 1.0)
    assert rows(interval_pairs(df, 0.7, slots=16), "a", "b") == sorted((p[0], q[0]) for p, q in pairs if all(min(p[k + 1], q[k + 1]) - max(p[k], q[k]) >= -0.7 for k in (1, 3, 5)))
    assert interval_pairs(df.limit(0), 1.0).count() == 0


def test_wide_boxes_meet_in_slots_with_their_bounds(spark):
    """Boxes that are wide on x and spread on y."""
    df = spark.range(60).selectExpr("id AS box", "0D AS min_x", "40D AS max_x", "id * 1D AS min_y", "id + 0.5D AS max_y")
    found = box_pairs(df, 0.5, 16.0, ("x", "y"))
    assert rows(found, "a", "b", "a_max_y", "b_min_y") == [(i, i + 1, i + 0.5, i + 1.0) for i in range(59)]
    assert "Broadcast" not in plan_of(found)


def test_wide_entities_meet_in_slots_of_the_other_axis(spark):
    df = spark.range(40).selectExpr("id AS entity", "id % 1 AS map", "id % 1 AS frame", "20D AS cx", "id * 2D AS cy", "0D AS cz", "0D AS min_x", "40D AS max_x", "id * 2D AS min_y", "id * 2D AS max_y", "0D AS min_z", "0D AS max_z", "0 AS first_t", "0 AS last_t")
    found = entity_candidates(df, 3.0, 0.05)
    assert rows(found, "a", "b") == [(i, i + 1) for i in range(39)] and "Broadcast" not in plan_of(found)


def test_entity_candidates_equal_all_pairs_also_of_large_boxes(spark):
    rng = random.Random(4)
    boxes = some_boxes(3)
    ents = [(b[0], f"m{b[0] % 2}", "map", *[(b[k] + b[k + 1]) / 2 for k in (1, 3, 5)], *b[1:], (t := rng.randrange(100)), t + 20) for b in boxes]
    df = spark.createDataFrame(ents, f"entity long, map string, frame string, cx double, cy double, cz double, {BOX}, first_t long, last_t long")
    expect = {}
    for i, p in enumerate(ents):
        for q in ents[i + 1 :]:
            why = [w for w, ok in (("near_centroids", math.dist(p[3:6], q[3:6]) <= 2.5), ("near_bounds", gap((0, *p[6:12]), (0, *q[6:12])) <= 0.4)) if ok]
            if p[1] == q[1] and why and max(p[12], q[12]) - min(p[13], q[13]) <= 30:
                expect[p[0], q[0]] = why
    for most in (512, 4, 0):
        with mock.patch("cairn.operators.spatial_joins.MOST_CELLS", most):
            assert {(r["a"], r["b"]): r["reasons"] for r in entity_candidates(df, 2.5, 0.4, 30).collect()} == expect
    assert expect


def test_contacts_equal_all_pairs(spark):
    points = [(i % 5, *p) for i, p in enumerate(cloud(80, 9, 6.0))]
    df = spark.createDataFrame(points, f"entity long, point long, {XYZ}")
    expect = {}
    for p in points:
        for q in points:
            d = math.dist(p[2:], q[2:])
            if p[0] != q[0] and d <= 1.5:
                e = expect.setdefault((p[0], q[0]), [9.0, 0, set(), set()])
                e[0], e[1] = min(e[0], d), e[1] + 1
                if d <= 1.0:
                    e[2].add(p[1]), e[3].add(q[1])
    got = {(r["subject"], r["object"]): (round(r["nearest"], 9), r["pairs"], r["contacts_s"], r["contacts_o"]) for r in contact_pairs(df, 1.5, 1.0).collect()}
    assert got == {k: (round(a, 9), n, len(s), len(o)) for k, (a, n, s, o) in expect.items()}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_overlaps_equal_all_pairs_with_a_member_in_every_set(spark, least):
    rng = random.Random(int(least * 10))
    base = [set(rng.sample(range(30), 8)) for _ in range(6)]
    sets = {i: {0, *rng.sample(sorted(base[i % 6]), rng.randint(5, 8)), 100 + i % 4} for i in range(40)}
    members = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s] * 2, "set long, member long")
    expect = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert {(r["a"], r["b"]): r["shared"] for r in overlaps(members, least, 7).collect()} == expect and expect


def test_unfinished_components_are_an_error_and_paths_are_shortest(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(spark.range(41).select(F.col("id").alias("node")), chain, rounds=2)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("p", "q")], "a string, b string")
    ends = spark.createDataFrame([("a", "d"), ("a", "q"), ("a", "c"), ("p", "q")], "a string, b string")
    assert {(r["a"], r["b"]): r["path"] for r in graphs.shortest_paths(links, ends).collect()} == {("a", "d"): ["a", "b", "c", "d"], ("a", "c"): ["a", "b", "c"], ("p", "q"): ["p", "q"]}
    entities = spark.createDataFrame([(x,) for x in "abcdpqxz"], "entity string")
    assert rows(graphs.match_components(entities, links), "component", "members") == [("a", ["a", "b", "c", "d", "x"]), ("p", ["p", "q"]), ("z", ["z"])]


def test_a_cluster_without_a_shared_folder_is_refused():
    context = mock.Mock(master="yarn", **{"getCheckpointDir.return_value": None})
    session = mock.Mock(sparkContext=context, conf=mock.Mock(**{"get.return_value": None}))
    with pytest.raises(RuntimeError):
        graphs.cut(mock.Mock(sparkSession=session))


def test_gates_channels_and_findings(spark):
    pairs = spark.createDataFrame([(1, 1, "m", "m", "f", "f"), (1, 2, "m", None, "f", "g"), (1, 3, "m", "m", "f", "f")], "a_entity long, b_entity long, a_map string, b_map string, a_frame string, b_frame string")
    got = pairs.select(channels.gates().alias("g"), channels.blocked(channels.gates()).alias("b")).collect()
    assert [[x["passed"] for x in r["g"]] for r in got] == [[False, True, True], [True, False, False], [True, True, True]] and [r["b"] for r in got] == [True, True, False]
    unit, inner, flat, away = (0, 1, 0, 1, 0, 1), (0, 0.5, 0, 1, 0, 1), (0, 1, 0, 1, 0, 0), (5, 6, 0, 1, 0, 1)
    columns = ", ".join(f"{s}_{m}_{a} double" for s in "ab" for a in "xyz" for m in ("min", "max"))
    df = spark.createDataFrame([tuple(map(float, unit + b)) for b in (unit, inner, flat, away)], columns).withColumns(channels.box_measures()).withColumn("jaccard", F.lit(0.0))
    out = df.withColumn("f", channels.geometry_findings()).select("iou", "extent_ratio", "gap", channels.status_of(F.col("f")).alias("s"), F.transform("f", lambda f: f["status"]).alias("f")).collect()
    assert [r["s"] for r in out] == ["supports", "supports", "neutral", "conflicts"] and [r["iou"] for r in out] == [1.0, 0.5, None, 0.0]
    assert [r["extent_ratio"] for r in out] == [1.0, 0.5, None, 1.0] and out[3]["gap"] == 4.0 and out[1]["f"] == ["neutral", "supports", "supports", "neutral", "neutral"]


def test_semantic_channel_cases(spark):
    labels = spark.createDataFrame([("p", "red chair"), ("q", "chair"), ("r", "sofa"), ("s", "bench"), ("t", "table"), ("u", "table"), ("u", "lamp")], "entity string, label string")
    states = spark.createDataFrame([(x, "unambiguous") for x in "pqrst"] + [("u", "ambiguous"), ("v", "insufficient")], "entity string, state string")
    attributes = spark.createDataFrame([("p", "colour", "Red"), ("q", "colour", "red"), ("r", "colour", "blue"), ("t", "colour", "blue")], "entity string, name string, value string")
    pairs = spark.createDataFrame([("p", "q"), ("r", "s"), ("p", "r"), ("p", "u"), ("p", "v"), ("r", "t")], "a string, b string")
    got = {(r["a"], r["b"]): (r["label_finding"], r["attribute_finding"], r["status"]) for r in channels.semantic_channel(pairs, labels, states, attributes, ["red"], [("sofa", "bench")]).collect()}
    assert got == {("p", "q"): ("supports", "neutral", "supports"), ("r", "s"): ("neutral", None, "neutral"), ("p", "r"): ("conflicts", "conflicts", "conflicts"), ("p", "u"): ("neutral", None, "neutral"), ("p", "v"): (None, None, "unavailable"), ("r", "t"): ("conflicts", "neutral", "conflicts")}


def test_semantic_channel_equals_a_plain_loop(spark):
    """Refinements by several words, values that are null or several, entities without labels, attributes or either."""
    rng = random.Random(2)
    labels = [(e, " ".join([*rng.sample(["red", "old", "red"], rng.randint(0, 2)), rng.choice(["bolt", "old bolt", "gear", "red"])])) for e in range(24) for _ in range(rng.randint(0, 2))]
    states = [(e, rng.choice(["unambiguous", "ambiguous"])) for e in range(22)]
    values = [(e, rng.choice("pq"), rng.choice(["X", "x ", "y", None])) for e in range(2, 26) for _ in range(rng.randint(0, 3))]
    pairs = [(a, b) for a in range(27) for b in range(a + 1, 27)]

    def refines(a, b):
        x, y = a.split(), b.split()
        return len(x) > len(y) and x[-len(y) :] == y and set(x[: -len(y)]) <= {"red", "old"}

    def expect(a, b):
        la, lb, label, attribute = [x for e, x in labels if e == a], [x for e, x in labels if e == b], None, None
        va, vb = [{(n, v.strip().lower()) for e, n, v in values if e == x and v} for x in (a, b)]
        if la and lb:
            alike = any(x == y or refines(x, y) or refines(y, x) for x in la for y in lb)
            settled = dict(states).get(a) == dict(states).get(b) == "unambiguous"
            label = "supports" if alike else "neutral" if any({x, y} == {"bolt", "gear"} for x in la for y in lb) else "conflicts" if settled else "neutral"
            differ = [v != w for n, v in va for m, w in vb if n == m]
            attribute = None if not differ else "conflicts" if any(differ) else "neutral"
        found = {label, attribute} - {None}
        return label, attribute, "unavailable" if not found else "conflicts" if "conflicts" in found else "supports" if "supports" in found else "neutral"

    frame = spark.createDataFrame
    got = channels.semantic_channel(frame(pairs, "a long, b long"), frame(labels, "entity long, label string"), frame(states, "entity long, state string"), frame(values, "entity long, name string, value string"), ["red", "old"], [("bolt", "gear")])
    assert {(r["a"], r["b"]): tuple(r)[2:] for r in got.collect()} == {p: expect(*p) for p in pairs}


def test_similarity_reasons_and_undefined_components(spark):
    features = spark.createDataFrame([("a", 1, "s", [1.0, 0.0]), ("a", 1, "s", [0.0, 1.0]), ("a", 2, "s", [0.0, 2.0]), ("b", 3, "s", [0.0, 1.0]), ("c", 4, "o", [1.0, 0.0]), ("d", 5, "s", [0.0, 0.0]), ("e", 6, "s", [None, 1.0]), ("f", 7, "s", [0.0, -1.0])], "entity string, observation long, space string, vector array<double>")
    pairs = spark.createDataFrame([("a", x) for x in "bcdfz"] + [("c", "z")], "a string, b string")
    got = {r["b"] if r["a"] == "a" else "cz": r for r in channels.similarity_channel(pairs, features, "s", 0.9, -0.5).collect()}
    assert [got[x]["reason"] for x in "bcdfz"] == [None, "incompatible_domain", "insufficient_evidence", None, "missing_evidence"] and got["cz"]["reason"] == "missing_evidence"
    first = np.array([1, 1]) / np.sqrt(2)
    proto = (first + [0, 1]) / 2
    assert got["b"]["similarity"] == pytest.approx(proto[1] / np.hypot(*proto)) and got["b"]["pair_min"] == pytest.approx(first[1]) and got["b"]["pair_max"] == 1.0
    assert got["b"]["status"] == "supports" and got["f"]["status"] == "conflicts"
    masked = channels.similarity_channel(spark.createDataFrame([("b", "e")], "a string, b string"), features, "s", 0.9, by_observation=False, least_share=0.6).first()
    assert masked["reason"] == "insufficient_evidence"
    assert channels.similarity_channel(spark.createDataFrame([("b", "e")], "a string, b string"), features, "s", 0.9, by_observation=False, least_share=0.5).first()["similarity"] == 1.0


def test_support_distances_equal_loops(spark):
    points = [(i % 4, *p) for i, p in enumerate(cloud(60, 12))]
    df = spark.createDataFrame(points, f"entity long, point long, {XYZ}")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "a long, b long")
    own = {e: [p[2:] for p in points if p[0] == e] for e in range(4)}
    for r in channels.support_distances(pairs, df).collect():
        ab = [min(math.dist(p, q) for q in own[r["b"]]) for p in own[r["a"]]]
        ba = [min(math.dist(p, q) for q in own[r["a"]]) for p in own[r["b"]]]
        assert (r["a_to_b"], r["b_to_a"], r["hausdorff"]) == pytest.approx((sum(ab) / len(ab), sum(ba) / len(ba), max(ab + ba)))
    assert [len(r["points"]) for r in channels.even_sample(df, 4).collect()] == [4] * 4


def test_splits(spark):
    lump = lambda e, k, x, n: [(e, 100 * k + i, x + i * 0.1, 0.0, 0.0) for i in range(n)]
    points = lump("one", 1, 0, 9) + lump("two", 2, 0, 5) + lump("two", 3, 9, 5) + lump("near", 4, 0, 5) + lump("near", 5, 1.0, 5) + lump("odd", 6, 0, 9) + lump("odd", 7, 9, 1)
    found = channels.split_candidates(spark.createDataFrame(points, f"entity string, point long, {XYZ}"), channels.SplitPolicy(0.3, 2, 0.1, 2.0, 0.9))
    assert rows(found, "entity", "pieces", "significant", "status") == [("near", 2, 2, "unresolved"), ("odd", 2, 1, "rejected"), ("two", 2, 2, "suggested")]


def test_relation_evidence_by_hand(spark):
    names = [f"{s}_{m}_{a}" for s in "so" for a in "xyz" for m in ("min", "max")]
    cases = {"above": (0, 1, 0, 1, 1, 2, 0, 1, 0, 1, 0, 1), "inside": (0.2, 0.8, 0.2, 0.8, 0.2, 0.8, 0, 1, 0, 1, 0, 1), "in_front_of": (3, 4, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1)}
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in cases.items()], "name string, " + ", ".join(f"{n} double" for n in names)).withColumns({f"{s}_{c}": F.lit(v) for s in "so" for c, v in (("points", 9), ("pieces", 1))})
    checks = predicates.geometric_checks()
    got = {r["name"]: r for r in df.select("name", *[predicates.evidence_status(c, predicates.unreliable(n in predicates.DEPTH)).alias(n) for n, c in checks.items()]).collect()}
    assert {n: [k for k in checks if got[n][k] == "supports"] for n in cases} == {"above": ["next_to", "above"], "inside": ["intersects", "inside"], "in_front_of": ["in_front_of"]}
    weak = df.withColumn("s_points", F.lit(2)).select(predicates.evidence_status(checks["inside"], predicates.unreliable(False)).alias("x")).collect()
    assert {r["x"] for r in weak} == {"ambiguous"}
    kept = {(r["name"], r["predicate"]): r["excluded"] for r in predicates.candidate_rules(df.select("name", *names)).collect()}
    assert len(kept) == 24 and kept["above", "above"] is None and kept["in_front_of", "above"] == "no_footprint_overlap" and kept["in_front_of", "next_to"] == "beyond_reach" and kept["inside", "above"] == "not_on_the_directed_side" and kept["above", "inside"] is None
    touch = df.withColumns({"nearest": F.lit(0.01), "contacts_s": F.lit(5), "contacts_o": F.lit(2), "s_tilt": F.lit(None).cast("double")})
    said = touch.filter("name = 'above'").select(*[predicates.evidence_status(c).alias(n) for n, c in predicates.contact_checks().items()]).first()
    assert (said["touching"], said["on_top_of"], said["leaning_against"]) == ("ambiguous", "ambiguous", "conflicts")


def test_rejections_come_in_their_order(spark):
    scans = [(i, "lidar", "c", 1, 5, "xyz") for i in range(10)]
    scans[0], scans[1], scans[2], scans[3] = (0, None, None, 1, 0, None), (1, "lidar", "", 1, 0, None), (2, "lidar", "c", 1, None, None), (3, "lidar", "c", 1, 5, "other")
    scans[6], scans[7] = (6, "camera", "c", 1, 5, "xyz"), (7, "body", "d", 1, 5, "xyz")
    declared = [(4, "corrected", None), (5, "uncorrected", None), (9, "corrected", 7)]
    poses = [(i, i, "found") for i in range(8)] + [(8, 8, "out_of_range"), (9, 9, "exact")]
    df = assembly.assemble(spark.createDataFrame(scans, "scan long, frame string, clock string, t long, n_points long, format string"), spark.createDataFrame(poses, "scan long, pose long, status string"), spark.createDataFrame([("lidar", 1)], "frame string, extrinsic long"), spark.createDataFrame(declared, "scan long, state string, corrected_t long"), body="body", clock="c", formats=("xyz",))
    assert [r["rejection"] for r in df.orderBy("scan").collect()] == [*assembly.REJECTIONS, None]


def test_poses_are_checked_and_brought_to_length_one(spark):
    nan = float("nan")
    poses = [("a", 1, 0.0, 0, 0, 1.0001), ("a", 2, nan, 0, 0, 1.0), ("a", 3, 0.0, 0, 0, 0.0), ("a", 50, 0.0, 0, 1.0, 1.0), ("a", 60, 0.0, 0, 0, 1.0), ("a", 60, 0.0, 0, 0, 1.0)]
    df = spark.createDataFrame([(k, t, x, 0.0, 0.0, float(qx), 0.0, float(qz), float(qw)) for k, t, x, qx, qz, qw in poses], "trajectory string, t long, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = assembly.check_poses(df, 0.001, 20).orderBy("t", "problem").collect()
    assert [r["problem"] for r in got] == [None, "non_finite_translation", "invalid_orientation", "invalid_orientation", None, "non_increasing_time"]
    assert got[0]["renormalized"] and got[0]["qw"] == 1.0 and got[4]["gap"] and not got[4]["renormalized"]


def test_maps_are_accumulated_and_read_in_blocks(spark):
    scans = spark.createDataFrame([("m", "s2", "f", "c", 5), ("m", "s1", "f", "c", 3), ("m", "s3", "f", "c", 9), ("n", "s1", "f", "c", 1), ("n", "s1", "g", "d", 1), ("e", "s9", "f", "c", 1)], "map string, scan string, frame string, clock string, t long")
    points = spark.createDataFrame([("m", "s1", float(i), 0.0, 0.0) for i in range(5)] + [("m", "s2", 10.0, 0.0, 0.0), ("m", "s2", float("inf"), 0.0, 0.0)], f"map string, scan string, {XYZ}")
    records = assembly.accumulate(scans, points)
    assert rows(records.filter("map = 'm'"), "scan", "ordinal", "first", "n", "dropped") == [("s1", 0, 0, 5, 0), ("s2", 1, 5, 1, 1), ("s3", 2, 6, 0, 0)]
    assert {r["map"]: r["problem"] for r in assembly.map_summary(records).collect()} == {"m": None, "n": "duplicate_scan", "e": "empty"}
    placed = points.filter("x < 20").withColumn("index", F.when(F.col("scan") == "s1", F.col("x")).otherwise(5).cast("long"))
    own = records.filter("map = 'm'")
    assert rows(assembly.read_blocks(placed, own, 2), "index", "block") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 0)]
    assert rows(assembly.read_blocks(placed, own, 2, {"x": (1.0, 3.0)}), "index", "block") == [(1, 0), (2, 1), (3, 1)]
    with pytest.raises(ValueError):
        assembly.read_blocks(placed, own, 0)


def test_axes_and_descriptors_equal_numpy(spark):
    rng = np.random.default_rng(5)
    clouds = {0: rng.normal(size=(60, 3)) * [5, 2, 0.5], 1: rng.normal(size=(40, 3)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * [4, 1, 0.2], 2: np.ones((5, 3)), 3: np.array([[0.0, 0, 0]])}
    data = [(g, i, *map(float, p)) for g, c in clouds.items() for i, p in enumerate(c)]
    df = spark.createDataFrame(data, f"g long, point long, {XYZ}")
    got = {r["g"]: r for r in moments.orientation(df, "g", 4, 1.2).collect()}
    assert got[2]["reason"] == "not_distinct" and got[3]["reason"] == "too_few_points" and got[2]["a1x"] is None
    shapes = {r["g"]: r for r in moments.descriptors(df.withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(0.0)}), "g").collect()}
    for g in (0, 1):
        values, vectors = np.linalg.eigh(np.cov(clouds[g].T, bias=True))
        assert [got[g][f"e{k}"] for k in (1, 2, 3)] == pytest.approx(values[::-1], rel=1e-6)
        for k, v in ((1, vectors[:, 2]), (2, vectors[:, 1])):
            v = v * np.sign(v[np.abs(v).argmax()])
            assert [got[g][f"a{k}{a}"] for a in "xyz"] == pytest.approx(v, abs=1e-6)
        s, middle = shapes[g], clouds[g].mean(0)
        assert s["max_radius"] == pytest.approx(np.linalg.norm(clouds[g] - middle, axis=1).max()) and s["linearity"] == pytest.approx((values[2] - values[1]) / values[2])
        assert s["density"] == pytest.approx(len(clouds[g]) / (4 / 3 * np.pi * np.linalg.norm(clouds[g], axis=1).max() ** 3))
        assert [s[f"normal_{a}"] for a in "xyz"] == pytest.approx(np.abs(vectors[:, 0]), abs=1e-5)
    assert shapes[2]["linearity"] is None and shapes[3]["density"] is None and len(moments.FEATURES) == 14


def test_exact_quantiles(spark):
    rng = random.Random(8)
    values = {"a": list(range(1, 21)), "b": [5.0] * 9, "c": [rng.choice([0.0, 1e9, rng.random()]) for _ in range(1001)], "d": [3.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r["g"]: (r["half"], r["p95"]) for r in moments.exact_quantiles(df, "g", "v", {"half": 0.5, "p95": 0.95}, bins=7).collect()}
    rank = lambda vs, p: sorted(vs)[max(1, math.ceil(len(vs) * p - 1e-9)) - 1]
    assert got == {g: (rank(vs, 0.5), rank(vs, 0.95)) for g, vs in values.items()} and got["a"][1] == 19
    mixed = {r["g"]: (r["p"], r["q"]) for r in moments.exact_quantiles(df, "g", "v", {}, {"p": 0.95, "q": 0.5}, bins=3).collect()}
    assert all(mixed[g] == pytest.approx((np.quantile(vs, 0.95), np.quantile(vs, 0.5))) for g, vs in values.items()) and mixed["a"][0] == pytest.approx(19.05)


def test_slerp_goes_the_shorter_way(spark):
    lit = lambda *q: tuple(map(F.lit, map(float, q)))
    a, b = lit(0, 0, 0, 1), lit(0, 0, -math.sin(0.5), -math.cos(0.5))  # a turn by one about z, written the other way
    q = spark.range(1).select(*[x.alias(n) for x, n in zip(G.slerp(a, b, F.lit(0.5)), "xyzw", strict=True)]).first()
    assert (q["z"], q["w"]) == pytest.approx((math.sin(0.25), math.cos(0.25)))
    near = spark.range(1).select(*[x.alias(n) for x, n in zip(G.slerp(a, lit(0, 0, 1e-4, 1), F.lit(0.5)), "xyzw", strict=True)]).first()
    assert math.hypot(*near) == pytest.approx(1)


def test_cameras_and_back(spark):
    camera = G.Camera(100, 110, 64, 48, 128, 96, "pinhole", (0.1, -0.02, 0.001, 0.002))
    df = spark.createDataFrame([(x / 10, y / 10, 1.0) for x in range(-4, 5) for y in range(-4, 5)] + [(0.0, 0.0, -1.0), (0.0, 0.0, 0.0)], XYZ)
    u, v, stage = G.project(camera, F.col("x"), F.col("y"), F.col("z"))
    seen = df.withColumns({"u": u, "v": v, "stage": stage})
    assert seen.filter("stage = 'outside_domain'").count() == 2
    back = seen.filter("stage <> 'outside_domain'").withColumns({f"b{a}": c for a, c in zip("xyz", G.unproject(camera, F.col("u"), F.col("v")), strict=True)})
    assert all(abs(r["bx"] / r["bz"] - r["x"]) < 1e-6 and abs(r["by"] / r["bz"] - r["y"]) < 1e-6 for r in back.collect())
    folding = G.Camera(100, 100, 64, 48, 128, 96, "fisheye", (-0.3,))
    assert folding.widest() == pytest.approx(math.sqrt(1 / 0.9)) and G.Camera(1, 1, 0, 0, 1, 1, "fisheye").widest() == math.pi
    with pytest.raises(ValueError):
        G.project(G.Camera(1, 1, 0, 0, 1, 1, "other"), F.lit(1), F.lit(1), F.lit(1))


def test_frame_graph():
    turn = ((0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4)), (1.0, 0.0, 0.0))
    graph = FrameGraph([("body", "arm", turn), ("arm", "hand", turn), ("body", "hand", compose(turn, turn))])
    assert graph.resolve("body", "hand")[1] == pytest.approx((1.0, 1.0, 0.0)) and [(x.child, round(x.distance, 9), round(x.angle, 9)) for x in graph.loops()] == [("hand", 0, 0)]
    assert compose(turn, invert(turn))[1] == pytest.approx((0, 0, 0))
    off = FrameGraph([("body", "arm", turn), ("arm", "hand", turn), ("body", "hand", turn)]).loops()
    assert len(off) == 1 and off[0].distance > 0.5
    with pytest.raises(ValueError):
        graph.resolve("body", "moon")
    with pytest.raises(ValueError):
        FrameGraph([("a", "b", ((0, 0, 0, 2.0), (0, 0, 0)))])


def test_regions_merge_as_a_loop_does(spark):
    rng = random.Random(6)
    data = [(f, 10 * f + i, *(x := (rng.uniform(0, 5), rng.uniform(0, 5))), x[0] + rng.uniform(0, 4), x[1] + rng.uniform(0, 4)) for f in range(4) for i in range(10)] + [(9, 1, 0.0, 0.0, 0.0, 0.0), (9, 2, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "frame long, region long, min_x double, min_y double, max_x double, max_y double")

    def alike(p, q):
        both = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        a, b = ((r[4] - r[2]) * (r[5] - r[3]) for r in (p, q))
        return (a + b - both > 0 and both >= 0.3 * (a + b - both)) or (min(a, b) > 0 and both >= 0.7 * min(a, b))

    expect = []
    for f in {r[0] for r in data}:
        stand = []
        for r in sorted(x for x in data if x[0] == f):
            kept = next((s for s in stand if alike(s, r)), r)
            if kept is r:
                stand.append(r)
            expect.append((f, r[1], kept[1]))
    assert rows(grids.merge_regions(df, 0.3, 0.7), "frame", "region", "kept") == sorted(expect) and any(r != k for _, r, k in expect)


def test_annotators_are_matched_one_to_one(spark):
    schema = "sample long, region long, min_x double, min_y double, max_x double, max_y double"
    first = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0), (2, 3, 0.0, 0.0, 1.0, 1.0)], schema)
    second = spark.createDataFrame([(1, 7, 1.0, 0.0, 11.0, 10.0), (1, 8, 0.0, 1.0, 10.0, 11.0), (2, 9, 5.0, 5.0, 6.0, 6.0)], schema)
    assert [(s, a, b, round(i, 3)) for s, a, b, i in rows(evaluation.match_annotations(first, second, 0.5), "sample", "a", "b", "iou")] == [(1, 1, 8, 0.818), (1, 2, 7, 1.0)]


def test_alignment_finds_the_turn_that_was_made(spark):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.linalg.det(q)
    p = rng.normal(size=(50, 3))
    data = [tuple(map(float, (*x, *(q @ x + [1, 2, 3])))) for x in p]
    turn, shift = evaluation.rigid_alignment(spark.createDataFrame(data, f"{XYZ}, rx double, ry double, rz double"))
    assert np.allclose(turn, q) and np.allclose(shift, [1, 2, 3])
    assert evaluation.rigid_alignment(spark.createDataFrame([], f"{XYZ}, rx double, ry double, rz double"))[0] == np.eye(3).tolist()


def test_plane_residuals_equal_numpy(spark):
    rng = np.random.default_rng(11)
    scans = {1: rng.uniform(0, 4, (30, 3)) * [1, 1, 0.05], 2: rng.uniform(0, 4, (60, 3)) * [1, 1, 0.05]}
    df = spark.createDataFrame([(s, i, *map(float, p)) for s, c in scans.items() for i, p in enumerate(c)], f"scan long, point long, {XYZ}")
    found = {r["point"]: r["residual"] for r in evaluation.plane_residuals(df, spark.createDataFrame([(1, 2)], "earlier long, later long"), 6, 1.0, 0.1).collect()}
    expect = {}
    for i, p in enumerate(scans[1]):
        d = np.linalg.norm(scans[2] - p, axis=1)
        near = np.argsort(d)[:6]
        if d[near].max() <= 1.0:
            values, vectors = np.linalg.eigh(np.cov(scans[2][near].T, bias=True))
            if values[0] <= 0.1 * values.sum():
                expect[i] = abs((p - scans[2][near].mean(0)) @ vectors[:, 0])
    assert found == pytest.approx(expect, abs=1e-6) and len(expect) > 10


def test_reports(spark):
    registry = evaluation.metric_registry(spark)
    assert registry.count() == 36
    report = [("no.such", "x", "ratio", 0.5), ("relations.f1", "state_estimation", "ratio", 0.5), ("relations.f1", "spatial_relations", "count", 0.5), ("relations.f1", "spatial_relations", "ratio", float("nan")), ("region.iou.mean", "region_discovery", "ratio", 1.5), ("runtime.wall_time", "x", "seconds", 2.0), ("runtime.wall_time", "x", "seconds", 3.0)]
    got = evaluation.report_problems(spark.createDataFrame(report, "metric string, stage string, unit string, value double"), registry)
    assert sorted(r["problem"] for r in got.collect()) == ["not_finite", "out_of_range", "repeated", "unknown_metric", "wrong_stage", "wrong_unit"]
    one, two = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, note string"), spark.createDataFrame([(1, "z"), (2, "b"), (3, "c")], "k long, note string")
    assert rows(evaluation.differences(one, two, ("note",)), "side", "k") == [("first", 2), ("second", 3)]
    factors = spark.createDataFrame([("f", "a", True), ("f", "b", False), ("g", "x", True), ("g", "y", False)], "factor string, value string, baseline boolean")
    cells = lambda mode: sorted(tuple(sorted(r["cell"].items())) for r in evaluation.ablation_cells(factors, mode).collect())
    assert cells("one") == [(("f", "a"), ("g", "y")), (("f", "b"), ("g", "x"))] and len(cells("full")) == 3


def test_materialization_reasons(spark):
    df = spark.createDataFrame([(1, 0, 0, None, None, True), (2, 3, 2, 1, 2, True), (3, 3, 3, 5, 2, True), (4, 3, 3, 1, 2, False), (5, 3, 3, 1, 2, True)], "support long, refs long, resolved long, first_t long, last_t long, valid boolean")
    assert rows(materialize(df), "support", "rejection") == [(1, "empty_geometry"), (2, "unresolvable_geometry"), (3, "invalid_temporal_evidence"), (4, "invalid_entity"), (5, None)]


def test_labels_fold_and_answers_parse_strictly(spark):
    df = spark.createDataFrame([("STRASSE",), ("straße",), ("ΟΔΟΣ!",), ("οδος",), (None,)], "x string")
    assert [r["k"] for r in df.select(label_key(F.col("x")).alias("k")).collect()] == ["strasse", "strasse", "οδοσ", "οδοσ", None]
    assert [r["k"] for r in df.select(text.folded(F.concat(F.col("x"), F.lit(" ﬁ  １"))).alias("k")).limit(2).collect()] == ["strasse fi 1"] * 2
    cases = {
        '```json\n{"claims": [{"label": "a", "role": "primary", "confidence": 0.5}]}\n```': None, '```\n```json\n{"claims": []}\n```\n```': "not_json", '{"claims": [{"label": "a", "role": "primary", "confidence": 1.5}]}': "confidence",
        '{"claims": [{"label": "a", "role": "primary"}], "abstained": true}': "abstained_with_claims", '{"claims": [], "abstained": true}': None, '{"claims": []}': "no_claim", "[1]": "not_json", "": "empty", '{"claims": [{"label": "a", "role": "maybe"}]}': "wrong_claim", '{"abstained": true}': "wrong_keys", '{"claims": [{"label": "a", "role": "primary", "confidence": NaN}]}': "not_json",
    }
    got = spark.createDataFrame([(c,) for c in [*cases, None]], "c string").select("c", text.parse_response(F.col("c")).alias("p")).collect()
    assert {r["c"]: r["p"]["problem"] for r in got} == {**cases, None: "empty"}
    bare = spark.createDataFrame([('{"claims": [{"label": "a", "role": "primary", "confidence": 0.5}]}',)], "c string").select(text.parse_response(F.col("c"), scored=False).alias("p"), text.parse_response(F.col("c"), region=False).alias("q")).first()
    assert bare["p"]["problem"] == "confidence" and bare["q"]["claims"][0]["confidence"] == 0.5
    with pytest.raises(ValueError):
        text.render("{a} {b}", a=F.lit(1))
    with pytest.raises(ValueError):
        text.render("{a}", a=F.lit(1), b=F.lit(2))


def test_selections(spark):
    df = spark.range(5).select(F.col("id").alias("k"))
    assert rows(select_ids(df, df.filter("k > 3").unionByName(df.filter("k = 4")), "k"), "k") == [(4,)]
    with pytest.raises(ValueError, match="the first is 9"):
        select_ids(df, spark.createDataFrame([(9,), (1,)], "k long"), "k")
    assert selection_identity("ids", 2, 1) == selection_identity("ids", 1, 2) != selection_identity("positions", 1, 2)


def test_empty_tables_give_empty_results(spark):
    points = spark.createDataFrame([], f"entity long, scan long, point long, observation long, t long, ox double, oy double, oz double, {XYZ}")
    boxes = spark.createDataFrame([], f"box long, {BOX}")
    for out in (
        within_radius(points, points, 1.0), neighbourhoods(points, points, 1.0, 3), box_pairs(boxes, 1.0, 1.0), contact_pairs(points, 1.0, 0.5), inter_scan_voxels(points, 1.0), moments.orientation(points, "entity", 3, 1.5), moments.descriptors(points, "entity"),
        channels.split_candidates(points, channels.SplitPolicy(1.0)), overlaps(spark.createDataFrame([], "set long, member long"), 0.5), evaluation.plane_residuals(points, spark.createDataFrame([], "earlier long, later long"), 3, 1.0, 0.1),
    ):
        assert out.count() == 0
