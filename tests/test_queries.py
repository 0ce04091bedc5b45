"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import datetime
import math
import random
from concurrent.futures import ThreadPoolExecutor
from unittest import mock

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.operators.graphs import cut, shortest_steps
from cairn.operators.spatial_joins import entity_candidates, interval_pairs
from cairn.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.7g}"
    return x.isoformat() if isinstance(x, datetime.datetime | datetime.date) else str(x)


def at_once(run, names, threads=6):
    """``run(name)`` of each name, or what it raised; most of a small query's time is planning, which threads share."""

    def one(name):
        try:
            return run(name)
        except Exception as error:  # noqa: BLE001  each name's test raises its own
            return error

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(names, pool.map(one, names), strict=True))


@pytest.fixture(scope="module")
def results(spark):
    def run(name):
        df = registry.queries()[name](spark, SF)
        return sorted(df.columns), [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]

    return at_once(run, sorted(registry.oracle_sql()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(results, duck, name):
    if isinstance(results[name], Exception):
        raise results[name]
    names, rows = results[name]
    mine = sorted(tuple(map(plain, r)) for r in rows)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


#: What depends on an order or a decomposition that SQL has not; tests/test_operators.py compares these with plain loops.
WITHOUT_SQL = {"g9_region_merge", "j16_annotator_agreement", "j1_aligned_error"}


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) | WITHOUT_SQL


def test_entry_imports_without_optional_parts(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: (None, None))
    assert set(__spark_entry__.queries()) == set(registry.queries())


def _tables(spark, folder, change):
    for t in TABLES:
        change(spark.read.parquet(f"{SF}/{t}.parquet")).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def _awkward(df):
    """Some rows, a few of them repeated, two of nulls only, and one with nothing but its key."""
    some = df.limit(400)
    null = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    bare = df.limit(1).select(df.columns[0], *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields[1:]])
    return some.unionByName(some.limit(20)).unionByName(null).unionByName(null).unionByName(bare)


def _failures(spark, folder):
    return {name: error for name, error in at_once(lambda n: registry.queries()[n](spark, folder).count(), sorted(registry.queries())).items() if isinstance(error, Exception)}


def test_empty_tables_give_results(spark, tmp_path):
    assert _failures(spark, _tables(spark, tmp_path, lambda df: df.limit(0))) == {}


def test_nulls_and_repeated_rows_give_results(spark, tmp_path):
    failed = _failures(spark, _tables(spark, tmp_path, _awkward))
    assert isinstance(failed.pop("b1_id_selection"), ValueError)  # ids that are not there are an error, which is what it is for
    assert failed == {}


def _on_parts(spark, folder, name, parts):
    """The query's rows and its SQL's over parts (key, size, price, length of the name); brands and types by key."""
    rows = [(k, "x" * n, f"Brand#{k % 3}", f"T{k % 2}", size, float(price)) for k, size, price, n in parts]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    found = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    return sorted(tuple(map(plain, r)) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_planes_through_a_line_are_as_in_sql(spark, tmp_path):
    lines = [[(40, 934.0, 9)], [(42, 935.0, 8), (36, 934.8, 8), (30, 934.6, 8), (27, 934.5, 8)], [(3, 982.9, 9)], [(8, 983.4, 10), (8, 983.6, 10), (8, 983.7, 10), (8, 983.9, 10)]]
    mine, sql = _on_parts(spark, tmp_path, "j3_plane_residuals", [(8 * (e + e // 2) + i, *p) for e, line in enumerate(lines) for i, p in enumerate(line)])
    assert mine == sql and len(sql) == 2


def test_a_tilt_needs_no_distinct_third_axis(spark, tmp_path):
    rng = random.Random(8)
    parts = [(k, rng.randint(0, 9), 900 + rng.randint(0, 3), 8 + rng.randint(0, 3)) for k in range(8 * 40)] + [(8 * 50, 3, 901, 9), (8 * 50 + 1, 5, 902, 11)]
    mine, sql = _on_parts(spark, tmp_path, "i13_contact_evidence", parts)
    assert mine == sql and any("unavailable" in r for r in sql)


def test_contacts_of_equal_points_are_found_once(spark, tmp_path):
    """Seven entities with the same points, three with others of the same box, and two with two points."""
    place = lambda e, i: (10 + i, 900 + i, 9 + i) if e < 7 else (10 + (i if i in (0, 7) else 3), 900 + i, 9 + i)
    parts = [(8 * e + i, *place(e, i)) for e in range(10) for i in range(8)] + [(8 * e + i, 12 + 3 * i, 903, 12 + i) for e in (12, 14) for i in range(2)]
    met = []
    with mock.patch("cairn.plans.relation_queries.interval_pairs", side_effect=lambda boxes, *a, **b: (met.append(boxes.count()), interval_pairs(boxes, *a, **b))[1]):
        mine, sql = _on_parts(spark, tmp_path, "i13_contact_evidence", parts)
    assert mine == sql and len(sql) >= 10 * 9 * 3 and met == [3]


@pytest.mark.parametrize("name", ["c16_relation_candidates", "i12_geometric_evidence", "i16_decided_relations"])
def test_relations_of_equal_boxes_are_found_once(spark, tmp_path, name):
    """Twelve entities with one box, five with another that is inside it, and one of a single part."""
    place = lambda e, i: (10 + 2 * i, 900 + i, 9 + i % 5) if e < 12 else (13 + i, 902 + i % 4, 10 + i % 2)
    parts = [(8 * e + i, *place(e, i)) for e in range(17) for i in range(8)] + [(8 * 17, 11, 908.5, 13)]
    met = []
    with mock.patch("cairn.plans.relation_queries.interval_pairs", side_effect=lambda boxes, *a, **b: (met.append(boxes.count()), interval_pairs(boxes, *a, **b))[1]):
        mine, sql = _on_parts(spark, tmp_path, name, parts)
    assert mine == sql and len(sql) >= 17 * 16 * 5 and met == [3]


def test_alike_entities_are_compared_once(spark, tmp_path):
    """Ten entities that differ in nothing but their number, in three kinds, met as three."""
    kinds = [(8 * e + i, f"{'red' if e % 3 else 'blue'} bolt{i % (2 + e % 3)}", f"Brand#{i % 2}", f"T{i % (1 + e % 3)}", 11 + i, 900.0 + i / 10) for e in range(10) for i in range(8)]
    spark.createDataFrame(kinds, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    items = [(k[0], datetime.datetime(1995, 1, 1 + k[0] % 8)) for k in kinds]
    spark.createDataFrame(items, "l_partkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con, met = duckdb.connect(), []
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    with mock.patch("cairn.plans.entity_queries.entity_candidates", side_effect=lambda entities, *a, **b: (met.append(entities.count()), entity_candidates(entities, *a, **b))[1]):
        mine = registry.queries()["i3_semantic_channel"](spark, str(tmp_path)).collect()
    sql = con.execute(f"SELECT a, b, label_finding, attribute_finding, status FROM ({registry.oracle_sql()['i3_semantic_channel']})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in mine) == sorted(tuple(map(plain, r)) for r in sql) and len(sql) == 45 and met == [3]


def test_resolution_needs_no_paths_and_long_chains_are_whole(spark, tmp_path):
    keys = [0, *range(200, 289), 12]
    mine, sql = _on_parts(spark, tmp_path, "g6_whole_resolution", [(k, 1, 900 + i, 9) for i, k in enumerate(keys)] + [(500, 1, 900, 9)])
    assert mine == sql and len(sql) == 92


def test_resolution_of_dense_places_takes_no_rounds(spark, tmp_path):
    """More links than one task joins, of few places: cuts of the lineage do not grow with the rounds that labels would take."""
    cuts = []
    with mock.patch("cairn.operators.graphs.ONE_TASK", 100), mock.patch("cairn.operators.graphs.cut", side_effect=lambda df: (cuts.append(1), cut(df))[1]):
        mine, sql = _on_parts(spark, tmp_path, "g6_whole_resolution", [(k, 1, 900 + 0.1 * k, 9) for k in range(90)] + [(200 + k, 3, 900 + 0.5 * k, 9) for k in range(10)])
    assert mine == sql and len(sql) == 91 and len(cuts) <= 3


def test_long_chains_do_not_fail_and_short_ones_are_counted(spark, tmp_path):
    keys = [0, *range(200, 289), 12]
    mine, sql = _on_parts(spark, tmp_path, "g5_contradiction_paths", [(k, 1, 900 + i, 9) for i, k in enumerate(keys)] + [(300, 3, 900, 9), (312, 3, 900, 9)])
    assert mine == sql and ("300", "312", "300", "1") in sql


def test_steps_equal_a_plain_search(spark):
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randrange(700), rng.randrange(700)) for _ in range(900)) if a < b} | {(1000 + i, 1001 + i) for i in range(80)}
    ends = [(a, b) for a in range(600) for b in (rng.randrange(700), 1050)] + [(1000, 1080), (1080, 1003)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def steps(a, b):
        seen, front, n = {a}, {a}, 0
        while front and b not in front:
            front, n = {w for u in front for w in near.get(u, ())} - seen, n + 1
            seen |= front
        return n if front else None

    expect = {(a, b): steps(a, b) for a, b in ends if a in near and b in near}
    found = shortest_steps(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame(ends, "a long, b long"))
    assert {(r["a"], r["b"]): r["steps"] for r in found.collect()} == {k: n for k, n in expect.items() if n is not None}


def test_steps_end_at_the_most_and_hubs_are_whole(spark):
    """A hub with more neighbours than are taken by turns, a chain behind it, and edges repeated both ways."""
    hub = [(0, i) for i in range(1, 150)] + [(149, 1000)] + [(1000 + i, 1001 + i) for i in range(20)]
    edges = spark.createDataFrame([*hub, *[(b, a) for a, b in hub[:9]], (5, None)], "a long, b long")
    ends = [(1, 2), (3, 1000), (3, 1003), (1005, 7), (1, 1020), (8, 8), (4, 5000)]
    got = {m: {(r["a"], r["b"]): r["steps"] for r in shortest_steps(edges, spark.createDataFrame(ends, "a long, b long"), m).collect()} for m in (None, 6)}
    assert got[None] == {(1, 2): 2, (3, 1000): 3, (3, 1003): 6, (1005, 7): 8, (1, 1020): 23, (8, 8): 0}
    assert got[6] == {k: n for k, n in got[None].items() if n <= 6}
