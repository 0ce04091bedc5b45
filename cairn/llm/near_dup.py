"""Near-duplicate documents: SimHash fingerprints, joined with themselves by a binary trie, as connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, join_heavy, load, version

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bits by which a trie's nodes go down at once, and bounds of the fingerprints below a pair of nodes that is not split.
STEP, LEAST, MOST = 4, 1 << 12, 1 << 18
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 20
#: Rows that a task takes together, if it has as many.
HELD = 1 << 18


def simhash(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints, unsigned 64 bits. Words are what ASCII white space parts, A-Z lower-cased; shingles count as often
    as they stand; fewer words than a shingle's are one shingle; none give zero."""
    from xxhash import xxh64_intdigest as digest

    hashes, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            own = [digest(line, seed)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            own = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes.append(np.array(own, np.uint64))
        counts[k] = len(own)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    full = np.flatnonzero(counts)
    flat, n = np.concatenate(hashes), counts[full]
    at = np.cumsum(n) - n
    for bit in range(64):
        ones = np.add.reduceat((flat >> np.uint64(bit)) & np.uint64(1), at).astype(np.int64)
        out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(_id, _v, _fp) for every row; the fingerprint is a signed long of the same bits, ``_v`` tells texts under one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                fps = simhash(part.column(2).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["_id", "_v", "_fp"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), version(F.col(text)).alias("_v"), F.col(text).alias("_text")).mapInArrow(run, "_id long, _v long, _fp long")


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(values: np.ndarray, start: tuple[np.ndarray, ...], bit: int = 63, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs of ``values`` within ``radius`` bits below the pairs of nodes ``start``, in parts.

    A trie's node is a range of sorted values that share a prefix. ``start`` has the bounds of the pairs' nodes, a0, a1, b0,
    b1, each node's values sorted and different, and the bits in which their prefixes differ; ``bit`` is the first below these.
    Pairs of nodes go down together, one bit a step: a node with itself, or two nodes with the bits in which their
    prefixes differ counted. A pair over the radius goes no further; two leaves are compared in the bits that are left.
    The traversal takes the deepest pairs first, in parts of bounded size.
    """
    ones = [None] * (bit + 1)  # running counts of each bit, made when a level is first reached
    stack = [(bit, *start)]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        # a leaf has no pair with itself
        live = (a1 > a0) & (b1 > b0) & (err <= radius) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = (x[live] for x in (a0, a1, b0, b1, err))
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = bit_count(values[i] ^ values[j]) <= radius
            if near.any():
                yield np.minimum(i, j)[near], np.maximum(i, j)[near]
            a0, a1, b0, b1, err = (x[~leaves] for x in (a0, a1, b0, b1, err))
        if not len(a0) or bit < 0:
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, a0[s], a1[s], b0[s], b1[s], err[s]) for s in (slice(half, None), slice(half))]
            continue
        if ones[bit] is None:
            ones[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        count = ones[bit]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        apart = a0 != b0
        down = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            (am[apart], a1[apart], b0[apart], bm[apart], err[apart] + 1),
        ]
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*down, strict=True))))


def join_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` places the least one that the pairs connect it with."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            while (x := root[a] != a).any():
                a = np.where(x, root[a], a)
            while (x := root[b] != b).any():
                b = np.where(x, root[b], b)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    while (root[root] != root).any():
        root = root[root]
    return root


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("_fp", 64 - depth)


def node_pairs(classes: DataFrame, most: int, radius: int = RADIUS) -> DataFrame:
    """The top of the trie's join with itself: pairs of nodes (depth, a, b), a <= b, prefixes of equal depth that differ in at
    most ``radius`` bits, each with at most ``most`` fingerprints below its nodes together, such that any two fingerprints
    in reach are below one pair. All pairs with more go down ``STEP`` bits a round, to the children that there are and
    that the budget allows, so that a dense part of the trie is split further than others. What a round shuffles is
    pairs and counts of nodes, not fingerprints' pairs."""
    done = []
    masks = [[m for m in range(1 << STEP) if m.bit_count() <= k] for k in range(radius + 1)]
    allowed = F.array(*[F.array(*map(F.lit, m)) for m in masks])
    nodes = cut(classes.groupBy(_prefix(STEP).alias("node")).agg(F.count("*").alias("n")))
    pairs = nodes.select(F.col("node").alias("a"), F.explode(allowed[radius]).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("b")).filter("a <= b")
    for depth in range(STEP, 64, STEP):
        sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        sized = cut(sized.select(F.lit(depth).alias("depth"), "a", "b", F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n")))
        large = (F.col("n") > most) & F.lit(depth + STEP < 64)
        done.append(sized.filter(~large & (F.col("n") > 1)).drop("n"))
        split = sized.filter(large)
        if split.isEmpty():
            break
        parents = split.select(F.explode(F.array("a", "b")).alias("up")).distinct()
        child = _prefix(depth + STEP)
        nodes = cut(classes.select("_fp").withColumn("up", _prefix(depth)).join(parents, "up", "left_semi").groupBy(child.alias("node")).agg(F.count("*").alias("n")))
        below = nodes.select(F.shiftrightunsigned("node", STEP).alias("a"), F.col("node").alias("x"))
        left = F.lit(radius) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        pairs = (
            split.join(below, "a")
            .select("a", "b", "x", F.explode(F.get(allowed, left)).alias("m"))
            .select("a", "b", F.col("x").alias("x"), (F.shiftleft("b", STEP) + F.col("x").bitwiseAND((1 << STEP) - 1).bitwiseXOR(F.col("m"))).alias("y"))
            .filter("a < b OR x <= y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
    return reduce(DataFrame.unionByName, done)


def near_edges(classes: DataFrame, fp: str = "_fp", radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """Links (u, v) between different fingerprints such that those within ``radius`` bits, and no others, are connected: the
    self-join of a binary trie. The top is traversed by joins of nodes (``node_pairs``) until what is below a pair is
    work for one task, the rest of the way there, for all pairs of nodes that the task has at once.

    A pair of nodes has at most ``most`` fingerprints, a task's share of them within fixed bounds; its task returns a spanning
    forest of their links, at most a row per member, never their pairs."""
    classes = classes.select(F.col(fp).alias("_fp"))
    if most is None:
        tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = min(MOST, max(LEAST, classes.count() // tasks))
    pairs = cut(node_pairs(classes, most, radius))
    depths = [r["depth"] for r in pairs.select("depth").distinct().collect()]  # 15 at most
    if not depths:
        return classes.select(F.col("_fp").alias("u"), F.col("_fp").alias("v")).limit(0)
    of = pairs.select("depth", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    placed = classes.select("_fp", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in sorted(depths)])).alias("_at"))
    dealt = placed.select("_fp", "_at.depth", "_at.node").join(of, ["depth", "node"]).select("depth", "a", "b", "_fp")
    dealt = dealt.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]
        for batch in _then_none(batches):
            if batch is not None:
                held = [np.concatenate((x, batch.column(k).to_numpy())) for k, x in enumerate(held)]
            depth, a, b, own = held
            if not len(own) or batch is not None and len(own) < HELD:
                continue
            first = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            whole = len(own) if batch is None else first[-1]  # the last pair may go on
            held = [x[whole:] for x in held]
            first = first[first < whole]
            if not len(first):
                continue
            ends = np.append(first[1:], whole)
            values = own[:whole].view(np.uint64)
            group = np.repeat(np.arange(len(first)), ends - first)
            values = values[np.lexsort((values, group))]  # by unsigned value: those below a come first
            above = np.zeros(whole, bool)
            for d in np.unique(depth[:whole]):
                at = depth[:whole] == d
                above[at] = values[at] >> np.uint64(64 - d) != a[:whole][at].view(np.uint64)
            middle = ends - np.add.reduceat(above, first)
            for d in np.unique(depth[first]):
                at = np.flatnonzero(depth[first] == d)
                self_ = a[first[at]] == b[first[at]]
                b0, b1 = np.where(self_, first[at], middle[at]), ends[at]
                start = (first[at], middle[at], b0, b1, bit_count((a ^ b)[first[at]]).astype(np.int8))
                root = join_roots(len(values), trie_pairs(values, start, 63 - int(d), radius))
                child = np.flatnonzero(root != np.arange(len(root)))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(values[child].view(np.int64)), pa.array(values[root[child]].view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def connected(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(node, root) for all ends of ``edges`` (u, v): the root is the least node of the component. Large-star and
    small-star in turn until nothing changes; each round is checkpointed, a large star's minimum is summed up before
    the shuffle, and joins on a large star's centre are split by adaptive execution. The rounds needed grow with the logarithm
    of the longest chain; where ``rounds`` are not enough, that is an error."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components are not whole after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _v, _fp, _component, _first) for every row: rows link if their fingerprints differ in at most two bits, and the
    component is the least id among all rows that links reach, ``_first`` the least ``_v`` among its rows of that id. Null and
    empty texts have the fingerprint zero and link like others; repeated rows are returned each; an empty table gives no
    rows; other columns are not read. Rows that share an id are rows of their own; a null id is larger than any other."""
    own = cut(fingerprints(docs, doc_id=doc_id, text=text))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_v").alias("v")))
    classes = cut(own.groupBy("_fp").agg(least.alias("_least"), F.count("*").alias("_n")))
    linked = cut(connected(near_edges(classes)))
    members = linked.join(classes.drop("_n"), linked["node"] == classes["_fp"]).select("node", "root", "_least")
    named = members.join(members.groupBy("root").agg(F.min("_least").alias("_all")), "root").select(F.col("node").alias("_fp"), "_all")
    of = classes.join(named, "_fp", "left").withColumn("_all", F.coalesce("_all", "_least")).select("_fp", F.col("_all.id").alias("_component"), F.col("_all.v").alias("_first"), "_n")
    return join_heavy(own, cut(of), ["_fp"], "_n").select("_id", "_v", "_fp", "_component", "_first")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the first by id, then by a hash of its text, of rows equal
    in both any one. Rows without an id are not compared and stay."""
    found = cut(near_duplicates(docs.filter(F.col("doc_id").isNotNull())))
    stays = (F.col("_id") == F.col("_component")) & (F.col("_v") == F.col("_first"))
    gone = cut(found.filter(~stays).select("_id", "_v").distinct())
    is_in = lambda rows: docs["doc_id"].eqNullSafe(rows["_id"]) & (version(docs["text"]) == rows["_v"])
    out = docs.join(gone, is_in(gone), "left_anti")
    repeated = cut(found.filter(stays).groupBy("_id", "_v").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", "_v"))
    if repeated.isEmpty():
        return out
    names = [f"`{c}`" for c in docs.columns]
    again = docs.join(repeated, is_in(repeated), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", version(F.col("text"))).orderBy(F.xxhash64(*names)))
    return out.join(repeated, is_in(repeated), "left_anti").unionByName(again.withColumn("_cairn_nth", nth).filter("_cairn_nth = 1").drop("_cairn_nth"))


def op5_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
