"""Passages of a benchmark in documents: SimHash of item-sized windows, Hamming blocks, weighted shingles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, chain, combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, load, version


@dataclass(frozen=True)
class LeakPolicy:
    """An item leaks into a document if ``similarity`` of the weight of its shingles of ``shingle`` words stands in a
    stretch of the document about as long as the item. ``radius``: bits in which the fingerprints of a window and an
    item's may differ, looked up by its four ``blocks`` of 16. ``items``: of the benchmark, about, that one pass over the
    documents takes."""

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 7
    items: int = 2000


#: Blocks of 16 bits of a fingerprint, and the largest window whose counts fit a byte.
BLOCKS, BYTE = 4, 255
#: Words of a batch that are looked at at once.
CHUNK = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 well mixed bits for each word, from its CRC."""
    x = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bit_sums(hashes: np.ndarray, largest: int) -> dict[int, np.ndarray]:
    """By powers of two up to ``largest``: for each of 64 bits, how many of so many words from each place on have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    sums = {1: np.ascontiguousarray(bits, np.uint8 if largest <= BYTE else np.uint32)}
    size = 1
    while 2 * size <= min(largest, len(hashes)):
        sums[2 * size] = sums[size][:, :-size] + sums[size][:, size:]
        size *= 2
    return sums


def window_fingerprints(sums: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The SimHash of each window of ``size`` words: the bits that more than half of its words have."""
    n = sums[1].shape[1] - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    half = sums[1].dtype.type(size // 2)
    out = np.empty((n, 8), np.uint8)
    for byte in range(8):
        count, at = None, 0
        for power in (p for p in sums if size & p):
            part = sums[power][8 * byte : 8 * byte + 8, at : at + n]
            count, at = part if count is None else count + part, at + power
        ones = (count > half).view(np.uint8)
        whole = ones[0]
        for bit in range(1, 8):
            whole |= ones[bit] << np.uint8(bit)
        out[:, byte] = whole
    return out.view(np.uint64).ravel()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + hashes[k : k + len(out)]
    return out


@dataclass
class Item:
    """``windows``: (first word, words) of those that are looked up."""

    item_id: int
    words: list[bytes]
    windows: list[tuple[int, int]]
    weights: dict[bytes, float]
    counts: Counter


@dataclass
class SizeIndex:
    """The windows of one size of all items: fingerprints, owners, and for each block all values that differ from a window's
    in at most ``radius // 4`` bits, sorted, with the window of each."""

    size: int
    fps: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    lookup: list[tuple[np.ndarray, np.ndarray]]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Fewer words than ``size`` are one shingle."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(words: list[bytes], counts: Counter, weights: dict[bytes, float], policy: LeakPolicy) -> list[tuple[int, int]]:
    """The window of the whole item, and disjoint parts of it, of equal size, one of which is whole in any copy that reaches the
    similarity. A copy may lack as many shingles as the lightest that weigh no more than the rest of the similarity. A word
    that is changed, added or lost breaks one shingle at least at either end of the item, and elsewhere all that go over
    the place but the one that starts or ends there; so it takes that many to touch another part."""
    n, k = len(words), min(policy.shingle, len(words))
    weighed = sorted(w for s, w in weights.items() for _ in range(counts[s]))
    spare = (1 - policy.similarity) * sum(weighed) * (1 + 1e-9)
    lost = sum(x <= spare for x in accumulate(weighed))
    parts = 1 + min(lost, 2) + max(0, lost - 2) // max(1, k - 1)
    size = max(1, n // parts)
    return [(0, n)] + [(start, size) for start in range(0, n - size + 1, size) if size < n]


def prepare(rows: list[tuple[int, str | None, dict[int, int]]], total: int, policy: LeakPolicy) -> list[Item]:
    """Items with their windows and the weights of their shingles: the rarer among all ``total`` items, the more. A row has its
    id, its text and by the CRC of each of its shingles how many items have it. Items without a word cannot leak."""
    items = []
    for item_id, text, spread in rows:
        words = words_of(text)
        if not words:
            continue
        counts = Counter(shingles(words, policy.shingle))
        weights = {s: float(np.log1p(total / max(1, spread.get(crc32(s), 1)))) for s in counts}
        items.append(Item(item_id, words, item_windows(words, counts, weights, policy), weights, counts))
    return items


def index(items: list[Item], policy: LeakPolicy) -> list[SizeIndex]:
    width = 64 // BLOCKS
    near = [sum(1 << b for b in c) for n in range(policy.radius // BLOCKS + 1) for c in combinations(range(width), n)]
    near = np.array(near, np.uint64)
    out = []
    for size in sorted({n for x in items for _, n in x.windows}):
        own = [(k, s) for k, x in enumerate(items) for s, n in x.windows if n == size]
        fps = np.array([window_fingerprints(bit_sums(word_hashes(items[k].words[s : s + size]), size), size)[0] for k, s in own], np.uint64)
        lookup = []
        for block in range(BLOCKS):
            value = _block(fps, block).astype(np.uint64)
            keys = (value[:, None] ^ near[None, :]).astype(np.uint16).ravel()
            order = np.argsort(keys, kind="stable")
            lookup.append((keys[order], (order // len(near)).astype(np.int32)))
        out.append(SizeIndex(size, fps, np.array([k for k, _ in own]), np.array([s for _, s in own]), lookup))
    return out


class Block:
    """Items with all that their search needs. ``shingles``: by size, the hashes of all items' shingles, sorted."""

    def __init__(self, items: list[Item], policy: LeakPolicy) -> None:
        self.items, self.indexes, self.policy = items, index(items, policy), policy
        self.lengths = np.array([len(x.words) for x in items], np.int64)
        by_size: dict[int, list[np.ndarray]] = {}
        for x in items:
            k = min(policy.shingle, len(x.words))
            by_size.setdefault(k, []).append(shingle_hashes(word_hashes(x.words), k))
        self.shingles = {k: np.unique(np.concatenate(v)) for k, v in by_size.items()}

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """The places of ``hashes``, of words, at which a shingle of some item begins."""
        hit = np.zeros(len(hashes), bool)
        for k, known in self.shingles.items():
            grams = shingle_hashes(hashes, k)
            low = np.zeros(1 << 16, bool)
            low[known.astype(np.uint16)] = True
            maybe = np.flatnonzero(low[grams.astype(np.uint16)])
            hit[maybe] |= np.isin(grams[maybe], known)
        return np.flatnonzero(hit)


def _block(fps: np.ndarray, block: int) -> np.ndarray:
    return fps.view(np.uint16).reshape(-1, 4)[:, block]


def candidates(fps: np.ndarray, idx: SizeIndex, policy: LeakPolicy) -> tuple[np.ndarray, np.ndarray]:
    """(place, window of an item) for all pairs within the radius. Fingerprints that close have a block, of four, in
    which they differ in at most ``radius // 4`` bits, so that the lookups lose none."""
    found = []
    for block, (values, who) in enumerate(idx.lookup):
        value = _block(fps, block)
        first = np.searchsorted(values, value)
        n = np.searchsorted(values, value, "right") - first
        at = np.flatnonzero(n)
        if not len(at):
            continue
        first, n = first[at], n[at]
        place = np.repeat(at, n)
        window = who[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        close = np.bitwise_count(fps[place] ^ idx.fps[window]) <= policy.radius
        if close.any():
            found.append(place[close] * len(idx.fps) + window[close])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found))
    return both // len(idx.fps), both % len(idx.fps)


def containment(item: Item, stretch: list[bytes], size: int) -> float:
    """The share of the weight of the item's shingles, repeats included, that the stretch has."""
    there = Counter(shingles(stretch, min(size, len(item.words)))) if stretch else Counter()
    own = sum(n * item.weights[s] for s, n in item.counts.items())
    return sum(min(n, there[s]) * item.weights[s] for s, n in item.counts.items()) / own


def find_leaks(texts: list[str | None], block: Block) -> list[tuple[int, int, float, int]]:
    """(text, item, similarity, first word of the stretch) of each item in each text, the best stretch, of equals the
    first. A stretch that reaches the similarity has a shingle of its item, so fingerprints are made of the windows that
    lie within the longest item's length of some item's shingle, of every size of window; elsewhere there is nothing to find."""
    items, policy = block.items, block.policy
    if not items:
        return []
    words = [words_of(t) for t in texts]
    reach = int(block.lengths.max()) + int(block.lengths.max()) // 5 + policy.shingle + 1
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for first, last in _chunks([len(w) for w in words]):
        flat = list(chain.from_iterable(words[first:last]))
        if not flat:
            continue
        lengths = np.array([len(w) for w in words[first:last]])
        ends = np.cumsum(lengths)
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        hashes = word_hashes(flat)
        hit = block.hits(hashes)
        if not len(hit):
            continue
        hits = np.concatenate(([0], np.cumsum(np.bincount(hit, minlength=len(flat)))))
        own = text_of[hit]
        about = np.zeros(len(flat) + 1, np.int64)
        np.add.at(about, np.maximum(hit - reach, ends[own] - lengths[own]), 1)
        np.add.at(about, np.minimum(hit + reach, ends[own]), -1)
        at = np.flatnonzero(np.cumsum(about[:-1]))
        zone = np.cumsum(np.concatenate(([0], (np.diff(at) > 1) | (np.diff(text_of[at]) > 0))))
        sums = bit_sums(hashes[at], block.indexes[-1].size)
        for idx in block.indexes:
            place, window = candidates(window_fingerprints(sums, idx.size), idx, policy)
            whole = zone[place] == zone[place + idx.size - 1] if len(place) else np.zeros(0, bool)
            place, window = at[place[whole]], window[whole]
            if not len(place):
                continue
            owner = idx.owner[window]
            n = block.lengths[owner]
            slack = n // 5 + 1
            doc = text_of[place]
            lo = np.maximum(place - idx.start[window] - slack, ends[doc] - lengths[doc])
            hi = np.minimum(place - idx.start[window] + n + slack, ends[doc])
            some = hits[hi] > hits[lo]
            for p, k, a, b in sorted(set(zip(*(x[some].tolist() for x in (doc, owner, lo, hi)), strict=True))):
                held, start = best.get((first + p, k)), a - int(ends[p] - lengths[p])
                if held and held[0] >= 1.0 and held[1] <= start:
                    continue
                share = containment(items[k], flat[a:b], policy.shingle)
                if share >= policy.similarity and (held is None or (-share, start) < (-held[0], held[1])):
                    best[first + p, k] = (share, start)
    return [(t, items[k].item_id, share, at) for (t, k), (share, at) in sorted(best.items())]


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK`` words."""
    first = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > CHUNK:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def blocks_of(benchmark: DataFrame, policy: LeakPolicy, item_id: str = "item_id") -> Iterator[Block]:
    """The benchmark in blocks of about ``policy.items`` items, one after another. How many items have a shingle is counted
    where the items are; the driver sees one block at a time. Repeated items are one."""
    size = policy.shingle

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({crc32(s) for s in shingles(words, size)}) if (words := words_of(t.as_py())) else [] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64()))], ["item_id", "_v", "_text", "_own"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), version(F.col("text")).alias("_v"), F.col("text").alias("_text"))
    rows = cut(rows.dropDuplicates(["item_id", "_v"]).mapInArrow(split, "item_id long, _v long, _text string, _own array<long>").filter(F.size("_own") > 0))
    total = rows.count()
    n = -(-total // policy.items)
    one = rows.select("item_id", "_v", F.explode("_own").alias("shingle"))
    spread = one.groupBy("shingle").agg(F.count("*").alias("n"))
    weighed = one.join(spread, "shingle").groupBy(F.col("item_id").alias("_of"), F.col("_v").alias("_of_v")).agg(F.map_from_entries(F.collect_list(F.struct("shingle", "n"))).alias("_spread"))
    placed = cut(rows.join(weighed, F.col("item_id").eqNullSafe(F.col("_of")) & (F.col("_v") == F.col("_of_v"))).select("item_id", "_text", "_spread", F.pmod(F.xxhash64("item_id", "_v"), F.lit(max(1, n))).alias("_block")))
    for k in range(n):
        own = placed.filter(F.col("_block") == k).select("item_id", "_text", "_spread").collect()
        yield Block(prepare(sorted(((r[0], r[1], r[2]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])), total, policy), policy)


def leaks(docs: DataFrame, benchmark: DataFrame, policy: LeakPolicy = LeakPolicy(), *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(_id, _v, item_id, similarity, start) for each row of ``docs`` and item that leaks into it; ``start`` is the first
    word of the stretch compared. The benchmark goes to the tasks in blocks, one pass over the documents for each; nothing
    of the documents is shuffled. Null and empty texts and items have no words and no leaks; a null id is a value; repeated
    rows have rows each, repeated items one; very long texts are searched whole; an empty table gives none; columns not
    named here are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), version(F.col(text)).alias("_v"), F.col(text).alias("_text"))
    schema = "_id long, _v long, item_id long, similarity double, start int"

    def search(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = find_leaks(batch.column(2).to_pylist(), block)
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32())))], ["_id", "_v", "item_id", "similarity", "start"])

        return rows.mapInArrow(run, schema)

    found = [search(block) for block in blocks_of(benchmark, policy, item_id)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def clean_stage(docs: DataFrame, benchmark: DataFrame, policy: LeakPolicy = LeakPolicy()) -> DataFrame:
    """The rows of ``docs`` without any leak, with all their columns; repeated rows fare alike. Rows stay where they are: each
    block of the benchmark is a filter over them."""
    at = docs.columns.index("text")

    def without(rows: DataFrame, block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in find_leaks(batch.column(at).to_pylist(), block)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, blocks_of(benchmark, policy), docs)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").alias("start_word"))
