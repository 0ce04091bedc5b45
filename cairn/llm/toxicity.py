"""Toxicity by compression distance: how much better a window compresses with a dictionary trained on toxic text."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, load


@dataclass(frozen=True)
class ToxicityPolicy:
    """``window`` and ``step`` in bytes. ``max_toxic``, ``max_ordinary`` and ``max_bytes`` (of either kind) bound the labelled
    rows that are fitted on the driver, those first by a hash of their ids; four fifths train the dictionaries, the rest
    calibrates. A segment that marks toxic text is in at least ``min_rows`` toxic rows, whatever share of them that is,
    ``min_ratio`` times as common there as in the others, and in so many that of all segments tried fewer than ``chance`` are
    expected to be so by chance. A toxic row with ``enough`` segments needs no others. ``dictionary`` (bytes, at most), ``cover``
    and ``gram`` are zstandard's: parts of ``cover`` bytes, chosen by how frequent their ``gram``-byte runs are. ``levels``: gains in
    bytes that count."""

    window: int = 64
    step: int = 48
    max_toxic: int = 1500
    max_ordinary: int = 3000
    max_bytes: int = 32 << 20
    segment_lengths: tuple[int, ...] = (4, 5, 6, 8, 10, 12)
    min_rows: int = 4
    min_ratio: float = 8.0
    chance: float = 0.05
    enough: int = 6
    dictionary: int = 4096
    cover: int = 16
    gram: int = 6
    levels: tuple[int, ...] = (1, 2, 3, 4, 5)
    threshold: float = 0.3


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """A null id counts as an empty text, so it is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def windows(data: bytes, window: int, step: int) -> list[bytes]:
    """Overlapping windows over all of ``data``; one at least."""
    return [data[i : i + window] for i in range(0, max(1, len(data) - (window - step)), step)]


def without_copies(texts: list[bytes], size: int = 5, share: float = 0.5) -> list[bytes]:
    """``texts`` without those that have ``share`` of their ``size``-word shingles in texts before them."""
    from xxhash import xxh64_intdigest as digest

    out, seen = [], set[int]()
    for t in texts:
        words = t.split()
        own = {digest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}
        if len(own & seen) < share * len(own):
            out.append(t)
        seen |= own
    return out


def toxic_segments(toxic: list[bytes], ordinary: list[bytes], policy: ToxicityPolicy) -> list[bytes]:
    """Parts of words that are in far more toxic texts than ordinary ones, those with the most excess first, none within
    another; as many as it takes, but none that ``min_rows`` texts without ``enough`` segments don't have: those would only match
    ordinary text. Copies count once: in them every part of a word is as frequent as they are."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)

    def spread(texts: list[bytes], among: dict[bytes, int] | None = None) -> Counter[bytes]:
        seen: Counter[bytes] = Counter()
        for t in texts:
            own = {w[i : i + n] for w in set(t.split()) for n in policy.segment_lengths for i in range(len(w) - n + 1)}
            seen.update(own if among is None else own & among.keys())
        return seen

    there = {s: n for s, n in spread(toxic).items() if n >= policy.min_rows}
    other = spread(ordinary, there)
    rate, least = len(toxic) / max(1, len(toxic) + len(ordinary)), math.log(max(1, len(there)) / policy.chance)
    ranked = []
    for s, n in there.items():
        share, usual = (n + 0.5) / (len(toxic) + 1), (other[s] + 0.5) / (len(ordinary) + 1)
        if share > policy.min_ratio * usual:
            # Chernoff's bound on the chance that so many of the texts that have it are toxic
            part = n / (n + other[s])
            excess = n * math.log(part / rate) + (other[s] * math.log((1 - part) / (1 - rate)) if other[s] else 0)
            if excess >= least:
                ranked.append((n * math.log(share / usual), len(s), s))
    out: list[bytes] = []
    has = [0] * len(toxic)
    for _, _, s in sorted(ranked, reverse=True):
        if not any(s in x for x in out):
            own = [i for i, t in enumerate(toxic) if s in t]
            if sum(has[i] < policy.enough for i in own) >= policy.min_rows:
                out = [x for x in out if x not in s] + [s]
                for i in own:
                    has[i] += 1
    return out


def toxic_text(toxic: list[bytes], segments: list[bytes]) -> list[bytes]:
    """The words of toxic texts that have a segment, as often as they stand, with the spaces about them: what is toxic in
    texts that are ordinary otherwise. Copies count once."""
    if not segments:
        return []
    marks = re.compile(b"|".join(map(re.escape, segments)))
    return [b" " + w + b" " for t in without_copies(toxic) for w in t.split() if marks.search(w)]


#: The last part of a zstandard dictionary's header: the three offsets it starts with.
_OFFSETS = struct.pack("<3I", 1, 4, 8)


def trained(samples: list[bytes], policy: ToxicityPolicy) -> bytes:
    """The content of the dictionary that zstandard trains on ``samples``, without its header. Few samples are taken several
    times, as it refuses them else; of so few that it still does, the dictionary is all of them."""
    import zstandard as z

    if not samples:
        return b""
    samples = samples * -(-64 // len(samples))
    size = policy.dictionary
    while size >= 256:
        try:
            made = z.train_dictionary(size, samples, k=policy.cover, d=policy.gram, steps=1).as_bytes()
        except z.ZstdError:
            size //= 2
            continue
        return made[made.index(_OFFSETS) + len(_OFFSETS) :]
    return b"".join(dict.fromkeys(samples))[: policy.dictionary]


class Gain:
    """Bytes by which the toxic dictionary shortens each window, over the ordinary one.

    The toxic dictionary goes on where the ordinary one ends, so that both hold what all texts share, and only toxic text
    tells them apart. A window is compressed doubled: its second half is one long match with either, so that it never
    falls back to being stored as it is, and every match in its first half shows. The compressor's window and tables
    cover the whole of the larger dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes, window: int, step: int) -> None:
        import zstandard as z

        log = max(12, (len(ordinary) + len(toxic) + 2 * window).bit_length())

        def using(content: bytes) -> z.ZstdCompressor:
            words = z.ZstdCompressionDict(content.ljust(16, b"\0"), dict_type=z.DICT_TYPE_RAWCONTENT)
            kind = {"window_log": log, "hash_log": log, "chain_log": log, "search_log": 4, "min_match": 4, "strategy": z.STRATEGY_GREEDY}
            return z.ZstdCompressor(dict_data=words, compression_params=z.ZstdCompressionParameters(**kind, write_content_size=0, write_checksum=0, write_dict_id=0))

        self.ordinary, self.toxic = using(ordinary), using(ordinary + toxic)
        self.window, self.step = window, step

    def __call__(self, data: bytes) -> np.ndarray:
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(w + w)) - len(b(w + w)) for w in windows(data, self.window, self.step)])


@dataclass(frozen=True)
class ToxicityModel:
    """The dictionaries' contents, the weights of ``features``, the first the bias, and the score where there are none."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    constant: float
    policy: ToxicityPolicy

    def gain(self) -> Gain:
        return Gain(self.ordinary, self.toxic, self.policy.window, self.policy.step)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(_ones(features) @ np.array(self.weights), -30, 30)))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def features(gains: np.ndarray, levels: tuple[int, ...]) -> list[float]:
    """Of a document's windows: the largest gain, and for each level how many reach it and which share."""
    n = [(gains >= k).sum() for k in levels]
    return [min(float(gains.max()), 12.0) / 4, *(math.log1p(x) for x in n), *(math.sqrt(x / len(gains)) for x in n)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, the first of them the bias."""
    x, w = _ones(x), np.zeros(x.shape[1] + 1)
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], rates: tuple[float, float], policy: ToxicityPolicy = ToxicityPolicy()) -> ToxicityModel:
    """``rates``: how many labelled rows each sampled one stands for. Where one kind has no rows nothing tells texts apart: all
    score the toxic share of the rows with half a row added to either kind, and 0 where there are no rows at all."""
    part = lambda rows, own: [t for i, t in enumerate(rows) if (i % 5 == 0) == own]
    if not toxic or not ordinary:
        n = len(toxic) * rates[0] + len(ordinary) * rates[1]
        return ToxicityModel(b"", b"", (), (len(toxic) * rates[0] + 0.5) / (n + 1) if n else 0.0, policy)
    segments = toxic_segments(part(toxic, False), part(ordinary, False), policy)
    common = trained([w for t in part(ordinary, False) for w in windows(t, policy.window, policy.window)], policy)
    model = ToxicityModel(common, trained(toxic_text(part(toxic, False), segments), policy), (), 0.0, policy)
    gain = model.gain()
    rows = [(features(gain(t), policy.levels), kind) for kind, texts in ((1, part(toxic, True)), (0, part(ordinary, True))) for t in texts]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    weights = logistic(x, y, np.where(y == 1, rates[0], rates[1]) / min(rates))
    return ToxicityModel(model.ordinary, model.toxic, tuple(weights.tolist()), 0.0, policy)


def first_by_hash(rows: DataFrame, n: int, most: int, key: str = "doc_id", parts: int = 512) -> DataFrame:
    """Of ``n`` rows at most ``most``, those first by a hash of ``key``, and nearly that many: whole ones of ``parts`` ranges of
    the hash, which are counted where the rows are. No task sorts or gets more than it has."""
    if n <= most:
        return rows
    share = min(1.0, 2.0 * most / n)
    at = F.shiftrightunsigned(F.xxhash64(F.lit(most), key), 11) / F.lit(float(1 << 53)) * F.lit(parts / share)
    placed = rows.withColumn("_at", F.floor(at)).filter(F.col("_at") < parts)
    counts = {r["_at"]: r["n"] for r in placed.groupBy("_at").agg(F.count("*").alias("n")).collect()}
    end = held = 0
    while end < parts and held + counts.get(end, 0) <= most:
        held += counts.get(end, 0)
        end += 1
    return placed.filter(F.col("_at") < end).drop("_at")


def train(docs: DataFrame, labels: DataFrame, policy: ToxicityPolicy = ToxicityPolicy()) -> ToxicityModel:
    """Fits on a sample of the rows of ``labels`` that aren't held out and have a label, at most ``max_toxic`` and ``max_ordinary`` of
    them and ``max_bytes`` of either, whole texts. Of repeated labels the larger counts, of texts under one id the first;
    labels without a text, and null ids, are passed over. The ids, of bounded number, are sent to the tasks that read the texts."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = cut(known)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bounds = ((1, policy.max_toxic), (0, policy.max_ordinary))
    chosen = [first_by_hash(known.filter(F.col("toxic") == kind), n.get(kind, 0), most) for kind, most in bounds]
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = texts.select("doc_id", "toxic", F.octet_length("text").alias("_size"))
    fits = sizes.withColumn("_size", F.sum("_size").over(before)).filter(F.col("_size") <= policy.max_bytes).select("doc_id")
    kinds: dict[int, list[bytes]] = {1: [], 0: []}
    for r in texts.join(F.broadcast(fits), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "text").toArrow().to_pylist():
        kinds[r["toxic"]].append(plain(r["text"]))
    rates = tuple(n.get(kind, 0) / max(1, len(kinds[kind])) or 1.0 for kind, _ in bounds)
    return fit(kinds[1], kinds[0], rates, policy)


def score(docs: DataFrame, model: ToxicityModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, over windows of the whole text; a null text is empty, and an empty one is a window
    of nothing, scored like others. Repeated rows are scored each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, levels = model.gain(), model.policy.levels
        for batch in batches:
            found = np.array([features(gain(plain(t.as_py())), levels) for t in batch.column(1)])
            scores = model.score(found) if len(found) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.policy.threshold).cast("int").alias("predicted"))
