"""Class-based bigram language model: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, load, version

#: The token after the last word; no word has a line feed.
END = b"\n"


@dataclass(frozen=True)
class LmPolicy:
    """``own``: the most frequent words, among which classes are exchanged, ``classes`` of them at most; every other word, however
    rare, then joins the class that its neighbours make likeliest. ``head``: words, at most, whose classes and counts go to
    all tasks; the rest, the tail, is joined. ``discount``: taken off each count for words not seen. Every count covers the
    whole corpus."""

    own: int = 1000
    classes: int = 64
    head: int = 131_072
    sweeps: int = 6
    discount: float = 0.5


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """A null id counts as an empty text, so it is in training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def tokens_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8, which is how they come."""
    return texts.cast(pa.binary()).to_pylist()


def count_words(texts: DataFrame, limit: int = 200_000) -> DataFrame:
    """(word binary, n) over all tokens of the column ``_text``; a task holds at most ``limit`` different words and those
    of one batch, and hands on what it has then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                counts.update(tokens_of(text))
                if len(counts) > limit:
                    yield _count_batch(counts)
                    counts.clear()
        if counts:
            yield _count_batch(counts)

    return texts.select("_text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_batch(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def token_chunks(texts: pa.Array, size: int = 200_000) -> Iterator[list[bytes]]:
    """The tokens of whole texts one after another, about ``size`` a time. Each text ends with the end, so that before
    every first word, but that of a chunk, stands the end."""
    held: list[bytes] = []
    for text in as_bytes(texts):
        held += tokens_of(text)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


class Vocabulary:
    """The head: words by the frequency of their counts, ``own`` first, and the end, which has the last place. ``len(self)`` stands for
    every other word, the tail."""

    def __init__(self, ranked: list[tuple[bytes, int]], ends: int, own: int) -> None:
        self.words = [w for w, _ in ranked] + [END]
        self.counts = np.array([n for _, n in ranked] + [ends], np.int64)
        self.own = min(own, len(ranked))
        self.at = {w: i for i, w in enumerate(self.words)}

    def __len__(self) -> int:
        return len(self.words)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.get, words, repeat(len(self.words))), np.int64, len(words))


def states_of(cls: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """The state of each place of a vocabulary of ``n_words`` and of the tail: the class where it has one, else the state of words
    without; of ``k`` classes the end is class ``k`` and state ``k + 1`` is that of the rest."""
    out = np.full(n_words + 1, k + 1)
    out[: len(cls)] = cls
    out[n_words - 1] = k
    return out


def _before(states: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate(([end], states[:-1]))


def _after(states: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate((states[1:], [end]))


def count_pairs(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each of the own words, the end (one before last) and the rest (last) stands after each: a table of fixed size,
    summed up in the tasks."""
    n = words.own + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        item = states_of(np.arange(words.own), len(words), words.own)
        for batch in batches:
            for tokens in token_chunks(batch.column(0)):
                own = item[words.places(tokens)]
                total += np.bincount(_before(own, words.own) * n + own, minlength=n * n)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    found = texts.select("_text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(n * n, np.int64)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each item by exchange clustering on the counts of item pairs: items in the order of their counts move
    to the class that gains most likelihood, the first of equals, until a sweep moves none. They start dealt out in
    turn, to ``classes`` of them at most; the last two items, the end and the rest, keep classes to themselves, the last two."""
    n = len(pairs)
    c = min(classes, n - 2) + 2
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[:-2], kind="stable")
    cls = np.arange(n) - n + c
    cls[order] = np.arange(n - 2) % max(1, c - 2)
    member = np.zeros((n, c))
    member[np.arange(n), cls] = 1
    pairs = pairs.astype(float)
    between = member.T @ pairs @ member
    into, out = member.T @ pairs, pairs @ member  # class -> item, item -> class
    left, right, sums_out, sums_in = between.sum(1), between.sum(0), pairs.sum(1), pairs.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old, self_ = cls[w], pairs[w, w]
            o, i = out[w].copy(), into[:, w].copy()
            o[old] -= self_
            i[old] -= self_
            between[old] -= o
            between[:, old] -= i
            between[old, old] -= self_
            left[old] -= sums_out[w]
            right[old] -= sums_in[w]
            # gain of each class as w's new one
            now = _xlogx(between)
            rows = _xlogx(between + o) - now
            cols = _xlogx(between + i[:, None]) - now
            diag = np.diagonal(between)
            gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols) + _xlogx(diag + o + i + self_) - _xlogx(diag)
            gain -= _xlogx(left + sums_out[w]) - _xlogx(left) + _xlogx(right + sums_in[w]) - _xlogx(right)
            gain[c - 2 :] = -np.inf
            new = old if gain[old] >= gain.max() - 1e-9 else int(gain.argmax())
            between[new] += o
            between[:, new] += i
            between[new, new] += self_
            left[new] += sums_out[w]
            right[new] += sums_in[w]
            if new != old:
                moved += 1
                cls[w] = new
                into[old] -= pairs[w]
                into[new] += pairs[w]
                out[:, old] -= pairs[:, w]
                out[:, new] += pairs[:, w]
        if not moved:
            break
    return cls


def gains(starts: np.ndarray, side: np.ndarray, n: np.ndarray, between: np.ndarray) -> np.ndarray:
    """What each word adds to the likelihood of the class pairs ``between`` as a member of each class, by words and classes. A word's
    entries begin at ``starts``: ``n`` times the state ``side`` stands before it, or after it if the number of states is added."""
    states = len(between)
    k = states - 2
    table = np.concatenate([between[:, :k], between[:k].T]).astype(float)
    one = _xlogx(table + 1) - _xlogx(table)
    out = np.empty((len(starts), k))
    left, right = between.sum(1)[:k].astype(float), between.sum(0)[:k].astype(float)
    for first in range(0, len(starts), 2048):
        own = starts[first : first + 2048]
        end = starts[first + 2048] if first + 2048 < len(starts) else len(side)
        s, x = side[own[0] : end], n[own[0] : end].astype(float)
        add = one[s]
        several = np.flatnonzero(x > 1)
        add[several] = _xlogx(table[s[several]] + x[several, None]) - _xlogx(table[s[several]])
        times = np.add.reduceat(np.where(s < states, x, 0), own - own[0])[:, None]
        out[first : first + 2048] = np.add.reduceat(add, own - own[0]) - (_xlogx(left + times) - _xlogx(left) + _xlogx(right + times) - _xlogx(right))
    return out


def _best(gain: np.ndarray) -> np.ndarray:
    """The first class whose gain is the greatest but for rounding."""
    return (gain >= gain.max(1, keepdims=True) - 1e-9).argmax(1)


def classify_head(texts: DataFrame, words: Vocabulary, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class of each word of the head: ``own`` of the first, of the others the likeliest by the states before and after them. The
    counts of word and state are sparse and summed up in the tasks, and each word is assigned where its counts are."""
    states, k = len(between), len(between) - 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = states_of(own, len(words), k)
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        for batch in batches:
            for tokens in token_chunks(batch.column(0)):
                at = words.places(tokens)
                own_ = state[at]
                pick = (at >= words.own) & (at < len(words) - 1)
                word = at[pick] * 2 * states
                parts.append(np.unique(np.concatenate((word + _before(own_, k)[pick], word + states + _after(own_, k)[pick])), return_counts=True))
            if sum(len(c) for c, _ in parts) > 4_000_000:
                parts = [merged()]
                if len(parts[0][0]) > 2_000_000:
                    yield rows(*parts.pop())
        if parts:
            yield rows(*merged())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                entries = lists.flatten()
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                cls = _best(gains(starts, entries.field(0).to_numpy().astype(np.int64), entries.field(1).to_numpy(), between))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls.astype(np.int32))], ["at", "cls"])

    cls = np.full(len(words) - 1, 0)
    cls[: words.own] = own
    if words.own < len(cls):
        counted = texts.select("_text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        counted = counted.select(F.expr(f"code div {2 * states}").cast("int").alias("at"), (F.col("code") % (2 * states)).cast("int").alias("side"), "n")
        found = counted.groupBy("at").agg(F.collect_list(F.struct("side", "n")).alias("e")).mapInArrow(assign, "at int, cls int").toArrow()
        cls[found["at"].to_numpy()] = found["cls"].to_numpy()
    return cls


def classify_tail(texts: DataFrame, words: Vocabulary, cls: np.ndarray, between: np.ndarray, limit: int = 200_000) -> DataFrame:
    """(word, n, cls) for each word of the tail, its count and likeliest class, and with a null word the class pairs of the whole
    corpus: ``n`` times the class ``cls % states`` stands after the state ``cls // states``.

    A task counts the class pairs whose second word is of the head, and for each word of the tail the states before and
    after it. A word's counts meet in one task, none of which is frequent; there it gets its class, and the pairs with it count."""
    states, k = len(between), len(between) - 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = states_of(cls, len(words), k)
        pairs, tail = np.zeros(states * states, np.int64), Counter[tuple[bytes, int]]()

        def rows(own: list[bytes], code: np.ndarray | list[int], n: np.ndarray | list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], ["word", "code", "n"])

        def flush() -> pa.RecordBatch:
            out = rows([w for w, _ in tail], [c for _, c in tail], list(tail.values()))
            tail.clear()
            return out

        for batch in batches:
            for tokens in token_chunks(batch.column(0)):
                at = words.places(tokens)
                own = state[at]
                before = _before(own, k)
                known = at < len(words)
                pairs += np.bincount((before * states + own)[known], minlength=states * states)
                rest = np.flatnonzero(~known)
                tail.update(zip([tokens[i] for i in rest.tolist()], (before * states + _after(own, k))[rest].tolist(), strict=True))
                if len(tail) > limit:
                    yield flush()
        seen = np.flatnonzero(pairs)
        # no word has a line feed
        yield rows([END + int(x).to_bytes(4, "big") for x in seen], seen.astype(np.int32), pairs[seen])
        if tail:
            yield flush()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(states * states, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            entries = lists.flatten()
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            code, n = entries.field(0).to_numpy().astype(np.int64), entries.field(1).to_numpy()
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            pair = pa.compute.starts_with(batch.column(0), END).to_numpy(zero_copy_only=False)
            pairs += np.bincount(code[pair[of]], n[pair[of]], states * states).astype(np.int64)
            here = ~pair[of]
            if not here.any():
                continue
            code, n, of = code[here], n[here], of[here]
            side = np.stack((code // states, states + code % states), 1).ravel()
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            own = _best(gains(2 * first, side, np.repeat(n, 2), between))
            pairs += np.bincount(code // states * states + np.repeat(own, np.diff(np.append(first, len(of)))), n, states * states).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(~pair)), pa.array(np.add.reduceat(n, first)), pa.array(own.astype(np.int32))], ["word", "n", "cls"])
        seen = np.flatnonzero(pairs)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.binary()), pa.array(pairs[seen]), pa.array(seen.astype(np.int32))], ["word", "n", "cls"])

    counted = texts.select("_text").mapInArrow(count, "word binary, code int, n long").repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n"))
    return counted.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("e")).mapInArrow(assign, "word binary, n long, cls int")


@dataclass
class ClassModel:
    """What the tasks need to score, of bounded size. ``states``: of each word of the head and of the tail. ``follow``: log10 of
    a class, by the state before it; ``class_tokens``, ``class_words``: training tokens and different words of each class."""

    words: Vocabulary
    states: np.ndarray
    follow: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    discount: float

    def unseen(self) -> np.ndarray:
        """The share of each class that is left to words not seen; a class without words has all its probability there."""
        return np.where(self.class_words > 0, self.discount * self.class_words / np.maximum(self.class_tokens, 1), 1.0)

    def unknown(self) -> np.ndarray:
        """log10 of a word not seen, of whatever class, by the state before it."""
        return np.log10(10**self.follow @ self.unseen())


def transitions(between: np.ndarray) -> np.ndarray:
    """log10 of each class (column) after each state, Witten-Bell between the counts of pairs and those of classes."""
    total = between.sum()
    single = (between.sum(0) + 1) / (total + between.shape[1])
    out, kinds = between.sum(1, keepdims=True), (between > 0).sum(1, keepdims=True)
    return np.log10((between + np.maximum(kinds, 1) * single) / (out + np.maximum(kinds, 1)))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts``: all those with ``n`` from some number on. Counts are grouped by their magnitude, 8 groups
    to a doubling, which makes a histogram of a few hundred rows; no task sorts words."""
    group = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(counts.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["g"]):
        held += r["n"]
        if held > most:
            least = r["g"] + 1
            break
    return counts.filter(group >= least)


def train(texts: DataFrame, policy: LmPolicy = LmPolicy()) -> tuple[ClassModel, DataFrame]:
    """The model of all rows of ``texts`` (column ``_text``), and (word, n, cls) for all words of the tail. Without any token every
    class has unseen words only."""
    counts = cut(count_words(texts))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends")).first()
    top = most_frequent(counts.filter(F.col("word") != F.lit(END)), policy.head).toArrow()
    ranked = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words = Vocabulary(ranked, total["ends"], policy.own)
    pairs = count_pairs(texts, words)
    own = exchange(pairs, policy.classes, policy.sweeps)
    k = int(own[-2])
    member = np.zeros((len(own), k + 2), np.int64)
    member[np.arange(len(own)), own] = 1
    between = member.T @ pairs @ member
    cls = classify_head(texts, words, own[:-2], between)
    found = cut(classify_tail(texts, words, cls, between))
    tail = found.filter("word IS NOT NULL")
    whole = np.zeros((k + 2) * (k + 2))
    for r in found.filter("word IS NULL").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        whole[r["cls"]] = r["n"]
    whole = whole.reshape(k + 2, k + 2)[:, : k + 1]  # no word is of the rest
    class_of = np.append(cls, k)
    tokens = np.bincount(class_of, words.counts, k + 1)
    distinct = np.bincount(class_of[words.counts > 0], minlength=k + 1)
    for r in tail.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["cls"]] += r["n"]
        distinct[r["cls"]] += r["v"]
    return ClassModel(words, states_of(cls, len(words), k), transitions(whole), tokens, distinct, total["n"], total["v"], policy.discount), tail


_ROWS = "_id long, _v long, word binary, m long, state int, n_tokens long, n_known long, base double, score double"


def _score_parts(model: ClassModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text one row with what the head tells, under a word that no text has, and a row per word of the tail and state
    before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, states, counts = model.words, model.states, model.words.counts
        n_head, end = len(words), int(model.states[-2])
        cls = states[:-1]
        per = np.log10(np.maximum(counts - model.discount, 1e-9)) - np.log10(np.maximum(model.class_tokens[cls], 1))
        emit, base = np.where(counts > 0, per, np.log10(model.unseen()[cls])), np.log10(counts + 1)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            texts = [tokens_of(t) for t in as_bytes(batch.column(2))]
            n_tokens = np.array([len(t) for t in texts], np.int64)
            first = np.cumsum(n_tokens) - n_tokens
            tokens = list(chain.from_iterable(texts))
            at = words.places(tokens)
            own = states[at]
            before = _before(own, end)
            near = at < n_head
            score, known, base_ = np.zeros(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at))
            score[near] = model.follow[before[near], own[near]] + emit[at[near]]
            known[near], base_[near] = counts[at[near]] > 0, base[at[near]]
            rest = np.flatnonzero(~near)
            text_of = np.repeat(np.arange(len(texts)), n_tokens)
            other = Counter(zip(text_of[rest].tolist(), [tokens[i] for i in rest.tolist()], before[rest].tolist(), strict=True))
            ids, versions = batch.column(0), batch.column(1)
            marks = [END + np.int64(v).tobytes() + np.int64(i or 0).tobytes() for i, v in zip(ids.to_pylist(), versions.to_pylist(), strict=True)]
            m, k = len(other), len(texts)
            owner = pa.array([t for t, _, _ in other], pa.int64())
            none = np.zeros(m)
            cols = [
                pa.concat_arrays([ids, ids.take(owner)]),
                pa.concat_arrays([versions, versions.take(owner)]),
                pa.array([*marks, *(w for _, w, _ in other)], pa.binary()),
                pa.array(np.concatenate((np.zeros(k, np.int64), np.fromiter(other.values(), np.int64, m)))),
                pa.array(np.concatenate((np.full(k, -1, np.int32), np.fromiter((s for _, _, s in other), np.int32, m)))),
                pa.array(np.concatenate((n_tokens, none.astype(np.int64)))),
                pa.array(np.concatenate((np.add.reduceat(known, first), none.astype(np.int64)))),
                pa.array(np.concatenate((np.add.reduceat(base_, first), none))),
                pa.array(np.concatenate((np.add.reduceat(score, first), none))),
            ]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)

    return run


_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def score(docs: DataFrame, policy: LmPolicy = LmPolicy(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from
    all rows that aren't held out. A null text is empty and has the end only; a null id counts as an empty one; repeated rows
    are learnt from and returned as often as they are there; very long texts are whole; an empty table gives no rows; other
    columns are not read.

    log10 P(text) = sum over its tokens of P(class | state before) P(word | class). Every word of the corpus has a class of its
    own finding; as what stands before another word it counts as its class, or, if it is of the tail, as the rest. A word
    seen n times has n - discount of its class's tokens, and what that leaves is the probability of the class's one symbol
    for words not seen; a word not seen may be of any class.

    The classes and counts of the most frequent words go to every task, a bounded number; the others, of which none is
    frequent by construction, meet theirs in a join on the word, one row per word, state before it and document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), version(F.col(text)).alias("_v"), F.col(text).alias("_text"))
    model, counts = train(rows.filter(~held_out(F.col("_id"))), policy)
    parts = rows.mapInArrow(_score_parts(model), _ROWS)
    n, k = F.col("n"), model.follow.shape[1]
    known = lambda xs, at: F.expr(f"get(from_json('[{','.join(repr(float(x)) for x in xs)}]', 'array<double>'), {at})")
    emit = F.log10(n - F.lit(model.discount)) - known(np.log10(np.maximum(model.class_tokens, 1)), "cls") + known(model.follow.ravel(), f"state * {k} + cls")
    emit = F.when(n.isNull(), known(model.unknown(), "state")).otherwise(emit)
    tail = F.col("state") >= 0
    joined = parts.join(counts, "word", "left").select(
        "_id",
        "_v",
        (~tail).cast("int").alias("copies"),
        "n_tokens",
        F.when(tail, F.when(n.isNotNull(), F.col("m")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(tail, F.col("m") * F.log10(F.coalesce(n, F.lit(0)) + 1.0)).otherwise(F.col("base")).alias("base"),
        F.when(tail, F.col("m") * emit).otherwise(F.col("score")).alias("score"),
    )
    sums = joined.groupBy("_id", "_v").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")])
    each = sums.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    whole = lambda c: F.expr(f"{c} div copies")
    return each.select(
        F.col("_id").alias("doc_id"),
        held_out(F.col("_id")).alias("held_out"),
        whole("n_tokens").alias("n_tokens"),
        whole("n_known").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - whole("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1)))).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents", "doc_id", "text"))
