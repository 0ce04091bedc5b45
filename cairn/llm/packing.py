"""Documents as token sequences of bounded length: bounded-space online best-fit."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, load

#: Entries kept by a worker's table of encoded words; when full it starts anew.
CACHE = 400_000
#: White space other than a space and a line feed, and white space beside white space.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_RUNS = ("  ", " \n", "\n ")
#: Places in a sequence, pieces that one task packs, and bins that are open at once.
CAPACITY, PIECES_A_TASK, OPEN_BINS = 2048, 25_000, 16_384


class Encoder:
    """Token ids of a text as unsigned 32-bit numbers, one byte string. ``ranks`` names a file of the vocabulary's tokens
    by rank, ``pattern`` its splitting rule, ``special`` its special tokens; they give the same ids as the same vocabulary
    in the tokenizers library, which takes the strings of special tokens in a text for these tokens.

    The splitting rule starts a new part at every space between two characters that aren't white space, so that there
    each word can be encoded once and kept; other texts are encoded whole. Special tokens must not hold spaces.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        known = {token: rank for token, rank in known.items() if rank not in special.values()}
        whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=special)
        self.plain, self.whole, self.special = whole.encode_ordinary, whole, tuple(special)
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, allowed_special="all")
        return self.plain(text)

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        if not parts[0] or not parts[-1] or any(x in text for x in _RUNS) or any(c in text for c in _OTHER_SPACE):
            return array("I", self.encode(text)).tobytes()
        first = array("I", self.encode(parts.pop(0))).tobytes()
        words = self.words
        out = list(map(words.get, parts))
        if None in out:
            if len(words) > CACHE:
                words.clear()
            encode = self.encode
            for i, x in enumerate(out):
                if x is None:
                    p = parts[i]
                    if (x := words.get(p)) is None:
                        x = words[p] = array("I", encode(" " + p)).tobytes()
                    out[i] = x
        out.insert(0, first)
        return b"".join(out)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: itself if it fits, else pieces of ``capacity``, the first of them
    shorter where they don't come out even."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


_PIECES = "_id long, _piece int, _start long, _length int, _crc long"
_PACKED = _PIECES + ", _sequence long, _offset int"


def tokenize(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """The pieces of all rows: ids of the whole text, then ``end``, cut only where longer than ``capacity``; a null
    text is empty. Only place, length and checksum of a piece leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(ranks, pattern, special), array("I", [end]).tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[i].as_py() or "") + tail
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    for column, x in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["_id", "_piece", "_start", "_length", "_crc"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, _PIECES)


class BestFit:
    """Bounded-space online best-fit. Open bins lie in stacks by their free space; a bit of ``free`` is set for each
    space that some open bin has. A piece goes to the bin with the least space that holds it, or opens a new one;
    when more than ``open_bins`` are open, the fullest closes."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.stacks, self.n_open, self.n_bins = 0, {}, 0, 0

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        bin_ = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return bin_

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        if fitting := self.free >> length:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, self.n_bins
            self.n_bins += 1
        if left := space - length:
            self.stacks.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        return bin_, self.capacity - space


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, pieces_a_task: int = PIECES_A_TASK, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with ``_sequence`` and ``_offset``. Each task packs about ``pieces_a_task`` pieces and numbers its
    sequences by itself; what it holds is the open bins. Pieces come longest first (of equals by a hash): the long ones open
    bins, the short ones fill them. More bins may be open than a task of pieces that long needs, so that few close early."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = [fit.add(n) for n in batch.column(3).to_pylist()]
            extra = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_sequence", "_offset"])

    pieces = cut(pieces)
    tasks = -(-max(1, pieces.count()) // pieces_a_task)
    return pieces.repartition(tasks).sortWithinPartitions(F.desc("_length"), F.xxhash64("_id", "_piece", "_crc"), "_id", "_piece", "_crc").mapInArrow(run, _PACKED)


#: The special tokens of the public vocabulary that is taken where none is named.
SPECIAL = {"<|endoftext|>": 50256}


def pack_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, special: dict[str, int] = SPECIAL, **options) -> DataFrame:
    """Every piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are the end token alone; repeated rows, and rows that share an id or have none, are packed each; very long texts
    are cut into pieces; an empty table gives no rows. Other columns are not read. Without ``ranks`` the public vocabulary at
    hand is taken."""
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks, pattern = ranks or str(public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN
    packed = pack(tokenize(docs, ranks, pattern, special), **options)
    return packed.select(
        F.col("_id").alias("doc_id"),
        F.col("_piece").alias("piece"),
        F.col("_start").alias("start"),
        F.col("_length").cast("long").alias("length"),
        F.col("_crc").alias("ids_crc32"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").cast("long").alias("offset"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents", "doc_id", "text"))
