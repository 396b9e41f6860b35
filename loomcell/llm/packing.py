"""Packing token sequences by non-negative least squares over length histograms.

Each document is cut into windows that are full and one rest, so that a document of
n tokens has ceil(n / window) pieces.  Rests are packed: lengths are put in bins,
all combinations of up to ``depth`` bins that fill a window exactly are enumerated,
and non-negative least squares chooses how often to repeat each so that the
histogram of rests is met.  Counts are rounded down, real rests take the places
(longest first within a bin), and what is left is packed greedily (best fit).

Counts are solved once, against the histogram of all pieces; pieces are dealt by a
hash into shards of a bounded size, and each shard takes its share of the counts, so no task sees more than a shard and sequence ids need no
global order.  Token ids never leave the tokenizing task: a piece's CRC is taken
there.

With ``in_order`` the order of the rows, such as that of a mix, is the order of sequence
ids: shards are then runs of about ``RUN`` neighbouring rows, and the sequences of a run
are numbered by the mean place of their tokens.  So a row's pieces stay within its run.

Defined results: a null text is an empty one, which is the single id 1; repeated
rows (and rows with a null doc_id) are packed one by one; equal lengths are taken
in the order of doc_id and start, with ``in_order`` of place and start; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.llm.common import file_starts, materialise, row_places, session, table, texts

WINDOW = 2048
END_ID = 1
#: Pieces in a shard, on average.
SHARD = 12_000
#: Rows in a shard, on average, where their order is kept.
RUN = 512
#: Width of a length bin, and the most pieces of a combination.
GRAIN, DEPTH = 32, 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level BPE vocabularies of this kind cut text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    Where the ids of a vocabulary follow the order of its merges, the same merges are
    run by tiktoken, which gives the ids of ``tokenizers`` several times as fast; texts
    that hold a special token's string, and other vocabularies, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if spec.get("normalizer") is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges)):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): k for t, k in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern gives up on very long runs of white space
            import regex

            ids = np.array([k for m in regex.finditer(PATTERN, text) for k in self.fast._encode_single_piece(m[0])])
        return ids.astype("<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces."""
    n = len(ids) // 4
    return [(s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)])) for s in range(0, n, window)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, in_order: bool = False) -> DataFrame:
    """Pieces of every row: PIECES and ``salt``, which tells rows with equal ids apart if their texts differ; ``in_order`` adds part and row, the row's place."""
    session(docs)
    path = path or tokenizer_path()
    rest = {"salt": F.xxhash64(text)} | (dict(zip(("part", "row"), row_places(docs), strict=True)) if in_order else {})
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(c.alias(name) for name, c in rest.items()))

    rest_names = list(rest)

    def split(batches):
        encode = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch, column in texts(batches):
            found = [cut(encode(t or "") + end, window) for t in column]
            counts = np.array([len(f) for f in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(found)), counts))
            flat = np.array([p for f in found for p in f], np.int64).reshape(-1, 3)
            tokens = np.repeat(np.array([f[-1][0] + f[-1][1] for f in found], np.int64), counts)
            columns = [batch.column(0).take(at), *(pa.array(flat[:, k]) for k in range(3)), pa.array(tokens), *(batch.column(name).take(at) for name in rest_names)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *rest_names])

    return own.mapInArrow(split, f"{PIECES}, salt long" + ", part string, row long" * in_order)


# --- the model -----------------------------------------------------------------------


@lru_cache(8)
def combinations(bins: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All multisets of up to ``depth`` sizes that sum to ``bins``: the sizes (0: none), and the matrix sizes x combinations."""
    found: list[tuple] = []

    def extend(prefix: tuple, rest: int, most: int) -> None:
        if rest == 0:
            found.append(prefix + (0,) * (depth - len(prefix)))
        elif len(prefix) < depth and rest <= most * (depth - len(prefix)):
            for size in range(min(rest, most), 0, -1):
                extend((*prefix, size), rest - size, size)

    extend((), bins, bins)
    sizes = np.array(found, np.int64)
    matrix = np.zeros((bins + 1, len(sizes)), np.float32)
    for k in range(depth):
        np.add.at(matrix, (sizes[:, k], np.arange(len(sizes))), 1)
    return sizes, matrix[1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    used: list[int] = []
    residual = b.astype(float)
    at32 = np.ascontiguousarray(a.T)
    limit = 1e-5 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = at32 @ residual.astype(np.float32)
        if used:
            gradient[used] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= limit:
            break
        used.append(k)
        while used:
            own = a[:, used].astype(float)
            solved = np.linalg.lstsq(own, b, rcond=None)[0]
            if (solved > 1e-9).all():
                x[:] = 0
                x[used] = solved
                break
            old = x[used]
            bad = solved <= 1e-9
            step = np.min(old[bad] / np.maximum(old[bad] - solved[bad], 1e-12))
            moved = old + step * (solved - old)
            x[used] = moved
            left = [u for u, v in zip(used, moved, strict=True) if v > 1e-9]
            if len(left) == len(used):
                left.remove(used[int(np.argmin(np.where(bad, moved, np.inf)))])
            for u in set(used) - set(left):
                x[u] = 0
            used = left
        residual = b - a[:, used].astype(float) @ x[used] if used else b.astype(float)
    return x


def solve(histogram: np.ndarray, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[tuple[tuple, float]]:
    """How often to repeat each combination of bins; ``histogram`` counts pieces by length, from 0 to window."""
    grain = max(1, min(grain, window // 8))
    bins = window // grain
    binned = np.zeros(bins + 1)
    np.add.at(binned, -(-np.arange(window) // grain), histogram[:window])
    sizes, matrix = combinations(bins, depth)
    x = nnls(matrix, binned[1:])
    return [(tuple(int(s) for s in sizes[k] if s), float(x[k])) for k in np.argsort(-x, kind="stable") if x[k] > 0]


def assign(lengths: np.ndarray, plan: list, share: float = 1.0, window: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (dense from 0) and offset of each piece; the order of equal lengths decides ties.

    ``share`` is the part of the planned repeats that is due here.
    """
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    full = np.flatnonzero(lengths >= window)
    sequence[full] = np.arange(len(full))
    made = len(full)
    rest = np.flatnonzero(lengths < window)
    grain = max(1, min(grain, window // 8))
    held = _ByAmount(window)
    for k in rest[np.argsort(-lengths[rest], kind="stable")][::-1].tolist():
        held.put(int(lengths[k]), k)
    rooms = _ByAmount(window)
    for own, repeats in plan:
        for _ in range(int(repeats * share + 1e-6)):
            room, took = window, []
            for j, size in enumerate(own):
                # The longest of the bin; the last one may be longer, where bins were rounded up.
                most = size * grain if j + 1 < len(own) else room
                length = held.greatest(most)
                if length <= (size - 1) * grain:
                    break
                took.append(held.take(length))
                room -= length
            if len(took) < len(own):  # a bin is used up: the rest is packed greedily
                for k in took:
                    held.put(int(lengths[k]), k)
                break
            at = 0
            for k in took:
                sequence[k], offset[k] = made, at
                at += int(lengths[k])
            rooms.put(room, made)
            made += 1
    # What is left: longest first, each into the sequence with the least room that takes it.
    while (length := held.greatest(window)) > 0:
        k = held.take(length)
        room = rooms.least(length)
        if room:
            s = rooms.take(room)
        else:
            room, s = window, made
            made += 1
        sequence[k], offset[k] = s, window - room
        rooms.put(room - length, s)
    return sequence, offset


class _ByAmount:
    """Things by a positive amount of up to ``most``; the last one put in is taken first."""

    def __init__(self, most: int):
        self.held: list[list[int]] = [[] for _ in range(most + 1)]
        self.some = 0  # bit n: there are things of amount n

    def put(self, amount: int, thing: int) -> None:
        if amount:
            self.held[amount].append(thing)
            self.some |= 1 << amount

    def take(self, amount: int) -> int:
        thing = self.held[amount].pop()
        if not self.held[amount]:
            self.some ^= 1 << amount
        return thing

    def greatest(self, most: int) -> int:
        """The greatest amount of at most ``most``, or 0."""
        return max(0, (self.some & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def least(self, need: int) -> int:
        """The least amount of at least ``need``, or 0."""
        rest = self.some >> need
        return need + (rest & -rest).bit_length() - 1 if rest else 0


def pack(found: DataFrame, window: int = WINDOW, shard: int = SHARD, in_order: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset.  ``found`` has PIECES and salt, with ``in_order`` part and row too."""
    found = materialise(found, "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # up to ``window`` rows
    histogram = np.array([counts.get(k, 0) for k in range(window + 1)], float)
    plan, total = solve(histogram, window), max(1, sum(counts.values()))
    if in_order:
        dealt, by = _runs(found), ["place", "start"]
    else:
        shards = max(1, round(total / shard))
        dealt, by = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(shards))), ["doc_id", "start", "salt"]

    def pack_shard(key, held):
        held = held.sort_by([(name, "ascending") for name in by])
        lengths = held.column("length").to_numpy()
        sequence, offset = assign(lengths, plan, held.num_rows / total, window)
        if in_order:
            sequence = by_place(sequence, lengths, held.column("place").to_numpy())
        held = held.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return held.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 36))).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(pack_shard, f"{PIECES}, sequence_id long, offset long")


def _runs(found: DataFrame) -> DataFrame:
    """``found`` with place, its row's from 0 in the order of all rows, and shard, the run of that.  The driver holds one row for each file."""
    sizes = {r["part"]: r["n"] for r in found.groupBy("part").agg((F.max("row") + 1).alias("n")).collect()}
    rows = sum(sizes.values())
    run = max(1, -(-rows // max(1, round(rows / RUN))))
    starts = found.sparkSession.createDataFrame(list(file_starts(sizes).items()), "part string, before long")
    placed = found.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("row"))
    return placed.withColumn("shard", F.expr(f"place div {run}"))


def by_place(sequence: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sequences numbered anew from 0, by the mean place of their tokens."""
    tokens = np.bincount(sequence, lengths)
    mean = np.bincount(sequence, lengths * (places - places.min()).astype(float)) / tokens
    number = np.empty(len(tokens), np.int64)
    number[np.argsort(mean, kind="stable")] = np.arange(len(tokens))
    return number[sequence]


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, in_order: bool = False
) -> DataFrame:
    """Every row's ids in windows; see the module."""
    return pack(pieces(docs, doc_id, text, window, path, in_order), window, in_order=in_order)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
