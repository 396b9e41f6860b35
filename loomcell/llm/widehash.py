"""Near-duplicates of a similarity, by SimHashes of 256 bits and exact confirmation.

What SimHashes estimate is the cosine of two texts' shingle vectors, by the angle: at a
cosine of 0.8 20 % of all bits differ, 52 of 256, and 64 bits cannot tell such pairs from
chance.  The first hash of each shingle is therefore mixed into four, each of which gives 64 bits.
Fingerprints of up to ``BUDGET`` differing bits are candidates, which takes texts of a
similarity of 0.8 with a probability of 0.88 and of 0.85 with over 0.99.

Candidates are confirmed by their shingles: a link is a pair of texts whose sets of five-word
shingles have a cosine, common shingles over the root of the product of both sizes, of 0.8 or
more.  (For equally long texts that is a Jaccard similarity of two thirds or more.)

The binary trie self-join of ``simhash`` finds the candidates: in each of several tries,
with bits in another random order, the first bits make root paths on which no error is
spent, and pairs of nodes descend together below each.  A task returns pairs that make a spanning forest
of what it found, the nearest ones first, and all pairs of all tasks are confirmed; a link is missed only if
no path of confirmed pairs stands for it.  A pair of 52 differing bits
has ``MISS`` or less to share no root path, at any number of fingerprints; nearer
pairs have less.  Root paths grow with the logarithm of that number, so that subtries hold about
``SUBTRIE`` fingerprints, and the tries that are needed grow with its power of 0.3: what is
shuffled grows a little faster than the input, which is the price of this kind of search.
Subtries over ``CAP`` fingerprints are first compared within chunks, and then chunk
by chunk, but for chunks of one component of confirmed links; no fingerprint is left out.

Defined results: as in ``simhash``; a text without words has the fingerprint of zeros and links to
its equals only; a text of fewer than five words has one shingle, all its words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.llm import simhash
from loomcell.llm.common import discard, materialise, row_key, session, texts
from loomcell.llm.simhash import _across, majority, one_of_each, shingle_hashes, trie_join, whole_subtries

WORDS = 4
BITS = 64 * WORDS
#: The least cosine of two sets of shingles, and the differing bits of a candidate.
SIMILAR, BUDGET = 0.8, 60
#: The share of differing bits for which tries are laid out, and the share of such pairs that may share no root path.
DIFFERING, MISS = math.acos(SIMILAR) / math.pi, 0.01
#: Fingerprints of a subtrie, about, and at most in one task without being cut.
SUBTRIE, CAP = 1024, 8192
#: Errors in the bits of a trie, 64 of all, of a pair within ``BUDGET``: their mean below a root path and over two deviations.
TRIE_BUDGET = 20


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of a hash."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    h = shingle_hashes(text, shingle)
    return np.packbits(np.concatenate([majority(mixed(h, k)) for k in range(WORDS)])).tobytes()


def wide_fingerprints(docs: DataFrame, keep: list, text: str = "text", shingle: int = 5) -> DataFrame:
    """The ``keep`` columns, named k0, k1, ..., and fp (binary) of every row."""
    session(docs)
    own = docs.select(*[c.alias(f"k{k}") for k, c in enumerate(keep)], F.col(text).alias("text"))

    def compute(batches):
        for batch, column in texts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([wide_fingerprint(t, shingle) for t in column], pa.binary())], [*batch.schema.names[:-1], "fp"])

    return own.mapInArrow(compute, own.drop("text").schema.add("fp", "binary", False))


def layout(n: int) -> list[tuple[np.ndarray, int]]:
    """The bits of each trie, in order, and the length of its root paths, for n fingerprints."""
    root = max(8, (max(n, 2) - 1).bit_length() - SUBTRIE.bit_length() + 1)
    tries = math.ceil(math.log(MISS) / math.log(1 - (1 - DIFFERING) ** root))
    rng = np.random.default_rng(11)
    return [(rng.permutation(BITS)[:64], root) for _ in range(tries)]


def _words(column) -> np.ndarray:
    """A column of fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _keys(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return np.frombuffer(np.packbits(bits[:, order], axis=1).tobytes(), ">u8").astype(np.uint64)


def _binary(words: np.ndarray) -> pa.Array:
    return pa.array([w.tobytes() for w in words], pa.binary())


def _forest(words: np.ndarray, known: np.ndarray | None, order: np.ndarray, root: int, budget: int) -> pa.RecordBatch:
    """Pairs that make a spanning forest over the candidates of a trie that are not within one known component."""
    keys = _keys(words, order)
    by = np.argsort(keys, kind="stable")
    keys, words = keys[by], words[by]
    label = np.arange(len(keys))
    if known is not None:
        _, first, inverse = np.unique(known[by], return_index=True, return_inverse=True)
        label = first[inverse]
    pairs: list = []
    trie_join(keys, label, root, TRIE_BUDGET, whole=words, whole_budget=budget, pairs=pairs)
    i, j = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in range(2))
    return pa.RecordBatch.from_arrays([_binary(words[i]), _binary(words[j])], ["a", "b"])


def shingle_sets(texts_: DataFrame, shingle: int = 5) -> DataFrame:
    """(fp, shingles): the distinct hashes of each row (fp, text), as longs."""

    def work(batches):
        for batch, column in texts(batches):
            found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in column]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(ends, np.concatenate(found or [ends[:0]])).cast(pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts_.select("fp", "text").mapInArrow(work, "fp binary, shingles array<long>")


def confirmed(edges: DataFrame, texts_of, shingle: int = 5, similar: float = SIMILAR) -> DataFrame:
    """The candidate pairs (a, b) whose texts have the similarity; ``texts_of`` gives (fp, text) of the fingerprints of a table (fp)."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    nodes = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    sets = materialise(shingle_sets(texts_of(nodes), shingle), "shingles")
    both = edges.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("double")
    out = materialise(both.filter(common * common >= similar * similar * F.size("x") * F.size("y")).filter("size(x) > 0").select("a", "b"), "confirmed")
    discard(edges, sets)
    return out


def wide_links(fps: DataFrame, budget: int = BUDGET, confirm=lambda edges: edges) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as the pairs that the tries find, and that ``confirm`` leaves, do."""
    session(fps)
    fps = materialise(fps.select("fp").distinct(), "fingerprints")
    tries = layout(fps.count())

    def expand(batches):
        for batch in batches:
            words = _words(batch.column(0))
            for c, (order, root) in enumerate(tries):
                path = (_keys(words, order) >> np.uint64(64 - root)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), c, np.int32)), pa.array(path), batch.column(0)], ["choice", "path", "fp"])

    dealt = fps.mapInArrow(expand, "choice int, path long, fp binary")
    heavy = materialise(dealt.groupBy("choice", "path").agg(F.count("*").alias("n")).filter(F.col("n") > CAP), "heavy")
    light = dealt.join(heavy, ["choice", "path"], "left_anti").repartition("choice", "path")

    def join_all(batches):
        for k, own in whole_subtries(batches):
            yield _forest(_words(own), None, *tries[k], budget)

    found = confirm(light.sortWithinPartitions("choice", "path").mapInArrow(join_all, "a binary, b binary"))
    if heavy.isEmpty():
        return found
    found = materialise(found, "links")
    rows = materialise(dealt.join(heavy, ["choice", "path"]), "dense")
    chunk = F.pmod(F.xxhash64("fp", "choice"), F.ceil(F.col("n") / F.lit(simhash.CAP // 2)).cast("long"))
    chunked = rows.withColumn("chunk", chunk).select("choice", "chunk", "path", "fp")

    def join_chunk(key, held):
        return pa.Table.from_batches([_forest(_words(held.column("fp")), None, *tries[key[0].as_py()], budget)])

    within = confirm(chunked.groupBy("choice", "path", "chunk").applyInArrow(join_chunk, "a binary, b binary"))
    near = materialise(within.union(found), "near")

    def join_pair(key, held):
        known = held.column("component").to_numpy(zero_copy_only=False).astype(object)
        return pa.Table.from_batches([_forest(_words(held.column("fp")), known, *tries[key[0].as_py()], budget)])

    return near.union(confirm(_across(rows, near, join_pair, "a binary, b binary")))


def one_of_each_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, budget: int = BUDGET, similar: float = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates; see ``simhash.one_of_each``."""
    keyed = docs.select(row_key(docs).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def links_of(rows: DataFrame, budget: int) -> DataFrame:
        def texts_of(nodes: DataFrame) -> DataFrame:
            """One text for each fingerprint: that of the smallest row digest."""
            one = rows.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("key", "doc_id")).alias("row")).select("fp", "row.key", F.col("row.doc_id").alias("own_id"))
            return keyed.join(one, "key").filter(F.col("id").eqNullSafe(F.col("own_id"))).select("fp", "text").dropDuplicates(["fp"])

        return wide_links(rows, budget, lambda edges: confirmed(edges, texts_of, shingle, similar))

    return one_of_each(docs, doc_id, text, shingle, budget, wide_fingerprints, links_of)
