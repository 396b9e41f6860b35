"""Exact top-k by inner product in a forest of M-trees.

Vectors become integers, floor(64 x).  Every vector goes to its nearest pivot (pivots
are a bounded sample); the vectors of a pivot are cut into groups of a bounded size,
and each group becomes an M-tree of paged nodes with a routing vector, a covering
radius and each child's distance to its parent's routing vector.

For a query q, a routing vector c and any x within radius r of c, <q, x> <= <q, c> +
|q| r; and <q, c> <= <q, p> + |q| d(p, c) for the parent p, so stored distances rule
out a child without touching its vector.  A block of queries walks a tree together,
the node of the highest bound first; a query takes no part in a node once its bound
there is below its k-th score.  Every query first searches the tree that holds it,
and the k-th score found there is its threshold in all others.  Results are exact.

Queries are a stated set (here ids divisible by 20) and meet the trees in blocks: a
task holds a few trees, and every block is sent to each task, pruned there.

Defined results: null vectors and those with null or non-finite components take no
part, nor do null ids; vectors of another length are not compared; a repeated id counts
once, with its smallest vector; fewer candidates than k give fewer rows; an empty
table gives none.  A component of over 2^24 in size after scaling is an error: scores would not be exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loomcell.llm.common import materialise, session, table

K = 20
PIVOTS = 64  # a bounded sample: vectors whose ids hash lowest
GROUP = 1 << 18  # components of all vectors in a tree, on average
TREES = 4  # trees of a task, on average
PAGE = 64  # entries of a node
BLOCK = 1024  # queries of a block
SLACK = 1e-6


class MTree:
    """A paged metric tree over integer vectors, stored as flat arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.order = np.arange(len(ids))
        self.routing: list[np.ndarray] = []  # of each node
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []  # of the order, for leaves
        self.own: list[np.ndarray] = []  # distances of a leaf's entries to its routing vector
        if len(ids):
            self._build(0, len(ids), None)

    def _build(self, low: int, high: int, parent: np.ndarray | None) -> int:
        at = self.order[low:high]
        own = self.vectors[at]
        centre = np.floor(own.mean(axis=0))
        node = len(self.routing)
        far = np.linalg.norm(own - centre, axis=1)
        self.routing.append(centre)
        self.radius.append(float(far.max()))
        self.to_parent.append(0.0 if parent is None else float(np.linalg.norm(centre - parent)))
        self.children.append([])
        self.span.append((low, high))
        if high - low <= PAGE or far.max() == 0:
            by = np.argsort(far, kind="stable")
            self.order[low:high] = at[by]
            self.own.append(far[by])
            return node
        self.own.append(np.empty(0))
        for a, b in self._split(low, high):
            self.children[node].append(self._build(a, b, centre))
        return node

    def _split(self, low: int, high: int) -> list[tuple[int, int]]:
        """Spans of up to 8 children: the widest one is halved between two far vectors, again and again."""
        spans = [(low, high)]
        while len(spans) < 8:
            spans.sort(key=lambda s: s[0] - s[1])
            a, b = spans[0]
            if b - a <= PAGE:
                break
            at = self.order[a:b]
            own = self.vectors[at]
            one = own[np.argmax(np.linalg.norm(own - own[0], axis=1))]
            two = own[np.argmax(np.linalg.norm(own - one, axis=1))]
            side = np.linalg.norm(own - one, axis=1) - np.linalg.norm(own - two, axis=1)
            by = np.argsort(side, kind="stable")
            self.order[a:b] = at[by]
            cut = a + min(max(int((side < 0).sum()), 1), b - a - 1)
            spans[0:1] = [(a, cut), (cut, b)]
        return spans

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (query x k, -inf and the largest id where there is none), at least ``floor``, ties to smaller ids."""
        q = q.astype(np.float64)
        n = len(qid)
        score, ident = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        least = floor.astype(np.float64).copy()
        if not n or not len(self.ids):
            return score, ident
        norm = np.linalg.norm(q, axis=1)
        dot = q @ self.routing[0]
        bound = dot + norm * self.radius[0]
        heap = [(-float((bound - least).max()), 0, np.arange(n), dot)]
        while heap:
            _, node, who, dot = heapq.heappop(heap)
            on = dot + norm[who] * self.radius[node] + SLACK * (1 + np.abs(dot)) >= least[who]
            who, dot = who[on], dot[on]
            if not len(who):
                continue
            for child in self.children[node]:
                # The stored distance to the parent rules out queries before any product.
                upper = dot + norm[who] * (self.to_parent[child] + self.radius[child])
                open_ = who[upper + SLACK * (1 + np.abs(upper)) >= least[who]]
                if len(open_):
                    own = q[open_] @ self.routing[child]
                    upper = own + norm[open_] * self.radius[child]
                    heapq.heappush(heap, (-float((upper - least[open_]).max()), child, open_, own))
            if not self.children[node]:
                low, high = self.span[node]
                reach = dot[:, None] + norm[who][:, None] * self.own[node][None, :]
                needed = (reach + SLACK * (1 + np.abs(reach)) >= least[who][:, None]).any(axis=0)
                at = self.order[low:high][needed]
                if len(at):
                    self._merge(who, qid, q[who] @ self.vectors[at].T, self.ids[at], score, ident, least, k)
        return score, ident

    @staticmethod
    def _merge(who, qid, found, ids, score, ident, least, k) -> None:
        found = np.where(ids[None, :] == qid[who][:, None], -np.inf, found)
        found[found < least[who][:, None]] = -np.inf
        some = np.isfinite(found).any(axis=1)
        who, found = who[some], found[some]
        if not len(who):
            return
        s = np.concatenate([score[who], found], axis=1)
        i = np.concatenate([ident[who], np.where(np.isfinite(found), ids[None, :], np.iinfo(np.int64).max)], axis=1)
        by = np.lexsort((i, -s), axis=1)[:, :k]
        score[who], ident[who] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        least[who] = np.maximum(least[who], score[who, -1])


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part, one for each id."""
    v = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    valid = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(valid)
    most = F.lit(1 << 24)
    v = F.transform(v, lambda x: F.when(F.abs(x) > most, F.raise_error(F.lit("a component is over 2^24 after scaling")).cast("long")).otherwise(x))
    return own.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


TREE = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("queries", T.BinaryType()),
        T.StructField("floors", T.BinaryType()),
    ]
)


def forest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """One row for each tree: its vectors, its queries (ids divisible by ``every``) and their k-th scores within the tree."""
    dims = vectors.withColumn("dim", F.size("v"))
    pivots: dict[int, np.ndarray] = {}
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))
    for r in dims.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).orderBy("dim", "rank").toLocalIterator():
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: np.array(p, np.float64).reshape(len(p), d) for d, p in pivots.items()}

    def route(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            nearest = np.zeros(len(dim), np.int32)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                if d:
                    own, p = _matrix(batch.column(1).take(pa.array(at))).astype(np.float64), pivots[int(d)]
                    nearest[at] = np.argmin((p * p).sum(axis=1)[None, :] - 2 * own @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], ["vec_id", "v", "dim", "pivot"])

    routed = materialise(dims.mapInArrow(route, "vec_id long, v array<long>, dim int, pivot int"), "routed")
    sizes = routed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(1)) / F.lit(GROUP)).alias("groups"))
    grouped = routed.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "groups"))

    def build(key, held):
        held = held.sort_by("vec_id")
        dim = key[0].as_py()
        ids = held.column("vec_id").to_numpy()
        own = _matrix(held.column("v")) if dim else np.zeros((len(ids), 0), np.int64)
        asked = ids % every == 0
        score, _ = MTree(ids, own).search(ids[asked], own[asked], np.full(asked.sum(), -np.inf), k)
        tree = dim << 40 | key[1].as_py() << 24 | key[2].as_py()
        blobs = [ids.tobytes(), own.astype(np.int32).tobytes(), np.flatnonzero(asked).tobytes(), score[:, -1].tobytes()]
        return pa.table([[tree], [dim], *([b] for b in blobs)], schema=pa.schema([("tree", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "queries", "floors"))]))

    return materialise(grouped.groupBy("dim", "pivot", "part").applyInArrow(build, TREE), "forest")


def _load(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.int32).reshape(len(ids), row["dim"])


def top_k(rows: DataFrame, every: int = 20, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each vector whose id is divisible by ``every``."""
    session(rows)
    trees = forest(materialise(integer_vectors(rows, vec_id, embedding, scale), "vectors"), every, k)

    def blocks(batches):
        """Queries of several trees together, with their thresholds."""
        held: dict[int, list] = {}

        def out(dim):
            parts = held.pop(dim)
            ids, vectors, floors = (np.concatenate([p[j] for p in parts]) for j in range(3))
            for a in range(0, len(ids), BLOCK):
                blobs = (x[a : a + BLOCK] for x in (ids, vectors, floors))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["dim", "ids", "vectors", "floors"])

        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _load(row)
                at = np.frombuffer(row["queries"], np.int64)
                if len(at):
                    own = held.setdefault(row["dim"], [])
                    own.append((ids[at], vectors[at], np.frombuffer(row["floors"], np.float64)))
                    if sum(len(p[0]) for p in own) >= BLOCK:
                        yield from out(row["dim"])
        for dim in list(held):
            yield from out(dim)

    asked = trees.mapInArrow(blocks, "dim int, ids binary, vectors binary, floors binary")
    # A few trees to each task, and every block of queries to all of them.
    parts = max(1, -(-trees.count() // TREES))
    part = F.pmod(F.xxhash64("tree"), F.lit(parts)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    columns = ["dim", "ids", "vectors", "floors"]
    met = trees.select(part.alias("part"), F.lit(0).alias("kind"), *columns).union(materialise(asked, "queries").select(each.alias("part"), F.lit(1).alias("kind"), *columns))
    met = met.repartitionById(parts, "part").sortWithinPartitions("kind")

    def search(batches):
        held: dict[int, list[MTree]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _load(row)
                if row["kind"] == 0:
                    held.setdefault(row["dim"], []).append(MTree(ids, vectors))
                    continue
                for tree in held.get(row["dim"], ()):
                    score, ident = tree.search(ids, vectors, np.frombuffer(row["floors"], np.float64), k)
                    who, rank = np.nonzero(np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(ident[who, rank]), pa.array(score[who, rank].astype(np.int64))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, min(v) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
