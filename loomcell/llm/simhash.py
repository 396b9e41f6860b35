"""Near-duplicates by 64-bit SimHash and a binary trie self-join.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42)
of a text's word shingles.  Fingerprints that differ in at most ``budget`` bits
link; components of links are near-duplicate groups.

The join: with ``blocks`` = m blocks of bits, at least m - budget of them are equal
in any linked pair.  For each choice of so many blocks, the bits are permuted so
that the chosen blocks come first: the root path of a binary trie on which no
error is spent.  Subtries below the root paths are dealt out to tasks, and in each
task pairs of nodes descend together, adding up differing bits; a pair is pruned
when its sum exceeds the budget, or when all fingerprints under both nodes are
already known to be connected.  A task returns a spanning forest of the links it
found, never the pairs of a group.  m grows with the number of distinct
fingerprints, so that subtries stay small; it does not change the result.

Subtries over ``cap`` fingerprints (a hot group of near copies) are first thinned:
fingerprints at distance 1 are linked exactly by grouping on each masked bit, and
then the subtrie is cut into chunks, of which pairs within one known component are
left out.  Everything else is compared, so no link is lost.

Defined results: a null text and a text without words have fingerprint 0 and link
like any other; a text with fewer words than a shingle has one shingle, the whole
sequence; rows with equal texts, or repeated rows, have equal fingerprints and so
one component; a null doc_id links like others, but names a component only if no
id in it is known; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.llm.common import materialise, row_key, session, table, texts
from loomcell.llm.components import connected_components

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints in one subtrie or chunk, at most.
CAP = 1024
#: Fingerprints of light subtries that a task holds at once, about.
HELD = 1 << 17


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text, repeats included; one of the whole sequence if it has fewer words, none without words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, stops[shingle - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Whether each of the 64 bits, highest first, is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * counts > len(hashes)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a whole text, as an unsigned integer."""
    return int.from_bytes(np.packbits(majority(shingle_hashes(text, shingle))).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list, text: str = "text", shingle: int = 4) -> DataFrame:
    """The ``keep`` columns, named k0, k1, ..., and fp (the fingerprint's bits as a signed long) of every row."""
    session(docs)
    own = docs.select(*[c.alias(f"k{k}") for k, c in enumerate(keep)], F.col(text).alias("text"))

    def compute(batches):
        for batch, column in texts(batches):
            fp = np.array([fingerprint(t, shingle) for t in column], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], "fp"])

    return own.mapInArrow(compute, own.drop("text").schema.add("fp", "long", False))


# --- the trie self-join in one task -------------------------------------------------


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; label holds each element's smallest known member."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := label[label], label):
            label[:] = above


def _forest_pairs(label: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), nearest first, those that join components that were still apart."""
    open_ = label[i] != label[j]
    i, j = i[open_], j[open_]
    by = np.argsort(far[open_], kind="stable")
    i, j = i[by], j[by]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    taken = []
    for k, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            taken.append(k)
    return i[taken], j[taken]


def _spread(lo1, hi1, lo2, hi2, most: int):
    """Index pairs under each pair of nodes, at most ``most`` at once."""
    n2 = hi2 - lo2
    sizes = (hi1 - lo1) * n2
    ends = np.cumsum(sizes)
    for base in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(base, min(base + most, int(ends[-1])))
        at = np.searchsorted(ends, k, "right")
        k -= ends[at] - sizes[at]
        yield lo1[at] + k // n2[at], lo2[at] + k % n2[at]


def trie_join(
    fps: np.ndarray, label: np.ndarray, root: int, budget: int, leaf: int = 16, most: int = 1 << 18, whole: np.ndarray | None = None, whole_budget: int = 0,
    pairs: list | None = None,
) -> None:
    """Unite in ``label`` all pairs within ``budget`` bits that agree in their first ``root`` bits.

    ``fps`` is sorted (unsigned); ``label`` starts as the components already known,
    as indexes of smallest members.  With ``whole``, the rows of words of wider
    fingerprints of which ``fps`` are a part, a pair must be within ``whole_budget``
    bits there too, and ``pairs`` gets the pairs (arrays i and j) that made a spanning
    forest of the links, the nearest ones of each batch first.
    """
    n = len(fps)
    if n < 2:
        return
    for limit, far in dict.fromkeys(((min(1, budget), whole_budget // 4), (budget, whole_budget))):  # near ones first: they make large nodes pure
        heads = np.flatnonzero(np.r_[True, (fps[1:] >> np.uint64(64 - root)) != (fps[:-1] >> np.uint64(64 - root))]) if root else np.array([0])
        tails = np.r_[heads[1:], n]
        stack = [(heads, tails, heads, tails, np.zeros(len(heads), np.int64), root)]
        while stack:
            lo1, hi1, lo2, hi2, err, depth = stack.pop()
            changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            pure = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (label[lo1] == label[lo2])
            go = ~pure & ((lo1 != lo2) | (hi1 - lo1 > 1))
            lo1, hi1, lo2, hi2, err = (x[go] for x in (lo1, hi1, lo2, hi2, err))
            if not len(lo1):
                continue
            if len(lo1) > most:  # bounded memory: one half at a time
                half = len(lo1) // 2
                for part in (slice(half, None), slice(None, half)):
                    stack.append((lo1[part], hi1[part], lo2[part], hi2[part], err[part], depth))
                continue
            small = ((hi1 - lo1) * (hi2 - lo2) <= leaf * leaf) | (depth >= 64)
            for i, j in _spread(lo1[small], hi1[small], lo2[small], hi2[small], most):
                near = (np.bitwise_count(fps[i] ^ fps[j]) <= limit) & (label[i] != label[j])
                i, j = i[near], j[near]
                if whole is not None:
                    apart = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1, dtype=np.int64)
                    near = apart <= far
                    i, j = i[near], j[near]
                    if pairs is not None and len(i):
                        i, j = _forest_pairs(label, i, j, apart[near])
                        pairs.append((i, j))
                _unite(label, i, j)
            lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
            if not len(lo1):
                continue
            bit = np.uint64(1) << np.uint64(63 - depth)

            def middle(lo, hi, bit=bit):
                """Where the children of each node part."""
                cut = np.searchsorted(fps, (fps[lo] & ~(bit - np.uint64(1)) & ~bit) | bit)
                return np.clip(cut, lo, hi)

            m1, m2 = middle(lo1, hi1), middle(lo2, hi2)
            same = (lo1 == lo2) & (hi1 == hi2)
            parts = [(lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1), tuple(x[~same] for x in (m1, hi1, lo2, m2, err + 1))]
            nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
            go = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= limit)
            stack.append((*(x[go] for x in nxt), depth + 1))


# --- dealing subtries out ------------------------------------------------------------


def _choices(blocks: int, budget: int) -> list[tuple[np.ndarray, int]]:
    """For each choice of blocks without errors: the bits in trie order, and how many make the root path."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - budget):
        first = [b for k in chosen for b in range(edges[k], edges[k + 1])]
        out.append((np.array(first + [b for b in range(64) if b not in set(first)]), len(first)))
    return out


def _permuted(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bits (0 is the highest) rearranged; runs of neighbours move together."""
    out = np.zeros_like(fps)
    k = 0
    while k < 64:
        run = 1
        while k + run < 64 and order[k + run] == order[k] + run:
            run += 1
        mask = np.uint64((1 << run) - 1)
        out |= ((fps >> np.uint64(64 - int(order[k]) - run)) & mask) << np.uint64(64 - k - run)
        k += run
    return out


def _blocks_for(n: int, budget: int) -> int:
    """Fewest blocks whose root paths leave subtries of a quarter of CAP at random."""
    for blocks in range(budget + 1, budget + 5):
        bits = min(p for _, p in _choices(blocks, budget))
        if n >> bits <= CAP // 4:
            break
    return blocks


def _forest(fps: np.ndarray, known: np.ndarray | None, order: np.ndarray, root: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (signed) of a spanning forest over the links among fps that are not within one known component."""
    moved = _permuted(fps, order)
    by = np.argsort(moved)
    moved, fps = moved[by], fps[by]
    label = np.arange(len(fps))
    if known is not None:
        _, first, inverse = np.unique(known[by], return_index=True, return_inverse=True)
        label = first[inverse]
    before = label.copy()
    trie_join(moved, label, root, budget)
    new = np.flatnonzero(label != before)
    return fps[new].view(np.int64), fps[label[new]].view(np.int64)


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def whole_subtries(batches, most: int = HELD):
    """(choice, fingerprints) of whole subtries of one choice, about ``most`` rows at once, from batches in the order of (choice, path, ...)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(last: bool):
        nonlocal held, rows
        own = pa.Table.from_batches(held).combine_chunks()
        choice, path = own.column(0).to_numpy(), own.column(1).to_numpy()
        # A batch may end within a subtrie: its rows wait for the next one.
        stop = len(own) if last else int(np.flatnonzero((choice == choice[-1]) & (path == path[-1]))[0])
        held, rows = own.slice(stop).to_batches(), len(own) - stop
        cuts = [0, *(np.flatnonzero(choice[1:stop] != choice[: stop - 1]) + 1).tolist(), stop] if stop else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(choice[a]), own.column(2).slice(a, b - a).combine_chunks()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from ready(False)
    if rows:
        yield from ready(True)


def links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all links of at most ``budget`` bits do."""
    session(fps)
    fps = materialise(fps.select("fp").distinct(), "fingerprints")
    choices = _choices(_blocks_for(fps.count(), budget), budget)
    roots = [root for _, root in choices]

    def expand(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for c, (order, root) in enumerate(choices):
                path = (_permuted(own, order) >> np.uint64(64 - root)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(path), batch.column(0)], ["choice", "path", "fp"])

    dealt = fps.mapInArrow(expand, "choice int, path long, fp long")
    sizes = materialise(dealt.groupBy("choice", "path").agg(F.count("*").alias("n")).filter("n > 1"), "subtries")
    heavy = sizes.filter(F.col("n") > CAP)
    # Dealt anew: a broadcast of the sizes would leave each fingerprint in the partition of its file.
    light = dealt.join(sizes.filter(F.col("n") <= CAP).select("choice", "path"), ["choice", "path"]).repartition("choice", "path")

    def join_light(batches):
        for k, own in whole_subtries(batches):
            order, root = choices[k]
            yield _edges(*_forest(own.to_numpy().view(np.uint64), None, order, root, budget))

    found = light.select("choice", "path", "fp").sortWithinPartitions("choice", "path").mapInArrow(join_light, "a long, b long")
    if heavy.isEmpty():
        return found
    return materialise(found, "links").union(_dense_links(dealt, heavy, choices, budget))


def _dense_links(dealt: DataFrame, heavy: DataFrame, choices: list, budget: int) -> DataFrame:
    """Links within subtries of over CAP fingerprints."""
    rows = materialise(dealt.join(heavy, ["choice", "path"]), "dense")
    hot = rows.select("fp").distinct()
    masked = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(
        "fp", "bit", F.expr("fp & ~shiftleft(1L, bit)").alias("rest")
    )
    near = masked.groupBy("bit", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("a", "b")
    near = materialise(near, "near")

    def join_pair(key, held):
        order, root = choices[key[0].as_py()]
        fps = held.column("fp").to_numpy().view(np.uint64)
        return pa.Table.from_batches([_edges(*_forest(fps, held.column("component").to_numpy(), order, root, budget))])

    return near.union(_across(rows, near, join_pair, "a long, b long"))


def _across(rows: DataFrame, near: DataFrame, join_pair, schema: str) -> DataFrame:
    """What ``join_pair`` finds in each pair of chunks of a subtrie; ``near`` are links already known, chunks of one component are not compared."""
    known = connected_components(near)
    rows = materialise(
        rows.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "dense"
    )
    # In each subtrie, components of over CAP fingerprints have chunks of their own ("pure"); the rest share chunks (tag null).
    size = rows.groupBy("choice", "path", "component").agg(F.count("*").alias("c")).filter(F.col("c") > CAP)
    rows = rows.join(size.select("choice", "path", "component", F.lit(True).alias("large")), ["choice", "path", "component"], "left")
    rows = rows.withColumn("tag", F.when(F.col("large"), F.col("component")))
    tags = rows.groupBy("choice", "path", "tag").agg(F.count("*").alias("c"))
    tags = materialise(tags.withColumn("chunks", F.ceil(F.col("c") / F.lit(CAP // 2)).cast("long")).drop("c"), "chunks")
    rows = rows.alias("r").join(tags.alias("t"), F.expr("r.choice = t.choice and r.path = t.path and r.tag <=> t.tag")).select("r.*", "t.chunks")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks"))
    # Each pair of chunks but those of one component: one or both are mixed, or the tags differ.
    chunk = tags.select("choice", "path", "tag", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    chunk = chunk.withColumn("id", F.xxhash64("tag", "chunk"))
    pairs = chunk.alias("x").join(
        chunk.alias("y"),
        F.expr("x.choice = y.choice and x.path = y.path and x.id <= y.id and (x.tag is null or y.tag is null or x.tag <> y.tag)"),
    )
    pairs = pairs.select("x.choice", "x.path", F.xxhash64("x.choice", "x.path", "x.id", "y.id").alias("pair"), F.explode(F.array_distinct(F.array("x.id", "y.id"))).alias("id"))
    sent = rows.withColumn("id", F.xxhash64("tag", "chunk")).join(materialise(pairs, "pairs"), ["choice", "path", "id"]).select("choice", "pair", "fp", "component")
    return sent.groupBy("choice", "pair").applyInArrow(join_pair, schema)


def classes(rows: DataFrame, budget: int = 4, links_of=links) -> DataFrame:
    """(fp, component): every distinct fingerprint of ``rows`` with the smallest one reachable (unsigned order is not implied)."""
    found = connected_components(links_of(rows, budget))
    return rows.select("fp").distinct().join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id of its group."""
    rows = materialise(fingerprints(docs, [F.col(doc_id)], text, shingle).withColumnRenamed("k0", "doc_id"), "simhash")
    known = classes(rows, budget)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(known, "fp")
    least = materialise(least, "classes")
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return rows.join(materialise(named, "named"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4, fingerprints_of=fingerprints, links_of=links
) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id (null last), then the smallest row digest.

    Among fully equal rows any one stays; all columns are returned as they came.
    """
    keyed = docs.withColumn("_lc_key", row_key(docs))
    rows = fingerprints_of(keyed, [F.col(doc_id), F.col("_lc_key")], text, shingle)
    rows = materialise(rows.select(F.col("k0").alias("doc_id"), F.col("k1").alias("key"), "fp"), "simhash")
    each = rows.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "n")
    least = each.groupBy("fp").agg(F.min(best).alias("best")).join(classes(rows, budget, links_of), "fp")
    kept = materialise(least.groupBy("component").agg(F.min("best").alias("best")).select("best.*"), "kept")
    kept = kept.select(F.col("doc_id").alias("_lc_id"), F.col("key").alias("_lc_kept"), "n")

    def rows_of(part: DataFrame) -> DataFrame:
        return keyed.join(part.drop("n"), (F.col("_lc_key") == F.col("_lc_kept")) & F.col(doc_id).eqNullSafe(F.col("_lc_id")), "left_semi")

    out = rows_of(kept.filter("n = 1"))
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        out = out.union(rows_of(repeated).dropDuplicates(["_lc_key", doc_id]))
    return out.drop("_lc_key")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
