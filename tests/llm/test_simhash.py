import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcell.llm import simhash
from loomcell.llm.components import connected_components

SCHEMA = "doc_id long, text string, component string"


def plain_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@given(st.text(alphabet="aB é\n\t\x0b\x1f ,", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(rng, groups, each, flips=3):
    out = set()
    for _ in range(groups):
        seed = rng.getrandbits(64)
        for _ in range(each):
            out.add(seed ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(flips + 1))}))
    return sorted(out)


@pytest.mark.parametrize("groups,each,root", [(40, 5, 0), (1, 150, 0), (200, 1, 0), (30, 8, 13)])
def test_trie_join_equals_all_pairs(groups, each, root):
    fps = clustered(random.Random(groups), groups, each)
    label = np.arange(len(fps))
    simhash.trie_join(np.array(fps, np.uint64), label, root, 4, leaf=2, most=64)
    want = plain_components([f for f in fps]) if not root else None
    if root:
        want = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if fps[i] >> (64 - root) == fps[j] >> (64 - root) and bin(fps[i] ^ fps[j]).count("1") <= 4:
                    a, b = want[i], want[j]
                    want = [min(a, b) if x in (a, b) else x for x in want]
    assert label.tolist() == want


def component_map(spark, fps):
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {r.fp: r.component for r in simhash.classes(rows).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(got[int(np.uint64(f).view(np.int64))], set()).add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("cap", [1024, 16])
def test_classes_equal_all_pairs_also_when_subtries_are_cut(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    fps = sorted({*clustered(random.Random(5), 20, 4), *clustered(random.Random(6), 2, 120, 5)})
    label = plain_components(fps)
    want = {}
    for f, x in zip(fps, label, strict=True):
        want.setdefault(x, set()).add(f)
    assert component_map(spark, fps) == {frozenset(g) for g in want.values()}


def test_classes_equal_all_pairs_when_fingerprints_lie_in_several_files(spark):
    fps = sorted({*clustered(random.Random(8), 400, 1), *clustered(random.Random(9), 10, 4)})  # few subtries, so that their sizes are what is broadcast
    want = {}
    for f, x in zip(fps, plain_components(fps), strict=True):
        want.setdefault(x, set()).add(f)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = simhash.materialise(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").distinct(), "files")
        assert rows.rdd.getNumPartitions() > 1
        assert component_map(spark, fps) == {frozenset(g) for g in want.values()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_planted_pairs_across_many_partitions(spark, threshold):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20_000)]
    pairs = [(f, f ^ sum(1 << b for b in rng.sample(range(64), 1 + k % 4))) for k, f in enumerate(base[:400])]
    signed = np.array([*base, *(b for _, b in pairs)], np.uint64).view(np.int64)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = spark.createDataFrame([(int(f),) for f in signed], "fp long").repartition(6)
        got = {r.fp: r.component for r in simhash.classes(rows).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    component = [got[int(f)] for f in signed]
    assert component[:400] == component[20_000:] and len(set(component)) == 20_000


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=60), st.integers(1, 7), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_subtries_are_never_cut(keys, size, most):
    keys = sorted(keys)
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int64()), pa.array(range(len(keys)), pa.int64())], ["choice", "path", "fp"])
    seen, place = [], {}
    for no, (choice, own) in enumerate(simhash.whole_subtries((batch.slice(k, size) for k in range(0, len(keys), size)), most)):
        for fp in own.to_pylist():
            assert keys[fp][0] == choice and place.setdefault(keys[fp], no) == no
            seen.append(fp)
    assert seen == list(range(len(keys)))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    body = " ".join(f"w{k}" for k in range(300))
    rows = [(3, body, "x"), (1, body.upper(), "x"), (2, body + " tail", None), (9, None, "y"), (8, "", "y"), (8, "", "y"), (7, " \t\n", "z"), (None, body, "q"), (20, "other words entirely here", ""), (21, "word " * 50000, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert {by[k][1] for k in (1, 2, 3, None)} == {1}
    assert by[9] == by[8] == by[7] == ("0" * 16, 7)
    assert by[20][1] == 20 and by[21][1] == 21
    assert by[3][0] == f"{plain_fingerprint(body):016x}"
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_one_row_of_each_group(spark):
    body = " ".join(f"w{k}" for k in range(300))
    rows = [(3, body, "x"), (1, body, "x"), (1, body, "x"), (9, None, "y"), (None, None, "y"), (None, "alone with no id at all", None), (None, "alone with no id at all", None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "component"]
    assert sorted((r.doc_id is None, r.doc_id, r.text == body) for r in got.collect() if r.doc_id) == [(False, 1, True), (False, 9, False)]
    assert got.count() == 3
    assert simhash.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got.filter(F.col("doc_id").isNull()).count() == 1
