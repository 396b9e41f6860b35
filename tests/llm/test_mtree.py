import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcell.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string"


def plain(rows, every=20, k=20):
    own = {}
    for vid, e, *_ in rows:
        if vid is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(64 * float(np.float32(x))) for x in e]
        own[vid] = min(own.get(vid, v), v)
    out = set()
    for q, a in own.items():
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in own.items() if c != q and len(b) == len(a))
            out |= {(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])}
    return out


@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([1, 3, 16]))
@settings(max_examples=40, deadline=None)
def test_tree_search_equals_brute_force(seed, n, dim):
    rng = np.random.default_rng(seed)
    v = rng.integers(-5, 6, (n, dim)) * rng.integers(1, 20)
    ids = np.sort(rng.choice(10**4, n, replace=False))
    score, ident = mtree.MTree(ids, v).search(ids[:9], v[:9], np.full(min(9, n), -np.inf), 5)
    for k in range(min(9, n)):
        want = sorted((-int(v[k] @ v[j]), int(ids[j])) for j in range(n) if j != k)[:5]
        got = [(-int(s), int(i)) for s, i in zip(score[k], ident[k], strict=True) if np.isfinite(s)]
        assert got == want


def test_search_skips_pages_of_clustered_vectors():
    rng = np.random.default_rng(1)
    v = (rng.normal(0, 300, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), v)
    seen = []
    merge = tree._merge
    tree._merge = lambda who, qid, found, *a: (seen.append(found.size), merge(who, qid, found, *a))
    tree.search(np.arange(10), v[:10], np.full(10, -np.inf))
    assert sum(seen) < 10 * 4000 / 3


@pytest.mark.parametrize("group", [1 << 18, 256])
def test_whole_search(spark, monkeypatch, group):
    monkeypatch.setattr(mtree, "GROUP", group)
    monkeypatch.setattr(mtree, "BLOCK", 8)
    rng = random.Random(group)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k, "", "") for k in range(300)]
    rows += [(k, [1.0] * 8, 0, None, None) for k in range(300, 420)]  # many copies: ties by id
    rows += [(1000, [float("nan")] * 8, 0, "", ""), (1020, None, 0, "", ""), (1040, [1.0, None] + [0.0] * 6, 0, "", ""), (None, [1.0] * 8, 0, "", ""), (2000, [1.0, 2.0], 0, "", ""), (2001, [0.5, 2.0], 0, "", ""), (2020, [], 0, "", ""), (40, rows[40][1], 1, "", "")]
    got = mtree.top_k(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)


def test_empty(spark):
    assert mtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
