import math
import random

import numpy as np
import pytest

from loomcell.llm import simhash, widehash

SCHEMA = "doc_id long, text string, fp string"


def prose(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, words, share):
    return [rng.choice("xyz") + w if rng.random() < share else w for w in words]


def test_fingerprint_is_the_majority_of_four_mixed_hashes():
    words = prose(random.Random(1), 40)
    h = simhash.shingle_hashes(" ".join(words), 5)
    bits = []
    for k in range(4):
        own = [int(x) for x in widehash.mixed(h, k)]
        bits += [2 * sum(x >> (63 - b) & 1 for x in own) > len(own) for b in range(64)]
    assert widehash.wide_fingerprint(" ".join(words)) == int("".join(str(int(b)) for b in bits), 2).to_bytes(32, "big")
    assert widehash.wide_fingerprint(None) == widehash.wide_fingerprint(" \n") == b"\0" * 32


def cosine(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in (a, b))
    return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0


def plain_groups(texts, similar=0.8):
    """Components of all pairs of equal texts and of the similarity: each text's least member."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (texts[i] == texts[j] or cosine(texts[i], texts[j]) >= similar):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("cap", [None, 16])
def test_kept_rows_equal_all_pairs_by_their_shingles(spark, monkeypatch, cap):
    """Groups of texts around the least similarity; the candidates' chance of 0.88 at it allows one miss in a hundred."""
    if cap:
        monkeypatch.setattr(simhash, "CAP", cap)
        monkeypatch.setattr(widehash, "CAP", cap)
    rng = random.Random(3)
    texts = []
    for g in range(40):
        base = prose(rng, rng.randrange(120, 400))
        for k in range(60 if g == 0 else 3):  # one hot group
            texts.append(edited(rng, base, 0.01 if g == 0 else 0.06 if k == 2 else 0.015))
    rows = [(k, " ".join(t), None) for k, t in enumerate(texts)]
    kept = {r.doc_id for r in widehash.one_of_each_similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    label = plain_groups(texts)
    want = {k for k in range(len(texts)) if label[k] == k}
    assert want <= kept and len(kept - want) <= 1 and 40 <= len(want) < len(texts) - 60


def test_pairs_below_the_similarity_are_not_confirmed(spark):
    rng = random.Random(4)
    base = prose(rng, 300)
    near, far = edited(rng, base, 0.02), edited(rng, base, 0.06)
    assert cosine(base, near) > 0.85 and 0.5 < cosine(base, far) < 0.79
    fps = {name: bytearray(widehash.wide_fingerprint(" ".join(t))) for name, t in (("base", base), ("near", near), ("far", far))}
    texts_ = spark.createDataFrame([(fps["base"], " ".join(base)), (fps["near"], " ".join(near)), (fps["far"], " ".join(far))], "fp binary, text string")
    edges = spark.createDataFrame([(fps["base"], fps["near"]), (fps["near"], fps["base"]), (fps["far"], fps["base"])], "a binary, b binary")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in widehash.confirmed(edges, lambda nodes: texts_.join(nodes, "fp", "left_semi")).collect()}
    assert got == {frozenset((bytes(fps["base"]), bytes(fps["near"])))}


def test_a_task_s_pairs_are_a_spanning_forest_of_its_links():
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (12, 4)).astype(np.uint64)
    words = np.concatenate([seeds ^ (rng.random((12, 4, 64)) < 0.04).dot(1 << np.arange(64, dtype=np.uint64)).astype(np.uint64) for _ in range(20)])
    batch = widehash._forest(words, None, np.arange(64), 0, 40)
    place = {w.tobytes(): k for k, w in enumerate(words)}
    got = list(range(len(words)))
    for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        i, j = place[a], place[b]
        assert np.bitwise_count(words[i] ^ words[j]).sum() <= 40 and got[i] != got[j]
        got = [min(got[i], got[j]) if x in (got[i], got[j]) else x for x in got]
    assert len(set(got)) == 12


def test_layout_grows_and_misses_few():
    for n in (0, 1, 1000, 10**6, 10**9):
        tries = widehash.layout(n)
        root = tries[0][1]
        assert n >> root <= widehash.SUBTRIE and (1 - (1 - math.acos(0.8) / math.pi) ** root) ** len(tries) <= 0.01
        assert all(len(set(order.tolist())) == 64 for order, _ in tries)


def test_one_of_each_similar(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(3, " ".join(base), "x"), (1, " ".join(edited(rng, base, 0.01)), None), (1, " ".join(base), "x"), (9, None, "y"), (8, "", ""), (None, "no id", None), (7, " ".join(prose(rng, 300)), None), (6, "long " * 60000, "")]
    got = widehash.one_of_each_similar(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp"]
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids, key=str) == sorted([1, 8, None, 7, 6], key=str)
    assert widehash.one_of_each_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_under_large_nodes_come_in_bounded_parts():
    nodes = [np.array(x) for x in ([0, 5, 7], [5, 6, 7], [0, 6, 7], [5, 9, 9])]
    got = [(int(i), int(j)) for a, b in simhash._spread(*nodes, 4) for i, j in zip(a, b, strict=True)]
    assert got == [(i, j) for lo, hi, lo2, hi2 in zip(*nodes, strict=True) for i in range(lo, hi) for j in range(lo2, hi2)]
    assert [len(a) for a, _ in simhash._spread(*nodes, 4)] == [4] * 7
    assert not list(simhash._spread(*(x[:0] for x in nodes), 4))


def test_wide_fingerprints_whose_trie_bits_are_all_equal_make_one_forest():
    rng = np.random.default_rng(8)
    words = np.zeros((3000, 4), np.uint64)
    words[:, 3] = rng.permutation(1 << 12)[:3000].astype(np.uint64)
    batch = widehash._forest(words, None, np.arange(64), 8, 12)
    assert batch.num_rows == 2999
