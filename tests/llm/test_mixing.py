import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcell.llm import mixing

SCHEMA = "doc_id long, source string, s string, start long"


@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_every_prefix_is_within_one_block(weights):
    own = dict(enumerate(weights))
    total = sum(weights)
    slots = mixing.schedule_period(own)
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, w in own.items():
        assert len(slots[s]) == w
        for k, t in enumerate(slots[s]):
            assert k * total // w <= t < -(-(k + 1) * total // w)
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - Fraction(t * w, total)) < 1


def test_plan_places_every_block_once():
    blocks, weights = {"a": 7, "b": 100, "c": 1, None: 13}, {"a": 3, "b": 1, "c": 5, None: 2}
    seen = {}
    for p in mixing.plan(blocks, weights):
        for s, slots in p.slots.items():
            for k in range(10**3):
                t = k // len(slots) * p.period + slots[k % len(slots)]
                if t < p.length:
                    assert seen.setdefault(p.start + t, s) == s
    assert sorted(seen) == list(range(sum(blocks.values())))
    assert {s: list(seen.values()).count(s) for s in blocks} == blocks


def test_positions_are_gapless_and_weights_hold(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "c", None]), None, 1) for k in range(900)] + [(5, "b", "same", None)] * 3 + [(None, "d", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got, total = mixing.interleave(docs, {"a": 2, "b": 3}, block=4)
    got = sorted(got.collect(), key=lambda r: r.mix_position)
    assert total == len(rows) and [r.mix_position for r in got] == list(range(len(rows)))
    assert sorted(map(str, ((r.doc_id, r.source, r.s, r.start) for r in got))) == sorted(map(str, rows))
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    weights = {"a": 2, "b": 3, "c": 1, None: 1, "d": 1}
    slots = {r.mix_slot: r.source for r in got}
    first_out = min(max(t for t, s in slots.items() if s == x) for x in weights)
    for t in range(first_out + 1):
        for s, w in weights.items():
            assert abs(sum(slots[u] == s for u in range(t)) - Fraction(t * w, 8)) < 1
    in_order = mixing.in_mix_order(docs, weights={"a": 2, "b": 3}, block=4)
    assert in_order.columns == docs.columns and in_order.count() == len(rows)


def test_empty_and_bad_weights(spark):
    assert mixing.interleave(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert mixing.in_mix_order(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mixing.interleave(spark.createDataFrame([(1, "a", "", 1)], SCHEMA), {"a": 0})
