import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcell.llm import quality

SCHEMA = "doc_id long, text string, lang string, kept string, n_words string"


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n")]
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:k] for k, x in enumerate(lines))
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.text(alphabet="ab#é|\n\t \x0b\x1f\xa0𝄞", max_size=80))
@settings(max_examples=300, deadline=None)
def test_base_counts_are_the_definition(text):
    data = text.encode()
    assert quality.base_counts(data, quality.histogram(data)) == plain(text)


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def prose(rng, n):
    common = ["the", "of", "and", "in", "to", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 150), "en", "x", None) for k in range(60)]
    rows += [(100, re.sub(" ", "### ", prose(rng, 150)), "en", "", ""), (101, " ".join("".join(rng.choice("qzxkw") for _ in range(6)) for _ in range(150)), "en", "", "")]
    rows += [(102, None, None, None, None), (102, None, None, None, None), (103, "", "en", "", ""), (104, "spam egg ham " * 60, None, "", ""), (None, prose(rng, 90), None, "", ""), (105, prose(rng, 20000), "en", "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_verdicts(scored):
    docs, rows = scored
    got = quality.quality(docs, carry=["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        r = by[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(by[k].kept for k in [*range(60), None, 105])
    assert not any(by[k].kept for k in (100, 101, 102, 103, 104))


def test_references_count_all_documents(scored):
    docs, rows = scored
    counts = {(r["lang"], r["idx"]): r["n"] for r in quality.reference_counts(docs).collect()}
    want = Counter()
    for _, text, lang, *_ in rows:
        if text and lang:
            want.update((lang, 8 + quality.slot(w)) for w in quality.folded_words(text.encode()))
    assert {k: n for k, n in counts.items() if k[1] >= 8} == dict(want)


def test_kept_documents_and_empty(spark, scored):
    docs, _ = scored
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 62
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality(empty, carry=["doc_id"]).count() == 0 and quality.kept_documents(empty).count() == 0


def test_languages_without_a_reference_are_decided_by_the_base_rules(spark):
    rng = random.Random(6)
    rare = " ".join("".join(rng.choice("qzxkw") for _ in range(6)) for _ in range(150))
    rows = [(k, prose(rng, 150), "en", "", "") for k in range(60)]
    rows += [(200, rare, "xx", "", ""), (201, rare, None, "", ""), (202, rare, "en", "", ""), (203, "spam egg ham " * 60, "xx", "", "")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, SCHEMA), carry=["doc_id"]).collect()}
    assert [got[k] for k in (200, 201, 202, 203)] == [True, True, False, False]
    assert {r.doc_id for r in quality.kept_documents(spark.createDataFrame(rows, SCHEMA)).collect()} == {*range(60), 200, 201}
