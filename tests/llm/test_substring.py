import random

import pytest

from loomcell.llm import substring

SCHEMA = "doc_id long, text string, start string, kept string"


def plain(rows, unit, unit_words=substring.UNIT_WORDS, min_words=substring.MIN_WORDS):
    """Every unit in rank order, runs of repeated ones."""
    docs = sorted({(d, t) for d, t, *_ in rows if t}, key=lambda r: (r[0] is None, r[0]))
    seen, out = {}, set()
    for d, t in docs:
        run = None
        for a, b, words in substring.hashed_units(t, unit, unit_words):
            key = " ".join(words)
            if key in seen:
                run = [run[0], b, run[2] + len(words), run[3]] if run else [a, b, len(words), seen[key]]
            else:
                seen[key] = (d, a, b)
                if run and run[2] >= min_words:
                    out.add((d, run[0], run[1], run[2], *run[3]))
                run = None
        if run and run[2] >= min_words:
            out.add((d, run[0], run[1], run[2], *run[3]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 14))) + rng.choice([". ", ".\n", "? "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(4)]
    rows = []
    for k in range(60):
        body = [sentence() for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            body.insert(rng.randrange(len(body) + 1), rng.choice(passages))
        rows.append((k, "".join(body), None, ""))
    return rows


@pytest.mark.parametrize("unit", ["sentence", "line"])
def test_spans_equal_brute_force(spark, unit):
    rows = corpus(unit) + [(500, None, "", ""), (501, "", "", ""), (3, corpus(unit)[3][1], None, ""), (600, "big words here now. " * 9000, "", ""), (None, "big words here now. " * 9, "", "")]
    got = substring.duplicate_spans(spark.createDataFrame(rows, SCHEMA), unit=unit).collect()
    mine = {(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id, r.kept_start, r.kept_end) for r in got}
    assert len(mine) == len(got) and mine == plain(rows, unit) and len(mine) >= (10 if unit == "sentence" else 1)


def test_cutting_keeps_the_rest_and_the_first_occurrence(spark):
    long_ = "one two three four five six seven eight nine ten. Then eleven twelve thirteen and so on, up to the end of it."
    rows = [(1, "Head. " + long_ + " Tail é.", "s", None), (2, "Ébène. " + long_ + " Rest.", "s", None), (3, None, None, None), (4, "short. short. short.", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in substring.without_duplicates(docs).collect()}
    assert got == {1: rows[0][1], 2: "Ébène.  Rest.", 3: None, 4: rows[3][1]}
    assert substring.without_duplicates(docs).columns == docs.columns
    assert substring.duplicate_spans(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("mark", ["", ".", "!!", ","])
@pytest.mark.parametrize("words", [51, 400])
def test_a_passage_is_cut_alike_wherever_it_stands(mark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4)) + mark
    passage = " ".join(word() for _ in range(words))
    found = []
    for n in (0, 1, 2, 7, 40):
        head = " ".join(["Head", *(word() for _ in range(n))]) + " "
        own = substring.hashed_units(head + passage + " " + word() + " end here. More of it.", "sentence", 3)
        found.append({(a - len(head), b - len(head)) for a, b, _ in own if a >= len(head) and b <= len(head) + len(passage)})
        assert all(len(w) >= 3 for _, _, w in own) and all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
    common = set.intersection(*found)
    assert sum(len(passage[a:b].split()) for a, b in common) >= min(20, words / 2), common
    assert sum(len(passage[a:b].split()) for a, b in common) >= words - 45


def test_short_units_alone_get_no_digest():
    assert substring.hashed_units("Yes. No.", "sentence", 3) == []
    assert [w for *_, w in substring.hashed_units("One two three. Yes. Four five six.", "sentence", 3)] == [["one", "two", "three"], ["four", "five", "six"]]


def test_scripts_without_spaces(spark):
    """A passage of letters without a space is found in another document; short ones are left alone."""
    rng = random.Random(12)
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "。".join(letters(rng.randrange(6, 60)) for _ in range(6)) + "。"
    thai = "".join(chr(rng.randrange(0xE01, 0xE2F)) for _ in range(300))
    rows = [(1, passage, "", ""), (2, letters(30) + "。" + passage + letters(9), "", ""), (3, "短い。" + letters(40), "", ""), (4, "短い。" + letters(40), "", ""), (5, thai, "", ""), (6, thai, "", "")]
    got = {r.doc_id: r for r in substring.duplicate_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {2, 6} and got[2].n_words >= 20
    assert passage.startswith(rows[1][1][got[2].start : got[2].end][:20]) and got[2].end - got[2].start >= len(passage) - 1
    assert got[6].end - got[6].start >= 250
    mine = {(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id, r.kept_start, r.kept_end) for r in got.values()}
    assert mine == plain(rows, "sentence")
