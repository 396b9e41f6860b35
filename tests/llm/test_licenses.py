import re

import pyarrow.parquet as pq
import pytest

from loomcell.llm import licenses

SCHEMA = "doc_id long, text string, start string, license string"
FLAT = [(n, t) for n, ts in licenses.wordings().items() for t in ts]
MIT = "Released under the MIT License."


def named(text):
    return [row[3] for row in licenses.scan(text)]


@pytest.mark.parametrize("frame", [lambda t: t, lambda t: "/* " + t.upper().replace(" ", "  ") + " */", lambda t: "prose before it. " + t + " And prose after it."])
def test_each_wording_is_its_own_licence(frame):
    for name, text in FLAT:
        assert [(r[3], r[6], r[7]) for r in licenses.scan(frame(text))] == [(name, 0, 0)], text


def test_compression_ranks_a_sentence_s_own_template_first():
    """A bare name is too short to rank; its exact words decide."""
    for name, text in FLAT:
        if len(text) > 60:
            best = licenses.gains(text)
            assert name in {t.name for gain, t in best if gain == best[0][0]}, text


CASES = {
    "Released under the BSD 2-Clause License.": ["BSD-2-Clause"],
    MIT + "\nLicensed under CC BY 4.0.": ["MIT", "CC-BY-4.0"],
    "Licensed under the GNU Lesser General Public License v3.0 or later.": ["LGPL-3.0-or-later"],
    "ISC License": ["ISC"],
    "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; "
    "either version 2 of the License, or\n(at your option) any later version.": ["GPL-2.0-or-later"],
    licenses.TEMPLATES["BSD"][0]: ["BSD"],
    "All rights reserved.": ["proprietary"],
    "a license to drive": [None],
    "Licensed under the Apache License, Version 1.1.": [None],
    "Released under the GPLv3.": ["GPL-3.0"],
    "GPL-2.0+": ["GPL-2.0-or-later"],
    "GNU Affero GPL version 3": ["AGPL-3.0"],
    "MIT License, CC BY-NC-SA 4.0 and LGPL-2.1-or-later": ["MIT", "CC-BY-NC-SA-4.0", "LGPL-2.1-or-later"],
    MIT + "\n\n\n" + MIT: ["MIT", "MIT"],
    MIT + " " + MIT: ["MIT", "MIT"],
    "word " * 30_000 + MIT + " word" * 30_000: ["MIT"],
    "license " * 30_000: [None],
}


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_names(text):
    assert named(text) == CASES[text]


def test_wording_differences_are_counted():
    assert [(r[3], r[6], r[7]) for r in licenses.scan("Released under the good MIT License, friends.")] == [("MIT", 0, 1)]
    (row,) = licenses.scan("Some line\n/* Released under the\nMIT License. */")
    assert row[3] == "MIT" and (row[6], row[7]) == (0, 0)
    text = "ä Released under the MIT License. ü"
    (row,) = licenses.scan(text)
    assert text[row[8] : row[9]] == MIT[:-1] and text[row[0] : row[1]] == text


def plain_scan(text):
    """Licences of all exact wordings in a text, the longest first, and how many cue lines have none within two lines: no compression, no alignment."""
    marks = licenses.tokens(text)
    own = [w for w, _, _ in marks]
    hits = []
    for name, wording in FLAT:
        want = licenses.words(wording)
        hits += [(len(want), k, name) for k in range(len(own)) if own[k : k + len(want)] == want]
    taken, found = set(), []
    for n, k, name in sorted(hits, key=lambda h: (-h[0], h[1])):
        if not taken & set(range(k, k + n)):
            taken |= set(range(k, k + n))
            found.append((marks[k][1], marks[k + n - 1][2], name))
    return sorted(found)


def test_a_whole_table_equals_exact_wordings_found_by_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = {}
    for r in licenses.op5_licenses(spark, path).collect():
        own = got.setdefault(r.doc_id, [])
        if r.license:
            assert (r.n_missing, r.n_added) == (0, 0)
            own.append((r.notice_start, r.notice_end, r.license))
    docs = pq.read_table(f"{path}/documents.parquet").to_pydict()
    cue = re.compile("licen[cs]e|copyright|rights reserved|warrant|redistribut|gpl|apache", re.IGNORECASE)
    assert any(got.values())
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        if cue.search(text or "") or doc_id in got:
            assert sorted(got[doc_id]) == plain_scan(text), doc_id


def test_documents(spark):
    rows = [(1, f"some prose\n{MIT}\nmore", None, "x"), (1, f"some prose\n{MIT}\nmore", None, "x"), (2, None, "", ""), (3, "", "", ""), (4, "no cue here", "", ""), (None, "w\n" * 20000 + MIT, "", ""), (5, MIT + "\n" * 9 + "Licensed under CC BY-NC 4.0.", "", "")]
    got = licenses.license_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.start, r.license) for r in got) == [("1", 11, "MIT"), ("1", 11, "MIT"), ("5", 0, "MIT"), ("5", 40, "CC-BY-NC-4.0"), ("None", 40000, "MIT")]
    assert all(r.block == MIT or r.license != "MIT" for r in got)
    assert licenses.license_blocks(spark.createDataFrame([], SCHEMA)).count() == 0
