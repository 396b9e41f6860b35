"""License scans by conditional compression.

A candidate block is a run of lines with a cue word and of those between them, at most
``GAP`` lines apart; it is looked at with the lines of its paragraph around it.  It is
compressed alone and with each template as a raw zstandard dictionary, and the templates are
ranked by how much they shorten it.  Each of them is then confirmed by an exact comparison of
wordings, wherever its naming words stand: the words of the template that the place lacks, in
order, and the words that it adds.  A difference in a naming word (a name, a version, "lesser",
"later") is another licence.  Where confirmed wordings overlap, the one that explains most
words wins; all that do not overlap are returned.

Words are compared in lower case; hyphens and the marks of a version ("version", "v", a final
".0") do not count.  A template is left out of the ranking only if the block lacks one of its
naming words, without which it cannot be confirmed.  Lines without a cue word (``CUE``, which
every template has) are not candidates.

Defined results: null and empty texts, and texts without a candidate, give no rows;
each candidate gives one row for each confirmed notice, or one with a null licence if there is
none; equal gains rank by template name; repeated rows give repeated results; other columns
are not touched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.llm.common import session, table, texts

# The wordings of licences.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
        "Apache 2.0 License",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "MIT License",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "ISC": [
        "ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "BSD 2-Clause License",
        "2-Clause BSD License",
        "Simplified BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "3-Clause BSD License",
        "New BSD License",
        "Modified BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License 2.0",
        "MPL 2.0 License",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": ["Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": ["zlib License", "SPDX-License-Identifier: Zlib"],
    "CC0-1.0": ["Released under CC0 1.0 Universal, no rights reserved.", "CC0 1.0", "Creative Commons Zero 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["Copyright, all rights reserved.", "All rights reserved."],
}
#: Parts of Creative Commons licences and what they stand for; versions.
CREATIVE = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
CREATIVE_KINDS, CREATIVE_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("2.0", "2.5", "3.0", "4.0")
#: GNU licences: what stands before "General Public License", and versions.
GNU = {"GPL": ("", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser ", ("2.1", "3.0")), "AGPL": ("Affero ", ("3.0",))}
#: Words in which a wording may not differ, besides all that have a digit.
NAMING = frozenset(
    """affero agpl apache attribution boost bsd bsl cc cc0 commons creative eclipse endorse epl general gnu gpl isc later lesser lgpl library
    mit modified mozilla mpl nc nd new noncommercial noderivatives noderivs only promote public sa sharealike simplified unencumbered unlicense zero zlib""".split()
)
#: A line that may belong to a licence text.
CUE = re.compile(
    r"licen[cs]e|copyright|spdx|warrant|redistribut|public\s+domain|hereby\s+granted|rights\s+reserved|gnu\s|gpl|apache|mozilla|mpl\s+2|creative\s+commons|cc0|cc[\s-]+by\b",
    re.IGNORECASE | re.ASCII,
)
#: A part of each cue, in lower case; a text without any of them has none.
HINTS = ("licen", "copyright", "spdx", "warrant", "redistribut", "domain", "granted", "reserved", "gnu", "gpl", "apache", "mozilla", "mpl", "commons", "cc0", "by")
WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
#: Words that count as another one, and words that do not count.
SAME, SILENT = {"gplv": "gpl", "lgplv": "lgpl", "agplv": "agpl", "licence": "license", "licenced": "licensed"}, {"v", "version"}
#: Candidate lines this near to each other make one block; as many lines of its paragraph are looked at around it.
GAP = 2
AROUND = 3
#: The share of a template's words that a place must have, in order.
COVER = 0.8


def _ruled() -> dict[str, list[str]]:
    """Wordings that follow from a licence's parts."""
    out: dict[str, list[str]] = defaultdict(list)
    for kind in CREATIVE_KINDS:
        parts = "-".join(CREATIVE[p] for p in kind.split("-"))
        for v in CREATIVE_VERSIONS:
            name = f"CC-{kind.upper()}-{v}"
            out[name] += [f"Licensed under CC {kind.upper()} {v}.", f"CC {kind.upper()} {v}", f"SPDX-License-Identifier: {name}"]
            out[name] += [f"This work is licensed under a Creative Commons {parts} {v} International License.", f"Creative Commons {parts} {v}"]
    for short, (kind, versions) in GNU.items():
        for v in versions:
            name, long = f"{short}-{v}", f"GNU {kind}General Public License"
            for ending, later in (("", ""), ("-or-later", " or later"), ("-or-later", " or any later version")):
                out[name + ending] += [f"This work is licensed under the {long}, version {v}{later}.", f"{long} {v}{later}", f"{short} {v}{later}", f"{long} {short} {v}{later}", f"GNU {kind}GPL {v}{later}"]
            out[name] += [f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}-only", f"version {v} of the {long}"]
            terms = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation"
            out[name] += [f"This program is free software: {terms}, version {v}.", f"{long} as published by the Free Software Foundation, version {v}"]
            out[name + "-or-later"] += [
                f"This program is free software: {terms}, either version {v} of the License, or (at your option) any later version.",
                f"version {v} of the {long}, or (at your option) any later version",
                f"SPDX-License-Identifier: {name}-or-later",
                f"SPDX-License-Identifier: {name}+",
            ]
    return dict(out)


def wordings() -> dict[str, list[str]]:
    """Every licence's wordings; those that have the same words as an earlier one are left out."""
    seen, out = set(), {}
    for name, own in (TEMPLATES | _ruled()).items():
        out[name] = [t for t in own if not (words := tuple(w for w, _, _ in tokens(t))) in seen and not seen.add(words)]
    return out


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of all words that count."""
    out = []
    for m in WORD.finditer(text):
        word = m[0].lower()
        if word in SILENT:
            continue
        while word.endswith(".0"):
            word = word[:-2]
        if word in ("gpl", "lgpl", "agpl") or not word[0].isdigit():
            word = SAME.get(word, word)
        elif text[m.end() : m.end() + 1] == "+":  # GPL-2.0+
            out += [(word, m.start(), m.end()), ("or", m.end(), m.end() + 1), ("later", m.end(), m.end() + 1)]
            continue
        out.append((word, m.start(), m.end()))
    return out


def words(text: str) -> list[str]:
    return [w for w, _, _ in tokens(text)]


def is_naming(word: str) -> bool:
    return word in NAMING or word[0].isdigit()


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    words: tuple
    naming: frozenset
    compressor: zstandard.ZstdCompressor


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    """Compressors with the raw dictionaries, one for each worker process."""
    out = []
    for name, own in sorted(wordings().items()):
        for text in own:
            raw = zstandard.ZstdCompressionDict(" ".join(text.split()).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            each = tuple(words(text))
            naming = frozenset(w for w in each if is_naming(w)) or frozenset(each)
            out.append(Template(name, text, each, naming, zstandard.ZstdCompressor(level=9, dict_data=raw)))
    return tuple(out)


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks, in code points."""
    found: list[list[int]] = []
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    at = 0
    while m := CUE.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        at = end = len(text) if end < 0 else end
        if found and text.count("\n", found[-1][1], start) <= GAP:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def surroundings(text: str, start: int, end: int) -> tuple[int, int]:
    """A block with up to ``AROUND`` lines of its paragraph on both sides."""
    for _ in range(AROUND):
        above = text.rfind("\n", 0, max(0, start - 1)) + 1
        if not start or not text[above : start - 1].strip():
            break
        start = above
    for _ in range(AROUND):
        below = text.find("\n", end + 1)
        below = len(text) if below < 0 else below
        if end >= len(text) or not text[end + 1 : below].strip():
            break
        end = below
    return start, end


def wording(place: list[str], template: tuple) -> tuple[int, int, int, int, int, bool]:
    """Words of the template met in order, words missing and added, the span in ``place``, and whether a difference is in a naming word."""
    pairs = [m for m in SequenceMatcher(None, place, template, autojunk=False).get_matching_blocks() if m.size]
    met = sum(m.size for m in pairs)
    if not met:
        return 0, len(template), 0, 0, 0, True
    first, end = pairs[0].a, pairs[-1].a + pairs[-1].size
    lacks = Counter(template)
    adds = Counter(place[first:end])
    for m in pairs:
        own = Counter(template[m.b : m.b + m.size])
        lacks.subtract(own)
        adds.subtract(own)
    other = any(n > 0 and is_naming(w) for c in (lacks, adds) for w, n in c.items())
    return met, len(template) - met, end - first - met, first, end, other


def gains(block: str, among: tuple | None = None) -> list[tuple[float, Template]]:
    """Templates (all, or those ``among``) by the share of the compressed size that they save, best first."""
    data = " ".join(block.split()).lower().encode()
    alone = len(zstandard.ZstdCompressor(level=9).compress(data))
    found = [(1 - len(t.compressor.compress(data)) / alone, t) for t in (templates() if among is None else among)]
    return sorted(found, key=lambda x: (-x[0], x[1].name, x[1].text))


def slack(n: int) -> int:
    """Words that a place may add to a template of n words."""
    return n // 4 + 1


@dataclass(frozen=True)
class Notice:
    """A confirmed licence at a place of a text, in code points."""

    name: str
    gain: float
    cover: float
    missing: int
    added: int
    start: int
    end: int


def places(own: list[str], at: dict, t: Template):
    """(met, missing, added, first word, end) wherever a template's wording is met."""
    anchor = min(t.naming, key=lambda w: (len(at[w]), t.words.count(w), w))
    j, m = t.words.index(anchor), len(t.words)
    for i in at[anchor]:
        low = max(0, i - j - slack(m))
        met, missing, added, first, end, other = wording(own[low : i - j + m + slack(m)], t.words)
        if met / m >= COVER and added <= slack(m) and not other:
            yield met, missing, added, low + first, low + end


def find_notices(text: str) -> tuple[Notice, ...]:
    """All notices of a text that do not overlap, by place."""
    marks = tokens(text)
    own = [w for w, _, _ in marks]
    at = defaultdict(list)
    for k, w in enumerate(own):
        at[w].append(k)
    found = []
    for gain, t in gains(text, tuple(t for t in templates() if t.naming <= at.keys())):
        found += [(met - missing - added, gain, t, met, missing, added, a, b) for met, missing, added, a, b in places(own, at, t)]
    taken = bytearray(len(own))
    out = []
    for _, gain, t, met, missing, added, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2].name, x[2].text, x[6])):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append(Notice(t.name, gain, met / len(t.words), missing, added, marks[a][1], marks[b - 1][2]))
    return tuple(sorted(out, key=lambda n: n.start))


_remembered = lru_cache(20_000)(find_notices)
#: Longer texts are not remembered.
MEMO_CHARS = 2000


def notices(text: str) -> tuple[Notice, ...]:
    return (_remembered if len(text) <= MEMO_CHARS else find_notices)(text)


def scan(text: str) -> list[tuple]:
    """COLUMNS of every candidate block of a text; a notice belongs to the first block that it touches."""
    out, done = [], 0
    for start, end in blocks(text):
        low, high = surroundings(text, start, end)
        own = [n for n in notices(text[low:high]) if low + n.end > max(start, done) and low + n.start < end and low + n.start >= done]
        for n in own:
            out.append((start, end, text[start:end], n.name, n.gain, n.cover, n.missing, n.added, low + n.start, low + n.end))
            done = low + n.end
        if not own:
            best = gains(text[start:end])[0][0]
            out.append((start, end, text[start:end], None, best, 0.0, 0, 0, None, None))
    return out


COLUMNS = "start long, end long, block string, license string, gain double, coverage double, n_missing long, n_added long, notice_start long, notice_end long"


def license_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each notice of each candidate block: its document's id, the block's place and text, the licence, how exact its wording is, and its own place."""
    session(docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]

    def work(batches):
        for batch, column in texts(batches):
            found = [(k, row) for k, t in enumerate(column) if t for row in scan(t)]
            columns = zip(*(row for _, row in found), strict=True) if found else [[]] * len(names)
            own = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in found], pa.int64())), *own], ["doc_id", *names])

    schema = own.select("doc_id").schema
    for part in COLUMNS.split(", "):
        schema = schema.add(*part.split())
    return own.mapInArrow(work, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents")).drop("block")
