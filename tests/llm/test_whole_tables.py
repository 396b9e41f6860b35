"""Registered queries over a whole table against plain recomputations that share none of their machinery."""

import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
import xxhash

from loomcell.llm import langid, mixing, packing, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


# --- op1 ------------------------------------------------------------------------------


def spark_hash(doc_id, source):
    """xxhash64(doc_id, source) as Spark chains it; nulls are passed over."""
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    if source is not None:
        h = xxhash.xxh64_intdigest(source.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, weights, block):
    """{(source, rank): (block, slot, position)}: slot by slot, the released block of the earliest deadline, a new period whenever a source ends."""
    counts = Counter(s for _, s in rows)
    names = sorted(counts, key=lambda s: (s is None, str(s)))
    left = {s: -(-counts[s] // block) for s in names}
    done = dict.fromkeys(names, 0)
    slot = start = position = 0
    taken, out = dict.fromkeys(names, 0), {}
    while any(left.values()):
        live = [s for s in names if left[s]]
        total = sum(weights.get(s, 1) for s in live)
        share = {s: Fraction(weights.get(s, 1), total) for s in live}
        due = lambda s, k: math.ceil(k / share[s])  # noqa: B023, E731
        ready = [s for s in live if math.floor(taken[s] / share[s]) <= slot - start]
        s = min(ready, key=lambda s: (due(s, taken[s] + 1), due(s, taken[s] + 2), live.index(s)))
        for k in range(min(block, counts[s] - done[s] * block)):
            out[s, done[s] * block + k] = (done[s], slot, position)
            position += 1
        taken[s], done[s], left[s], slot = taken[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        if not left[s]:
            start, taken = slot, dict.fromkeys(names, 0)
    return out


def test_op1_equals_a_plain_schedule(spark, docs):
    rows = [(d["doc_id"], d["source"]) for d in docs]
    want = plain_mix(rows, mixing.WEIGHTS, mixing.BLOCK)
    buckets = max(1, math.isqrt(len(rows)))
    rank, seen = {}, Counter()
    for doc_id, source in sorted(rows, key=lambda r: (spark_hash(*r) % buckets, spark_hash(*r))):
        rank[doc_id] = (source, seen[source])
        seen[source] += 1
    got = {r.doc_id: (r.mix_block, r.mix_slot, r.mix_position) for r in mixing.op1_mixing(spark, SF).collect()}
    assert got == {d: want[rank[d]] for d, _ in rows}


def test_too_many_sources_or_slots_are_an_error(spark):
    many = spark.range(mixing.MOST_SOURCES + 1).selectExpr("id as doc_id", "cast(id as string) as source")
    with pytest.raises(ValueError, match="coarser"):
        mixing.interleave(many)
    with pytest.raises(ValueError, match="scale"):
        mixing.interleave(many.limit(2), {"0": mixing.MOST_SLOTS, "1": 1})


# --- op2 ------------------------------------------------------------------------------


def plain_classes(text):
    out = [0] * 8
    for c in text:
        if ord(c) > 127:
            k = 7
        elif c.islower():
            k = 0
        elif c.isupper():
            k = 1
        elif c.isdigit():
            k = 2
        elif c in " \t\n\v\f\r":
            k = 3
        elif c in ".,;:!?'\"()-":
            k = 4
        else:
            k = 5 if c in "#*$%&|<>" else 6
        out[k] += 1
    return out


def plain_slots(text):
    folded = "".join(c if ord(c) > 127 else c.lower() if c.isalnum() else " " for c in text)
    return Counter(zlib.crc32(w.encode()) % 8192 for w in re.split("[ \t\n\v\f\r]+", folded) if w)


def distance(p, q):
    h = lambda x: -sum(v * math.log2(v) for v in x if v)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, h(m) - (h(p) + h(q)) / 2))


def test_op2_verdicts_equal_a_plain_recomputation(spark, docs):
    rules = quality.QualityRules()
    classes, slots = {}, {}
    for d in docs:
        if d["text"] is not None and d["lang"] is not None:
            own = classes.setdefault(d["lang"], [0] * 8)
            classes[d["lang"]] = [a + b for a, b in zip(own, plain_classes(d["text"]), strict=True)]
            slots.setdefault(d["lang"], Counter()).update(plain_slots(d["text"]))
    langs = [x for x in classes if sum(slots[x].values()) >= rules.min_reference_words]
    common = {x: [s for s, _ in sorted(slots[x].items(), key=lambda i: (-i[1], i[0]))[: rules.common_words]] for x in langs}
    share = lambda own, at: [v / sum(own.values()) for v in [sum(own.values()) - sum(own[s] for s in at), *(own[s] for s in at)]]
    want = {}
    for d in docs:
        text = d["text"] or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed
        if kept and d["lang"] in langs:
            own, n = plain_classes(text), plain_slots(text)
            chars, total = sum(own), sum(n.values())
            char = min(distance([v / chars for v in own], [v / sum(classes[x]) for v in classes[x]]) for x in langs)
            word = min(distance(share(n, common[x]), share(slots[x], common[x])) for x in langs)
            kept = not (chars >= rules.min_chars and char > rules.char_limit + rules.char_slack / math.sqrt(chars))
            kept = kept and not (total >= rules.min_words and word > rules.word_limit + rules.word_slack / math.sqrt(total))
        want[d["doc_id"]] = (len(words), failed, kept)
    got = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in quality.op2_quality(spark, SF).collect()}
    assert got == want and {k for *_, k in got.values()} == {True, False}


# --- op3 ------------------------------------------------------------------------------


def test_op3_pieces_hold_every_id_of_the_table_once(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d["doc_id"]: [*whole.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs}
    rows = packing.op3_packing(spark, SF).collect()
    places, sequences = {d: [] for d in ids}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        places[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(p) == list(range(len(ids[d]))) for d, p in places.items())
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


# --- op8 ------------------------------------------------------------------------------


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    data = f" {' '.join(letters.split())} ".encode()
    for k, n in enumerate((2, 3, 4)):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + b) % 2**32
            yield k, k * langid.SLOTS + (code * 2654435761 % 2**32 >> 18)


def test_op8_predictions_equal_plain_naive_bayes_and_decoding(spark, docs):
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
    counts = {}
    for d in docs:
        if not held(d) and d["lang"] is not None and d["text"] is not None and any(map(str.isalpha, d["text"])):
            counts.setdefault(d["lang"], Counter()).update(plain_grams(d["text"]))
    names = sorted(counts)
    totals = {x: [sum(n for (k, _), n in counts[x].items() if k == order) + 0.5 * langid.SLOTS for order in range(3)] for x in names}
    codes = langid.codewords(len(names)).tolist()
    got = {r.doc_id: r for r in langid.op8_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs[::3]:
        text, r = d["text"], got[d["doc_id"]]
        assert r.held_out == held(d)
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = Counter(plain_grams(text))
        n = sum(grams.values())
        margins = [0.0] * len(codes[0])
        for (order, at), times in grams.items():
            share = [(counts[x][order, at] + 0.5) / totals[x][order] for x in names]
            for b in range(len(margins)):
                on = [s for s, c in zip(share, codes, strict=True) if c[b] > 0]
                off = [s for s, c in zip(share, codes, strict=True) if c[b] < 0]
                margins[b] += times * math.log(sum(on) / len(on) / (sum(off) / len(off)))
        margins = [m / n * min(n / 3, 200) ** 0.5 for m in margins]
        loss = [sum(math.log1p(math.exp(-c * m * langid.SCALE)) if -c * m * langid.SCALE < 30 else -c * m * langid.SCALE for c, m in zip(code, margins, strict=True)) / len(code) * 4 for code in codes]
        p = [math.exp(min(loss) - x) for x in loss]
        assert r.lang_pred == names[loss.index(min(loss))] and abs(r.score - max(p) / sum(p)) < 1e-3


# --- op10 -----------------------------------------------------------------------------


def plain_spans(text, feistel):
    """At each place in turn every kind in order, without any search for where to look."""
    kinds = [(name, re.compile(p), action) for name, p, action in pii.KINDS]
    at, spans = 0, []
    while at < len(text):
        for name, pattern, action in kinds:
            m = pattern.match(text, at)
            ends = [] if m is None else [len(m[0])] if name != "iban" else pii._iban_ends(m[0])
            size = next((n for n in ends if action(feistel, m[0][:n], False) is not None), None)
            if size:
                spans.append((name, at, at + size))
                at += size
                break
        else:
            at += 1
    return spans


def test_op10_spans_equal_a_plain_walk(spark, docs):
    feistel = pii.Feistel(pii.DEMO_KEY)
    got = {r.doc_id: r for r in pii.op10_pii(spark, SF).collect()}
    found = 0
    for d in docs:
        text, r = d["text"], got[d["doc_id"]]
        if text is None:
            assert r.text is None and r.n_spans == 0
            continue
        spans = plain_spans(text, feistel)
        assert (r.n_spans, r.kinds) == (len(spans), ",".join(k for k, *_ in spans)), d["doc_id"]
        found += len(spans)
        assert pii.pseudonymise(r.text, feistel, back=True)[0] == text
    assert found > 20

