"""run() against a plain walk through the stages."""

import random

import corpus_pipeline
from loomcell.llm import mixing, packing, pii
from loomcell.llm.common import file_starts, materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    common = ["the", "of", "and", "in", "to", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(n))


def documents():
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(80, 400)), "en", f"src{k % 5}", 1) for k in range(80)]
    rows += [(200 + k, rows[k][1], "en", "src0", 1) for k in range(20)]
    rows += [(300, rows[3][1] + " mail me@example.com", "en", None, None), (301, "junk### " * 80, "en", "src1", 1), (302, None, None, None, None), (303, "short", "en", "src2", 1)]
    rows[10] = (10, rows[10][1] + " card 4111111111111111", "en", "src0", 1)
    return rows


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]


def test_pipeline_equals_a_plain_walk(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {d: t for d, t, *_ in rows if d < 300 or d == 300}
    sets = {}
    for d, t in clean.items():
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + corpus_pipeline.SHINGLE]) for k in range(len(w) - corpus_pipeline.SHINGLE + 1)}
    group = {d: d for d in clean}
    changed = True
    while changed:
        changed = False
        for a in clean:
            for b in clean:
                if len(sets[a] & sets[b]) >= corpus_pipeline.SIMILAR * (len(sets[a]) * len(sets[b])) ** 0.5 and group[b] < group[a]:
                    group[a], changed = group[b], True
    kept = {d: t for d, t in clean.items() if group[d] == d}
    assert len(kept) <= 81
    encode = packing.encoder(packing.tokenizer_path())
    want = set()
    for d, t in kept.items():
        ids = encode(pii.pseudonymise(t, pii.Feistel(pii.DEMO_KEY))[0]) + b"\1\0\0\0"
        want |= {(d, s, n, c, len(ids) // 4) for s, n, c in packing.cut(ids, 2048)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark):
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(documents()[:5], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, None)
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes
            out.count()


def assert_in_order(got, place, run):
    """Runs follow each other, and so do the sequences in them by the mean place of their tokens."""
    got = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [place[r.doc_id] // run for r in got] == sorted(place[r.doc_id] // run for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault((place[r.doc_id] // run, r.sequence_id), []).append(r)
    means = [(k, sum(r.length * place[r.doc_id] for r in own) / sum(r.length for r in own)) for (k, _), own in sequences.items()]
    assert means == sorted(means) and len({k for k, _ in means}) > 2


def test_sequences_follow_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 40, raising=False)
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.choice([5, 40, 3000])), "en", rng.choice(["src0", "src1", "src7", None]), 1) for k in rng.sample(range(10**6), 280)]
    docs = spark.createDataFrame(rows, SCHEMA)
    place = {r.doc_id: r.mix_position for r in mixing.interleave(docs)[0].collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, None)
    written = materialise(mixed, "mixed")
    for given in (written, mixed):
        assert_in_order(corpus_pipeline.pack_sequences(spark, given, None).collect(), place, 40)
    backwards = {d: len(rows) - 1 - k for d, k in place.items()}
    turned = spark.createDataFrame(sorted(rows, key=lambda r: backwards[r[0]]), SCHEMA)
    assert_in_order(corpus_pipeline.pack_sequences(spark, materialise(turned, "turned"), None).collect(), backwards, 40)


def test_the_pipeline_keeps_the_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 20, raising=False)
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
    place = {r.doc_id: r.mix_position for r in mixing.interleave(docs)[0].collect()}
    run = -(-len(place) // round(len(place) / 20))
    assert_in_order(corpus_pipeline.run(spark, str(tmp_path)).collect(), place, run)


def test_files_are_ordered_by_the_numbers_in_their_names():
    sizes = {"a/part-100000-x1-c000": 1, "a/part-99999-x1-c001": 2, "a/part-99999-x1-c000": 3, "a/part-00002-x1-c000": 4}
    assert file_starts(sizes) == {"a/part-00002-x1-c000": 0, "a/part-99999-x1-c000": 4, "a/part-99999-x1-c001": 7, "a/part-100000-x1-c000": 9}
