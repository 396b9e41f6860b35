"""Substring dedup by hashing of lines, sentences or paragraphs.

Units of over ``LONG`` words are cut, and neighbouring ones of too few words for a digest of
their own are put together, at words whose hash says so: where a passage is cut depends
on the passage, not on what stands before it.
In scripts without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) every letter counts as a word.
Units are normalised (case, white space and the marks at their ends do not count) and hashed
to 128 bits; digests are grouped over all documents; the occurrence of least rank
(document id, then offset) is kept and the others are duplicates.  Short units are
not judged by themselves: neighbouring duplicate units make a run, over unhashed
units too, and a run is removed if it has at least ``min_words`` words.  Spans carry
the offsets of the original text, in code points.

The grouping is a pre-aggregated minimum, so a line that a third of all documents
share costs no task more than another; finding the duplicates is a join that may be
split at such a digest.

Defined results: null and empty texts have no units; a null doc_id ranks after all
others; rows with the same doc_id and an equal text are one document, and their spans come once;
units of fewer than ``unit_words`` words are not hashed; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.llm.common import discard, materialise, session, table, texts

#: Ends of units; what follows the match begins the next one.
BOUNDARY = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n\s*\n"), "sentence": re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？｡])(?=[^。！？｡\n])")}
WORD = re.compile(r"\S+")
#: Letters of scripts that are written without spaces.
SPACELESS = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_SPACELESS, LETTER_OR_WORD = re.compile(f"[{SPACELESS}]"), re.compile(rf"[{SPACELESS}]|[^\s{SPACELESS}]+")
UNIT_WORDS, MIN_WORDS = 3, 20
#: Words of a unit beyond which it is cut, after one word in CUT; short units are put together up to one that ends on one word in JOIN.
LONG, CUT, JOIN = 24, 8, 4
#: Short units are put together up to so many words.
JOINED = 12


def units(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of every unit that is not blank."""
    at, out = 0, []
    for m in BOUNDARY[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if b > a and not text[a:b].isspace()]


def normal(text: str) -> list[str]:
    """Words of a unit, in lower case, without the marks at the unit's ends."""
    text = text.lower().strip(" \t\r\n.,;:!?\"'()*#|-。、，！？；：「」『』（）｡\u3000")
    return text.split() if spaced(text) else LETTER_OR_WORD.findall(text)


def spaced(text: str) -> bool:
    """Whether white space parts the words of a text."""
    return text.isascii() or not ANY_SPACELESS.search(text)


def _marks(word: str, one_in: int) -> bool:
    return zlib.crc32(word.encode()) % one_in == 0


def cut_units(text: str, start: int, end: int, unit_words: int) -> list[tuple[int, int]]:
    """A long unit in parts of ``unit_words`` words or more, each ending on a word whose hash says so; the last one as it comes."""
    out, begin, n, last = [], None, 0, start
    for m in (WORD if spaced(text[start:end]) else LETTER_OR_WORD).finditer(text, start, end):
        begin = m.start() if begin is None else begin
        n, last = n + 1, m.end()
        if n >= unit_words and _marks(m[0].lower(), CUT):
            out.append((begin, last))
            begin, n = None, 0
    if begin is not None:
        out.append((begin, last))
    return out


def hashed_units(text: str, unit: str, unit_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the units of a text that get a digest."""
    out: list[tuple[int, int, list[str]]] = []
    short: list[tuple[int, int, list[str]]] = []
    held = 0

    def flush():
        nonlocal held
        if held >= unit_words:
            out.append((short[0][0], short[-1][1], [w for _, _, own in short for w in own]))
        short.clear()
        held = 0

    for a, b in units(text, unit):
        words = normal(text[a:b])
        if len(words) >= unit_words:
            flush()
            if len(words) <= LONG:
                out.append((a, b, words))
            else:
                parts = ((x, y, normal(text[x:y])) for x, y in cut_units(text, a, b, unit_words))
                out += [p for p in parts if len(p[2]) >= unit_words]
        elif words:
            short.append((a, b, words))
            held += len(words)
            if held >= unit_words and (held >= JOINED or _marks(words[-1], JOIN)):
                flush()
    flush()
    return out


def digests(docs: DataFrame, unit: str, unit_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, hi, lo, no, words, start, end) of every hashed unit; no counts a document's hashed units, doc is its text's digest."""
    session(docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))

    def work(batches):
        for batch, column in texts(batches):
            at, rows, marks = [], [], []
            for k, t in enumerate(column):
                if not t:
                    continue
                for no, (a, b, words) in enumerate(hashed_units(t, unit, unit_words)):
                    marks.append(xxhash.xxh3_128_digest(" ".join(words)))
                    rows.append((no, len(words), a, b))
                    at.append(k)
            pair = np.frombuffer(b"".join(marks), ">i8").reshape(-1, 2).astype(np.int64)
            flat = np.array(rows, np.int32).reshape(-1, 4)
            where = pa.array(at, pa.int64())
            columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array(pair[:, 0]), pa.array(pair[:, 1]), *(pa.array(flat[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "hi", "lo", "no", "words", "start", "end"])

    schema = own.select("doc_id", "doc").schema
    for name, kind in (("hi", "long"), ("lo", "long"), ("no", "integer"), ("words", "integer"), ("start", "integer"), ("end", "integer")):
        schema = schema.add(name, kind)
    return own.mapInArrow(work, schema)


def duplicate_spans(
    docs: DataFrame, unit: str = "sentence", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Spans to remove: doc_id, doc (digest of its text), start, end, n_units, n_words, and kept_doc_id, kept_start, kept_end of the first unit's kept occurrence."""
    found = materialise(digests(docs, unit, unit_words, doc_id, text), "digests")  # read twice: texts are cut and hashed once
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "doc", "start", "end")
    least = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(rank).alias("kept"), F.max(rank).alias("last"))
    least = least.filter("n > 1 and kept <> last").select("hi", "lo", "kept")
    least = materialise(least, "repeated")
    again = found.join(least, ["hi", "lo"]).withColumn("rank", rank).filter("rank <> kept").drop("hi", "lo")
    again = materialise(again.select("doc_id", "doc", "no", "words", "start", "end", "kept"), "duplicates")
    discard(found, least)
    again = again.dropDuplicates(["doc_id", "doc", "no"])
    # Neighbouring duplicates of a document have equal no - row_number; a document bounds the window.
    run = F.col("no") - F.row_number().over(Window.partitionBy("doc_id", "doc").orderBy("no"))
    runs = again.withColumn("run", run).groupBy("doc_id", "doc", "run")
    first = F.min(F.struct("start", "kept"))["kept"]
    spans = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), first.alias("kept"))
    spans = spans.filter(F.col("n_words") >= min_words)
    return spans.select(
        "doc_id", "doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_units", "n_words",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").cast("long").alias("kept_start"), F.col("kept.end").cast("long").alias("kept_end"),
    )


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns, with the duplicate spans cut out of the text (null stays null)."""
    spans = duplicate_spans(docs, doc_id=doc_id, text=text, **options)
    cuts = spans.groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_lc_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_lc_id"), F.col("doc").alias("_lc_doc"), "_lc_cuts")
    keyed = docs.withColumn("_lc_key", F.xxhash64(text))
    joined = keyed.join(cuts, (F.col("_lc_key") == F.col("_lc_doc")) & F.col(doc_id).eqNullSafe(F.col("_lc_id")), "left")
    body = F.col(text)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("_lc_cuts")),
        lambda k: F.substring(
            body,
            (F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("_lc_cuts", k - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get("_lc_cuts", k)["start"], F.length(body).cast("long")) - F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("_lc_cuts", k - 1)["end"])).cast("int"),
        ),
    )
    cut = F.when(F.col("_lc_cuts").isNull(), body).otherwise(F.concat_ws("", pieces))
    return joined.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents")).drop("doc")
