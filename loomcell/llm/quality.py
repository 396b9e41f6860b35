"""Quality rules by distribution divergence.

A document's character-class histogram and its common-word histogram are held
against references of every language by the Jensen-Shannon distance (base 2,
0 to 1).  The references are counts over *all* documents with a language; they
are bounded in size (classes, and hash slots of words), so each task sends a
fixed number of counters however much text it reads.

Defined results: a null text counts as a text without words; a null language
adds nothing to the references; a document whose language is null or has no reference
(fewer than ``min_reference_words`` words in the table) is decided by the base rules only,
its distances being those to the nearest language that has one; repeated
rows are scored alike, one row each; extra columns are passed through by
``quality`` and clash with nothing but the columns that it adds.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.llm.common import session, table, texts

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "non_ascii")
SLOTS = 8192
#: Class of each byte; 8 (dropped) for the bytes of a character after its first.
BYTE_CLASS = np.array(
    [
        8 if 0x80 <= b < 0xC0 else 7 if b >= 0xC0 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit()
        else 3 if chr(b) in SPACE else 4 if chr(b) in ".,;:!?'\"()-" else 5 if chr(b) in SYMBOLS else 6
        for b in range(256)
    ],
    dtype=np.uint8,
)
#: ASCII letters to lower case, other ASCII characters to spaces, the rest as it is.
SPACE_BYTES, SYMBOL_BYTES = ([ord(c) for c in x] for x in (SPACE, SYMBOLS))
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    A distance may exceed its limit by its slack over the root of the number of
    observations, which is how far a clean short text strays by chance.
    """

    char_limit: float = 0.26
    char_slack: float = 1.0
    word_limit: float = 0.16
    word_slack: float = 2.5
    min_chars: int = 200
    min_words: int = 50
    common_words: int = 64
    min_reference_words: int = 2000


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit mix first; those that seem to recur are compared word by word.
    """
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    keys = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[2:]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(keys, again)).tolist()
    windows = [(words[k], words[k + 1], words[k + 2]) for k in at]
    found = Counter(windows)
    covered = np.zeros(n, bool)
    sure = np.array([k for k, w in zip(at, windows, strict=True) if found[w] > 1], np.int64)
    for k in range(3):
        covered[sure + k] = True
    return int(covered.sum())


def histogram(data: bytes) -> np.ndarray:
    """How often each byte occurs."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def class_counts(bytes_: np.ndarray) -> np.ndarray:
    """Characters of each class, from a byte histogram."""
    return np.bincount(BYTE_CLASS, weights=bytes_, minlength=9)[:8]


def base_counts(data: bytes, bytes_: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not data:
        return 0, 0, 0, 0, 0
    words = data.split()
    seen: set[bytes] = set()
    lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            lines += bool(line.strip())
        else:
            seen.add(line)
    chars = int(bytes_[BYTE_CLASS < 8].sum() - bytes_[SPACE_BYTES].sum())
    return len(words), chars, int(bytes_[SYMBOL_BYTES].sum()), lines, repeated_words(words)


def slot(word: bytes) -> int:
    return zlib.crc32(word) % SLOTS


def folded_words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, the root of the divergence in bits."""
    m = (p + q) / 2
    d = 0.0
    for x in (p, q):
        on = x > 0
        d += float((x[on] * np.log2(x[on] / m[on])).sum()) / 2
    return math.sqrt(max(0.0, d))


def reference_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, idx, n): counts of classes (idx 0 to 7) and of word slots (idx 8 and up) over all documents."""
    session(docs)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch, column in texts(batches):
            words: dict[str, Counter] = {}
            for lang_, text_ in zip(batch.column(1).to_pylist(), column, strict=True):
                data = text_.encode()
                total.setdefault(lang_, np.zeros(8 + SLOTS, np.int64))[:8] += class_counts(histogram(data)).astype(np.int64)
                words.setdefault(lang_, Counter()).update(folded_words(data))
            for lang_, counter in words.items():
                own = total[lang_]
                for word, k in counter.items():
                    own[8 + slot(word)] += k
        for lang_, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "idx", "n"])

    own = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    return own.mapInArrow(count, "lang string, idx int, n long").groupBy("lang", "idx").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Reference:
    """One language: class shares, and the shares of its common words' slots with the rest at index 0."""

    lang: str
    classes: np.ndarray
    index: dict
    words: np.ndarray


def references(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> list[Reference]:
    """References of all languages; the driver gets ``common_words`` + 9 rows for each."""
    counts = reference_counts(docs, text, lang)
    is_word = F.col("idx") >= 8
    ranked = counts.withColumn("total", F.sum(F.when(is_word, F.col("n"))).over(Window.partitionBy("lang"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "idx"))
    )
    rows = ranked.filter((~is_word) | (F.col("rank") <= rules.common_words)).filter(F.col("total") >= rules.min_reference_words).collect()
    out = []
    for name in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == name]
        classes = np.zeros(8)
        for r in own:
            if r["idx"] < 8:
                classes[r["idx"]] = r["n"]
        top = sorted((r for r in own if r["idx"] >= 8), key=lambda r: r["rank"])
        words = np.array([0.0] + [r["n"] for r in top])
        words[0] = own[0]["total"] - words.sum()
        out.append(Reference(name, classes / classes.sum(), {r["idx"] - 8: k + 1 for k, r in enumerate(top)}, words / words.sum()))
    return out


class Scorer:
    """Distances of documents to the nearest of some references."""

    #: Words whose slot is remembered, at most.
    MEMO = 200_000

    def __init__(self, refs: list[Reference]):
        self.refs = refs
        self.slots = {s: k for k, s in enumerate(sorted({s for r in refs for s in r.index}))}
        #: For each reference, the place of every common slot in its histogram.
        self.places = [np.array([r.index.get(s, 0) for s in self.slots], np.int64) for r in refs]
        self.memo: dict[bytes, int] = {}

    def place(self, word: bytes) -> int:
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        found = self.memo[word] = self.slots.get(slot(word), -1)
        return found

    def __call__(self, data: bytes, bytes_: np.ndarray) -> tuple[float, float, int, int]:
        """Distances (classes, common words) and the observations behind each."""
        if not data or not self.refs:
            return 0.0, 0.0, 0, 0
        classes = class_counts(bytes_)
        n_chars = int(classes.sum())
        words = folded_words(data)
        common = np.zeros(len(self.slots))
        memo = self.memo
        for word, k in Counter(words).items():
            at = memo.get(word)
            if at is None:
                at = self.place(word)
            if at >= 0:
                common[at] += k
        n_words = len(words)
        char = word = 1.0
        for r, places in zip(self.refs, self.places, strict=True):
            own = np.bincount(places, weights=common, minlength=len(r.words))
            own[0] += n_words - own.sum()
            char = min(char, js_distance(classes / max(n_chars, 1), r.classes))
            word = min(word, js_distance(own / max(n_words, 1), r.words))
        return char, word, n_chars, n_words


def verdict(char: float, word: float, n_chars: int, n_words: int, rules: QualityRules) -> bool:
    """True if no histogram that is long enough to judge strays beyond its limit."""
    if n_chars >= rules.min_chars and char > rules.char_limit + rules.char_slack / math.sqrt(n_chars):
        return False
    return not (n_words >= rules.min_words and word > rules.word_limit + rules.word_slack / math.sqrt(n_words))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, by default) of every row with the base counts, both distances and the verdict."""
    spark = session(docs)
    refs = spark.sparkContext.broadcast(references(docs, rules, text, lang))
    carry = docs.columns if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    at = carry.index(text) if text in carry else len(carry)
    own = [F.col(f"`{c}`").alias(n) for c, n in zip([*carry, text], [*names, "text"], strict=True)][: max(at + 1, len(carry))]
    own = docs.select(*own, F.col(f"`{lang}`").alias("lang"))

    def score(batches):
        scorer = Scorer(refs.value)
        known = {r.lang for r in refs.value}
        for batch in batches:
            rows = []
            for t, lang_ in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = (t or "").encode()
                bytes_ = histogram(data)
                base = base_counts(data, bytes_)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                char, word, n_chars, n_words = scorer(data, bytes_)
                rows.append((*base, failed, not failed and (lang_ not in known or verdict(char, word, n_chars, n_words, rules)), char, word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, *[x.split()[0] for x in MEASURES.split(", ")]])

    schema = own.select(*names).schema
    for part in MEASURES.split(", "):
        schema = schema.add(*part.split())
    out = own.mapInArrow(score, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], *out.columns[len(names) :])


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    scored = quality(docs, rules)
    verdict_at = len(docs.columns) + [x.split()[0] for x in MEASURES.split(", ")].index("kept")
    scored = scored.toDF(*[f"_lc_{k}" for k in range(len(scored.columns))]).filter(F.col(f"_lc_{verdict_at}"))
    return scored.select(*[F.col(f"_lc_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
