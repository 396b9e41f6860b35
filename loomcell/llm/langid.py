"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit a binary classifier over
hashed byte n-grams (2 to 4 bytes of lower-case letters and single spaces) predicts
that bit of a text's codeword.  The classifiers are naive Bayes: an n-gram weighs
the log of its share in the languages with +1 over that in those with -1, and a bit's
margin is the mean weight.  Decoding adds up the logistic loss of every bit against
each codeword and takes the least; if the runner-up is close, the text is ambiguous.

Up to ``EXHAUSTIVE`` languages have exhaustive codes, more have random ones of a fixed seed.
Training reads whole texts of at most ``train_docs`` document ids of each language,
those whose ids hash lowest (a documented bound; every text is then predicted).

Defined results: a null text and one without letters is ``und`` with score 0 and not
ambiguous; so is every text if nothing could be learned; a null language or text is not trained
on; ties go to the language first in order; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.llm.common import session, table, texts

ORDERS = (2, 3, 4)
SLOTS = 1 << 14
#: Training documents of each language.
TRAIN_DOCS = 1500
#: Texts are read in steps of so many bytes, to bound memory; all of a text counts.
STEP = 1 << 18
EXHAUSTIVE = 7
#: A runner-up with over this share of the best's probability makes a text ambiguous.
AMBIGUOUS = 0.5
SCALE = 8.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


def slots(text: str) -> np.ndarray:
    """n-gram slots of a text: SLOTS for each order."""
    data = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    out = []
    for k, n in enumerate(ORDERS):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for j in range(1, n):
            code = code * np.uint32(257) + data[j : len(data) - n + 1 + j]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - 14)
        out.append(code + np.uint32(k * SLOTS))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 and -1, no column constant."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0] * bits] + [[1.0 if (b >> (n - 2 - r)) & 1 else -1.0 for b in range(bits)] for r in range(n - 1)])
    rng = np.random.default_rng(7)
    best, width = None, int(np.ceil(12 * np.log2(n)))
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, width))
        near = np.min(width - m @ m.T + np.eye(n) * 4 * width) / 2
        if (np.abs(m.sum(axis=0)) < n).all() and (best is None or near > best[0]):
            best = (near, m)
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: list
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits

    def margins(self, text: str) -> np.ndarray:
        at = slots(text)
        total = np.zeros(self.weights.shape[1])
        for k in range(0, len(at), STEP):
            total += self.weights[at[k : k + STEP]].sum(axis=0, dtype=np.float64)
        # Bounded evidence: short texts stay unsure, long ones saturate.
        return total / len(at) * min(len(at) / len(ORDERS), 200) ** 0.5

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability and whether the decoding is ambiguous."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -self.codes * self.margins(text) * SCALE).sum(axis=1) / self.codes.shape[1] * 4
        p = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        runner = np.partition(p, -2)[-2]
        return self.languages[best], float(p[best] / p.sum()), bool(runner > AMBIGUOUS)


def train(counts: dict[str, np.ndarray]) -> Model:
    """Classifiers from n-gram counts by language."""
    languages = sorted(counts)
    codes = codewords(len(languages))
    share = np.array([counts[name] for name in languages], float).reshape(len(languages), len(ORDERS), SLOTS) + 0.5
    share /= share.sum(axis=2, keepdims=True)
    share = share.reshape(len(languages), len(ORDERS) * SLOTS)
    weights = np.zeros((share.shape[1], codes.shape[1]), np.float32)
    if len(languages) > 1:
        for b in range(codes.shape[1]):
            on = codes[:, b] > 0
            weights[:, b] = np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0))
    return Model(languages, codes, weights)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows of ``docs``; n-gram counts are added up on the executors."""
    session(docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = own.filter("lang is not null and text is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    # Twice the wanted share of each language by hash, counted first, so that no task ranks a whole language.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod("h", F.lit(1 << 30)) * F.col("n") < F.lit(train_docs * (2 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id"))
    near = ids.join(F.broadcast(sizes), "lang").filter(share).distinct()
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= train_docs).select("lang", "doc_id")
    sample = own.join(F.broadcast(chosen), ["lang", "doc_id"]).filter("text is not null").select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch, column in texts(batches):
            for name, t in zip(batch.column(0).to_pylist(), column, strict=True):
                if has_letter(t):
                    own = total.setdefault(name, np.zeros(len(ORDERS) * SLOTS, np.int64))
                    own += np.bincount(slots(t), minlength=len(own))
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "slot", "n"])

    summed = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("own"))  # at most ORDERS x SLOTS for each language
    counts = {}
    for r in lists.toLocalIterator():
        counts[r["lang"]] = np.zeros(len(ORDERS) * SLOTS, np.int64)
        at, n = zip(*r["own"], strict=True)
        counts[r["lang"]][list(at)] = n
    return train(counts)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, by default) of every row with lang_pred, score and ambiguous."""
    spark = session(docs)
    carry = docs.columns if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        known = shared.value
        for batch, column in texts(batches):
            found = [known.predict(t) for t in column]
            added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*names, "lang_pred", "score", "ambiguous"])

    schema = own.select(*names).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    out = own.mapInArrow(work, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "lang_pred", "score", "ambiguous")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id's digits leaves 2 when divided by 4 (null id: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    found = identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
