"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word takes its longest prefix in the vocabulary, then the
longest continuation piece, and so on; if that gets stuck, the whole word is one
unknown token.  A trie of the vocabulary gets failure links and, with each, the
number of pieces that are popped on the way: failing at a node means that the
longest piece matched so far, and perhaps more behind it, is now certain.  Adding
those precomputed numbers gives the count in one pass over the characters, without
building a piece.

A text is cut at white space, and runs of letters and digits are cut from each
other character, which is a word of its own.  Words repeat, so each task remembers
the counts of the words it has seen, within a bound.

Defined results: a null or empty text, and one without words, has 0 tokens;
repeated rows are counted alike, row by row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.llm.common import session, table, texts

WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Words remembered in each task, at most.
MEMO = 400_000
#: Longer words are not remembered.
MEMO_CHARS = 40


class Automaton:
    """Counts of greedy word pieces; ``initial`` pieces begin a word, ``continuing`` ones follow."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        # Node 0 starts a word, node 1 is where continuation pieces start.
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                if piece:
                    final[at] = True
        #: Where to go on after a mismatch (-1: stuck), and the pieces that are certain by then.
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [0, 1]
        for at in queue:
            for c, to in self.next[at].items():
                if final[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    back, n = self.fail[at], self.popped[at]
                    while back != -1 and c not in self.next[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    if back != -1:
                        self.fail[to], self.popped[to] = self.next[back][c], n
                queue.append(to)

    def count(self, word: str) -> int:
        """Pieces of a word, 1 if it has none (the unknown token), 0 for an empty one."""
        if not word:
            return 0
        at, n = 0, 0
        for c in word:
            while (to := self.next[at].get(c)) is None:
                n += self.popped[at]
                at = self.fail[at]
                if at == -1:
                    return 1
            at = to
        while at != 1:  # what is still pending must end on whole pieces
            n += self.popped[at]
            at = self.fail[at]
            if at == -1:
                return 1
        return n


def vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a sentence-piece model: a piece with the word mark begins a word."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    initial, continuing = [], []
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k)
        if piece.startswith("▁"):
            initial.append(piece[1:])
        else:
            continuing.append(piece)
    return [p for p in initial if p], [p for p in continuing if "▁" not in p]


@lru_cache(2)
def automaton(path: str | None) -> Automaton:
    """One for each worker process."""
    return Automaton(*vocabulary(path))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, by default) of every row with n_words and n_tokens."""
    session(docs)
    carry = docs.columns if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("text"))

    def count(batches):
        model = automaton(path)
        memo: dict[str, int] = {}
        for batch, column in texts(batches):
            words, tokens = [], []
            for t in column:
                found = WORD.findall(t or "")
                n = 0
                for word, k in Counter(found).items():
                    one = memo.get(word)
                    if one is None:
                        one = model.count(word)
                        if len(word) <= MEMO_CHARS:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[word] = one
                    n += k * one
                words.append(len(found))
                tokens.append(n)
            added = [pa.array(np.array(x, np.int64)) for x in (words, tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*names, "n_words", "n_tokens"])

    out = own.mapInArrow(count, own.select(*names).schema.add("n_words", "long").add("n_tokens", "long"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_words", "n_tokens")


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), carry=["doc_id"])
