from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from loomcell.llm import tokencount

SCHEMA = "doc_id long, text string, n_words string, c0 string"


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abcd", max_size=14), max_size=8))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_greedy_matching(initial, continuing, words):
    model = tokencount.Automaton(initial, continuing)
    for w in words:
        assert model.count(w) == greedy(w, initial, continuing), w


def test_public_vocabulary_equals_word_piece():
    initial, continuing = tokencount.vocabulary()
    vocab = {p: k for k, p in enumerate(["[UNK]", *initial, *("##" + p for p in continuing)])}
    plain = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    model = tokencount.automaton(None)
    for w in ["the", "untokenizable", "Straße", "x" * 300, "Éan", "汉字", "123456", "ñciónmente", "!", "thedtiouanon"]:
        assert model.count(w) == len(plain.encode(w).ids), w


def test_documents(spark):
    rows = [(1, "The the, the!\tx_y", "a", None), (1, "The the, the!\tx_y", "a", None), (2, None, None, None), (3, " \n", "", ""), (None, "ab " * 40000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = tokencount.token_counts(docs, carry=["doc_id"]).collect()
    model = tokencount.automaton(None)
    want = sum(model.count(w) for w in ["The", "the", ",", "the", "!", "x", "_", "y"])
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got) == sorted([("1", 8, want)] * 2 + [("2", 0, 0), ("3", 0, 0), ("None", 40000, 40000 * model.count("ab"))])
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
