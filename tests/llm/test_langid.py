import zlib

import numpy as np
import pytest

from loomcell.llm import langid
from loomcell.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, c0 string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 9, 30])
def test_codewords_are_distinct_and_useful(n):
    m = langid.codewords(n)
    assert len(np.unique(m, axis=0)) == n and set(np.unique(m)) <= {-1.0, 1.0}
    if n > 1:
        assert (np.abs(m.sum(axis=0)) < n).all()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.op8_langid(spark, SF).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(k, "the quick brown fox of the north " * 3, "en", "", "") for k in range(30)] + [(100 + k, "der schnelle braune Fuchs und das", "de", "", "") for k in range(30)]
    docs = spark.createDataFrame([*rows, (1, "x", None, "", ""), (2, None, "en", "", ""), (2, None, "en", "", "")], SCHEMA)
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    odd = [(1, None, None, "", ""), (1, None, None, "", ""), (2, "", "", "", ""), (3, "12 %%\n", "", "", ""), (None, "das ist der Fuchs", "", "", ""), (5, "the north of " * 90000, "", "", ""), (6, "汉字", "", "", "")]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(odd, SCHEMA), model, carry=["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en")} <= got
    empty = langid.fit(spark.createDataFrame([], SCHEMA))
    assert empty.languages == [] and empty.predict("the") == ("und", 0.0, False)
    assert langid.identify(spark.createDataFrame([], SCHEMA), model, carry=["doc_id"]).count() == 0
    assert model.predict("a")[1] < model.predict("the quick brown fox of the north")[1]
