import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcell.llm import pii

F = pii.Feistel(b"k1")
SCHEMA = "doc_id long, pii_text string, text string, c0 string"


@pytest.mark.parametrize("n", [1, 2, 7, 100, 365, 1000, 12345])
def test_permutation_and_back(n):
    images = [F.permute(x, n, "t") for x in range(n)]
    assert sorted(images) == list(range(n))
    assert [F.permute(y, n, "t", back=True) for y in images] == list(range(n))


@given(st.from_regex(r"[a-zA-Z0-9._+-]{1,30}", fullmatch=True))
@settings(deadline=None)
def test_strings_keep_their_format(text):
    new = F.string(text, "x")
    assert F.string(new, "x", back=True) == text
    assert [re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t))) for t in (new,)] == [re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text)))]


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "1234567890123456"],
    "email": ["the.92@mail2.example.com", "A_b+c@x.org"],
    "ip": ["192.168.10.254", "8.8.8.8"],
    "phone": ["+1 (499) 555-6503", "+49 30 1234567", "(030) 123-4567"],
    "ssn": ["078-05-1120"],
    "date": ["1999-12-31", "29/02/2000", "01.05.1987"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "secret": ["1eb9c654e721b4f812088970e66a6345cee33dd6"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
@pytest.mark.parametrize("frame", ["{}", "see {}, or", "é ({}).\nnext", '= "{}"### a', "{}!! OF"])
def test_each_kind_is_found_replaced_and_restored(kind, value, frame):
    text = frame.format(value)
    new, spans = pii.pseudonymise(text, F)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, value)]
    assert value not in new and len(new) == len(text) or kind == "ip"
    again, found = pii.pseudonymise(new, F, back=True)
    assert again == text and [k for k, *_ in found] == [kind]


@pytest.mark.parametrize("local", ["a" * 100_000, "aB9." * 2_000 + "x", "9" * 5_000])
def test_long_values_keep_their_format_and_come_back(local):
    text = f"to {local}@example.com!"
    new, spans = pii.pseudonymise(text, F)
    assert spans == [("email", 3, len(text) - 1)] and new != text and len(new) == len(text)
    kind = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    assert kind(new) == kind(text) and pii.pseudonymise(new, F, back=True)[0] == text
    other = pii.pseudonymise("to " + ("b" if local[0] == "a" else "1") + local[1:] + "@example.com!", F)[0]
    assert other[3 + pii.BLOCK : 3 + 2 * pii.BLOCK] != new[3 + pii.BLOCK : 3 + 2 * pii.BLOCK]


def test_cards_stay_valid_and_values_stay_linked():
    new, _ = pii.pseudonymise("4111111111111111 and 4111-1111-1111-1111 and 4111111111111111", F)
    a, b, c = new.split(" and ")
    assert a == c == b.replace("-", "") and pii.luhn_digit(a[:-1]) == a[-1] and a != "4111111111111111"
    assert pii.pseudonymise("4111111111111111", pii.Feistel(b"k2"))[0] != a


@pytest.mark.parametrize("text", ["", "no data", "version 3.1.4", "999.1.1.1", "2023-13-45", "12345", "a@b", "item 10 of 20", "x" * 5000])
def test_clean_texts_stay(text):
    assert pii.pseudonymise(text, F) == (text, [])


def test_documents(spark):
    mail = "the.92@mail2.example.com"
    rows = [(1, "kept", f"write to {mail}", None), (1, "kept", f"write to {mail}", None), (2, None, None, "x"), (None, "", "", ""), (3, "", "w " * 60000 + mail, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.pseudonymous_documents(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == 5 and not any(mail in (r.text or "") for r in out)
    assert {r.pii_text for r in out if r.doc_id == 1} == {"kept"} and [r.text for r in out if r.doc_id == 2] == [None]
    ends = {r.text.split()[-1] for r in out if r.doc_id in (1, 3)}
    assert len(ends) == 1
    spans = pii.pseudonyms(docs, carry=["doc_id"]).collect()
    assert {tuple(map(tuple, r.pii_spans)) for r in spans if r.doc_id == 1} == {(("email", 9, 33),)}
    assert pii.pseudonymous_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.sampled_from(["a", "é", " ", "\n", "1", "23", "4111111111111111", "@", "x.org", "+1 (499) 555-6503", ".", "-", "(", "DE89 3704 0044 0532 0130 00", "٣", "w" * 50, "2020-01-02"]), max_size=40).map("".join))
@settings(deadline=None, max_examples=300)
def test_neighbourhoods_find_what_a_scan_of_the_whole_text_finds(text):
    whole = [(m.lastgroup, m.start(), m.end()) for m in pii.PATTERN.finditer(text)]
    whole = [s for s in whole if pii.ACTIONS[s[0]](F, text[s[1] : s[2]], False) is not None]
    assert pii.pseudonymise(text, F)[1] == whole


@pytest.mark.parametrize("part", ["a", "1", "@", "1 ", "a1", "a.", "1a@", "a%", "(12)", "1-"])
def test_long_texts_take_linear_time(part):
    assert len(pii.pseudonymise(part * 100_000 + "é", F)[0]) >= 100_000


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013000 EUR 50", "iban", "DE89370400440532013000"),
        ("NO12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
        ("on 12/31/2001.", "date", "12/31/2001"),
    ],
)
def test_what_follows_or_fails_hides_no_value(text, kind, value):
    new, spans = pii.pseudonymise(text, F)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, value)] and value not in new
    assert pii.pseudonymise(new, F, back=True)[0] == text
