"""Format-preserving pseudonyms for personal data.

Spans are found by patterns and validated (check digits, octets, calendar dates),
and each is replaced by a keyed permutation of its own format: a Feistel network
over the digits or letters, walked until the result is valid too.  A value always
has the same pseudonym, so equal values stay linked across documents, and whoever
has the key can go back.

* card: 13 to 19 digits with a Luhn check digit, with or without separators -> the
  digits before the check digit are permuted, the check digit is made anew;
* iban: of its country's length and mod-97 checked -> account characters permuted in their classes, check made anew;
* email: letters and digits of the local part permuted, the domain stays;
* ip: dotted quad -> the 32 bits are permuted as one number;
* phone and ssn: the digits are permuted, signs and spaces stay;
* date (ISO, or day first with / or ., or month first where that is the only reading): the day is permuted among all days
  from 1900 to 2099;
* secret: long hexadecimal or mixed tokens -> characters permuted in their classes.

Numbers of 13 to 19 digits that fail the check are treated as plain account numbers
(digits permuted): better one number too many than a mistyped card left in place.
Only ASCII digits count as digits.

Defined results: a null text stays null, an empty one empty; texts without a span are
returned as they came; spans do not overlap (the leftmost, then the first kind listed
wins); equal and repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcell.llm.common import session, table, texts

#: Only for tests and the registered query; a real run passes its own.
DEMO_KEY = b"loomcell-demonstration-key"
ROUNDS = 8
#: Characters that are permuted as one number, at most.
BLOCK = 256
DIGITS = "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """Keyed permutations of [0, n), by cycle walking an unbalanced network over a*b >= n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, value: int, m: int) -> int:
        data = tweak + b"|%d|%d" % (r, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=16).digest(), "big") % m

    def _once(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * self._round(tweak, r, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, r, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The image of x, or with ``back`` what has the image x."""
        if n < 2:
            return x
        b = math.isqrt(n - 1) + 1
        a = -(-n // b)
        tag = f"{tweak}/{n}".encode()
        x = self._once(x, a, b, tag, back)
        while x >= n:
            x = self._once(x, a, b, tag, back)
        return x

    def string(self, text: str, tweak: str, back: bool = False) -> str:
        """Letters and digits permuted together, each within its class; other characters stay.

        Beyond ``BLOCK`` characters, block by block; what comes before a block goes into its key.
        """
        out, before = [], ""
        for k in range(0, len(text), BLOCK):
            part = text[k : k + BLOCK]
            new = self._block(part, tweak + before, back)
            out.append(new)
            before = "/" + hashlib.blake2b((before + (new if back else part)).encode(), digest_size=16).hexdigest()
        return "".join(out)

    def _block(self, text: str, tweak: str, back: bool) -> str:
        classes = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), None) for c in text]
        value, n = 0, 1
        for c, s in zip(text, classes, strict=True):
            if s:
                n *= len(s)
                value = value * len(s) + s.index(c)
        value = self.permute(value, n, tweak + "/" + "".join("." if s is None else s[0] for s in classes), back)
        out = []
        for c, s in zip(reversed(text), reversed(classes), strict=True):
            if s:
                value, k = divmod(value, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def _card(f: Feistel, text: str, back: bool) -> str:
    digits = re.sub("[^0-9]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return _account(f, text, back)
    payload = f.string(digits[:-1], "card", back)
    return _refill(text, payload + luhn_digit(payload))


def _account(f: Feistel, text: str, back: bool) -> str:
    """Digits permuted among those of the same length that are not valid cards, so that the two kinds never meet."""
    digits = re.sub("[^0-9]", "", text)
    while True:
        digits = f.string(digits, "account", back)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return _refill(text, digits)


def _number(f: Feistel, text: str, back: bool) -> str:
    return _refill(text, f.string(re.sub("[^0-9]", "", text), "number", back))


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    rest = f.string(plain[4:], "iban/" + plain[:2], back)
    it = iter(plain[:2] + _iban_check(plain[:2], rest) + rest)
    return "".join(c if c == " " else next(it) for c in text)


#: Characters of an IBAN by country.
IBAN_LENGTH = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FK,FO,FI,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for c in cs.split(",")}


def _iban_pattern() -> str:
    """As many characters as the country has; for a country that is not in the table, as many as follow."""
    exact = "|".join(f"(?:{'|'.join(c for c in IBAN_LENGTH if IBAN_LENGTH[c] == n)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTH.values())))
    return rf"(?<!\w)(?=[A-Z]{{2}}[0-9]{{2}})(?:{exact}|(?!{'|'.join(IBAN_LENGTH)})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?!\w)"


def _iban_ends(text: str) -> list[int]:
    """Where an IBAN at the start of a match may end: at any word, longest first, if its country's length is not known."""
    if text[:2] in IBAN_LENGTH:
        return [len(text)]
    return [m.end() for m in re.finditer(r"[A-Z0-9](?![A-Z0-9])", text)][::-1]


def _email(f: Feistel, text: str, back: bool) -> str:
    local, _, domain = text.rpartition("@")
    return f"{f.string(local, 'email', back)}@{domain}"


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


FIRST = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST).days


def _date(f: Feistel, text: str, back: bool) -> str | None:
    parts = re.split(r"([-/.])", text)
    year_first = len(parts[0]) == 4
    y, m, d = (int(p) for p in (parts[::2] if year_first else parts[::-2]))
    month_first = not year_first and d <= 12 < m
    if month_first:
        m, d = d, m
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    if not 0 <= (day - FIRST).days < DAYS:
        return None
    new = FIRST + datetime.timedelta(f.permute((day - FIRST).days, DAYS, "date", back))
    while month_first and new.day <= 12:  # its pseudonym must not read as day first
        new = FIRST + datetime.timedelta(f.permute((new - FIRST).days, DAYS, "date", back))
    out = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
    if month_first:
        out = [out[1], out[2], out[0]]
    elif not year_first:
        out.reverse()
    return parts[1].join(out)


def _secret(f: Feistel, text: str, back: bool) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        x = f.permute(int(text, 16), 16 ** len(text), f"hex/{len(text)}", back)
        out = f"{x:0{len(text)}x}"
        return out.upper() if re.search("[A-F]", text) else out
    return f.string(text, "secret", back)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Kinds in the order of precedence: (name, pattern, replacement).
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", _iban_pattern(), _iban),
    ("date", r"(?<![\w./-])(?:(?:19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|(?:19|20)[0-9][0-9]/[0-9][0-9]/[0-9][0-9]|[0-9][0-9]/[0-9][0-9]/(?:19|20)[0-9][0-9]|[0-9][0-9]\.[0-9][0-9]\.(?:19|20)[0-9][0-9])(?![\w/-])", _date),
    ("ip", r"(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\w]|\.[0-9])", _ip),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _number),
    ("card", r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?!\w)", _card),
    ("secret", r"(?<!\w)(?=\w*[0-9])(?=\w*[A-Za-z])(?:[0-9a-f]{24,128}|[0-9A-F]{24,128}|(?:sk|pk|ghp|gho|AKIA|xox[bp])[\w-]{12,100})(?!\w)", _secret),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{2,4}\)[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w|[.-][0-9])|(?<![\w.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w.-]?[0-9])", _number),
]
#: One pass finds all kinds, in the neighbourhood of digits and @ signs: nothing else holds a span.
PATTERN = re.compile("|".join(f"(?P<{name}>{p})" for name, p, _ in KINDS))
HINT, BLANK = re.compile("[0-9@]+"), re.compile(r"\s|$")
#: No span has a stretch of so many characters without a hint, or goes on for so long after its last one (but for the rest of its token).
STRETCH = 40
ACTIONS = {name: action for name, _, action in KINDS}


SINGLE = {name: re.compile(p) for name, p, _ in KINDS}


def replacement(text: str, m: re.Match, end: int, feistel: Feistel, back: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first kind, from that of the match on, that is valid at the start of a match."""
    names = list(ACTIONS)
    for name in names[names.index(m.lastgroup) :]:
        own = m if name == m.lastgroup else SINGLE[name].match(text, m.start(), end)
        if own is None:
            continue
        for size in _iban_ends(own[0]) if name == "iban" else (len(own[0]),):
            new = ACTIONS[name](feistel, own[0][:size], back)
            if new is not None:
                return name, m.start() + size, new
    return None


def regions(text: str):
    """(start, end) of the parts of a text that may hold spans, at white space; every character is looked at a bounded number of times."""
    low = 0
    hint = HINT.search(text)
    while hint:
        start = max(low, max(text.rfind(c, low, hint.start()) for c in " \n\t") + 1)
        end = hint.end()
        while hint:
            while (hint := HINT.search(text, end, end + STRETCH)) is not None:
                end = hint.end()
            low = BLANK.search(text, min(len(text), end + STRETCH)).start()
            hint = HINT.search(text, end, low)
            end = low
        yield start, low
        hint = HINT.search(text, low)


def pseudonymise(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each span in the original."""
    out, spans, at = [], [], 0
    for start, end in regions(text):
        m = PATTERN.search(text, start, end)
        while m:
            found = replacement(text, m, end, feistel, back)
            if found is None:
                m = PATTERN.search(text, m.start() + 1, end)
                continue
            kind, stop, new = found
            out += [text[at : m.start()], new]
            at = stop
            spans.append((kind, m.start(), stop))
            m = PATTERN.search(text, stop, end)
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text", carry: list[str] | None = None, back: bool = False) -> DataFrame:
    """The carried columns (all but the text, by default), then pii_text and pii_spans: array of (kind, start, end) in code points."""
    session(docs)
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(f"`{text}`").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        feistel = Feistel(key)
        for batch, column in texts(batches):
            done = [(None, []) if t is None else pseudonymise(t, feistel, back) for t in column]
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in done], pa.string()), pa.array(found, span)], [*names, "pii_text", "pii_spans"])

    schema = own.select(*names).schema.add("pii_text", "string").add("pii_spans", SPANS)
    out = own.mapInArrow(work, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "pii_text", "pii_spans")


def pseudonymous_documents(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in their text column, other columns as they came."""
    rest = [c for c in docs.columns if c != text]
    done = pseudonyms(docs, key, text, rest)
    done = done.toDF(*[f"_lc_{k}" for k in range(len(done.columns))])
    place = {c: f"_lc_{k}" for k, c in enumerate([*rest, text])}
    return done.select(*[F.col(place[c]).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("doc_id", F.col("pii_text").alias("text"), F.size("pii_spans").cast("long").alias("n_spans"), F.concat_ws(",", "pii_spans.kind").alias("kinds"))
