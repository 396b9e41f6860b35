"""Nucleotide strings as column expressions: A C G T, anything else N (code 4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGTN"


def normalise(seq: Column) -> Column:
    """Upper case, with everything but A C G T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def contains_n(seq: Column) -> Column:
    return normalise(seq).contains("N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(normalise(seq), "ACGT", "TGCA"))


def encode(seq: Column, base: int = 5) -> Column:
    """The code of a sequence, first letter in the highest place; null with base 4 if it has an N."""
    digits = F.translate(normalise(seq), LETTERS, "01234")
    code = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("long")), F.lit(0).cast("long"), lambda a, d: a * base + d)
    return code if base == 5 else F.when(~digits.contains("4"), code)


def digit(code: Column, place: int, base: int = 5) -> Column:
    """The digit at a place counted from the end, in whole numbers (codes may pass 2^53)."""
    low = code % F.lit(base**place)
    return F.call_function("div", code - low, F.lit(base**place).cast("long")) % base


def decode(code: Column, length: int, base: int = 5) -> Column:
    """The sequence of a code; one expression of constant size, as the optimizer walks a copy for each letter many times."""
    powers = F.array(*[F.lit(base**k).cast("long") for k in reversed(range(length))])
    letters = F.transform(powers, lambda p: F.substring(F.lit(LETTERS), (F.call_function("div", code - code % p, p) % base).cast("int") + 1, F.lit(1)))
    return F.when(code.isNotNull(), F.array_join(letters, ""))


def neighbours(seq: Column, length: int) -> Column:
    """All sequences with one letter exchanged for another of A C G T; none gets a new N."""
    others = lambda p: F.filter(F.array(*map(F.lit, "ACGT")), lambda c: c != F.substring(seq, p, F.lit(1)))
    changed = lambda p, c: F.concat(F.substring(seq, F.lit(1), p - 1), c, F.substring(seq, p + 1, F.lit(length)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda p: F.transform(others(p), lambda c: changed(p, c))))


def code_neighbours(code: Column, length: int) -> Column:
    """The same for codes of two bits a letter."""
    return F.array(*[code.bitwiseXOR(F.lit(d << 2 * p).cast("long")) for p in range(length) for d in (1, 2, 3)])


def pack_key(umi: Column, gene: Column, bits: int = 22) -> Column:
    """umi and gene in one long."""
    return F.shiftleft(umi.cast("long"), bits).bitwiseOR(gene.cast("long"))


def unpack_key(key: Column, bits: int = 22) -> tuple[Column, Column]:
    return F.shiftright(key, bits), key.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def clamp_mapq(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(60), x))
