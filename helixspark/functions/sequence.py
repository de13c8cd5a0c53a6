"""Functions of sequences, as Column expressions."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALPHABET = "ATGCRYSWKMBDHVN-"


def count_of(seq: Column, bases: str) -> Column:
    """How many of the bases (any case) there are."""
    return (F.length(seq) - F.length(F.translate(F.upper(seq), bases, ""))).cast("long")


def is_valid(seq: Column, least: int = 10) -> Column:
    """Not empty, long enough, and of IUPAC letters only."""
    return F.coalesce(seq.isNotNull() & (F.length(seq) >= least) & F.upper(seq).rlike(f"^[{ALPHABET}]+$"), F.lit(False))


def validity(seq: Column, least: int = 10) -> Column:
    return F.when(seq.isNull() | (F.length(seq) == 0), "empty").when(~F.upper(seq).rlike(f"^[{ALPHABET}]+$"), "invalid characters").when(F.length(seq) < least, "too short").otherwise("valid")


def revcomp(seq: Column) -> Column:
    """Reverse complement of A, C, G and T in either case; other letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def reverse_complement(seq: Column) -> Column:
    """IUPAC reverse complement, upper-cased. S and W change places (kept for equal results)."""
    return F.reverse(F.translate(F.upper(seq), "ATGCRYSWKMBVDHN-", "TACGYRWSMKVBHDN-"))


def gc_content(seq: Column) -> Column:
    """Per cent of G and C among A, C, G and T; 0 without any."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, count_of(seq, "GC") * 100.0 / known).otherwise(0.0)


def at_content(seq: Column) -> Column:
    """Counted per cent of A and T; 0 without A, C, G or T."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, count_of(seq, "AT") * 100.0 / known).otherwise(0.0)


def at_complement(seq: Column) -> Column:
    """100 less the GC content: 100 for a sequence of ambiguous bases."""
    return 100.0 - gc_content(seq)


def gc_of_total(seq: Column) -> Column:
    """Per cent of G and C among all letters, N too."""
    return F.when(F.length(seq) > 0, count_of(seq, "GC") * 100.0 / F.length(seq)).otherwise(0.0)


def gc_balance(seq: Column) -> Column:
    gc = gc_content(seq)
    return F.when(gc > 60, "GC-rich").when(gc < 40, "AT-rich").otherwise("balanced")


def is_palindrome(seq: Column) -> Column:
    return F.upper(seq) == reverse_complement(seq)


def melting_temperature(seq: Column) -> Column:
    """Wallace's rule up to 13 bases, the GC formula above."""
    n = F.length(seq)
    gc = count_of(seq, "GC")
    return F.when(n < 2, 0.0).when(n <= 13, 2.0 * count_of(seq, "AT") + 4.0 * gc).otherwise(64.9 + 41.0 * gc / n - 650.0 / n)


def invalid_characters(seq: Column) -> Column:
    """Distinct letters outside of the alphabet, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.upper(seq), ""), lambda c: (c != "") & ~F.lit(ALPHABET).contains(c)))), "")


def invalid_positions(seq: Column, at_most: int = 10) -> Column:
    """The first places (from 1) of letters outside of the alphabet: a report of a stated length."""
    letters = F.split(F.upper(seq), "")
    return F.slice(F.filter(F.sequence(F.lit(1), F.length(seq)), lambda i: ~F.lit(ALPHABET).contains(F.get(letters, i - 1))), 1, at_most)


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def shortened(seq: Column, limit: int = 50) -> Column:
    return F.when(F.length(seq) > limit, F.concat(F.substring(seq, 1, limit - 3), F.lit("..."))).otherwise(seq)


def shuffled(seq: Column, seed: int) -> Column:
    """The letters in random order, the same for a seed. Not the order that another generator gives."""
    return F.array_join(F.shuffle(F.split(seq, ""), seed), "")


def shortest_unit(s: str) -> str:
    """The prefix as long as the least period, if that is half the length at most; else all of s. Linear: by borders."""
    border, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = border[k - 1]
        k += s[i] == s[k]
        border[i] = k
    period = len(s) - k
    return s[:period] if 2 * period <= len(s) else s


@F.pandas_udf(StringType())
def _shortest_units(seq: pd.Series) -> pd.Series:
    return seq.map(shortest_unit, na_action="ignore")


def primitive_unit(seq: Column) -> Column:
    """The shortest prefix, of half the length at most, that repeats through the sequence (a partial tail is allowed)."""
    return _shortest_units(seq)


def normalize_score(raw: Column, least: float | Column, most: float | Column, length: Column, cap: float) -> Column:
    """Raw scores on the common scale of 1 to 3: 1 + 2 x place in the raw range x length against a cap."""
    least, most = (x if isinstance(x, Column) else F.lit(float(x)) for x in (least, most))
    place = F.when(most == least, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - least) / (most - least))))
    return F.round(F.least(F.lit(3.0), 1.0 + 2.0 * place * F.least(F.lit(1.0), length / float(cap))), 3)
