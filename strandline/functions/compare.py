"""Comparisons of short sequences as column expressions (bytes, as residues are ASCII)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this length comparisons are unrolled and stay in generated code.
UNROLL = 24


def part(s: Column, start, size) -> Column:
    """Bytes [start, start + size) of a binary column, from 0; constant time, unlike on strings."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(s, start + 1, F.lit(size) if isinstance(size, int) else size)


def hamming(s: Column, start: Column, q: Column, size: Column, longest: int) -> Column:
    """Number of bytes in which q differs from the `size` (at most `longest`) bytes of s from `start` on.

    Bytes are read from the sequence in place: a window cut out first would be
    inlined into every term.
    """
    if longest <= UNROLL:
        same = lambda i: part(s, start + i, 1) == part(q, i, 1)
        terms = [F.when((size <= i) | same(i), 0).otherwise(1) for i in range(longest)]
        return sum(terms[1:], terms[0]) if terms else F.lit(0)
    places = F.sequence(F.lit(0), size - 1)
    return F.size(F.filter(places, lambda i: part(s, start + i, 1) != part(q, i, 1)))


def mutated_positions(a: Column, b: Column) -> Column:
    """'[i, j]', from 1, of the differing positions; '[]' if none."""
    places = F.sequence(F.lit(1), F.octet_length(a))
    wrong = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.concat(F.lit("["), F.array_join(wrong.cast("array<string>"), ", "), F.lit("]"))


def is_subsequence(short: Column, long: Column, most: int) -> Column:
    """Whether `short` can be had from `long` by leaving out residues, `most` at most (bytes).

    It can if and only if the edit distance is the difference in length.  A
    built-in function, unlike a scan by higher-order functions, stays in
    generated code: no row is made, with its copy of the sequence, to be tested.
    """
    text = lambda c: F.decode(c, "ISO-8859-1")
    return F.levenshtein(text(short), text(long), most) == F.octet_length(long) - F.octet_length(short)
