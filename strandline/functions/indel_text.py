"""The text that says which residues were inserted or deleted, e.g. 'd: A[2,4]'."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _removable(long: str, short: str) -> range:
    """Indexes whose removal turns `long` into `short` (one longer): one run, maybe empty."""
    n, ahead, behind = len(short), 0, 0
    while ahead < n and long[ahead] == short[ahead]:
        ahead += 1
    while behind < n and long[-1 - behind] == short[-1 - behind]:
        behind += 1
    return range(n - behind, ahead + 1)


def edit_entries(query: str, matched: str) -> list[tuple[str, int, int]]:
    """(residues, low, high) of each edit, positions from 1 and in the query.

    Both kinds of edit remove residues from the longer string.  Index i is
    position i + 1; behind an earlier insertion it is one less, as that residue
    is none of the query's.  Edits never touch the query's ends.
    """
    deletion = len(matched) < len(query)
    long, short = (query, matched) if deletion else (matched, query)
    lowest, highest = 2, len(query) - 1 if deletion else len(query)
    if len(long) - len(short) == 1:
        spots = [i for i in _removable(long, short) if lowest <= i + 1 <= highest]
        return [(long[spots[0]], spots[0] + 1, spots[-1] + 1)] if spots else []
    if len(long) - len(short) != 2:
        return []
    shift = 1 if deletion else 0
    pairs = []
    for i in range(len(long)):
        for j in _removable(long[:i] + long[i + 1 :], short):
            if j >= i and lowest <= i + 1 and j + 1 + shift <= highest and j + 1 + shift >= lowest:
                pairs.append((i, j + 1))
    joint = sorted({(i + 1, long[i] + long[j]) for i, j in pairs if j == i + 1})
    if joint:  # one event of two residues; starts are one range while the residues are the same
        out: list[tuple[str, int, int]] = []
        for at, residues in joint:
            if out and out[-1][0] == residues and out[-1][2] == at - 1:
                out[-1] = (residues, out[-1][1], at)
            else:
                out.append((residues, at, at))
        return out
    if not pairs:
        return []
    ones, twos = sorted(i + 1 for i, _ in pairs), sorted(j + shift for _, j in pairs)
    return [(long[pairs[0][0]], ones[0], ones[-1]), (long[pairs[0][1]], twos[0], twos[-1])]


def describe(query: str, matched: str) -> str:
    kind = "d" if len(matched) < len(query) else "i"
    shown = [f"{kind}: {r}[{a}]" if a == z else f"{kind}: {r}[{a},{z}]" for r, a, z in edit_entries(query, matched)]
    return ", ".join(shown) if shown else "[]"


@F.pandas_udf(StringType())
def _describe(query: pd.Series, matched: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else describe(q, m) for q, m in zip(query, matched, strict=True)], dtype=object)


def indel_positions(query: Column, matched: Column) -> Column:
    """Text for each (query, matched) pair; null where nothing matched.

    Repeats make equivalent placements, which the built-in functions cannot
    enumerate readably; it runs on final hits only, in Arrow batches.
    """
    return _describe(query, matched)
