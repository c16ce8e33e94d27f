"""Exact, substitution and indel search as a seed join with verification.

Two physical forms give the same candidates.  With few queries (their size is
checked) the seeds are broadcast and the scan of the sequences explodes, probes
and verifies in one stage without any shuffle.  With many queries, or a stored
k-mer table, narrow k-mer rows are joined to the seeds by shuffle and the
sequences are joined back for verification.

Hits have: ordinal, protein_num, start (from 0), matched, edits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import hamming, is_subsequence, part
from ..session import BROADCAST_BYTES
from .kmers import kmers, seeds, windows

SEED_BYTES = 160


@dataclass(frozen=True)
class QueryStats:
    """What planning needs to know of a batch: one small aggregate."""

    n: int
    shortest: int
    longest: int

    @classmethod
    def of(cls, queries: DataFrame) -> QueryStats:
        size = F.octet_length("query_seq")
        row = queries.agg(F.count("*"), F.min(size), F.max(size)).first()
        return cls(row[0], row[1] or 0, row[2] or 0)

    def seeds_fit(self, per_query: int) -> bool:
        return self.n * per_query * SEED_BYTES <= BROADCAST_BYTES


def candidates(
    proteins: DataFrame, queries: DataFrame, k: int, regime: str, stats: QueryStats, index: DataFrame | None = None
) -> DataFrame:
    """ordinal, q, len, at, protein_num, seq, pos: every place where a seed stands."""
    probes = seeds(queries, k, regime)
    per_query = max(1, stats.longest - k + 1) if regime != "first" else 1
    if index is None and stats.seeds_fit(per_query):
        found = windows(proteins, k).withColumn("kmer", part(F.col("seq"), F.col("pos"), k).cast("string"))
        return found.join(F.broadcast(probes), "kmer").drop("kmer")
    table = kmers(proteins, k) if index is None else index
    probes = F.broadcast(probes) if stats.seeds_fit(per_query) else probes
    found = table.select("kmer", "protein_num", "pos").join(probes, "kmer").drop("kmer")
    return found.join(proteins.select("protein_num", F.col("sequence").cast("binary").alias("seq")), "protein_num")


def _windowed(found: DataFrame) -> DataFrame:
    """Candidate windows (`start`, `w`) that lie inside their sequence."""
    found = found.withColumn("start", F.col("pos") - F.col("at"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.octet_length("seq"))
    return found.filter(inside).withColumn("w", F.substring("seq", F.col("start") + 1, F.col("len")))


def _hits(found: DataFrame, edits: Column) -> DataFrame:
    return found.select("ordinal", "protein_num", "start", F.col("w").cast("string").alias("matched"), edits.cast("long").alias("edits"))


def within(found: DataFrame, k: int, budget: int | None, longest: int) -> DataFrame:
    """Windows with `edits` within the budget, each once.

    A window is kept for the first of its query's seeds that stands in place.
    That is decided from the row itself, after the count of differences, so the
    few rows left need no shuffle to become distinct.
    """
    edits = hamming(F.col("seq"), F.col("start"), F.col("q"), F.col("len"), longest)
    step = F.when(F.col("len") % k == 0, k).otherwise(1)
    before = F.when(F.col("at") > 0, F.sequence(F.lit(0), F.col("at") - step, step)).otherwise(F.array().cast("array<int>"))
    again = F.exists(before, lambda o: part(F.col("seq"), F.col("start") + o, k) == part(F.col("q"), o, k))
    found = _windowed(found).withColumn("edits", edits)
    return found.filter(~again if budget is None else (F.col("edits") <= budget) & ~again)


def exact_hits(proteins: DataFrame, queries: DataFrame, k: int, stats: QueryStats | None = None, index: DataFrame | None = None) -> DataFrame:
    """Every place where a query stands: one candidate each, from its first k-mer, so nothing to make distinct."""
    stats = stats or QueryStats.of(queries)
    found = _windowed(candidates(proteins, queries, k, "first", stats, index))
    return _hits(found.filter(F.col("w") == F.col("q")), F.lit(0))


def exact_hits_by_voting(proteins: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same hits as an aggregate: starts that all seeds of a query agree on."""
    stats = QueryStats.of(queries)
    found = _windowed(candidates(proteins, queries, k, "cover", stats))
    votes = found.groupBy("ordinal", "protein_num", "start", "w", "len").agg(F.count_distinct("at").alias("votes"))
    n_seeds = F.ceil(F.col("len") / k)
    return _hits(votes.filter(F.col("votes") == n_seeds), F.lit(0))


def mismatch_hits(
    proteins: DataFrame, queries: DataFrame, k: int, budget: int, stats: QueryStats | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Windows within `budget` substitutions of a query that share one of its seeds in place.

    Complete if the query has at least k * (budget + 1) residues; shorter ones
    keep the seed condition.  Budget 0 is the exact search.
    """
    if budget == 0:
        return exact_hits(proteins, queries, k, stats, index)
    stats = stats or QueryStats.of(queries)
    found = within(candidates(proteins, queries, k, "tiled", stats, index), k, budget, stats.longest)
    return _hits(found, F.col("edits"))


def _splits(budget: int) -> Column:
    """How many edits fall left and right of a seed: negative for deletions, positive for insertions."""
    table = [(0, 0)] + [
        (sign * left, sign * right)
        for sign in (-1, 1) for left in range(budget + 1) for right in range(budget + 1 - left) if left + right
    ]
    return F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in table])


def _side(a: Column, b: Column, last: bool, budget: int) -> Column:
    """Whether b comes from a by edits of one kind that spare the outer residue."""
    n, m = F.octet_length(a), F.octet_length(b)
    outer = F.substring(a, n, F.lit(1)) == F.substring(b, m, F.lit(1)) if last else part(a, 0, 1) == part(b, 0, 1)
    edited = (n > 0) & (m > 0) & (n != m) & outer
    return (a == b) | (edited & F.when(n < m, is_subsequence(a, b, budget)).otherwise(is_subsequence(b, a, budget)))


def indel_hits(
    proteins: DataFrame, queries: DataFrame, k: int, budget: int, stats: QueryStats | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Windows that come from a query by up to `budget` insertions, or by as many deletions, never both.

    The query's first and last residue stay.  A place of a seed is extended to
    both sides for every split of the edits between them.
    """
    stats = stats or QueryStats.of(queries)
    found = candidates(proteins, queries, k, "cover", stats, index).withColumn("split", F.explode(_splits(budget)))
    left, right = F.col("split.l"), F.col("split.r")
    found = found.withColumn("start", F.col("pos") - F.col("at") - left)
    found = found.withColumn("stop", F.col("pos") + F.col("len") - F.col("at") + right)
    found = found.filter(
        (F.col("start") >= 0) & (F.col("start") <= F.col("pos")) & (F.col("pos") + k <= F.col("stop"))
        & (F.col("stop") <= F.octet_length("seq"))
        # cheap necessary conditions first: the outer residues
        & (part(F.col("seq"), F.col("start"), 1) == part(F.col("q"), 0, 1))
        & (part(F.col("seq"), F.col("stop") - 1, 1) == F.substring("q", F.col("len"), F.lit(1)))
    )
    cut = lambda s, a, z: F.substring(F.col(s), a + 1, z - a)
    ok = _side(cut("q", F.lit(0), F.col("at")), cut("seq", F.col("start"), F.col("pos")), False, budget) & _side(
        cut("q", F.col("at") + k, F.col("len")), cut("seq", F.col("pos") + k, F.col("stop")), True, budget
    )
    found = found.filter(ok).withColumn("w", cut("seq", F.col("start"), F.col("stop")))
    edits = F.abs(F.octet_length("w") - F.col("len"))
    return _hits(found, edits).dropDuplicates(["ordinal", "protein_num", "start", "matched"])
