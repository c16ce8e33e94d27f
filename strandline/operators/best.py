"""Best match: the closest windows of each query, by a ladder of seed lengths and budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import QueryStats, _hits, candidates, mismatch_hits, within


def ladder_lengths(shortest: int) -> list[int]:
    """The shortest query's length, halved down to 2, each once, descending."""
    out, k = {max(2, shortest)}, shortest
    while k > 2:
        k //= 2
        out.add(max(k, 2))
    return sorted(out, reverse=True)


def best_match_hits(
    proteins: DataFrame, queries: DataFrame, keep: Callable[[DataFrame], DataFrame], index: Callable[[int], DataFrame | None] = lambda k: None
) -> DataFrame:
    """Hits of each query on the first rung that finds any (all of that rung's hits).

    A rung is a mismatch search of the queries still unmatched at seed length k,
    with the budget that is complete for the shortest of them; after the last
    length the budget climbs at k = 2 until it reaches the shortest query.  That
    limit depends on the batch, as in the search this engine mirrors.  `keep`
    materialises a rung's hits (a checkpoint), so no rung repeats another's work.
    """
    left, found = queries, None

    def rung(k: int, budget: int, stats: QueryStats) -> None:
        nonlocal left, found
        # a single residue has no seed of two; it is searched exactly
        hits = keep(mismatch_hits(proteins, left, min(k, max(1, stats.shortest)) if budget == 0 else k, budget, stats, index(k)))
        ids = left.join(hits.select("ordinal").distinct(), "ordinal", "left_semi").select("query_id").distinct()
        left = keep(left.join(ids, "query_id", "left_anti"))
        found = hits if found is None else found.unionByName(hits)

    stats = QueryStats.of(left)
    for k in ladder_lengths(stats.shortest):
        if not stats.n:
            return found
        rung(k, max(0, stats.shortest // k - 1), stats)
        stats = QueryStats.of(left)
    budget = stats.shortest // 2
    while stats.n and budget < stats.shortest:
        budget += 1
        rung(2, budget, stats)
        stats = QueryStats.of(left)
    return found


def closest_hits(proteins: DataFrame, queries: DataFrame) -> DataFrame:
    """Single pass without the batch's limit: for each query the windows nearest among those sharing a 2-mer in place.

    One job, for batches of few short queries; the ladder does less work when most match early.
    """
    stats = QueryStats.of(queries)
    found = within(candidates(proteins, queries, 2, "tiled", stats), 2, None, stats.longest)
    found = _hits(found, F.col("edits"))
    least = found.groupBy("ordinal").agg(F.min("edits").alias("edits"))
    return found.join(F.broadcast(least) if stats.seeds_fit(1) else least, ["ordinal", "edits"])
