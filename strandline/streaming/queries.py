"""Search as a stream-static join: arriving queries against fixed sequences, or arriving sequences against fixed queries.

Both are map-only per micro-batch apart from the distinct of hits, so they need
no state, and `foreachBatch` with the batch id makes the sink idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import substitution_rows
from ..operators.search import QueryStats, _hits, candidates, mismatch_hits, within
from ..plans.planner import auto_k

QUERY_SCHEMA = "ordinal long, query_id string, query_seq string"


def read_query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Queries from JSON-lines files as they arrive."""
    return spark.readStream.schema(QUERY_SCHEMA).json(folder).withColumn("query_seq", F.upper("query_seq"))


def search_queries(
    stream: DataFrame,
    proteins: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_mismatches: int = 0,
    k: int = 0,
    index: Callable[[int], DataFrame | None] = lambda k: None,
    **trigger,
) -> StreamingQuery:
    """Run each micro-batch of queries as one search; `sink` gets its result rows and the batch id."""

    def batch(queries: DataFrame, batch_id: int) -> None:
        stats = QueryStats.of(queries)
        if stats.n:
            seed = k or auto_k(stats.shortest, max_mismatches)
            hits = mismatch_hits(proteins, queries, seed, max_mismatches, stats, index(seed))
            sink(substitution_rows(queries, hits), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch_sequences(stream: DataFrame, queries: DataFrame, k: int = 0, max_mismatches: int = 0) -> DataFrame:
    """Hits of fixed queries in arriving sequences (protein_num, sequence), as a stream in append mode.

    The seeds are broadcast and a hit is kept for its first standing seed only,
    so the plan is map-only and keeps no state.
    """
    stats = QueryStats.of(queries)
    k = k or auto_k(stats.shortest, max_mismatches)
    regime = "tiled" if max_mismatches else "first"
    if not stats.seeds_fit(max(1, stats.longest)):
        raise ValueError("too many queries to broadcast to every micro-batch")
    found = candidates(stream, queries, k, regime, stats)
    return _hits(within(found, k, max_mismatches, stats.longest), F.col("edits"))
