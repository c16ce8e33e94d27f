"""Exact dedup with a heavy-hitter split.

1.  One pass turns each text into the SHA-256 of its normalised form; digests
    (not texts) are checkpointed and are all that moves afterwards.
2.  Misra-Gries: every partition keeps at most ``counters`` digests.  Summed, a
    digest's counter falls short of its true count by at most N / (counters+1)
    for all partitions together, so every digest with more than 2N / counters
    copies has a sum above N / counters, and fewer than ``counters`` digests can.
3.  Those are verified: one map-side combined aggregate gives their exact size
    and winner.  The table has under ``counters`` rows, whatever the input, so it
    is broadcast and heavy rows are decided where they lie, without a shuffle.
4.  The other digests are shuffled; none of their groups holds more than
    2N / counters rows.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
The row with the largest id stays (null id is smallest); of rows repeating that
id exactly one stays.  An empty table gives an empty result, other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

COUNTERS = 512


def misra_gries(values: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """At most `counters` values with lower bounds of their counts, each short by n / (counters+1) at most."""
    held: dict[bytes, int] = {}
    for value in values:
        if value in held:
            held[value] += 1
        elif len(held) < counters:
            held[value] = 1
        else:
            held = {v: n - 1 for v, n in held.items() if n > 1}
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((v for b in batches for v in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            names=["digest", "n"],
        )

    return run


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text after lower-casing A-Z; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    rows = checkpoint(rows.withColumn("rid", F.monotonically_increasing_id()))
    total = rows.count()

    best = F.max(F.struct("doc_id", "rid")).alias("best")
    heavy = (
        rows.select("digest")
        .mapInArrow(_summaries(counters), "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > total / counters)
        .select("digest")
    )  # fewer than `counters` rows
    winners = (
        rows.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest")
        .agg(best, F.count("*").alias("group_size"))
    )
    winners = checkpoint(winners)  # fewer than `counters` rows
    near = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest",
        "doc_id",
        "rid",
        F.max(F.struct("doc_id", "rid")).over(same).alias("best"),
        F.count("*").over(same).alias("group_size"),
    )
    return near.unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
