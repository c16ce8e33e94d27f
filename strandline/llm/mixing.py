"""Mixing sources to target weights by pivotal dependent rounding.

Targets.  Sources in code point order (null last) take the weights in turn,
repeating, and share ``total`` times all words; a target stops at ``most``
times its source's size and the excess is shared out again by weight until none
is above.  Only one row per source takes part in that.

Copies.  A document of a source with rate r = target / size is due r copies:
floor(r) for certain and one more with probability r - floor(r).  Pivotal
rounding settles those probabilities in pairs: of two fractional documents one
gives mass to the other, weighted by their sizes, with odds that keep both
expectations, until one of them is 0 or 1.  The words taken therefore never
change while pairs are settled, and a whole source ends within one document of
its target.

Distribution.  Rows equal in id, source and size are one with a number n from
the start (combined map-side): settling them among themselves leaves floor(n p)
of them whole and at most one fractional.  A source is dealt by a hash of the
row into chunks of about ``CHUNK`` rows, so a source that holds a third of
everything is many chunks.  Each chunk settles its rows in rounds of disjoint
pairs and leaves at most one fractional row; the residuals of ``FAN``
neighbouring chunks meet in the next level, and so on until one is left, which
is settled on its own odds.  Odds come from hashes of rows, so reruns agree
whatever the partitions.

A null source is a source of its own; null or empty text has size 0 and is
taken 0 words; a source without words has target 0.  Rows that repeat in every
respect count each for itself.  Only the id, source and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, checkpoint, flat, mix, words

WEIGHTS = (5, 2, 1)
CHUNK = 4096
FAN = 64
_ROW = "doc_id long, source string, size long"
_LEFT = f"{_ROW}, source_size long, target double, n long, h long, chunk long, base long, whole long, p double"
#: Rows that one row of the last step stands for at most.
COPIES = 4096
#: The table of sources (one row each, under 100 bytes) is broadcast up to this many, else it is shuffled.
BROADCAST_SOURCES = 100_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        count = words(*flat(block.column("text")))[2]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("source"), pa.array(count, pa.int64())],
            names=["doc_id", "source", "size"],
        )


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size: the number of words of each document."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(_sizes, _ROW)


def _numbered(each: DataFrame) -> DataFrame:
    """Sources with their place `turn` in code point order, null last: ranges are sorted apart, only their sizes are collected."""
    order = F.col("source").asc_nulls_last()
    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = checkpoint(each.repartitionByRange(parts, order).withColumn("pid", F.spark_partition_id()))
    sizes = dict(each.groupBy("pid").count().collect())  # at most `parts` rows
    before = {pid: sum(n for q, n in sizes.items() if q < pid) for pid in sizes}
    if not before:
        return each.withColumn("turn", F.lit(0)).drop("pid")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("pid"))
    return each.withColumn("turn", start + F.row_number().over(Window.partitionBy("pid").orderBy(order)) - 1).drop("pid")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_rows, target: one row per source, from rows (source, size, n)."""
    each = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_rows"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") % len(weights) + 1).cast("int"))
    each = checkpoint(_numbered(each).withColumn("weight", weight))
    capped = F.lit(most) * F.col("source_size")
    goal = total * (each.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round caps at least one more source
        held = each.agg(
            F.sum(F.when(capped <= level * F.col("weight"), capped).otherwise(0.0)),
            F.sum(F.when(capped <= level * F.col("weight"), 0.0).otherwise(F.col("weight"))),
        ).first()
        if not held[1]:
            break
        new = (goal - held[0]) / held[1]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return each.select(
        "source", "source_size", "n_rows", F.least(capped, F.lit(level) * F.col("weight")).alias("target")
    )


def settle(size: np.ndarray, p: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one chunk: probabilities, all but at most one of them 0 or 1, and that one's index (or -1).

    The sum of size * p stays; sizes are positive; `key` (64 bits a row) fixes
    the odds.  A round settles disjoint pairs; what stays fractional meets in
    the next round.
    """
    p, tiny = p.astype(float).copy(), 1e-9
    settled = lambda rows: (p[rows] <= tiny) | (p[rows] >= 1 - tiny)
    every = np.arange(len(p))
    p = np.where(settled(every), np.round(p), p)
    left = every[~settled(every)]
    while len(left) > 1:
        i, j = left[: len(left) // 2 * 2].reshape(-1, 2).T
        a, b = size[i], size[j]
        up = np.minimum(a * (1 - p[i]), b * p[j])  # words that the first can take from the second
        down = np.minimum(a * p[i], b * (1 - p[j]))
        odds = (mix(key[i] ^ mix(key[j])) >> np.uint64(11)) / float(1 << 53)
        move = np.where(odds < down / (up + down), up, -down)
        p[i] += move / a
        p[j] -= move / b
        pair = np.concatenate([i, j])
        p[pair] = np.where(settled(pair), np.round(p[pair]), p[pair])
        left = left[~settled(left)]
    return p, int(left[0]) if len(left) else -1


def _settle_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["chunk", "h", "doc_id", "size"], kind="stable", na_position="first")
    p, _ = settle(pdf["size"].to_numpy(), pdf["p"].to_numpy(), pdf["h"].to_numpy().view(np.uint64))
    return pdf.assign(p=p, chunk=pdf["chunk"] // FAN)


def _expanded(settled: DataFrame) -> DataFrame:
    """One row a document again: `whole` of the n equal rows have one copy more, and the next one if p came out as 1."""
    ups = F.col("whole") + F.col("p").cast("long")
    span = lambda first, stop: F.explode(F.sequence(first, stop))
    each = settled.withColumn("ups", ups)
    few = each.filter(F.col("n") <= COPIES).withColumn("i", span(F.lit(0).cast("long"), F.col("n") - 1))
    # many equal rows are dealt over tasks before they become rows again
    many = each.filter(F.col("n") > COPIES).withColumn("b", span(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    many = many.repartition("doc_id", "size", "b").withColumn(
        "i", span(F.col("b") * COPIES, F.least(F.col("n"), (F.col("b") + 1) * COPIES) - 1)
    )
    return few.unionByName(many.drop("b")).withColumn("copies", F.col("base") + (F.col("i") < F.col("ups")).cast("long"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    total: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    equal = sizes(docs, id_col, source_col, text_col).groupBy("doc_id", "source", "size")
    rows = equal.agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("doc_id", "source", "size"))
    rows = checkpoint(rows)
    per_source = checkpoint(targets(rows, weights, total, most))
    few = per_source.count() <= BROADCAST_SOURCES
    known = F.broadcast(per_source) if few else per_source
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / CHUNK)).cast("long")
    rate = F.col("target") / F.greatest("source_size", F.lit(1))
    due = F.col("n") * F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0)
    level = checkpoint(
        rows.join(known, rows["source"].eqNullSafe(per_source["source"])).select(
            "doc_id", rows["source"], "size", "source_size", "target", "n", "h",
            F.pmod("h", chunks).alias("chunk"), F.floor(rate).cast("long").alias("base"),
            F.floor(due).cast("long").alias("whole"), (due - F.floor(due)).alias("p"),
        )
    )
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    settled, width = [level.filter(~is_open)], -(-(per_source.agg(F.max("n_rows")).first()[0] or 0) // CHUNK)
    while width:
        level = checkpoint(level.filter(is_open).groupBy("source", "chunk").applyInPandas(_settle_group, _LEFT))
        settled.append(level.filter(~is_open))
        width = -(-width // FAN) if width > 1 else 0
    odd = F.pmod(F.xxhash64("doc_id", "source", F.lit("last")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    settled.append(level.filter(is_open).withColumn("p", F.when(odd < F.col("p"), 1.0).otherwise(0.0)))
    return _expanded(reduce(DataFrame.unionByName, settled)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
