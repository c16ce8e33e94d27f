"""K-mers of sequences and seeds of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import part
from ..session import spread


def windows(proteins: DataFrame, k: int) -> DataFrame:
    """protein_num, seq (binary), pos (from 0): every place of a k-mer.

    `seq` rides along by reference: explode, probe and verification share one
    generated stage, so a row is only made for what the probe lets through.
    """
    rows = spread(proteins.select("protein_num", F.col("sequence").cast("binary").alias("seq")))
    last = F.octet_length("seq") - k  # no filter on it: one would repeat what made the sequence
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return rows.select("protein_num", "seq", F.explode(places).alias("pos"))


def kmers(proteins: DataFrame, k: int) -> DataFrame:
    """protein_num, pos, kmer: the narrow k-mer table (what an index stores)."""
    return windows(proteins, k).select("protein_num", "pos", part(F.col("seq"), F.col("pos"), k).cast("string").alias("kmer"))


def postings(kmer_rows: DataFrame) -> DataFrame:
    """kmer, n, positions: the k-mer table as posting lists in (protein, position) order."""
    places = F.sort_array(F.collect_list(F.struct("protein_num", "pos")))
    return kmer_rows.groupBy("kmer").agg(F.count("*").alias("n"), places.alias("positions"))


def seed_offsets(length: Column, k: int, regime: str) -> Column:
    """Offsets of a query's seeds.

    first: the first k-mer (a hit has it); tiled: tiles if k divides the length,
    else every offset; cover: tiles and the last k-mer.
    """
    last = length - k
    if regime == "first":
        return F.array(F.lit(0))
    tiles = F.sequence(F.lit(0), last, F.lit(k))
    if regime == "cover":
        return F.array_distinct(F.concat(tiles, F.array(last)))
    return F.when(length % k == 0, tiles).otherwise(F.sequence(F.lit(0), last))


def seeds(queries: DataFrame, k: int, regime: str) -> DataFrame:
    """ordinal, q (binary), len, at (offset), kmer: seeds of the queries that have one."""
    q = F.col("query_seq").cast("binary")
    rows = queries.select("ordinal", q.alias("q"), F.octet_length("query_seq").alias("len")).filter(F.col("len") >= k)
    rows = rows.withColumn("at", F.explode(seed_offsets(F.col("len"), k, regime)))
    return rows.withColumn("kmer", part(F.col("q"), F.col("at"), k).cast("string"))
