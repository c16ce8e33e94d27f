"""From hits to result rows: misses, positions, metadata, counts and the best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import mutated_positions
from ..functions.indel_text import indel_positions
from ..session import small

METADATA = [
    "protein_id", "protein_name", "species", "taxon_id", "gene", "pe_level", "sequence_version", "gene_priority",
    "swissprot",
]
# The names of the result columns, in order.
COLUMNS = {
    "query_id": "Query ID", "query_seq": "Query Sequence", "matched": "Matched Sequence", "protein_id": "Protein ID",
    "protein_name": "Protein Name", "species": "Species", "taxon_id": "Taxon ID", "gene": "Gene",
    "edits": "Mismatches", "positions": "Mutated Positions", "index_start": "Index start", "index_end": "Index end",
    "pe_level": "Protein Existence Level", "gene_priority": "Gene Priority", "swissprot": "SwissProt Reviewed",
}
INDEL_COLUMNS = {"edits": "Indels", "positions": "Indel Positions"}


def with_misses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its hits, one row without a match where there are none (per ordinal, not per id)."""
    return queries.select("ordinal", "query_id", "query_seq").join(hits, "ordinal", "left")


def substitution_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Result rows of exact and mismatch hits; misses have positions '[]'."""
    rows = with_misses(queries, hits)
    text = mutated_positions(F.col("query_seq").cast("binary"), F.col("matched").cast("binary"))
    return rows.select(
        "ordinal", "query_id", "query_seq", "matched", "protein_num", "edits",
        F.coalesce(text, F.lit("[]")).alias("positions"),
        (F.col("start") + 1).cast("long").alias("index_start"),
        (F.col("start") + F.octet_length("matched")).cast("long").alias("index_end"),
    )


def indel_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Result rows of indel hits; misses have no positions."""
    rows = with_misses(queries, hits)
    return rows.select(
        "ordinal", "query_id", "query_seq", "matched", "protein_num", "edits",
        indel_positions(F.col("query_seq"), F.col("matched")).alias("positions"),
        (F.col("start") + 1).cast("long").alias("index_start"),
        (F.col("start") + F.octet_length("matched")).cast("long").alias("index_end"),
    )


def positional_rows(epitopes: DataFrame, hits: DataFrame) -> DataFrame:
    """Result rows of discontinuous hits: start and end are the first and last listed position."""
    rows = with_misses(epitopes, hits)
    return rows.select(
        "ordinal", "query_id", "query_seq", "matched", "protein_num", "edits",
        F.coalesce("positions", F.lit("[]")).alias("positions"),
        F.col("first").alias("index_start"), F.col("last").alias("index_end"),
    )


def annotated(rows: DataFrame, metadata: DataFrame, n_proteins: int | None = None) -> DataFrame:
    """Rows with their protein's metadata; misses keep nulls.  Broadcast if the checked size allows."""
    side = metadata.select("protein_num", *METADATA)
    return rows.join(small(side, n_proteins, 300) if n_proteins is not None else side, "protein_num", "left")


def versioned(protein_id: Column, version: Column) -> Column:
    return F.when(version.isNotNull(), F.concat(protein_id, F.lit("."), version.cast("string"))).otherwise(protein_id)


def finished(rows: DataFrame, sequence_version: bool = True, indels: bool = False) -> DataFrame:
    """The result's 15 columns under their public names."""
    if sequence_version:
        rows = rows.withColumn("protein_id", versioned(F.col("protein_id"), F.col("sequence_version")))
    names = COLUMNS | (INDEL_COLUMNS if indels else {})
    return rows.select(*[F.col(c).alias(n) for c, n in names.items()])


def best_rows(rows: DataFrame) -> DataFrame:
    """One row per query id: fewest edits, then gene priority, unhyphenated id, reviewed, existence level, no fragment.

    Protein number and start make the order total.  Rows without a match pass.
    """
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    order = [
        F.col("edits").asc(), F.col("gene_priority").desc_nulls_last(),
        flag(~F.contains("protein_id", F.lit("-"))).desc(), flag(F.col("swissprot")).desc(),
        F.col("pe_level").asc_nulls_last(), flag(~F.contains("protein_name", F.lit("Fragment"))).desc(),
        F.col("protein_num").asc(), F.col("index_start").asc(), F.col("ordinal").asc(),
    ]
    hits = rows.filter("matched is not null")
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return first.filter("_n = 1").drop("_n").unionByName(rows.filter("matched is null"))


def counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """ordinal, query_id, query_seq, mismatches, count: no rows for levels without hits."""
    levels = hits.groupBy("ordinal", F.col("edits").alias("mismatches")).agg(F.count("*").alias("count"))
    return queries.select("ordinal", "query_id", "query_seq").join(levels, "ordinal")
