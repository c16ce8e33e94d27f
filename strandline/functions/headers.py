"""Protein metadata from FASTA headers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protein_id(h: Column) -> Column:
    """Between the first two bars, else the first word, else ''."""
    word = F.coalesce(F.element_at(F.split(F.ltrim(h), r"\s+"), 1), F.lit(""))
    return F.when(h.rlike(r"^[^|]*\|[^|]*\|"), F.regexp_extract(h, r"^[^|]*\|([^|]*)\|", 1)).otherwise(word)


def protein_name(h: Column) -> Column:
    """After the first blank, up to ' OS='; '' without a blank."""
    after = F.regexp_extract(h, r"(?s)^[^ ]* (.*)$", 1)
    return F.trim(F.element_at(F.split(after, " OS=", 2), 1))


def species(h: Column) -> Column:
    return F.trim(F.regexp_extract(h, r"(?s)OS=(.*?)(?: OX=|$)", 1))


def field(h: Column, tag: str) -> Column:
    """Text after the first `tag` up to white space."""
    return F.regexp_extract(h, f"{tag}(\\S*)", 1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def metadata(proteins: DataFrame) -> DataFrame:
    """One row per protein (protein_num, header): the nine fields, typed, blanks as null.

    An isoform (dash in its id) without an existence level takes that of its
    canonical entry, wherever that stands in the file (the last one if several).
    Gene priority is 1 for a gene's first reviewed canonical entry in file order.
    """
    h = F.col("header")
    base = proteins.select(
        "protein_num",
        protein_id(h).alias("protein_id"),
        protein_name(h).alias("protein_name"),
        species(h).alias("species"),
        field(h, "OX=").alias("taxon_id"),
        field(h, "GN=").alias("gene"),
        field(h, "PE=").alias("pe"),
        F.coalesce(blank_to_null(field(h, "SV=")), F.lit("1")).alias("sv"),
        h.startswith("sp|").alias("swissprot"),
    ).withColumn("isoform", F.contains("protein_id", F.lit("-")))

    canonical = (
        base.filter(~F.col("isoform") & (F.col("pe") != ""))
        .groupBy(F.col("protein_id").alias("base_id"))
        .agg(F.max_by("pe", "protein_num").alias("canonical_pe"))
    )
    lacking = F.col("isoform") & F.col("pe").isin("", "0")
    base = base.withColumn("base_id", F.when(lacking, F.substring_index("protein_id", "-", 1)))
    base = base.join(canonical, "base_id", "left")
    pe = F.coalesce(F.when(lacking, F.col("canonical_pe")), blank_to_null(F.col("pe")), F.lit("0"))

    eligible = F.col("swissprot") & ~F.col("isoform") & (F.col("gene") != "")
    firsts = base.filter(eligible).groupBy("gene").agg(F.min("protein_num").alias("protein_num"))
    firsts = firsts.select("protein_num", F.lit(1).cast("long").alias("first"))
    return base.join(firsts, "protein_num", "left").select(
        "protein_num",
        blank_to_null(F.col("protein_id")).alias("protein_id"),
        blank_to_null(F.col("protein_name")).alias("protein_name"),
        blank_to_null(F.col("species")).alias("species"),
        blank_to_null(F.col("taxon_id")).alias("taxon_id"),
        blank_to_null(F.col("gene")).alias("gene"),
        pe.try_cast("long").alias("pe_level"),
        F.col("sv").try_cast("long").alias("sequence_version"),
        F.coalesce("first", F.lit(0).cast("long")).alias("gene_priority"),
        "swissprot",
    )
