"""FASTA as a splittable Spark source.

A record is read as one 'line' with the separator newline + '>', so large files
split like any text file and a '>' inside a header is no boundary.  Ordinals
follow file order: rows are numbered within their split and splits are offset by
the record counts before them (one row per split is all that is collected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number rows from 1 in order of their (file, block, seq) columns, which are dropped."""
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n")).orderBy("file", "block").collect()
    before, table = 0, []
    for row in counts:  # one row per input split
        table.append((row["file"], row["block"], before))
        before += row["n"]
    offsets = rows.sparkSession.createDataFrame(table, "file string, block long, before long")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))
    out = rows.withColumn("_r", inside).join(F.broadcast(offsets), ["file", "block"])
    return out.select((F.col("before") + F.col("_r")).cast("long").alias(name), *[
        c for c in rows.columns if c not in ("file", "block", "seq")
    ])


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """value, file, block, seq: the lines of text files with what orders them."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """protein_num (from 1, file order), header, sequence, seq_len.

    Lines are trimmed and joined; case is kept.  Text before the first header and
    records with an empty header are skipped.
    """
    raw = lines(spark, path, "\n>")
    trim = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    first = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) == 1
    raw = raw.withColumn("head", first & (F.col("block") == 0))
    # only a file's first record still has its '>'; without one it is text before the first header
    raw = raw.filter(~F.col("head") | F.col("value").startswith(">"))
    body = F.when(F.col("head"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    parts = F.split(body, "\n")
    records = raw.select(
        "file", "block", "seq",
        trim(F.element_at(parts, 1)).alias("header"),
        F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), trim), "").alias("sequence"),
    ).filter("header <> ''")
    return numbered(records, "protein_num").withColumn("seq_len", F.octet_length("sequence"))
