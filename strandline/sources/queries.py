"""Query sources: Python list, .txt, FASTA or DataFrame."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import lines, numbered, read_fasta

# File extensions taken as FASTA.
FASTA_EXTENSIONS = {".fasta", ".fas", ".fa", ".fna", ".ffn", ".faa", ".mpfa", ".frn"}
SCHEMA = "ordinal long, query_id string, query_seq string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system (local, HDFS, object store)."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(str(path))
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def resolved(path) -> str:
    """A relative path that exists here, made absolute: the JVM may have another working folder."""
    return os.path.abspath(path) if os.path.exists(str(path)) else str(path)


def read_queries(spark: SparkSession, query) -> DataFrame:
    """ordinal, query_id, query_seq (upper case).

    A list or text file has ids '1', '2', ...; FASTA ids are the header's first
    word.  A DataFrame needs query_id and query_seq and keeps its ids.
    """
    if isinstance(query, DataFrame):
        rows = query.select(F.col("query_id").cast("string"), F.upper("query_seq").alias("query_seq"))
        order = rows.rdd.zipWithIndex().map(lambda r: (r[1] + 1, r[0][0], r[0][1]))
        return spark.createDataFrame(order, SCHEMA)
    if isinstance(query, (list, tuple)):
        return spark.createDataFrame([(i, str(i), s.upper()) for i, s in enumerate(query, 1)], SCHEMA)
    path = resolved(query)
    if not exists(spark, path):
        raise FileNotFoundError(f"Query file not found: {query}")
    suffix = Path(path).suffix.lower()
    if suffix in FASTA_EXTENSIONS:
        records = read_fasta(spark, path)
        return records.select(
            F.col("protein_num").alias("ordinal"),
            F.element_at(F.split("header", r"\s+"), 1).alias("query_id"),
            F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("query_seq"),
        )
    if suffix == ".txt":
        kept = lines(spark, path).withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value <> ''")
        return numbered(kept).select("ordinal", F.col("ordinal").cast("string").alias("query_id"), F.upper("value").alias("query_seq"))
    raise ValueError(
        f"Unsupported query format: {Path(path).suffix}. Use a Python list, .txt file, or FASTA file for the query."
    )
