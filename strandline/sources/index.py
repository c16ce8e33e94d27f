"""A stored index: proteins, metadata and k-mer tables as Parquet, found by the content they were made from.

<folder>/<name>.index/<fingerprint>/{proteins, metadata, kmers/k=<k>}

The fingerprint covers every record of the FASTA, so a changed file never meets
a stale index.  K-mer tables are range-partitioned and sorted by k-mer, which
lets Parquet statistics skip row groups; each k is its own table.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import metadata
from ..operators.kmers import kmers
from .fasta import read_fasta
from .queries import exists, resolved


def fingerprint(proteins: DataFrame) -> str:
    """Hash of all records and their order."""
    mark = F.sum(F.xxhash64("protein_num", "header", "sequence").cast("decimal(38,0)"))
    n, total = proteins.agg(F.count("*"), mark).first()
    return f"{n}-{int(total or 0) & ((1 << 64) - 1):016x}"


class ProteinIndex:
    """Tables of one proteome; built where missing.  Without `store` nothing is read ahead or written."""

    def __init__(self, spark: SparkSession, proteome: str, folder: str = ".", name: str = "", store: bool = True):
        if os.path.exists(str(proteome)) and "://" not in str(folder):
            folder = os.path.abspath(folder)
        proteome = resolved(proteome)
        if not exists(spark, proteome):
            raise FileNotFoundError(f"Proteome file not found: {proteome}")
        self.spark, self.name = spark, name or Path(str(proteome)).stem
        source = read_fasta(spark, str(proteome))
        self.root = f"{str(folder).rstrip('/')}/{self.name}.index/{fingerprint(source)}" if store else None
        if not store:
            self.proteins, self.metadata = source, metadata(source)
            return
        if not self._complete("proteins"):
            source.write.mode("overwrite").parquet(f"{self.root}/proteins")
        self.proteins = spark.read.parquet(f"{self.root}/proteins")
        if not self._complete("metadata"):
            metadata(self.proteins).write.mode("overwrite").parquet(f"{self.root}/metadata")
        self.metadata = spark.read.parquet(f"{self.root}/metadata")

    def _complete(self, table: str) -> bool:
        return exists(self.spark, f"{self.root}/{table}/_SUCCESS")

    def has(self, k: int) -> bool:
        return self._complete(f"kmers/k={k}")

    def build(self, k: int) -> None:
        """Write the k-mer table: one shuffle, spilled and merged by Spark."""
        if k < 2:
            raise ValueError("k must be >= 2.")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["kmer", "protein_num", "pos"]  # all three bound the ranges, so a k-mer of any frequency is split
        rows = kmers(self.proteins, k).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").parquet(f"{self.root}/kmers/k={k}")

    def kmers(self, k: int) -> DataFrame:
        if not self.has(k):
            self.build(k)
        return self.spark.read.parquet(f"{self.root}/kmers/k={k}")


class IndexBuilder:
    """Build a proteome's index ahead of searches."""

    def __init__(self, proteome: str, proteome_name: str = "", preprocessed_files_path: str = ".", spark: SparkSession | None = None):
        from ..session import session

        self.index = ProteinIndex(spark or session(), proteome, preprocessed_files_path, proteome_name)

    def preprocess(self, k: int) -> str:
        self.index.build(k)
        return self.index.root
