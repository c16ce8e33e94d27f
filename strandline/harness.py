"""Benchmark runner: every method on every dataset, with times, recall and peak memory.

A dataset names its files and what is searched; a method turns a dataset into
hits with the columns of `recall.KEY`.  Methods that do not apply to a dataset
raise ValueError and get a row without figures.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.best import ladder_lengths
from .operators.results import annotated, finished, substitution_rows
from .operators.search import QueryStats
from .plans.engine import Search, materialise
from .plans.planner import LONGEST_EXACT_SEED, auto_k
from .recall import KEY, read_expected, recall_percent, scan_hits, timed
from .sources.index import ProteinIndex
from .sources.queries import read_queries


@dataclass(frozen=True)
class Dataset:
    """What is searched in what: a query file of a kind, its proteome, the expected hits."""

    name: str
    queries: str
    proteome: str
    expected: str
    max_mismatches: int = 0
    best_match: bool = False
    k: int = 0


def datasets(folder: str, proteome: str = "human.fasta") -> list[Dataset]:
    """The four kinds of search that are measured, in `folder`: <name>.fasta and <name>-expected.tsv."""
    listed = [("mhc-ligands", 0, False), ("milk-peptides", 0, True), ("coronavirus", 2, False), ("neoepitopes", 3, False)]
    at = lambda *p: os.path.join(folder, *p)
    return [Dataset(n, at(f"{n}.fasta"), at(proteome), at(f"{n}-expected.tsv"), m, b) for n, m, b in listed]


class Seeded:
    """The engine itself: the k-mer tables that a dataset needs are built ahead, then it is searched."""

    def __init__(self, spark: SparkSession, dataset: Dataset, folder: str):
        self.spark, self.dataset, self.folder = spark, dataset, folder

    def lengths(self) -> list[int]:
        """Seed lengths of the search: the ladder for best matches, else the longest that finds all hits."""
        shortest = QueryStats.of(read_queries(self.spark, self.dataset.queries)).shortest
        if self.dataset.k:
            return [self.dataset.k]
        if self.dataset.best_match:
            return ladder_lengths(shortest)
        k = auto_k(shortest, self.dataset.max_mismatches)
        return [min(k, LONGEST_EXACT_SEED) if not self.dataset.max_mismatches else k]

    def preprocess(self) -> None:
        index = ProteinIndex(self.spark, self.dataset.proteome, self.folder)
        for k in self.lengths():
            if not index.has(k):
                index.build(k)

    def search(self) -> DataFrame:
        d = self.dataset
        rows = Search(
            d.queries, d.proteome, d.max_mismatches, k=d.k, preprocessed_files_path=self.folder, best_match=d.best_match,
            sequence_version=False, ordered=False, spark=self.spark,
        ).rows()
        return rows.filter(F.col("Matched Sequence").isNotNull()).select(*KEY)


class Scan:
    """The baseline without seeds: every window against every query; nothing is built ahead."""

    def __init__(self, spark: SparkSession, dataset: Dataset, folder: str):
        if dataset.best_match:
            raise ValueError("a scan has no notion of best match")
        self.spark, self.dataset = spark, dataset

    def preprocess(self) -> None:
        raise TypeError("nothing to build")

    def search(self) -> DataFrame:
        index = ProteinIndex(self.spark, self.dataset.proteome, store=False)
        queries = read_queries(self.spark, self.dataset.queries)
        hits = scan_hits(index.proteins, queries, self.dataset.max_mismatches)
        rows = annotated(substitution_rows(queries, hits), index.metadata)
        return finished(rows, False, False).filter(F.col("Matched Sequence").isNotNull()).select(*KEY)


METHODS: dict[str, Callable] = {"seeded": Seeded, "scan": Scan}


@dataclass
class PeakMemory:
    """Largest execution memory (MB, all tasks of a stage) of the stages run since the start."""

    spark: SparkSession
    before: set = field(default_factory=set)

    def _stages(self) -> dict[int, int]:
        store = self.spark.sparkContext._jsc.sc().statusStore()
        empty = self.spark._jvm.java.util.ArrayList()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.double, 0)
        listed = store.stageList(empty, False, False, none, empty)
        return {s.stageId(): s.peakExecutionMemory() for s in (listed.apply(i) for i in range(listed.size()))}

    def start(self) -> PeakMemory:
        self.before = set(self._stages())
        return self

    def megabytes(self) -> float:
        return max((v for k, v in self._stages().items() if k not in self.before), default=0) / 1e6


def run_benchmark(
    spark: SparkSession, listed: Iterable[Dataset], folder: str, methods: dict[str, Callable] = METHODS, memory: bool = False
) -> list[dict]:
    """One row a dataset and method: seconds to preprocess and to search, recall in percent, peak memory in MB."""
    out = []
    for dataset in listed:
        for name, method in methods.items():
            row = {"dataset": dataset.name, "method": name, "preprocess_s": None, "search_s": None, "recall": None, "peak_mb": None}
            out.append(row)
            try:
                adapter = method(spark, dataset, folder)
            except ValueError:
                continue
            probe = PeakMemory(spark).start() if memory else None
            row["preprocess_s"] = timed(adapter.preprocess)[1]
            hits, row["search_s"] = timed(lambda adapter=adapter: materialise(adapter.search()))
            row["peak_mb"] = probe.megabytes() if probe else None
            row["recall"] = recall_percent(hits, read_expected(spark, dataset.expected)).first()["recall"]
    return out
