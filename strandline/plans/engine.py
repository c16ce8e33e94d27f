"""The search facade: one call from sources to a result frame or file."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.best import best_match_hits
from ..operators.positional import is_discontinuous, parse, positional_hits
from ..operators.results import annotated, best_rows, counts, finished, indel_rows, positional_rows, substitution_rows
from ..operators.search import QueryStats, indel_hits, mismatch_hits
from ..session import session
from ..sources.index import ProteinIndex
from ..sources.queries import read_queries
from ..sources.sinks import DEFAULT_NAME, as_frame, write_single
from .planner import FRAME_FORMATS, LONGEST_EXACT_SEED, Request, auto_k, clamp_k, warn_recall


# The names of the count columns.
_COUNTS = ["query_id as `Query ID`", "query_seq as `Query Sequence`", "mismatches as `Mismatches`", "count as `Count`"]


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder; only a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint(eager=True)


class Search:
    """Search queries in a proteome.

    `query`: list, .txt, FASTA path or DataFrame (query_id, query_seq).
    `proteome_file`: FASTA path.  `use_index` stores and reuses k-mer tables in
    `preprocessed_files_path`; without it the sequences are scanned.  `ordered`
    sorts the whole result by query and place; large results do without.
    """

    def __init__(
        self,
        query,
        proteome_file,
        max_mismatches: int = 0,
        max_indels: int = 0,
        k: int = 0,
        preprocessed_files_path: str = ".",
        best_match: bool = False,
        output_format: str = "dataframe",
        output_name: str = "",
        sequence_version: bool = True,
        counts_only: bool = False,
        proteome_name: str = "",
        use_index: bool = True,
        ordered: bool = True,
        spark: SparkSession | None = None,
    ):
        self.request = Request(max_mismatches, max_indels, k, best_match, output_format, counts_only)
        self.spark = spark or session()
        self.proteome_file, self.folder, self.proteome_name = str(proteome_file), preprocessed_files_path, proteome_name
        self.output_name, self.sequence_version, self.use_index = output_name or DEFAULT_NAME, sequence_version, use_index
        self.ordered = ordered
        queries = read_queries(self.spark, query)
        flagged = is_discontinuous(F.col("query_seq"))
        self.linear, self.epitopes = queries.filter(~flagged), parse(queries)
        self.stats = QueryStats.of(self.linear)
        self.n_epitopes = self.epitopes.count()
        self.request.check_queries(self.stats.n, self.n_epitopes, self.stats.shortest)

    def _seed_length(self, edits: int) -> int:
        return self.request.k or auto_k(self.stats.shortest, edits)

    def _index(self, k: int) -> DataFrame | None:
        if not self.use_index:
            return None
        if not self.index.has(k):
            print(f"{self.index.name}: writing {k}-mers")
        return self.index.kmers(k)

    def _mismatch_hits(self, k: int, budget: int) -> DataFrame:
        if budget == 0 and not self.request.k:
            k = min(k, LONGEST_EXACT_SEED, max(1, self.stats.shortest))
        print(f"{self.index.name}: {self.stats.n} queries, substitutions (k={k}, at most {budget})")
        return mismatch_hits(self.index.proteins, self.linear, k, budget, self.stats, self._index(k) if k > 1 else None)

    def _indel_rows(self) -> DataFrame:
        """Queries too short for 3-mers go on their own; either group keeps complete recall."""
        n = self.request.max_indels
        seeds_of_3 = F.floor(F.octet_length("query_seq") / (n + 1)) >= 3
        out = []
        for group, short in ((self.linear.filter(~seeds_of_3), True), (self.linear.filter(seeds_of_3), False)):
            stats = QueryStats.of(group)
            if stats.n:
                k = clamp_k(self.request.k, 2 if short else auto_k(stats.shortest, n))
                warn_recall(group, k, n)
                print(f"{self.index.name}: {stats.n} queries, insertions or deletions (k={k}, at most {n})")
                out.append(indel_rows(group, indel_hits(self.index.proteins, group, k, n, stats, self._index(k))))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def rows(self) -> DataFrame:
        """The result as a Spark DataFrame, before any conversion."""
        self.index = ProteinIndex(self.spark, self.proteome_file, self.folder, self.proteome_name, self.use_index)
        request = self.request
        budget = request.max_mismatches
        if request.counts_only:
            if not self.stats.n:
                return counts(self.linear, mismatch_hits(self.index.proteins, self.linear, 2, 0, self.stats)).selectExpr(*_COUNTS)
            k = self._seed_length(budget)
            warn_recall(self.linear, k, budget)
            return counts(self.linear, self._mismatch_hits(k, budget)).orderBy("ordinal", "mismatches").selectExpr(*_COUNTS)

        parts = []
        describe = lambda rows: annotated(rows, self.index.metadata)
        if self.stats.n:
            if request.max_indels > 0:
                parts.append(describe(self._indel_rows()))
            elif request.best_match:
                if request.k:
                    hits = self._mismatch_hits(request.k, budget)
                else:
                    hits = best_match_hits(self.index.proteins, self.linear, materialise, lambda k: self._index(k) if k > 1 else None)
                parts.append(best_rows(describe(substitution_rows(self.linear, hits))))
            else:
                k = self._seed_length(budget)
                warn_recall(self.linear, k, budget)
                parts.append(describe(substitution_rows(self.linear, self._mismatch_hits(k, budget))))
        if self.n_epitopes:
            hits = positional_hits(self.index.proteins, self.epitopes, budget)
            parts.append(describe(positional_rows(self.epitopes, hits)))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if self.ordered:
            rows = rows.orderBy("ordinal", "protein_num", "index_start")
        return finished(rows, self.sequence_version, request.max_indels > 0)

    def match(self):
        """Run the search: a frame, or None after writing a file."""
        df = self.rows()
        if self.request.output_format in FRAME_FORMATS:
            return as_frame(df, self.request.output_format)
        write_single(df, self.request.output_format, self.output_name)
        return None

