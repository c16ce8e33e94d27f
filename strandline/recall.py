"""Measuring a search: recall against expected hits, step times, and the scan that needs no index."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .functions.compare import hamming
from .operators.search import QueryStats
from .session import BROADCAST_BYTES, spread

# The columns on which hits are compared.
KEY = ["Query Sequence", "Matched Sequence", "Protein ID", "Index start"]


def recall_percent(result: DataFrame, expected: DataFrame, key: list[str] = KEY) -> DataFrame:
    """expected, found, recall (percent, 100 at most): one row."""
    want, got = expected.select(*key).dropDuplicates(), result.select(*key).dropDuplicates()
    joined = want.join(got.withColumn("_hit", F.lit(1)), key, "left")
    return joined.agg(
        F.count("*").alias("expected"),
        F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("found"),
        F.least(F.sum("_hit") * 100.0 / F.count("*"), F.lit(100.0)).alias("recall"),
    )


def read_expected(spark, path: str) -> DataFrame:
    """Expected hits: tab-separated with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def write_report(rows: list[dict], path: str) -> None:
    """A benchmark's result table, tab-separated."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(rows[0]) + "\n" if rows else "")
        f.writelines("\t".join("N/A" if v is None else str(v) for v in r.values()) + "\n" for r in rows)


def timed(action: Callable[[], object]) -> tuple[object, float | None]:
    """Result and seconds of a step; None seconds for a step that does not apply (TypeError)."""
    start = time.perf_counter()
    try:
        return action(), time.perf_counter() - start
    except TypeError:
        return None, None


def _blocks(size: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 blocks of a query, of which a window within the budget has at least one in place."""
    cuts = [j * size // (budget + 1) for j in range(budget + 2)]
    return [(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _codes(data: np.ndarray, n: int, size: int, bits: int) -> np.ndarray:
    """Hashes of the first bytes (8 at most) of the n blocks of `size` bytes that start at data[0], data[1] and so on."""
    code = np.zeros(n, np.uint32)
    for i in range(min(size, 8)):
        code *= np.uint32(0x01000193)
        code ^= data[i : i + n]
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - bits)


def _near(data: np.ndarray, at: np.ndarray, q: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of query, place in data, edits) of all windows within the budget; at: where the sequences end.

    Every window is looked at.  Those without any block of any query in place are
    over the budget for each of them; all others are compared with every query.
    """
    size, bits = q.shape[1], min(22, max(16, (8 * len(q)).bit_length()))
    blocks, tables = _blocks(size, budget), []
    for start, length in blocks:
        tables.append(np.zeros(1 << bits, bool))
        for row in q:
            tables[-1][_codes(row[start:], 1, length, bits)] = True
    for lo in range(0, len(data) - size + 1, _PLACES):
        n = min(_PLACES, len(data) - size + 1 - lo)
        here = np.zeros(n, bool)
        for (start, length), table in zip(blocks, tables, strict=True):
            here |= table[_codes(data[lo + start :], n, length, bits)]
        ends = at[np.searchsorted(at, lo, side="right") : np.searchsorted(at, lo + n + size)]
        over = (np.unique(ends)[:, None] - np.arange(1, size)).ravel() - lo  # windows over a sequence's end
        here[over[(over >= 0) & (over < n)]] = False
        places = np.flatnonzero(here) + lo
        for some in np.array_split(places, len(places) // (1 << 16) + 1):
            columns = [data[some + i] for i in range(size)]
            for j, row in enumerate(q.tolist()):
                far = np.zeros(len(some), np.uint8 if size < 256 else np.uint32)
                for i, column in enumerate(columns):
                    far += column != row[i]
                hit = np.flatnonzero(far <= budget)
                if len(hit):
                    yield np.full(len(hit), j), some[hit], far[hit]


#: Windows that are looked at in one go.
_PLACES = 1 << 18


def _scanned(queries: list[tuple[int, bytes]], budget: int, ordinal: pa.DataType, number: pa.DataType):
    """Hits of the queries in every window of the sequences, for mapInArrow."""
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for o, q in queries:
        groups.setdefault(len(q), []).append((o, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pc.is_valid(batch.column("seq")))
            column = rows.column("seq").cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            for size, group in groups.items():
                names = pa.array([o for o, _ in group], ordinal)
                if size:
                    found = _near(data, ends, np.frombuffer(b"".join(q for _, q in group), np.uint8).reshape(len(group), size), budget)
                else:  # an empty query stands before every residue and at the end
                    own = np.repeat(np.arange(len(starts)), ends - starts + 1)
                    first = starts + np.arange(len(starts))  # of the places, one more for each sequence
                    place = np.arange(len(own)) - first[own] + starts[own]
                    found = ((np.full(len(own), j), place, np.zeros(len(own), np.int64)) for j in range(len(group)))
                for which, places, edits in found:
                    if size:
                        own = np.searchsorted(ends, places, side="right")
                    cut = [data[p : p + size].tobytes() for p in places]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(which)), rows.column("protein_num").take(pa.array(own)).cast(number), pa.array(places - starts[own], pa.int32()),
                         pa.array(cut, pa.binary()), pa.array(edits, pa.int64())],
                        names=["ordinal", "protein_num", "start", "w", "edits"],
                    )

    return run


def scan_hits(proteins: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """Hits by comparing every window with every query of its length: the baseline without seeds.

    Exact text scans (skip tables, failure functions and the like) differ from
    it in constants only.  For budget 0 windows and queries meet by equality.
    Otherwise queries that fit a task travel to the sequences, which are scanned
    in arrays; more of them meet the windows in a join.
    """
    stats = QueryStats.of(queries)
    rows = spread(proteins.select("protein_num", F.col("sequence").cast("binary").alias("seq")))
    q = queries.select("ordinal", F.col("query_seq").cast("binary").alias("q"))
    if budget > 0 and stats.seeds_fit(1) and stats.n * stats.longest <= BROADCAST_BYTES:
        given = [(r["ordinal"], bytes(r["q"])) for r in q.filter(F.col("q").isNotNull()).collect()]
        kinds = {f.name: f.dataType for f in [*q.schema.fields, *rows.schema.fields]}
        run = _scanned(given, budget, to_arrow_type(kinds["ordinal"]), to_arrow_type(kinds["protein_num"]))
        schema = f"ordinal {kinds['ordinal'].simpleString()}, protein_num {kinds['protein_num'].simpleString()}, start int, w binary, edits long"
        found = rows.mapInArrow(run, schema)
        return found.select("ordinal", "protein_num", "start", F.col("w").cast("string").alias("matched"), "edits")
    sizes = [r[0] for r in queries.select(F.octet_length("query_seq")).distinct().collect()]
    rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.octet_length("seq") >= F.col("size"))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.octet_length("seq") - F.col("size"))))
    rows = rows.withColumn("w", F.substring("seq", F.col("start") + 1, F.col("size")))
    q = F.broadcast(q) if stats.seeds_fit(1) else q
    if budget == 0:
        found = rows.join(q, F.col("w") == F.col("q")).withColumn("edits", F.lit(0))
    else:
        found = rows.join(q, F.col("size") == F.octet_length("q"))
        edits = hamming(F.col("seq"), F.col("start"), F.col("q"), F.col("size"), stats.longest)
        found = found.withColumn("edits", edits).filter(F.col("edits") <= budget)
    return found.select("ordinal", "protein_num", "start", F.col("w").cast("string").alias("matched"), F.col("edits").cast("long").alias("edits"))
