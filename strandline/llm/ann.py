"""Approximate nearest neighbours by collision counting on single projections.

Largest inner product becomes smallest distance: vectors are scaled by the
largest norm and completed to unit length by one more coordinate, queries are
scaled to unit length.  Rows are dealt into blocks of at most ``BLOCK`` vectors;
in a block every one of ``LINES`` random lines keeps its projections in one
sorted array.  A query widens windows around its own projections, radius by
radius; the same arrays serve all radii (virtual rehashing), and a wider window
counts only the places that it newly covers.  A vector that lies in at least
``SHARE`` of the windows is verified: its inner product is computed in double
precision on the original vectors.  At that share, near vectors pass and of
vectors at the usual distance a few per cent do (`nearest(..., counts=True)`
reports how many were verified; the tests hold it under 5 %).  A query is done in
a block when as many verified vectors as wanted lie within the radius; nothing
caps the candidates on the way.

Every row is indexed in every run, each query meets every block, and the best
of all blocks are merged; recall is measured against brute force in the tests.

Null, zero and non-finite vectors, and vectors of another length than most (of
equally common lengths: the longest), take no part.  A query never finds its own
row.  Rows repeating an id are rows of their own.  Of equal vectors only the
k + 1 of smallest ids can be among a query's k nearest, so the others are asked
for but not searched, and a vector that a third of all rows share costs no more
than k + 1 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

LINES = 240  # a multiple of 8, below 256
BLOCK = 1 << 15
QUERIES = 8192
WIDTH = 3.0  # of a window, in radii
SHARE = 0.853
#: Distances lie between 0 and 2 once scaled.
RADII = np.array([0.2, 0.35, 0.5, 0.6, 0.7, 0.78, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5, 1.65, 1.8, 2.0])


class Lines:
    """The projections of a block's vectors on all lines, sorted, and counters of collisions with one query's windows."""

    def __init__(self, x: np.ndarray, scale: float):
        self.n, dim = x.shape
        self.lines = np.random.default_rng(20240229).standard_normal((LINES, dim + 1))
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / scale**2))
        spot = (x / scale) @ self.lines[:, :dim].T + rest[:, None] * self.lines[:, dim]
        self.order = np.ascontiguousarray(np.argsort(spot, axis=0, kind="stable").T.astype(np.int32))
        self.spot = np.take_along_axis(spot.T, self.order, axis=1)
        # the place of each vector in each sorted array
        self.places = np.empty((LINES, self.n), np.uint16)
        np.put_along_axis(self.places, self.order, np.arange(self.n, dtype=np.uint16)[None, :].repeat(LINES, 0), axis=1)
        self.moved, self.inside = np.empty((8, self.n), np.uint16), np.empty((8, self.n), bool)
        self.need = int(np.ceil(SHARE * LINES))

    def windows(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (queries x radii x lines) of every window; the last radius holds everything."""
        centre = unit @ self.lines[:, :-1].T
        low = np.zeros((len(unit), len(RADII) + 1, LINES), np.int32)
        high = np.full_like(low, self.n)
        for j in range(LINES):
            mid = centre[:, j, None]
            low[:, :-1, j] = np.searchsorted(self.spot[j], mid - WIDTH / 2 * RADII)
            high[:, :-1, j] = np.searchsorted(self.spot[j], mid + WIDTH / 2 * RADII, side="right")
        return low, high

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of every vector: its place is between the ends, one unsigned comparison a line."""
        counts = np.zeros(self.n, np.uint8)
        low, wide = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        for j in range(0, LINES, 8):  # a few lines at a time stay in cache
            np.subtract(self.places[j : j + 8], low[j : j + 8], out=self.moved)
            np.less(self.moved, wide[j : j + 8], out=self.inside)
            counts += self.inside.view(np.uint8).sum(0, dtype=np.uint8)
        return counts

    def widen(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, new_low: np.ndarray, new_high: np.ndarray) -> None:
        """Count the places that wider windows newly cover."""
        for j in range(LINES):
            counts[self.order[j, new_low[j] : low[j]]] += 1
            counts[self.order[j, high[j] : new_high[j]]] += 1


def _search(k: int, scale: float):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "score": [], "verified": []}).astype(
            {"qid": "int64", "query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"}
        )
        if not len(data) or not len(queries):
            return empty
        x = np.stack(data["vec"].to_numpy()).astype(np.float64)
        q = np.stack(queries["vec"].to_numpy()).astype(np.float64)
        ids, rid, own = data["vec_id"].fillna(2**63 - 1).to_numpy(), data["rid"].to_numpy(), queries["rid"].to_numpy()
        block, length = Lines(x, scale), np.sqrt((q * q).sum(1)) * scale
        out, last, step = [], len(RADII), 0
        for at in range(0, len(q), 256):
            batch = slice(at, at + 256)
            low, high = block.windows(q[batch] / np.sqrt((q[batch] ** 2).sum(1))[:, None])
            for i in range(at, min(at + 256, len(q))):
                tested = rid == own[i]
                found, close = [], []
                wanted = min(k, int(block.n - tested.sum()))
                # windows open a radius below the one where the query before was done: smaller ones are inside
                step = max(0, step - 1)
                a, z = low[i - at], high[i - at]
                counts = block.count(a[step], z[step])
                while wanted:
                    if step == last:
                        new = np.flatnonzero(~tested)
                    else:
                        new = np.flatnonzero((counts >= block.need) & ~tested)
                    if len(new):
                        tested[new] = True
                        score = (x[new] * q[i]).sum(1)
                        found.append((new, score))
                        close.append(np.sqrt(np.maximum(0.0, 2 - 2 * score / length[i])))
                    if step == last or sum(int((f <= RADII[step]).sum()) for f in close) >= wanted:
                        break
                    step += 1
                    if step < last:
                        block.widen(counts, a[step - 1], z[step - 1], a[step], z[step])
                if found:
                    place = np.concatenate([f[0] for f in found])
                    score = np.concatenate([f[1] for f in found])
                    verified = len(score)
                    if len(score) > k:  # the k best and whatever ties with the last
                        good = score >= np.partition(score, len(score) - k)[len(score) - k]
                        place, score = place[good], score[good]
                    top = np.lexsort((ids[place], -score))[:k]
                    out.append((np.full(len(top), i), place[top], score[top], np.full(len(top), verified)))
        if not out:
            return empty
        asker, place, score, verified = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame(
            {
                "qid": own[asker],
                "query_id": queries["vec_id"].to_numpy()[asker],
                "vec_id": data["vec_id"].take(place).to_numpy(),
                "score": score,
                "verified": verified,
            }
        )

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", counts: bool = False
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query row, ties to smaller vec_id.

    `is_query` is a condition on the column `vec_id`.  With `counts` also
    `verified`: how many vectors the query was compared with, over all blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    usable = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & usable).withColumn("norm2", square).filter("norm2 > 0")
    rows = checkpoint(rows.withColumn("rid", F.monotonically_increasing_id()))
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("m"))
    most = lengths.agg(F.max(F.struct("n", "d", "m")).alias("best")).first()["best"]
    if most is None:
        none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("norm2").alias("score"))
        return none.withColumn("verified", F.lit(0).cast("long")) if counts else none
    rows = rows.filter(F.size("vec") == most["d"])
    queries = rows.filter(is_query)
    alike = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last(), "rid")
    searched = rows.select("rid", "vec_id", "vec", F.row_number().over(alike).alias("nth")).filter(F.col("nth") <= k + 1)
    searched = checkpoint(searched.select(*[F.col(c).alias(c) for c in ("rid", "vec_id", "vec")]))
    n_blocks = -(-searched.count() // BLOCK)
    # few blocks of vectors still feed all cores: the queries are cut finer then
    n_queries, cores = queries.count(), spark.sparkContext.defaultParallelism
    n_query_blocks = max(1, -(-n_queries // QUERIES), min(-(-2 * cores // n_blocks), n_queries // 64))
    dealt = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = searched.select("rid", "vec_id", "vec", dealt(n_blocks).alias("db"), every(n_query_blocks).alias("qb"))
    asked = queries.select("rid", "vec_id", "vec", every(n_blocks).alias("db"), dealt(n_query_blocks).alias("qb"))
    found = (
        data.groupBy("db", "qb")
        .cogroup(asked.groupBy("db", "qb"))
        .applyInPandas(_search(k, float(np.sqrt(most["m"]))), "qid long, query_id long, vec_id long, score double, verified long")
    )
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    if counts:
        found = checkpoint(found.withColumn("part", F.spark_partition_id()))
        sums = found.groupBy("qid", "part").agg(F.max("verified").alias("v")).groupBy("qid").agg(F.sum("v").alias("verified"))
        found = found.drop("verified").join(sums, "qid")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *["verified"] * counts)
