import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann


def brute(rows, k, step):
    """query -> [(score, id)] of rows (id, vector) with distinct ids."""
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(float(score[j]), int(ids[j])) for j in order]
    return out


@pytest.mark.parametrize("spread, block", [(0.0, 8192), (1.5, 300)])
def test_recall_and_scores(spark, monkeypatch, spread, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 24)) * np.exp(spread * rng.random((1500, 1)))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    want = brute(rows, 20, 20)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    recall = []
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
        truth = dict((i, s) for s, i in want[q])
        assert all(abs(truth[i] - s) < 1e-12 * max(1, abs(s)) for _, i, s in hits if i in truth)
        recall.append(len(truth.keys() & {h[1] for h in hits}) / 20)
    assert np.mean(recall) >= 0.9


def test_ties_few_candidates_and_unusable_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(0, 30)] + [(40, None), (60, [0.0] * 3), (80, [float("nan"), 1.0, 1.0]), (100, [1.0, 2.0]), (120, [None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit("x")).withColumn("qb", F.lit(1))
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert {r.query_id for r in out} == {0, 20}
    assert [r.vec_id for r in sorted(out, key=lambda r: (r.query_id, r["rank"]))] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    few = ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 1.0), (0, 2, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(df.filter("vec_id >= 40 and vec_id < 100"), F.col("vec_id") % 20 == 0).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, 1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(20, 1, 3, 1.0), (20, 1, 3, 1.0)]


@pytest.mark.parametrize("n, most", [(6000, 0.1), (24_000, 0.05)])
def test_recall_and_share_of_verified_vectors_at_two_sizes(spark, n, most):
    """Unit vectors without any structure, the hardest case; the larger table verifies the smaller share."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    asked = F.col("vec_id") % (n // 100) == 0
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), asked, 20, counts=True).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r)
    recall = []
    for q, hits in got.items():
        score = (x * x[q]).sum(1)
        score[q] = -2
        recall.append(len({h.vec_id for h in hits} & set(np.argsort(-score)[:20].tolist())) / 20)
    assert len(got) == 100 and np.mean(recall) >= 0.9
    assert np.mean([hits[0].verified for hits in got.values()]) / n < most


def test_one_vector_of_a_third_of_all_rows(spark):
    x = np.random.default_rng(1).standard_normal((600, 8))
    x = (x / np.sqrt((x * x).sum(1))[:, None]).tolist()
    rows = [(i, x[0] if i % 3 == 0 else x[i]) for i in range(600)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    for q in range(0, 600, 20):
        got = [r.vec_id for r in sorted(out, key=lambda r: (r.query_id, r["rank"])) if r.query_id == q]
        assert len(got) == 20
        if q % 3 == 0:  # the vector itself: its other rows are nearest, by id
            assert got == [i for i in range(0, 600, 3) if i != q][:20]
