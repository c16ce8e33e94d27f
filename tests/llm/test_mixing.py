import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing


def water_level(sizes, weights, total=1.5, most=2.0):
    """Targets by capping one source at a time."""
    goal, open_, out = total * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = (goal - sum(most * sizes[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i] + 1e-9}
        if not over:
            break
        open_ -= over
    for i in range(len(sizes)):
        out[i] = level * weights[i] if i in open_ else most * sizes[i]
    return out


@pytest.mark.parametrize("chunk, fan", [(4096, 64), (7, 2)])
def test_targets_copies_and_reruns(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    monkeypatch.setattr(mixing, "FAN", fan)
    rng = random.Random(4)
    sources = ["b"] * 150 + ["a"] * 60 + ["é"] * 40 + [None] * 30 + ["Z"] * 5
    rows = [(i, s, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    out = mixing.mix_sources(df.repartition(3)).collect()
    assert len(out) == len(rows)
    order = ["Z", "a", "b", "é", None]
    sizes = [sum(len(t.split()) for _, s, t in rows if s == k) for k in order]
    want = dict(zip(order, water_level(sizes, [5, 2, 1, 5, 2]), strict=True))
    for k, size in zip(order, sizes, strict=True):
        own = [r for r in out if r.source == k]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - want[k]) < 1e-6 * max(1, want[k]) for r in own)
        assert abs(sum(r.taken for r in own) - want[k]) <= max(r.size for r in own)
    texts = {i: len(t.split()) for i, _, t in rows}
    assert all(r.size == texts[r.doc_id] and r.taken == r.copies * r.size and r.copies <= 2 for r in out)
    again = mixing.mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_edge_cases(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "x y"), (2, "b", "p q r"), (2, "b", "p q r"), (3, "c", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(df).collect()
    assert len(out) == 6 and all(0 <= r.taken <= 2 * r.size for r in out)
    assert {r.target for r in out if r.source in ("a", "c")} == {0.0}
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_settling_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    sums = np.zeros(40)
    for trial in range(400):
        out, open_ = mixing.settle(size, p, rng.integers(0, 1 << 63, 40).astype(np.uint64))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert sum(0 < x < 1 for x in out) <= 1 and (open_ < 0 or 0 < out[open_] < 1)
        sums += out
    assert np.abs(sums / 400 - p).max() < 0.12


def test_many_rows_without_an_id_and_of_one_size(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit("a b").alias("text"))
    both = df.unionByName(other)
    out = mixing.mix_sources(both).groupBy("source", "doc_id", "target", "copies").count().collect()
    assert sum(r["count"] for r in out) == 23_000
    for source, size in (("s", 3), ("t", 2)):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.copies * r["count"] for r in own) * size - own[0].target) <= size
    again = mixing.mix_sources(both.repartition(5)).groupBy("source", "doc_id", "target", "copies").count().collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
