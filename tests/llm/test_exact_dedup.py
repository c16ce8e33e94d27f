import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm.exact_dedup import exact_dedup, misra_gries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault((t or "").translate(LOWER), []).append(i)
    return sorted(
        (i, max(texts[n]), len(texts[n]), i == max(texts[n]), hashlib.sha256(n.encode()).hexdigest())
        for i, t in rows for n in [(t or "").translate(LOWER)]
    )


@pytest.mark.parametrize("counters", [4, 512])
def test_matches_brute_force(spark, counters):
    rng = random.Random(2)
    texts = ["Hot text"] * 200 + ["hOT TEXT", "hot  text", None, "", "É", "é", "K", "k", "K", "x" * 100_000] + [f"t{rng.randint(0, 80)}" for _ in range(300)]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("digest", F.lit(1))
    out = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, counters=counters).collect())
    assert out == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = exact_dedup(df).collect()
    assert sorted((r.text_sha256[:2], r.keep_id or 0, r.group_size, r.kept) for r in out) == [
        ("3e", 0, 2, False), ("3e", 0, 2, True), ("ca", 1, 3, False), ("ca", 1, 3, False), ("ca", 1, 3, True),
    ]
    assert exact_dedup(df.limit(0)).collect() == []


def test_misra_gries_bounds():
    rng = random.Random(1)
    values = [b"a"] * 400 + [b"b"] * 300 + [str(rng.randint(0, 500)).encode() for _ in range(600)]
    rng.shuffle(values)
    held, true = misra_gries(iter(values), 9), Counter(values)
    assert len(held) <= 9
    for v, n in true.items():
        assert n - len(values) / 10 <= held.get(v, 0) <= n
