import random

import pytest

from strandline import recall
from strandline.sources.queries import read_queries

from test_search import brute_mismatch, found, proteins


@pytest.mark.parametrize("budget", [1, 2, 5])
def test_scan_equals_the_definition(spark, monkeypatch, budget):
    rng = random.Random(budget)
    monkeypatch.setattr(recall, "_PLACES", 50)
    text = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    seqs = [text(rng.randint(0, 60)) for _ in range(40)] + [""]
    queries = sorted({text(n) for n in (1, 3, 4, 9, 12, 12, 12, 40)} | {seqs[0][2:14] or "ACD"})
    got = found(recall.scan_hits(proteins(spark, [*seqs, None]), read_queries(spark, queries), budget))
    assert got == sorted(brute_mismatch(seqs, queries, budget))


def test_scan_of_many_windows_is_done_in_arrays(spark):
    """The join of 4 million windows with 200 queries took 42 s."""
    import time

    rng = random.Random(1)
    seq = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=1_000_000))
    queries = sorted({seq[i * 4000 : i * 4000 + 12] for i in range(200)})
    table, q = proteins(spark, [seq] * 4), read_queries(spark, queries)
    recall.scan_hits(proteins(spark, ["ACD"]), q, 2).collect()
    start = time.time()
    hits = recall.scan_hits(table, q, 2).filter("edits = 0").collect()
    assert len(hits) >= 800 and time.time() - start < 30
