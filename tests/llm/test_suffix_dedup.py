import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import induced_sort
from strandline.llm import suffix_dedup as sd
from strandline.llm.induced_sort import MEMORY, suffix_array


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) per text, from counts of all strings."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated(parts, length):
    """For each distinct segment, which of its strings are repeated."""
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    out = [np.zeros(len(p) - length + 1, bool) for p in parts]
    for i, a, z in zip(*sd.repeated_runs(data, offsets, np.ones(len(parts), np.int64), length), strict=True):
        assert a < z and not out[i][a:z].any()
        out[i][a:z] = True
    return out


def run(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sd.suffix_dedup(df, length).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(10, 90)) for _ in range(5)]
    out = []
    for _ in range(n):
        t = text(rng.randint(0, 120))
        if rng.random() < 0.5:
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(passages) + t[at:]
        if out and rng.random() < 0.2:
            t = out[rng.randrange(len(out))]
            if rng.random() < 0.5 and t:
                at = rng.randrange(len(t))
                t = t[:at] + "X" + t[at:]
        out.append(t)
    return out + [None, "", "=" * 1000, "ab" * 300, "short"]


@pytest.mark.parametrize("seed, length, hot, depth, chunk", [(1, 200, 20_000, 12, 8 << 20), (2, 60, 3, 12, 100), (3, 60, 3, 1, 8 << 20)])
def test_matches_brute_force(spark, monkeypatch, seed, length, hot, depth, chunk):
    monkeypatch.setattr(sd, "HOT", hot)  # with a low limit, crowded anchors are dealt again
    monkeypatch.setattr(sd, "DEPTH", depth)  # and then settled string by string
    monkeypatch.setattr(sd, "CHUNK", chunk)
    monkeypatch.setattr(sd, "SHARD", 4000)
    texts = planted(seed)
    assert run(spark, texts, length) == brute(texts, length)


def test_repeated_rows_null_ids_clashing_columns_and_empty(spark):
    t = "q" * 10 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, "x" + t), (2, "other")], "doc_id long, text string")
    df = df.withColumn("f", F.lit(1)).withColumn("th", F.lit("y")).withColumn("n_bytes", F.lit(0))
    rows = sd.suffix_dedup(df, 200, outputs=True).collect()
    got = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept) if r.kept is not None else None) for r in rows)
    assert got == [(0, 310, b"x"), (1, 310, b""), (1, 310, b""), (2, 0, None)]
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_greatest_owned_string_with_unowned_suffixes_after_it(spark):
    shared = "zy" + "".join(chr(97 + i * 7 % 25) for i in range(190)) + "zzzzabcd"
    texts = [shared + "a", shared + "b"]
    assert run(spark, texts, 200) == brute(texts, 200)
    for seed in range(200):
        rng = random.Random(seed)
        length = rng.randint(2, 6)
        parts = list({bytes(rng.choices(b"abz", k=rng.randint(length, 2 * length - 1))) for _ in range(rng.randint(1, 6))})
        strings = [[p[i : i + length] for i in range(len(p) - length + 1)] for p in parts]
        every = sum(strings, [])
        found = repeated(parts, length)
        assert [f.tolist() for f in found] == [[every.count(x) > 1 for x in own] for own in strings]


def naive_arrays(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def test_induced_sorting_with_and_without_disk():
    for seed in range(300):
        rng = random.Random(seed)
        symbols = rng.choice([2, 3, 5, 20])
        text = [rng.randint(1, symbols) for _ in range(rng.randint(0, 70))] * rng.randint(1, 3)
        text += [symbols] * rng.choice([0, 0, 25]) + [0]
        cap = rng.choice([1, 5, 200])
        order, lcp = suffix_array(np.array(text, np.uint16), symbols + 1, cap, rng.choice([MEMORY, 40]))
        assert (order.tolist(), lcp.tolist()) == naive_arrays(text, cap)


@pytest.mark.parametrize("chunk", [8 << 20, 37])
def test_every_string_belongs_to_one_segment(monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    raw = np.frombuffer(("".join(planted(9)[:20])).encode(), np.uint8)
    offsets = np.array([0, 700, 700, 900, len(raw)])
    value, start, count, anchor = sd.segments(raw, offsets, 200)
    strings = sorted(s + i for s, n in zip(start, count, strict=True) for i in range(n))
    assert strings == [i for a, z in zip(offsets, offsets[1:], strict=False) for i in range(a, z - 199)]
    assert ((start >= offsets[value]) & (start + count + 199 <= offsets[value + 1])).all()
    # a string's anchor does not depend on where chunks end
    monkeypatch.setattr(sd, "CHUNK", 1 << 20)
    _, start2, count2, anchor2 = sd.segments(raw, offsets, 200)
    of = lambda s, n, f: np.repeat(f, n)[np.argsort(np.concatenate([np.arange(a, a + k) for a, k in zip(s, n, strict=True)]))]
    assert (of(start, count, anchor) == of(start2, count2, anchor2)).all()


def test_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    texts = [long, "x" + long[1_000_000:1_000_500] + "y", "z" * 2_000_000]
    got = run(spark, texts, 200)
    assert [r[1:3] for r in got] == [(500, 1), (500, 1), (2_000_000, 1)]


def test_a_shard_of_production_size_waits_on_disk(monkeypatch):
    spilled = []
    spill = induced_sort.BucketQueue._spill
    monkeypatch.setattr(induced_sort.BucketQueue, "_spill", lambda self: spilled.append(1) or spill(self))
    rng = random.Random(6)
    parts = list({bytes(rng.choices(b"abcdefghijkl ", k=350)) for _ in range(sd.SHARD // 350)})
    twice = parts[0][:250] + bytes(rng.choices(b"xyz", k=100))
    found = repeated([*parts, twice], 200)
    assert spilled and [f.sum() for f in found if f.any()] == [51, 51]
