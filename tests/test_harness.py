"""The benchmark runner on a small proteome."""

import random

from strandline.harness import Dataset, datasets, run_benchmark
from strandline.recall import KEY, write_report


def test_rows_of_every_dataset_and_method(spark, tmp_path):
    rng = random.Random(2)
    proteins = [(f"sp|P{i}|X{i}_Y Name OS=Some OX=1 GN=G PE=1 SV=1", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=120))) for i in range(8)]
    (tmp_path / "p.fasta").write_text("".join(f">{h}\n{s}\n" for h, s in proteins))
    queries = [(i, s[10 * i : 10 * i + 9]) for i, (_, s) in enumerate(proteins)]
    (tmp_path / "q.fasta").write_text("".join(f">{i}\n{q}\n" for i, q in queries))
    expected = ["\t".join(KEY), *(f"{q}\t{q}\tP{i}\t{10 * i + 1}" for i, q in queries)]
    (tmp_path / "e.tsv").write_text("\n".join(expected) + "\n")
    files = [str(tmp_path / n) for n in ("q.fasta", "p.fasta", "e.tsv")]
    listed = [Dataset("exact", *files), Dataset("near", *files, max_mismatches=2), Dataset("best", *files, best_match=True)]
    rows = run_benchmark(spark, listed, str(tmp_path / "index"), memory=True)
    assert [(r["dataset"], r["method"], r["recall"]) for r in rows] == [
        ("exact", "seeded", 100.0), ("exact", "scan", 100.0), ("near", "seeded", 100.0), ("near", "scan", 100.0),
        ("best", "seeded", 100.0), ("best", "scan", None),
    ]
    assert all(r["search_s"] > 0 and r["peak_mb"] >= 0 for r in rows[:5]) and rows[0]["preprocess_s"] > 0 and rows[1]["preprocess_s"] is None
    write_report(rows, str(tmp_path / "report.tsv"))
    assert len((tmp_path / "report.tsv").read_text().splitlines()) == 7
    assert [(d.max_mismatches, d.best_match) for d in datasets("x")] == [(0, False), (0, True), (2, False), (3, False)]
