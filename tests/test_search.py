"""Search modes against definitions written out in plain Python."""

import random

import pytest

from strandline import Search
from strandline.operators import best, results, search
from strandline.operators.positional import parse, positional_hits
from strandline.plans.planner import auto_k, clamp_k
from strandline.sources.queries import read_queries


def write_fasta(path, records):
    path.write_text("".join(f">{h}\n{s}\n" for h, s in records))
    return str(path)


def proteins(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs, 1)], "protein_num long, sequence string")


def found(df):
    return sorted((r.ordinal, r.protein_num, r.start, r.matched, r.edits) for r in df.collect())


def distance(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def brute_mismatch(seqs, queries, budget, k=None):
    out = []
    for o, q in enumerate(queries, 1):
        if k and len(q) < k:
            continue
        offsets = range(0, len(q) - (k or 1) + 1, k if k and len(q) % k == 0 else 1)
        for p, s in enumerate(seqs, 1):
            for st in range(len(s) - len(q) + 1):
                w = s[st : st + len(q)]
                if distance(w, q) <= budget and (not k or any(q[i : i + k] == w[i : i + k] for i in offsets)):
                    out.append((o, p, st, w, distance(w, q)))
    return sorted(out)


def is_sub(short, long):
    it = iter(long)
    return all(c in it for c in short)


def brute_indel(seqs, queries, n):
    out = set()
    for o, q in enumerate(queries, 1):
        for p, s in enumerate(seqs, 1):
            for st in range(len(s)):
                for size in range(max(1, len(q) - n), len(q) + n + 1):
                    w = s[st : st + size]
                    if len(w) < size:
                        continue
                    near = len(w) >= 2 and len(w) != len(q) and w[0] == q[0] and w[-1] == q[-1]
                    if w == q or (near and (is_sub(w, q) if len(w) < len(q) else is_sub(q, w))):
                        out.add((o, p, st, w, abs(len(w) - len(q))))
    return sorted(out)


def random_case(seed, letters="ACDEFGHIK", n=6):
    rng = random.Random(seed)
    text = lambda size: "".join(rng.choice(letters) for _ in range(size))
    seqs = [text(rng.randint(0, 60)) for _ in range(n)]
    queries = []
    for _ in range(n):
        s = max(seqs, key=len)
        at, size = rng.randrange(max(1, len(s) - 14)), rng.randint(4, 13)
        q = list(s[at : at + size])
        for _ in range(rng.randint(0, 2)):
            q[rng.randrange(len(q))] = rng.choice(letters)
        queries.append("".join(q))
    return seqs, queries


@pytest.mark.parametrize("seed", range(3))
def test_exact_is_independent_of_k_and_of_the_physical_form(spark, seed):
    seqs, queries = random_case(seed)
    table, q = proteins(spark, seqs), read_queries(spark, queries)
    want = brute_mismatch(seqs, queries, 0)
    assert found(search.exact_hits(table, q, 4)) == want
    assert found(search.exact_hits(table, q, 2)) == want
    assert found(search.exact_hits_by_voting(table, q, 3)) == want
    from strandline.operators.kmers import kmers

    assert found(search.exact_hits(table, q, 3, index=kmers(table, 3))) == want


@pytest.mark.parametrize("seed, k, budget", [(0, 2, 1), (1, 2, 2), (2, 3, 2), (3, 3, 3), (4, 4, 2)])
def test_mismatch_equals_the_seeded_definition(spark, seed, k, budget):
    seqs, queries = random_case(seed, "ACDE")
    got = found(search.mismatch_hits(proteins(spark, seqs), read_queries(spark, queries), k, budget))
    assert got == brute_mismatch(seqs, queries, budget, k)


def test_mismatch_shuffled_form_and_completeness(spark, monkeypatch):
    seqs, queries = random_case(11, "ACD")
    table, q = proteins(spark, seqs), read_queries(spark, queries)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    k = auto_k(min(map(len, queries)), 1)
    assert found(search.mismatch_hits(table, q, k, 1)) == brute_mismatch(seqs, queries, 1)


@pytest.mark.parametrize("seed, n", [(0, 1), (1, 1), (2, 2), (3, 2)])
def test_indels_equal_the_closed_form(spark, seed, n):
    seqs, queries = random_case(seed, "ACD" if seed % 2 else "ACDEFG")
    queries = [q for q in queries if len(q) >= 2 * (n + 1)]
    got = found(search.indel_hits(proteins(spark, seqs), read_queries(spark, queries), 2, n))
    assert got == brute_indel(seqs, queries, n)


def test_indel_candidates_are_tested_in_generated_code(spark):
    """A filter outside it would hold, for each candidate of a sequence, a copy of the whole sequence."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = search.indel_hits(proteins(spark, ["ACDEFGHIKL"]), read_queries(spark, ["ACDEFGHI"]), 2, 2)
        plan = hits._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    filters = [line for line in plan if "Filter (" in line]
    assert filters and all("*(" in line for line in filters), filters


def test_positional_rules(spark):
    seqs = ["NQALLKMWY", "NQA", "NAALLKMWY"]
    q = parse(read_queries(spark, ["N1, A3, L5", "l5, n1", "A3, W8, Q2", "N1, N01", "PEPTIDE"]))
    rows = {r.ordinal: r.query_seq for r in q.collect()}
    assert rows == {1: "N1, A3, L5", 2: "L5, N1", 3: "A3, W8, Q2", 4: "N1, N1"}
    got = [(r.ordinal, r.protein_num, r.matched, r.edits, r.positions, r.first, r.last) for r in positional_hits(proteins(spark, seqs), q, 1).collect()]
    assert (1, 1, "N1, A3, L5", 0, "[]", 1, 5) in got and (2, 1, "L5, N1", 0, "[]", 5, 1) in got
    assert (3, 3, "A3, W8, A2", 1, "[2]", 3, 2) in got
    assert not any(p == 2 and o in (1, 2, 3) for o, p, *_ in got)


@pytest.mark.parametrize("seed", range(3))
def test_best_match_is_the_nearest_window(spark, seed):
    seqs, queries = random_case(seed + 20, "ACDEF")
    table, q = proteins(spark, seqs), read_queries(spark, queries)
    got = {}
    for o, p, st, _, d in found(best.closest_hits(table, q)):
        got.setdefault(o, (d, set()))[1].add((p, st))
    for o, text in enumerate(queries, 1):
        hits = [h for h in brute_mismatch(seqs, [text], len(text), 2)]
        least = min((h[4] for h in hits), default=None)
        assert got.get(o, (None, set())) == (least, {(h[1], h[2]) for h in hits if h[4] == least})
    ladder = {}
    for o, p, st, _, d in found(best.best_match_hits(table, q, lambda df: df.cache())):
        ladder.setdefault(o, []).append((d, p, st))
    for o, hits in ladder.items():
        assert min(hits)[0] == got[o][0]


# Header texts vary one field at a time; the first of each pair must win.
HEADER = "{kind}|{id}|X_Y {name} OS=Homo sapiens OX=9606{gene}{pe} SV=1"


def header(kind="sp", id="P1", name="Some protein", gene=" GN=G", pe=" PE=1"):
    return HEADER.format(kind=kind, id=id, name=name, gene=gene, pe=pe)


@pytest.mark.parametrize(
    "better, worse",
    [
        (header(id="P2"), header(id="P3", kind="tr")),
        (header(kind="tr", id="Q1", gene=""), header(kind="tr", id="Q2-2", gene="")),
        (header(id="P9", gene=""), header(kind="tr", id="P8", gene="")),
        (header(kind="tr", id="A1", gene="", pe=" PE=1"), header(kind="tr", id="A2", gene="", pe=" PE=3")),
        (header(kind="tr", id="B1", gene=""), header(kind="tr", id="B2", gene="", name="Some protein (Fragment)")),
    ],
)
@pytest.mark.parametrize("swap", [False, True])
def test_tie_breaks(spark, tmp_path, better, worse, swap):
    records = [(better, "MKACDEFGHIKLW"), (worse, "WWACDEFGHIKLM")]
    path = write_fasta(tmp_path / "p.fasta", records[::-1] if swap else records)
    rows = Search(["ACDEFGHIKL"], path, best_match=True, preprocessed_files_path=str(tmp_path), spark=spark, use_index=False).match().collect()
    assert [r["Protein ID"] for r in rows] == [better.split("|")[1] + ".1"]


def test_facade_rows_misses_and_versions(spark, tmp_path):
    path = write_fasta(
        tmp_path / "p.fasta",
        [("sp|P1|A_B Alpha one OS=Mus musculus OX=10090 GN=Ab PE=2 SV=3", "MKTAYIAKQRQ"), ("plain", "GGTAYIAKGG\nTAYIAK")],
    )
    args = dict(preprocessed_files_path=str(tmp_path), spark=spark)
    df = Search(["TAYIAK", "WWWWWW"], path, **args).match()
    assert df.columns == list(results.COLUMNS.values())
    rows = [(r["Query ID"], r["Protein ID"], r["Index start"], r["Index end"], r["Mutated Positions"]) for r in df.collect()]
    assert rows == [("1", "P1.3", 3, 8, "[]"), ("1", "plain.1", 3, 8, "[]"), ("1", "plain.1", 11, 16, "[]"), ("2", None, None, None, "[]")]
    first = df.collect()[0]
    assert (first["Protein Name"], first["Species"], first["Taxon ID"], first["Gene"]) == ("Alpha one", "Mus musculus", "10090", "Ab")
    assert (first["Protein Existence Level"], first["Gene Priority"], first["SwissProt Reviewed"]) == (2, 1, True)
    bare = Search(["TAYIAK"], path, sequence_version=False, use_index=False, **args).match().collect()
    assert [r["Protein ID"] for r in bare] == ["P1", "plain", "plain"]
    mixed = Search(["TAYIAR", "M1, K2", "T3, A4, W5"], path, max_mismatches=1, **args).match().collect()
    assert [(r["Query ID"], r["Matched Sequence"], r["Mismatches"], r["Mutated Positions"]) for r in mixed] == [
        ("1", "TAYIAK", 1, "[6]"), ("1", "TAYIAK", 1, "[6]"), ("1", "TAYIAK", 1, "[6]"),
        ("2", "M1, K2", 0, "[]"), ("3", "T3, A4, Y5", 1, "[5]"), ("3", "T3, A4, Y5", 1, "[5]"),
    ]


def test_facade_indels(spark, tmp_path):
    path = write_fasta(tmp_path / "p.fasta", [("P", "MKVNALVETRFCGHI"), ("Q", "MKABXCDYEFWW")])
    args = dict(preprocessed_files_path=str(tmp_path), spark=spark)
    df = Search(["NALVEATRFC", "HHHHHH"], path, max_indels=1, **args).match()
    assert "Indels" in df.columns and "Mismatches" not in df.columns
    rows = df.collect()
    assert (rows[0]["Matched Sequence"], rows[0]["Indels"], rows[0]["Indel Positions"]) == ("NALVETRFC", 1, "d: A[6]")
    assert rows[1]["Matched Sequence"] is None and rows[1]["Indel Positions"] is None
    rows = Search(["ABCDEF"], path, max_indels=2, **args).match().collect()
    assert [(r["Matched Sequence"], r["Indel Positions"]) for r in rows] == [("ABXCDYEF", "i: X[3], i: Y[5]")]


def test_counts_equal_the_hits(spark, tmp_path):
    seqs, queries = random_case(31, "ACD")
    queries = [q for q in queries if len(q) >= 4]
    path = write_fasta(tmp_path / "p.fasta", [(f"P{i}", s) for i, s in enumerate(seqs) if s])
    args = dict(max_mismatches=1, preprocessed_files_path=str(tmp_path), spark=spark)
    rows = Search(queries, path, counts_only=True, **args).match().collect()
    want = {}
    for o, *_, d in brute_mismatch([s for s in seqs if s], queries, 1, auto_k(min(map(len, queries)), 1)):
        want[str(o), d] = want.get((str(o), d), 0) + 1
    assert {(r["Query ID"], r["Mismatches"]): r["Count"] for r in rows} == want


def test_arguments_and_warnings(spark, tmp_path, capsys):
    path = write_fasta(tmp_path / "p.fasta", [("P", "ZZABCDEFGHIKLMZZ")])
    bad = lambda message, *a, **b: pytest.raises(ValueError, match=message)
    for message, kw in [
        ("k must be", dict(k=1)), ("max_indels", dict(max_indels=3)), ("mutually", dict(max_indels=1, max_mismatches=1)),
        ("best_match", dict(max_indels=1, best_match=True)), ("counts_only", dict(max_indels=1, counts_only=True)),
        ("Invalid output", dict(output_format="parquet")), ("counts_only", dict(counts_only=True, best_match=True)),
        ("cannot exceed", dict(k=9)),
    ]:
        with bad(message):
            Search(["ABCDE"], path, spark=spark, **kw)
    with bad("empty"):
        Search([], path, spark=spark)
    with bad("together"):
        Search(["A1, B2"], path, max_indels=1, spark=spark)
    with bad("Unsupported"):
        Search(write_fasta(tmp_path / "q.doc", [("a", "b")]), path, spark=spark)
    with pytest.raises(FileNotFoundError):
        Search(str(tmp_path / "none.txt"), path, spark=spark)
    with pytest.warns(UserWarning, match="complete recall"):
        Search(["ABCE"], path, max_mismatches=2, spark=spark, preprocessed_files_path=str(tmp_path)).match()
    assert "lengths: [4]" in capsys.readouterr().out
    assert clamp_k(0, 3) == 3 and clamp_k(2, 3) == 2 and clamp_k(5, 3) == 3
    assert "using k=3" in capsys.readouterr().out
    assert [best.ladder_lengths(n) for n in (15, 9, 2, 1)] == [[15, 7, 3, 2], [9, 4, 2], [2], [2]]
