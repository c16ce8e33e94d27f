import csv
import json
import zipfile

import pytest

from strandline import IndexBuilder, ProteinIndex, Search
from strandline.cli import main
from strandline.functions.headers import metadata
from strandline.functions.indel_text import describe
from strandline.operators.kmers import kmers, postings
from strandline.recall import read_expected, recall_percent, scan_hits, timed, write_report
from strandline.sources.fasta import lines, read_fasta
from strandline.sources.queries import read_queries
from strandline.sources.sinks import output_path, write_parquet, write_single


def test_fasta_layouts_and_order(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_bytes(b"stray\n>one a->b\r\nACD\r\n EF \r\n\r\n>two\nGH\n\n>three\n>four |x\nIK\nLM")
    rows = [(r.protein_num, r.header, r.sequence, r.seq_len) for r in read_fasta(spark, str(path)).orderBy("protein_num").collect()]
    # text before the first header is no record
    assert [r[1:3] for r in rows] == [("one a->b", "ACDEF"), ("two", "GH"), ("three", ""), ("four |x", "IKLM")]
    assert [r[0] for r in rows] == [1, 2, 3, 4] and rows[0][3] == 5


def test_fasta_order_survives_splits(spark, tmp_path):
    path = tmp_path / "big.fasta"
    path.write_text("".join(f">p{i}\n{'ACDEFGHIKL' * (i % 7 + 1)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read_fasta(spark, str(path))
        assert lines(spark, str(path), "\n>").rdd.getNumPartitions() > 1
        assert [r.header for r in df.orderBy("protein_num").collect()] == [f"p{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_query_sources(spark, tmp_path):
    get = lambda q: [(r.ordinal, r.query_id, r.query_seq) for r in read_queries(spark, q).orderBy("ordinal").collect()]
    assert get(["abc", "De"]) == [(1, "1", "ABC"), (2, "2", "DE")]
    (tmp_path / "q.txt").write_text("abc\n\n  de \n")
    assert get(str(tmp_path / "q.txt")) == [(1, "1", "ABC"), (2, "2", "DE")]
    (tmp_path / "q.FA").write_text(">x 1 more\nab\nc\n>y\nde\n>x again\nfg\n")
    assert get(str(tmp_path / "q.FA")) == [(1, "x", "ABC"), (2, "y", "DE"), (3, "x", "FG")]
    df = spark.createDataFrame([("k", "abc")], "query_id string, query_seq string")
    assert get(df) == [(1, "k", "ABC")]


def test_header_fields(spark):
    headers = [
        "sp|Q1|A_B Alpha, beta (Fragment) OS=Homo sapiens OX=9606 GN=AB PE=1 SV=2",
        "sp|Q1-2|A_B Isoform 2 OS=Homo sapiens OX=9606 GN=AB SV=1",
        "tr|Q2|C_D Two OS=Mus musculus GN=CD PE=0",
        "plain_id with words",
        "bare",
        "sp||no id",
        "sp|Q3|E_F Three GN=AB PE=4",
        "sp|Q9-1|G Nine PE=0",
    ]
    df = spark.createDataFrame(list(enumerate(headers, 1)), "protein_num long, header string")
    r = {x.protein_num: x for x in metadata(df).collect()}
    assert (r[1].protein_id, r[1].protein_name, r[1].species, r[1].taxon_id, r[1].gene) == ("Q1", "Alpha, beta (Fragment)", "Homo sapiens", "9606", "AB")
    assert (r[1].pe_level, r[1].sequence_version, r[1].gene_priority, r[1].swissprot) == (1, 2, 1, True)
    assert (r[2].pe_level, r[2].gene_priority) == (1, 0)  # from its canonical entry
    assert (r[3].species, r[3].taxon_id, r[3].pe_level, r[3].sequence_version, r[3].swissprot) == ("Mus musculus GN=CD PE=0", None, 0, 1, False)
    assert (r[4].protein_id, r[4].protein_name, r[4].gene) == ("plain_id", "with words", None)
    assert (r[5].protein_id, r[5].protein_name) == ("bare", None)
    assert r[6].protein_id is None and r[7].gene_priority == 0 and r[8].pe_level == 0


@pytest.mark.parametrize(
    "query, matched, text",
    [
        ("GATTACA", "GATTACA", "[]"), ("CATTAG", "CATAG", "d: T[3,4]"), ("CATAG", "CATTAG", "i: T[3,4]"),
        ("WQQW", "WW", "d: QQ[2]"), ("WQRSW", "WRW", "d: Q[2], d: S[4]"), ("WKW", "WKLMW", "i: LM[3]"),
        ("WABABW", "WABW", "d: AB[2], d: BA[3], d: AB[4]"), ("CCCCC", "CCC", "d: CC[2,3]"), ("CCC", "CCCCC", "i: CC[2,3]"),
        ("TRST", "TXRYST", "i: X[2], i: Y[3]"), ("AC", "ABC", "i: B[2]"),
    ],
)
def test_edit_texts(query, matched, text):
    assert describe(query, matched) == text


def test_kmers_and_postings(spark):
    df = spark.createDataFrame([(1, "ACACA"), (2, "AC"), (3, "A"), (4, None)], "protein_num long, sequence string")
    assert sorted((r.kmer, r.protein_num, r.pos) for r in kmers(df, 2).collect()) == [
        ("AC", 1, 0), ("AC", 1, 2), ("AC", 2, 0), ("CA", 1, 1), ("CA", 1, 3),
    ]
    lists = {r.kmer: [(p.protein_num, p.pos) for p in r.positions] for r in postings(kmers(df, 2)).collect()}
    assert lists["AC"] == [(1, 0), (1, 2), (2, 0)]


def test_index_is_reused_and_follows_content(spark, tmp_path):
    path = tmp_path / "p.fasta"
    path.write_text(">a\nACDEFG\n")
    root = IndexBuilder(str(path), preprocessed_files_path=str(tmp_path), proteome_name="own", spark=spark).preprocess(3)
    index = ProteinIndex(spark, str(path), str(tmp_path), "own")
    assert index.root == root and index.has(3) and not index.has(2)
    assert index.kmers(2).count() == 5 and index.has(2)
    path.write_text(">a\nACDEFH\n")
    assert not ProteinIndex(spark, str(path), str(tmp_path), "own").has(3)
    with pytest.raises(ValueError):
        index.build(1)
    with pytest.raises(FileNotFoundError):
        ProteinIndex(spark, str(tmp_path / "none.fasta"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, True, None), ('q"\t', 2, False, 1.5)], "s string, n long, b boolean, x double")
    rows = list(csv.reader(open(write_single(df, "csv", tmp_path / "r"), newline="")))
    assert rows == [["s", "n", "b", "x"], ["a,b", "1", "true", ""], ['q"\t', "2", "false", "1.5"]]
    assert list(csv.reader(open(write_single(df, "tsv", tmp_path / "r.TSV"), newline=""), delimiter="\t"))[1][0] == "a,b"
    assert json.load(open(write_single(df, "json", tmp_path / "r")))[0] == {"s": "a,b", "n": 1, "b": True, "x": None}
    with zipfile.ZipFile(write_single(df, "xlsx", tmp_path / "r")) as z:
        assert "a,b" in z.read("xl/worksheets/sheet1.xml").decode()
    write_parquet(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert output_path("", "csv") == "search_results.csv" and output_path("a.CSV", "csv") == "a.CSV"
    with pytest.raises(ValueError):
        write_single(df, "parquet", "x")


def test_command_line_and_formats(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.fasta").write_text(">sp|P1|X Y OS=A OX=1 SV=2\nMKACDEFGHIK\n")
    (tmp_path / "q.txt").write_text("ACDEF\nACDEY\n")
    assert main(["preprocess", "-p", "p.fasta", "-k", "5"], spark) == 0
    assert main(["match", "-q", "q.txt", "-p", "p.fasta", "-k", "5", "-o", "out"], spark) == 0
    rows = list(csv.DictReader(open("out.csv")))
    assert [(r["Query ID"], r["Protein ID"], r["Index start"]) for r in rows] == [("1", "P1.2", "3"), ("2", "", "")]
    assert main(["match", "-q", "q.txt", "-p", "p.fasta", "-m", "1", "-k", "2", "-c", "-f", "tsv", "-o", "counts"], spark) == 0
    assert [r["Count"] for r in csv.DictReader(open("counts.tsv"), delimiter="\t")] == ["1", "1"]
    args = dict(proteome_file="p.fasta", preprocessed_files_path=str(tmp_path), spark=spark)
    assert list(Search(["ACDEF"], output_format="pandas", **args).match()["Protein ID"]) == ["P1.2"]
    assert Search(["ACDEF"], output_format="json", output_name="o", **args).match() is None
    assert json.load(open("o.json"))[0]["Index end"] == 7


def test_recall_harness(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">a\nMKACDEFGHIKACDEF\n")
    result = Search(["ACDEF"], str(tmp_path / "p.fasta"), preprocessed_files_path=str(tmp_path), spark=spark).match()
    write_report([{c: r[c] for c in ("Query Sequence", "Matched Sequence", "Protein ID", "Index start")} for r in result.collect()]
                 + [{"Query Sequence": "ACDEF", "Matched Sequence": "ACDEF", "Protein ID": "b.1", "Index start": 1}], str(tmp_path / "want.tsv"))
    row = recall_percent(result, read_expected(spark, str(tmp_path / "want.tsv"))).first()
    assert (row.expected, row.found) == (3, 2) and abs(row.recall - 200 / 3) < 1e-9
    assert timed(lambda: None)[1] >= 0 and timed(lambda: len(1)) == (None, None)
    df = spark.createDataFrame([(1, "MKACDEFGHIKACDYF")], "protein_num long, sequence string")
    hits = scan_hits(df, read_queries(spark, ["ACDEF", "MKA"]), 1).collect()
    assert sorted((h.ordinal, h.start, h.edits) for h in hits) == [(1, 2, 0), (1, 11, 1), (2, 0, 0), (2, 9, 1)]
