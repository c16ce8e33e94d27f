import json

from strandline.operators.search import mismatch_hits
from strandline.sources.queries import read_queries
from strandline.streaming.queries import read_query_stream, search_queries, watch_sequences


def test_arriving_queries(spark, tmp_path):
    proteins = spark.createDataFrame([(1, "MKACDEFGHIK"), (2, "WWACDYFGW")], "protein_num long, sequence string")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"ordinal": 1, "query_id": "a", "query_seq": "acdefg"}) + "\n")
    got = []
    run = lambda: search_queries(
        read_query_stream(spark, str(folder)), proteins, lambda df, i: got.extend((i, r.query_id, r.protein_num, r.edits) for r in df.collect()),
        str(tmp_path / "checkpoint"), max_mismatches=1,
    ).awaitTermination()
    run()
    assert sorted(got) == [(0, "a", 1, 0), (0, "a", 2, 1)]
    (folder / "2.json").write_text(json.dumps({"ordinal": 2, "query_id": "b", "query_seq": "QQQQ"}) + "\n")
    run()
    assert got[2:] == [(1, "b", None, None)]


def test_arriving_sequences_without_state(spark, tmp_path):
    rows = [(1, "MKACDEFGHIKACDACDACD"), (2, "WWACDYFGWACDACD"), (3, "AC")]
    table = spark.createDataFrame(rows, "protein_num long, sequence string")
    table.write.parquet(str(tmp_path / "in"))
    queries = read_queries(spark, ["ACDACD", "ACDEFGH"])
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = watch_sequences(stream, queries, k=2, max_mismatches=2).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.ordinal, r.protein_num, r.start, r.matched, r.edits)
    assert sorted(map(key, spark.table("watched").collect())) == sorted(map(key, mismatch_hits(table, queries, 2, 2).collect()))
