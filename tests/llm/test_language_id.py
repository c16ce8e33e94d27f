import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_id as li
from strandline.llm.queries import learnable, op2_language_id


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(op2_language_id(spark, sf_dir), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_ids_and_sources_of_predicted_rows_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(learnable(), F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    one = li.identify_languages(docs, learnable()).collect()
    two = li.identify_languages(hidden, learnable()).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_mixtures_and_edge_cases(spark):
    en, de = "the house and the garden were there when they came ", "das haus und der garten waren schon da als sie kamen "
    train = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    probe = [(100, en * 4, None), (101, None, "en"), (102, " 123 !? ", "de"), (103, (en + de) * 30, None), (104, "", None), (104, "", None), (105, "ß", "x")]
    df = spark.createDataFrame(train + probe, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    rows = li.identify_languages(df, F.col("doc_id") < 100).collect()
    out = {r.doc_id: r for r in rows}
    assert len(rows) == 47
    assert out[100].lang_pred == "en" and out[100].languages.startswith("en:1.0")
    assert {out[i].lang_pred for i in (101, 102, 104)} == {"und"} and out[101].score == 0
    assert out[103].languages.count(":") == 2 and 0.3 < out[103].score < 0.7
    other = df.withColumnRenamed("score", "c1")
    carried = li.identify_languages(other, F.col("doc_id") < 100, carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "c1", "lang_pred", "score"]
    assert [(r.c1, 0 <= r.score <= 1) for r in carried.collect()] == [("s", True)] * 47
    with pytest.raises(ValueError):  # no column is lost in silence
        li.identify_languages(df, carry=True)
    assert {r.lang_pred for r in li.identify_languages(df, F.col("doc_id") < 100, most=1).collect()} == {"de", "und"}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.identify_languages(unlabelled).collect()} == {"und"}
    assert li.identify_languages(df.limit(0)).collect() == []


def test_em_raises_the_likelihood_to_the_known_mixture():
    rng = np.random.default_rng(3)
    like = np.exp(-4 * rng.random((4000, 3))).astype(np.float32)
    like[:1000, 0] = 1
    like[1000:, 1] = 1
    p, value = li._em(like, np.array([0, 4000]), np.ones((1, 3), np.float32))
    grid = max(
        ((a, b) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, 21)),
        key=lambda x: np.log(like @ np.array([x[0], x[1], 1 - x[0] - x[1]]) + 1e-30).sum(),
    )
    assert abs(p[0, 0] - grid[0]) < 0.06 and abs(p[0, 1] - grid[1]) < 0.06 and np.isfinite(value).all()
