"""The driver queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_decode
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .language_id import identify_languages
from .license_scan import license_scan
from .mixing import mix_sources
from .near_dedup import near_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def learnable(id_col: str = "doc_id"):
    """Rows that may be learnt from: those that are not held out (rows without an id are)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"), learnable())
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "languages")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=200)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("detections", F.size("detections"))


def queries() -> dict:
    listed = (
        op1_bpe, op2_language_id, op3_token_counts, op4_near_dedup, op5_suffix_dedup, op6_html_text, op7_exact_dedup,
        op8_nearest, op9_mix_sources, op10_license_scan,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            with t as (
              select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
              from documents)
            select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
                   doc_id = max(doc_id) over same as kept, sha256(norm) as text_sha256
            from t window same as (partition by norm)""",
    }
