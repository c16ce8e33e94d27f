"""Language identification by multilingual mixture inference.

Training.  Byte 4-grams of words (one per letter position: the byte before, the
byte, the two after, cut at the word's end) are hashed into ``BUCKETS`` cells
and counted per language over a bounded sample: about ``SAMPLE`` labelled rows a
language, chosen by a hash of the id.  The table of log probabilities has
languages x BUCKETS cells whatever the input, and is broadcast; at most
``LANGUAGES`` labels are learnt, those of most rows, so it stays under 64 MB.

Prediction, from the text alone.  Every word of a text has a likelihood under
each language, from its n-grams.  Expectation-maximisation estimates the
document's language proportions, each word being a draw from the mixture.  The
language set grows from the best single language by the one that raises the
likelihood most, as long as the gain exceeds a penalty of ``PENALTY`` / 2 *
log(words) for each language more.  The answer is the language with the largest
proportion in the chosen set (ties: the first in code point order), the score
that proportion.  All documents of a block go through the iterations together.

Null texts and texts without a letter are `und` with score 0, as is everything
if no row is labelled.  Prediction is a map: no shuffle, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import blocks, flat

BUCKETS = 1 << 16
SAMPLE = 1500
LANGUAGES = 256
PENALTY = 4.0
ROUNDS = 25
UNKNOWN = "und"
#: What a byte counts as: a letter in lower case, a byte of a longer character, or a blank.
_FOLD = np.array([b | 32 if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all n-grams, first n-gram of each word, and the n + 1 offsets of the values in words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    t = np.full(n + 3, 32, np.uint8)
    t[1 : n + 1] = _FOLD[data]
    begins, stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[offsets[:-1]], stops[offsets[1:]] = True, True
    here = t[1 : n + 1]
    before = np.where(begins[:n], 32, t[:n]).astype(np.uint32)
    one = np.where(stops[1:], 32, t[2 : n + 2])
    two = np.where(np.append(stops[2:], True) | (one == 32), 32, t[3 : n + 3])
    inside = np.flatnonzero(here != 32)
    key = (before << 24) | (here.astype(np.uint32) << 16) | (one.astype(np.uint32) << 8) | two
    key = key[inside] * np.uint32(0x9E3779B1)
    cells = (key >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(before[inside] == 32)
    word_at = inside[first]
    return cells, first, np.searchsorted(word_at, offsets)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train(rows: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their log probabilities (BUCKETS x languages) from rows (id, text, lang)."""
    rows = rows.filter(F.col("lang").isNotNull())
    each = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most)
    seen = {r["lang"]: r["count"] for r in each.collect()}
    langs = sorted(seen, key=lambda s: s.encode())
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / seen[k]))])
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(langs) * BUCKETS, np.int64)
        for block in blocks(batches, "text"):
            cells, first, at = grams(*flat(block.column("text")))
            lang = np.array([place[k] for k in block.column("lang").to_pylist()], np.int64)
            of_word = np.repeat(lang, np.diff(at))
            of_gram = np.repeat(of_word, np.diff(np.append(first, len(cells))))
            counts += np.bincount(of_gram * BUCKETS + cells, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["cell", "n"])

    drawn = rows.filter(F.col("lang").isin(langs)).filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    summed = drawn.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(langs) * BUCKETS)
    found = summed.toPandas()  # languages x BUCKETS rows at most
    counts[found["cell"].to_numpy(np.int64)] = found["n"]
    counts = counts.reshape(len(langs), BUCKETS) + 0.2
    return langs, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32).copy()


def _em(like: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document (all have words) over its languages in `mask`, and its log likelihood."""
    size = np.diff(at)[:, None].astype(np.float32)
    p = mask / mask.sum(1, keepdims=True).astype(np.float32)
    of_word = np.repeat(np.arange(len(size)), np.diff(at))
    for _ in range(ROUNDS):
        joint = like * p[of_word]
        joint /= joint.sum(1, keepdims=True)
        new = np.add.reduceat(joint, at[:-1], axis=0) / size
        if np.abs(new - p).max() < 1e-3:
            p = new
            break
        p = new
    return p, np.add.reduceat(np.log((like * p[of_word]).sum(1)), at[:-1])


def _pick(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of some documents, and the offsets of these documents in them."""
    size = np.diff(at)[rows]
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[rows] - (ends - size), size)
    return index, np.concatenate([[0], ends])


def mixtures(like: np.ndarray, at: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of every document, zero outside the chosen set."""
    n, k = len(at) - 1, like.shape[1]
    eye = np.eye(k, dtype=np.float32)
    single = np.add.reduceat(np.log(like + 1e-30), at[:-1], axis=0)
    mask = eye[single.argmax(1)]
    best, proportions = single.max(1), mask.copy()
    price = penalty / 2 * np.log1p(np.diff(at))
    active = np.flatnonzero(_em(like, at, np.ones((n, k), np.float32))[1] - best > price) if k > 1 else []
    while len(active):
        index, own = _pick(at, active)
        tried = []
        for lang in range(k):
            p, value = _em(like[index], own, np.maximum(mask[active], eye[lang]))
            tried.append((np.where(mask[active, lang] > 0, -np.inf, value), p))
        values = np.stack([v for v, _ in tried])
        choice = values.argmax(0)
        value = values[choice, np.arange(len(active))]
        p = np.stack([p for _, p in tried])[choice, np.arange(len(active))]
        gain = value - best[active] > price[active]
        rows = active[gain]
        mask[rows, choice[gain]], best[rows], proportions[rows] = 1, value[gain], p[gain]
        active = rows[mask[rows].sum(1) < k]
    return proportions


def predict_block(texts: pa.Array, langs: list[str], table: np.ndarray) -> tuple[list[str], list[float], list[str]]:
    """Language, score and proportions as text of every value."""
    cells, first, at = grams(*flat(texts))
    n = len(texts)
    out, score, shares = [UNKNOWN] * n, [0.0] * n, [""] * n
    rows = np.flatnonzero(np.diff(at))
    if not len(rows) or not langs:
        return out, score, shares
    words = np.add.reduceat(table[cells], first, axis=0)
    like = np.exp(words - words.max(1, keepdims=True)) + np.float32(1e-12)
    at = np.append(at[rows], at[-1])  # documents without words take no place
    proportions = mixtures(like, at)
    lettered = pa.compute.match_substring_regex(texts, "[A-Za-z]").to_pylist()
    for i, p in zip(rows.tolist(), proportions, strict=True):
        if lettered[i] or has_letter(texts[i].as_py()):
            j = int(p.argmax())
            out[i], score[i] = langs[j], float(min(1.0, p[j]))
            shares[i] = ",".join(f"{langs[k]}:{p[k]:.3f}" for k in np.argsort(-p, kind="stable") if p[k] > 0)
    return out, score, shares


def identify_languages(
    docs: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    most: int = LANGUAGES,
    carry: bool = False,
) -> DataFrame:
    """Per document: doc_id, lang_pred, score, languages (chosen set with proportions).

    `training`: which rows may be learnt from (all labelled ones if None).
    `carry`: instead of doc_id all columns of `docs` as they are, then lang_pred
    and score; ValueError if `docs` has columns of these names.
    """
    if carry and {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("carry: columns lang_pred and score are taken")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    learn = docs if training is None else docs.filter(training)
    learn = learn.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, table = train(learn, sample, most)
    model = spark.sparkContext.broadcast((langs, table))  # languages x BUCKETS x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for block in blocks(batches, "text"):
            lang, score, shares = predict_block(block.column("text"), langs, table)
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in names), *found], names=[*names, "lang_pred", "score", "languages"]
            )

    if not carry:
        names = ["doc_id"]
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")
    # any column names go through the map under numbers
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    fields = [StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = StructType([*fields, *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("languages", StringType())))])
    rows = rows.select("*", F.col(names[docs.columns.index(text_col)]).cast("string").alias("text"))
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], "lang_pred", "score")
