"""Token counts from distinct pre-tokens, without materialising ids.

The piece model is read from a path.  The normalised text is cut before every
run of word marks (U+2581, which stands for a space): since no piece of the
vocabulary has a mark after another character (checked when the model is
opened), no merge crosses a cut and the counts of the parts add up.

1.  Each task gives its pre-tokens of at least a ``FREQUENT``-th of its own
    occurrences; those whose sums reach a ``FREQUENT``-th of the table's number
    ``FREQUENT`` at most, whatever the table.  Their pieces are counted once and
    broadcast, and each document's frequencies meet them where it lies.
2.  A document's other pre-tokens travel with their frequencies to one place for
    each distinct pre-token, where its pieces are counted once (runs of a sorted
    partition, so nothing is held), joined to the frequencies, and summed per
    document.  None of those keys is frequent, so none is hot.

No ids are kept anywhere, only numbers of pieces.
Null is empty and has no tokens.  Rows that repeat an id count each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, stored

MEMORY = 500_000
FREQUENT = 1_000_000
#: Bytes of a pre-token that is broadcast; of the ``TOP`` most frequent ones it may be LONG_BYTES.
SHORT_BYTES, LONG_BYTES, TOP = 64, 16 << 10, 1000
MARK = "▁"
_PARTS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        # marks must stand for spaces one by one, with one added in front
        plain = self.model.encode("  a  b ", out_type=str)
        self.cuts = not crossing and "".join(plain) == MARK + "  a  b ".replace(" ", MARK)
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))
    @staticmethod
    def parts(text: str) -> list[str]:
        """Pre-tokens, each without the one mark that it begins with."""
        if MARK not in text:
            parts = text.split(" ")
            if all(parts):
                return parts
        return [p[1:] for p in _PARTS.findall(MARK + text.replace(" ", MARK))]

    def pieces(self, parts: list[str]) -> list[int]:
        """Number of pieces of each pre-token; the model puts the leading mark there itself, a mark alone is one piece."""
        return [len(n) if part else self.alone for part, n in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]

    def whole(self, text: str | None) -> int:
        """Tokens of a whole text, for models whose texts cannot be cut."""
        return len(self.model.encode(text)) if text else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    if not PieceCounter(path).cuts:
        counted = rows.mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)

    seen = rows.select("text").mapInArrow(_frequencies, "part string, n long")
    seen = checkpoint(seen.groupBy("part").agg(F.sum("n").alias("n")))  # the sum over null is that of all occurrences
    total = F.lit((seen.filter("part is null").agg(F.sum("n")).first()[0] or 0))
    size, often = F.octet_length("part"), F.col("n")
    short = (size <= SHORT_BYTES) & (often * FREQUENT >= total)
    long = (size <= LONG_BYTES) & (often * TOP >= total)
    chosen = seen.filter(short | long).select("part").mapInArrow(_piece_counts(path), "part string, pieces long")
    known = docs.sparkSession.sparkContext.broadcast(dict(chosen.collect()))  # bounded by the two lines above

    schema = "doc_id long, n_bytes long, n_tokens long, parts array<string>, times array<int>"
    met = stored(rows.mapInArrow(_partial_sums(known), schema).withColumn("rid", F.monotonically_increasing_id()))
    rare = met.select("rid", F.inline(F.arrays_zip("parts", "times"))).toDF("rid", "part", "times")
    rare = rare.repartition("part").sortWithinPartitions("part").mapInArrow(_piece_sums(path), "rid long, rest long")
    rest = rare.groupBy("rid").agg(F.sum("rest").alias("rest"))
    out = met.filter(F.size("parts") > 0).select("rid", "doc_id", "n_bytes", "n_tokens").join(rest, "rid")
    out = out.select("doc_id", "n_bytes", (F.col("n_tokens") + F.col("rest")).alias("n_tokens"))
    out = met.filter(F.size("parts") == 0).select("doc_id", "n_bytes", "n_tokens").unionByName(out)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for block in blocks(batches, "text"):
            counts = [pieces.whole(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent pre-tokens of a task with their number, and under null the number of all."""
    counts: Counter = Counter()
    total = 0
    for block in blocks(batches, "text"):
        for text in block.column("text").to_pylist():
            if text:
                parts = PieceCounter.parts(text)
                counts.update(parts)
                total += len(parts)
        while len(counts) > MEMORY:  # as in a Misra-Gries summary, all give up one
            counts = Counter({p: n - 1 for p, n in counts.items() if n > 1})
    often = {p: n for p, n in counts.items() if n * FREQUENT >= total} | {None: total}
    yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], names=["part", "n"])


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for block in blocks(batches, "part"):
            counts = pieces.pieces(block.column("part").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("part"), pa.array(counts, pa.int64())], names=["part", "pieces"])

    return run


def _piece_sums(path: str):
    """Pieces times frequency for every row of a partition sorted by pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        last, held = None, 0
        for block in blocks(batches, "part"):
            runs = block.column("part").dictionary_encode()  # in the order of first sight, so sorted
            distinct = runs.dictionary.to_pylist()
            ahead = distinct[0] == last  # a run goes on from the block before
            counts = ([held] if ahead else []) + pieces.pieces(distinct[ahead:])
            last, held = distinct[-1], counts[-1]
            rest = np.array(counts, np.int64)[runs.indices.to_numpy()] * block.column("times").to_numpy()
            yield pa.RecordBatch.from_arrays([block.column("rid"), pa.array(rest, pa.int64())], names=["rid", "rest"])

    return run


def _partial_sums(known):
    """Per document the tokens of its frequent pre-tokens, and the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for block in blocks(batches, "text"):
            sums, at, parts, times = [], [0], [], []
            for text in block.column("text").to_pylist():
                own = 0
                for part, n in Counter(PieceCounter.parts(text)).items() if text else ():
                    pieces = get(part)
                    if pieces is None:
                        parts.append(part)
                        times.append(n)
                    else:
                        own += n * pieces
                sums.append(own)
                at.append(len(parts))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("n_bytes"), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(parts, pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))],
                names=["doc_id", "n_bytes", "n_tokens", "parts", "times"],
            )

    return run
