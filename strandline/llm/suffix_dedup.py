"""Removal of repeated byte strings with suffix arrays built by external induced sorting.

A byte goes if a string of ``length`` bytes covering it also starts anywhere
else.  Strings are compared in shards, and a string's shard must not depend on
where it stands:

1.  Of the hashes of all GRAM-byte grams inside a string, the smallest (leftmost
    of equals) is its anchor, so equal strings have equal anchors.  The strings
    of a text that share an anchor start in one run; the run and the bytes that
    its strings cover are a segment of under 2 * length bytes.  Every string
    belongs to exactly one segment.
2.  Anchors that occur once cannot hold a repeated string: one aggregate over
    anchor hashes leaves the few segments that can.  Equal segments are one from
    there on, with their number as weight (combined map-side), so copies in any
    number cost one segment.
3.  The distinct segments of an anchor meet in one shard of about SHARD bytes
    (an anchor with a single one needs no comparison).
    An anchor with more than HOT distinct segments is dealt again: its segments
    are cut by a second choice of anchor inside each string (another hash), and
    so on.  What DEPTH choices do not part (strings made of very few grams) is
    settled string by string in an aggregate over their digests, so no anchor's
    segments need fit into one task.
4.  Each shard's suffix and common-prefix arrays come from `induced_sort`.  A
    string is repeated if its segment has weight 2 or more, or if a string that
    a segment owns stands next to it with a common prefix of `length` or more.
5.  Repeated runs go back to the documents that hold the segment.

Null is empty text; matches never cross documents.  Rows that repeat an id count
each for themselves, and rows equal in id and text get equal results.  Segments
are told apart by 128-bit digests of their bytes (XXH3); the 64-bit hashes of
anchors only deal strings to shards, where bytes decide.  A text of any size is
cut into segments CHUNK starts at a time; runs end there, strings do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTES, _INVERSE, BLOCK_BYTES, _powers, blocks, checkpoint, flat, mix, seeds, stored
from .induced_sort import suffix_array

GRAM = 64
SHARD = 1 << 20
HOT = 20_000
DEPTH = 12
CHUNK = 8 << 20
_PLACE = 28  # bits of an order key that hold the position in a chunk


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of `size` bytes, from prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(_INVERSE, n + 1 - size))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width] for every i that has them all."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    shaped = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(shaped, axis=1).ravel()
    behind = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, seed: int = 0) -> tuple:
    """Runs of strings with one anchor: value, start in the flat bytes, number of strings, anchor hash."""
    parts = [
        _chunk_segments(data[a : a + CHUNK + length - 1], np.clip(offsets - a, 0, None), length, min(gram, length), seed, a)
        for a in range(0, max(len(data) - length + 1, 1), CHUNK)
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _chunk_segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, seed: int, at: int) -> tuple:
    """The runs among the first CHUNK starts of `data`, which stands at `at` in the flat bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h = _gram_hashes(data, gram)
    order = h if not seed else mix(h ^ seeds(seed, 707)[-1])
    key = (order >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_least(key, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    # the end of each start's own value
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    first = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[owner + 1])
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    own, owner = anchor[first], owner[first]
    begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])))
    return owner[begin], first[begin] + at, np.diff(np.append(begin, len(first))), h[own[begin]]


def digests(raw: bytes, starts: list[int], counts: list[int], length: int) -> list[bytes]:
    """Digests of the bytes of segments."""
    import xxhash

    make, view = xxhash.xxh3_128_digest, memoryview(raw)
    return [make(view[a : a + n + length - 1]) for a, n in zip(starts, counts, strict=True)]


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = flat(block.column("text"))
            value, start, count, anchor = segments(data, offsets, length)
            at = np.searchsorted(value, np.arange(block.num_rows + 1))
            raw = data.tobytes()
            own = digests(raw, start.tolist(), count.tolist(), length)
            sha = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), block.column("id"), block.column("th"),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(sha, pa.string()),
                    _lists(at, start - offsets[value], pa.int32()), _lists(at, count, pa.int32()),
                    _lists(at, anchor.view(np.int64), pa.int64()), _lists(at, own, pa.binary()),
                ],
                names=["doc_id", "id", "th", "n_bytes", "sha", "s", "c", "f", "g"],
            )

    return run


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Values that lie one after the other in `data`."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.array(at, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes())])


def _bytes_of(length: int):
    """Rows (f, g, w, bytes) of the segments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = flat(block.column("text"))
            listed = block.column("listed")
            segment = listed.flatten()
            start = np.repeat(offsets[:-1], listed.value_lengths().to_numpy()) + segment.field("s").to_numpy()
            size = segment.field("c").to_numpy().astype(np.int64) + length - 1
            own = _binary(data[_ranges(start, size)], np.append(0, np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([*(segment.field(c) for c in ("f", "g", "w")), own], names=["f", "g", "w", "bytes"])

    return run


def repeated_runs(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, length: int) -> tuple:
    """Runs [a, z) of strings that are repeated among all distinct segments (by weight or elsewhere): segment, a, z."""
    sizes = np.diff(offsets)
    counts = sizes - length + 1
    # segments are parted by symbol 1, ended by 0; bytes stand above
    text = np.ones(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    text[-1] = 0
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = inside[-1] = False
    text[inside] = data.astype(np.uint16) + 2
    order, lcp = suffix_array(text, 258, cap=length)
    edge = np.zeros(len(text) + 1, np.int64)
    edge[starts] += 1
    edge[starts + counts] -= 1
    held = np.flatnonzero(np.cumsum(edge[:-1])[order] > 0)  # places of the strings that segments own
    found = np.zeros(len(text) + 1, bool)
    if len(held):
        # prefix shared with the owned string before: the least on the way there
        shared = np.minimum.reduceat(lcp[: held[-1] + 1], np.append(0, held[:-1] + 1))
        near = shared >= length
        near[0] = False
        found[order[held]] = near | np.append(near[1:], False)
    heavy = np.flatnonzero(weights > 1)
    found[_ranges(starts[heavy], counts[heavy])] = True
    # a segment's last bytes own no string, so runs end inside their segment
    change = np.flatnonzero(found[1:] != found[:-1]) + 1
    if found[0]:
        change = np.append(0, change)
    a, z = change[::2], change[1::2]
    segment = np.searchsorted(starts, a, side="right") - 1
    return segment, a - starts[segment], z - starts[segment]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of so many numbers from each start."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        again = table.select(["f", "g"]).to_pandas().duplicated().to_numpy()
        table = table.filter(pa.array(~again)).combine_chunks()
        data, offsets = flat(table.column("bytes"))
        segment, a, z = repeated_runs(data, offsets, table.column("w").to_numpy(), length)
        new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else segment
        at = np.append(new, len(segment))
        held = table.select(["f", "g"]).take(pa.array(segment[new]))
        return held.append_column("a", _lists(at, a, pa.int32())).append_column("z", _lists(at, z, pa.int32()))

    return run


def _recut(length: int, depth: int):
    """Segments cut again by another choice of anchor; rows (f, g, w, off, f2, g2, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "bytes"):
            data, offsets = flat(block.column("bytes"))
            value, start, count, anchor = segments(data, offsets, length, seed=depth)
            f, g, w = (block.column(c).take(pa.array(value)) for c in ("f", "g", "w"))
            raw = data.tobytes()
            own = digests(raw, start.tolist(), count.tolist(), length)
            parts = [raw[a : a + n - 1 + length] for a, n in zip(start.tolist(), count.tolist(), strict=True)]
            finer = mix(anchor ^ mix(f.to_numpy().view(np.uint64) + np.uint64(depth)))
            yield pa.RecordBatch.from_arrays(
                [f, g, w, pa.array(start - offsets[value], pa.int32()),
                 pa.array(finer.view(np.int64)), pa.array(own, pa.binary()), pa.array(parts, pa.binary())],
                names=["f", "g", "w", "off", "f2", "g2", "bytes"],
            )

    return run


def _strings(length: int):
    """Every string of the segments: f, g, off, w, d (its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "bytes", BLOCK_BYTES // length):
            f, g, off, w, d = [], [], [], [], []
            for x in block.select(["f", "g", "w", "bytes"]).to_pylist():
                n = len(x["bytes"]) - length + 1
                f += [x["f"]] * n
                g += [x["g"]] * n
                w += [x["w"]] * n
                off += range(n)
                d += digests(x["bytes"], list(range(n)), [1] * n, length)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip((f, g, w, off, d), kinds, strict=True)], names=["f", "g", "w", "off", "d"]
            )

    return run


_SOLVED = "f long, g binary, a array<int>, z array<int>"


def _string_by_string(parts: DataFrame, length: int) -> DataFrame:
    """The runs of `_solve` by an aggregate over string digests."""
    each = stored(parts.mapInArrow(_strings(length), "f long, g binary, w long, off int, d binary"))
    several = checkpoint(each.groupBy("d").agg(F.sum("w").alias("n")).filter("n > 1").select("d"))
    found = each.join(several, "d", "left_semi").groupBy("f", "g").agg(F.collect_list("off").alias("a"))
    return found.select("f", "g", "a", F.transform("a", lambda x: x + 1).alias("z"))


def _solve(parts: DataFrame, length: int, depth: int = 0) -> DataFrame:
    """f, g, a, z: runs [a, z) of repeated strings of each segment (f, g, w, bytes) that has some."""
    hot = checkpoint(parts.groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("f"))
    any_hot = hot.count() > 0
    cool = parts.join(hot, "f", "left_anti") if any_hot else parts
    total = cool.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("f"), F.lit(max(1, -(-total // SHARD)))).alias("shard")
    dealt = cool.select("f", "g", "w", "bytes", shard).groupBy("shard")
    solved = dealt.applyInArrow(_shard(length), _SOLVED)
    if not any_hot:
        return solved
    crowded = parts.join(hot, "f", "left_semi")
    if depth >= DEPTH:
        return solved.unionByName(_string_by_string(crowded, length))
    cut = crowded.mapInArrow(_recut(length, depth + 1), "f long, g binary, w long, off int, f2 long, g2 binary, bytes binary")
    cut = stored(cut)
    finer = cut.groupBy(F.col("f2").alias("f"), F.col("g2").alias("g")).agg(F.sum("w").alias("w"), F.min("bytes").alias("bytes"))
    finer = stored(finer)
    several = checkpoint(finer.groupBy("f").agg(F.sum("w").alias("n")).filter("n > 1").select("f"))
    deeper = _solve(finer.join(several, "f", "left_semi"), length, depth + 1)
    back = cut.select("f", "g", "off", "f2", "g2").join(deeper.toDF("f2", "g2", "a", "z"), ["f2", "g2"])
    moved = lambda c: F.transform(c, lambda x: x + F.col("off"))
    back = back.select("f", "g", moved("a").alias("a"), moved("z").alias("z")).groupBy("f", "g")
    return solved.unionByName(
        back.agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("z")).alias("z"))
    )


def _kept(length: int):
    """What is left of each text without the bytes of its repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = flat(block.column("text"))
            found = block.column("found")
            segment = found.flatten()
            base = np.repeat(offsets[:-1], found.value_lengths().to_numpy()) + segment.field("s").to_numpy()
            base = np.repeat(base, segment.field("a").value_lengths().to_numpy())
            a, z = (segment.field(c).flatten().to_numpy() for c in ("a", "z"))
            edge = np.bincount(base + a, minlength=len(data) + 1) - np.bincount(base + z - 1 + length, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone & ~np.append(False, gone[:-1])
            inner = offsets[:-1][offsets[:-1] < len(data)]
            first[inner] = gone[inner]  # runs do not go on from one text into the next
            before = lambda flags: np.append(0, np.cumsum(flags))[offsets]
            removed = before(gone)
            kept = _binary(data[~gone], offsets - removed)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("th"), pa.array(np.diff(removed)), pa.array(np.diff(before(first))), kept],
                names=["id", "th", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_dedup(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `outputs` also kept (binary; null: all of it)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    # rows are known by (id, th): rows equal in both are alike in every way that matters here
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    schema = "doc_id long, id long, th long, n_bytes long, sha string, s array<int>, c array<int>, f array<long>, g array<binary>"
    base = stored(rows.mapInArrow(_anchored(length), schema))
    every = base.select("id", "th", F.inline(F.arrays_zip("s", "c", "f", "g")))
    # a table of its own, so that the join below is of two plain exchanges and a hot anchor's side can be split
    repeated = checkpoint(every.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"))
    places = stored(every.join(repeated, "f", "left_semi").select("id", "th", "s", "c", "f", "g"))
    distinct = stored(
        places.groupBy("f", "g")
        .agg(F.count("*").alias("w"), F.min(F.struct("id", "th", "s", "c")).alias("one"))
        .select("f", "g", "w", "one.*")
    )
    # an anchor with one distinct segment has nothing to compare it with: its weight (2 at least) says it all
    crowded = distinct.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    crowded = checkpoint(crowded)
    alone = distinct.join(crowded, "f", "left_anti").select("f", "g", F.array(F.lit(0)).alias("a"), F.array("c").alias("z"))
    compared = distinct.join(crowded, "f", "left_semi")
    listed = compared.groupBy("id", "th").agg(F.collect_list(F.struct("s", "c", "f", "g", "w")).alias("listed"))
    parts = rows.select("id", "th", "text").join(listed, ["id", "th"]).select("text", "listed")
    parts = stored(parts.mapInArrow(_bytes_of(length), "f long, g binary, w long, bytes binary"))
    solved = _solve(parts, length).unionByName(alone)

    found = places.join(solved, ["f", "g"]).groupBy("id", "th").agg(F.collect_set(F.struct("s", "a", "z")).alias("found"))
    left = rows.join(found, ["id", "th"]).select("id", "th", "text", "found")
    left = left.mapInArrow(_kept(length), "id long, th long, n_removed long, n_spans long, kept binary")
    left = left.withColumn("kept_sha", F.sha2("kept", 256))
    left = (left if outputs else left.drop("kept")).dropDuplicates(["id", "th"])
    out = base.select("doc_id", "id", "th", "n_bytes", "sha").join(left, ["id", "th"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept"] if outputs else []),
    )
