"""Suffix and common-prefix arrays by induced sorting through disk-backed bucket queues.

The order of all suffixes is induced from the order of the LMS suffixes: popping
suffixes in ascending order pushes their left neighbours of larger type into the
queue under their own first symbol, where they are already in order; a second,
descending sweep does the same for the smaller type.  A queue entry is a tuple
(suffix, common prefix with the entry before it in its bucket); a popped range's
minimum plus one is the common prefix of the two entries that it induces, so
prefix lengths (saturated at ``cap``) are carried along.  Those of the sorted LMS
suffixes, which start the induction, are carried from one LMS suffix to the next
in the text and only extended by comparison; so are pairs where two parts of a
bucket meet.  The recursion on names carries none.

Entries with equal first symbol leave the queue as one batch, so a sweep is a
sequence of array operations.  Buckets beyond ``memory`` bytes are written to an
unnamed scratch file and read back when their turn comes, in sequence; nothing
of it outlives the sort.  LMS substrings are sorted by the same two sweeps and
named; if names repeat, the string of names is sorted recursively.  Below the
first level symbols are so many that batches hold few entries; there substrings
are named by refinement and the sweeps run entry by entry, in memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that a queue holds before it writes to disk.
MEMORY = 1 << 20


class BucketQueue:
    """First-in-first-out buckets by symbol, popped in symbol order; large ones wait on disk."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.held: list[list] = [[] for _ in range(symbols)]
        self.memory, self.used, self.file = memory, 0, None

    def push(self, symbol: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.held[symbol].append((suffixes, prefixes))
        self.used += suffixes.nbytes + prefixes.nbytes
        if self.used > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="strandline-queue-")
        self.file.seek(0, 2)
        for bucket in self.held:
            for i, entry in enumerate(bucket):
                if isinstance(entry[0], np.ndarray):
                    at = self.file.tell()
                    entry[0].tofile(self.file)
                    entry[1].tofile(self.file)
                    bucket[i] = (at, len(entry[0]))
        self.file.flush()
        self.used = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a bucket in the order of their arrival."""
        parts, self.held[symbol] = self.held[symbol], []
        loaded = []
        for a, b in parts:
            if isinstance(a, np.ndarray):
                self.used -= a.nbytes + b.nbytes
                loaded.append((a, b))
            else:
                self.file.seek(a)
                loaded.append((np.fromfile(self.file, np.int32, b), np.fromfile(self.file, np.uint8, b)))
        if not loaded:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*loaded, strict=True))

    def close(self) -> None:
        if self.file:
            self.file.close()


class _RangeMin:
    """Minima of ranges [a, b] of a byte array."""

    def __init__(self, values: np.ndarray):
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.flat = np.concatenate(self.rows)
        self.start = np.cumsum([0, *map(len, self.rows[:-1])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp(b - a + 1)[1] - 1
        at = self.start[level]
        return np.minimum(self.flat[at + a], self.flat[at + b - (1 << level) + 1])


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol must be the unique smallest."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    index = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(index[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return small


def _packed(text: np.ndarray, cap: int) -> np.ndarray:
    """The four 16-bit symbols from every place on, as one number."""
    padded = np.concatenate([text.astype("<u2", copy=False), np.zeros(cap + 36, "<u2")])
    return np.ndarray(len(padded) - 3, "<u8", padded.data, strides=(2,))


def _extended(fours: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, up to cap, that are known to agree in so many symbols.

    The last symbol is unique, so no pair is equal beyond it.
    """
    out = known.copy()
    live = np.flatnonzero(out < cap)
    words = np.arange(1)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = fours[x[:, None] + 4 * words] ^ fours[y[:, None] + 4 * words]
        first = (differ != 0).argmax(1)
        here = differ[np.arange(len(live)), first]
        same = np.where(here == 0, 4 * len(words), 4 * first)
        for width in (16, 32, 48):
            same += (here != 0) & (here & np.uint64((1 << width) - 1) == 0)
        out[live] = np.minimum(out[live] + same, cap)
        live = live[(here == 0) & (out[live] < cap)]
        words = np.arange(8)
    return out


def common_prefix(fours: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> int:
    """Common prefix length of two suffixes (arrays of one), up to cap."""
    return int(_extended(fours, a, b, np.zeros(1, np.int64), cap)[0])


def neighbour_prefixes(text: np.ndarray, lms: np.ndarray, cap: int, lanes_of: int = 64) -> np.ndarray:
    """Common prefix of each of the sorted LMS suffixes with the one before.

    Values are carried along the text: if a suffix shares h symbols with the one
    before it in order, the next LMS suffix, d symbols on, shares h - d with its
    own, as the match holds an LMS suffix there as well (its type is certain where
    the next symbol differs).  Lanes of consecutive suffixes advance together.
    """
    n = len(lms)
    fours, place = _packed(text, cap), np.argsort(lms, kind="stable")
    lanes = -(-n // lanes_of)
    pad = lambda x: np.pad(x, (0, lanes * lanes_of - n), mode="edge").reshape(lanes, lanes_of)
    here, mate = pad(lms[place].astype(np.int64)), pad(lms[np.maximum(place - 1, 0)].astype(np.int64))
    alone, out = pad(place == 0), np.zeros((lanes, lanes_of), np.int64)
    sure = text[here] != text[np.minimum(here + 1, len(text) - 1)]
    held = np.zeros(lanes, np.int64)
    for j in range(lanes_of):
        if j:
            held = held - (here[:, j] - here[:, j - 1])
            held[(held < 2) | ~sure[:, j]] = 0
        held = np.where(alone[:, j], 0, _extended(fours, here[:, j], mate[:, j], np.where(alone[:, j], cap, held), cap))
        out[:, j] = held
    prefixes = np.zeros(n, np.uint8)
    prefixes[place] = out.ravel()[:n]
    return prefixes


def _sweep(text, fours, small, buckets, seeds, cap, memory, ascending):
    """One induction sweep.

    `seeds[c]`: (suffixes, prefixes) of symbol c that are known before, in
    popping order; they leave after the bucket's own entries.  Returns, per
    symbol, the entries induced, in popping order, with prefixes against the
    entry popped before in the same bucket.
    """
    queue = BucketQueue(buckets, memory)
    since = np.full(buckets, cap, np.uint8)  # least prefix popped since the last push to a bucket
    first = np.ones(buckets, bool)
    out: list = [None] * buckets

    def pop_batch(c: int, suffixes: np.ndarray, prefixes: np.ndarray) -> tuple:
        """Push what a batch induces; what it induces in its own bucket is returned."""
        before = suffixes - 1
        wanted = before >= 0
        wanted[wanted] = small[before[wanted]] != ascending
        spots = np.flatnonzero(wanted)
        before = before[spots]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        symbols, before, spots = symbols[order], before[order], spots[order]
        minimum = _RangeMin(prefixes)
        lcps = np.zeros(len(spots), np.uint8)
        own: tuple = (np.zeros(0, np.int32), np.zeros(0, np.uint8))
        lowest = prefixes.min()
        tails = np.minimum(since, lowest)
        if len(spots):
            new = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            later = np.ones(len(spots), bool)
            later[new] = False
            later = np.flatnonzero(later)
            if len(later):
                lcps[later] = np.minimum(minimum(spots[later - 1] + 1, spots[later]).astype(np.int16) + 1, cap)
            heads = symbols[new]
            reach = minimum(np.zeros(len(new), np.int64), spots[new])
            reach = np.minimum(np.minimum(since[heads], reach).astype(np.int16) + 1, cap)
            lcps[new] = np.where(first[heads], 0, reach)
            first[heads] = False
            stops = np.append(new[1:], len(spots))
            ends = spots[stops - 1]
            inside = ends + 1 < len(prefixes)
            tails[heads] = cap
            if inside.any():
                tails[heads[inside]] = minimum(ends[inside] + 1, np.full(int(inside.sum()), len(prefixes) - 1))
            for c2, a, z in zip(heads.tolist(), new.tolist(), stops.tolist(), strict=True):
                entry = (before[a:z].astype(np.int32), lcps[a:z])
                if c2 == c:
                    own = entry
                else:
                    queue.push(c2, *entry)
        since[:] = tails
        return own

    for c in range(buckets) if ascending else range(buckets - 1, -1, -1):
        done = []
        suffixes, prefixes = queue.pop(c)
        if len(prefixes):
            prefixes = prefixes.copy()
            prefixes[0] = 0  # nothing before it in this bucket
        while len(suffixes):
            done.append((suffixes, prefixes))
            suffixes, prefixes = pop_batch(c, suffixes, prefixes)
        out[c] = tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32), np.zeros(0, np.uint8))
        more, more_prefixes = seeds[c]
        if len(more):
            more_prefixes = more_prefixes.copy()
            more_prefixes[0] = common_prefix(fours, out[c][0][-1:], more[:1], cap) if len(out[c][0]) else 0
            own = pop_batch(c, more, more_prefixes)
            if len(own[0]):
                raise AssertionError("a seed induced an entry of its own bucket")
    queue.close()
    return out


def _induce(text, small, buckets, lms, prefixes, cap, memory):
    """Suffixes in order and common prefixes with the one before, from ordered LMS suffixes."""
    symbol = text[lms]
    at = np.searchsorted(symbol, np.arange(buckets + 1))
    seeds = [(lms[a:z].astype(np.int32), prefixes[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
    fours = _packed(text, cap)
    large = _sweep(text, fours, small, buckets, seeds, cap, memory, True)

    def backwards(entry):
        suffixes, lcps = entry
        back = np.zeros(len(lcps), np.uint8)
        back[1:] = lcps[:0:-1]
        return suffixes[::-1], back

    small_parts = _sweep(text, fours, small, buckets, [backwards(e) for e in large], cap, memory, False)
    order, lcp = [], []
    for c in range(buckets):
        (a, la), (b, lb) = large[c], backwards(small_parts[c])
        if len(a) and len(b):
            lb = lb.copy()
            lb[0] = common_prefix(fours, a[-1:], b[:1], cap)
        order += [a, b]
        lcp += [la, lb]
    order, lcp = np.concatenate(order), np.concatenate(lcp)
    # the last symbol is the smallest suffix and is induced by none
    return np.append(np.int32(len(text) - 1), order), np.append(np.uint8(0), lcp)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, given them sorted; equal ones share a name."""
    place = np.zeros(len(text), np.int64)
    place[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(text) - 1)
    a, b = order[:-1], order[1:]
    size_a, size_b = ends[place[a]] - a, ends[place[b]] - b
    same = (size_a == size_b) & (a != len(text) - 1) & (b != len(text) - 1)
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
        live = live[k <= size_a[live]]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(len(lms), np.int64)
    names[place[order]] = rank
    return names, int(rank[-1]) + 1


def _sort_lms(text, small, buckets, cap, memory) -> np.ndarray:
    """LMS suffixes in order."""
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return lms
    start = lms[np.argsort(text[lms], kind="stable")]
    order, _ = _induce(text, small, buckets, start, np.zeros(len(start), np.uint8), 1, memory)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = order[is_lms[order]].astype(np.int64)
    names, n = _names(text, lms, order)
    if n == len(lms):
        return order
    return lms[np.array(sort_names(names.tolist(), n))]


def _refined_names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, from their symbols and types.

    A substring's name starts as its place among all by the first symbol and is
    refined symbol by symbol.  Substrings with equal codes so far are all ended
    or all open, as an end is a change of type, so open ones are sorted alone.
    """
    code = 2 * text + small
    ends = np.append(lms[1:], len(text) - 1)
    first = code[lms]
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(lms), np.int64)
    rank[order] = np.searchsorted(first[order], first[order])
    live, k = np.flatnonzero(ends > lms), 1
    while len(live):
        own, next_code = rank[live], code[lms[live] + k]
        order = np.lexsort((next_code, own))
        own, next_code = own[order], next_code[order]
        at = np.arange(len(own))
        group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), at, 0))
        new = np.append(True, (own[1:] != own[:-1]) | (next_code[1:] != next_code[:-1]))
        rank[live[order]] = own + np.maximum.accumulate(np.where(new, at, 0)) - group
        # a substring whose rank is its own needs no further symbol
        single = np.zeros(len(live), bool)
        single[order] = new & np.append(new[1:], True)
        live, k = live[~single], k + 1
        live = live[ends[live] >= lms[live] + k]
    distinct, names = np.unique(rank, return_inverse=True)
    return names, len(distinct)


def sort_names(text: list[int], symbols: int) -> list[int]:
    """Suffix array of a string of names whose last one is the unique smallest: the same recursion, entry by entry."""
    n = len(text)
    if n == 1:
        return [0]
    array = np.array(text)
    small = types(array)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, count = _refined_names(array, small, lms)
    if count == len(lms):
        sorted_lms = lms[np.argsort(names)]
    else:
        sorted_lms = lms[np.array(sort_names(names.tolist(), count))]
    tail = np.cumsum(np.bincount(array, minlength=symbols)).tolist()
    head = [0, *tail[:-1]]
    stops = tail.copy()
    # the left neighbour's symbol if it is of the larger (smaller) type, else -1; n stands for an empty place
    left = np.append(-1, array[:-1])
    kind = np.append(True, small[:-1])
    to_large = np.append(np.where(kind, -1, left), -1).tolist()
    to_small = np.append(np.where(kind, left, -1), -1).tolist()
    order = [n] * n
    for i in reversed(sorted_lms.tolist()):
        c = text[i]
        tail[c] -= 1
        order[tail[c]] = i
    for i in order:  # entries pushed ahead are met later on
        c = to_large[i]
        if c >= 0:
            at = head[c]
            order[at] = i - 1
            head[c] = at + 1
    tail = stops
    for i in reversed(order):
        c = to_small[i]
        if c >= 0:
            at = tail[c] - 1
            order[at] = i - 1
            tail[c] = at
    order[0] = n - 1
    return order


def suffix_array(text: np.ndarray, buckets: int, cap: int = 200, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `text` in order, and the common prefix of each with the one before (up to cap < 255).

    Symbols are below `buckets`; the last one must be 0 and occur nowhere else.
    """
    small = types(text) if len(text) > 1 else np.ones(1, bool)
    if len(text) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    lms = _sort_lms(text, small, buckets, cap, memory)
    prefixes = neighbour_prefixes(text, lms, cap) if len(lms) else np.zeros(0, np.uint8)
    return _induce(text, small, buckets, lms, prefixes, cap, memory)
