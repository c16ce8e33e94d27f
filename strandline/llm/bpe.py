"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file's path is a parameter; nothing of it is kept here.  A text
is cut at special tokens, normalised (NFC, white space to one space, lower
case), split by the file's pattern, and its pre-tokens are spelt in byte
symbols, the last one bearing the word-end suffix.  The pre-tokens that a batch
sees for the first time go through the merge rounds together: their symbols
stand in one flat array, every adjacent pair becomes one 64-bit key, a binary
search over the sorted merge keys gives its rank, and each word merges all
places of its lowest-ranked pair.  Words that have no pair left drop out.  A
word of more than ``LONG`` bytes has rounds of its own that touch only the places
of the round's pair and their neighbours, so its cost does not grow with its
length times its rounds.

Null is empty text; empty text has no ids and decodes to the empty string.
Texts are processed whole.  Per worker, words already merged are remembered, two
generations of about ``MEMORY`` of them, so memory is bounded whatever the
vocabulary of the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

MEMORY = 150_000
LONG = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    names = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a `tokenizers` JSON file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a word-level BPE file of the expected kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(r"\s+")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([self.vocab.get(s + end, -1) for s in symbols], np.int64)
        if (self.inner < 0).any() or (self.final < 0).any():
            raise ValueError("the vocabulary lacks byte symbols")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.pairs = left, right
        self.numbers = [str(i) for i in range(max(self.tokens) + 1)]
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the n + 1 offsets of the words."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        none = len(self.ranks)
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.repeat(low, lengths)
            over = best == none
            if over.any():  # these words are finished
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            hit = rank == best
            # of overlapping places (a a a) every other one merges, from the left
            begin = hit & ~np.append(False, hit[:-1])
            first = np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - first) % 2 == 0
            places = np.flatnonzero(hit)
            sym[places] = self.made[rank[places]]
            stay = np.ones(len(sym), bool)
            stay[places + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: rounds over the places of its lowest-ranked pair, kept by rank."""
        data = np.frombuffer(word, np.uint8)
        sym, n = self.inner[data], len(data)
        sym[-1] = self.final[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, places, heap = np.ones(n, bool), {}, []

        def enter(at: np.ndarray) -> None:
            """Remember the pairs that begin at these places under their ranks."""
            rank = self._ranks(sym[at], sym[after[at]])
            known = rank < len(self.ranks)
            at, rank = at[known], rank[known]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            new = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for r, own in zip(rank[new].tolist(), np.split(at, new[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(own)

        enter(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[(sym[at] == self.pairs[0][r]) & (sym[after[at]] == self.pairs[1][r])]
            if not len(at):
                continue
            # of overlapping places (a a a) every other one merges, from the left
            begin = np.append(True, after[at[:-1]] != at[1:])
            first = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            near = np.unique(np.concatenate([at, before[at]]))
            enter(near[(near >= 0) & (after[near] < n)])
        return sym[alive]

    def pre_tokens(self, chunk: str) -> list[str]:
        """Normalised pre-tokens of a piece of text without special tokens."""
        chunk = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # lower case goes character by character: a final sigma is not special
        return self.pattern.findall(self.space.sub(" ", chunk).replace("Σ", "σ").lower())

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that share no pre-token: special tokens and, between them, runs without white space.

        The control characters that str.split() takes for white space, unlike
        the pattern, leave their stretch of text uncut.
        """
        out = []
        for part in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special or any(c in part for c in "\x1c\x1d\x1e\x1f"):
                out.append(part)
            else:
                out += part.split()
        return out

    def learn(self, chunks: set[str]) -> None:
        """Merge the new pre-tokens of those chunks and remember each chunk's ids and tokens as text."""
        listed, split = list(chunks), []
        for c in listed:
            plain = c.lower()
            if plain.isalpha() and "Σ" not in c and (plain.isascii() or unicodedata.is_normalized("NFC", c)):
                split.append((plain,))  # letters alone are one pre-token
            elif plain[-1] in ".," and plain[:-1].isalpha() and plain.isascii():
                split.append((plain[:-1], plain[-1]))
            else:
                split.append(() if c in self.special else self.pre_tokens(c))
        words = list(dict.fromkeys(chain.from_iterable(split)))
        raw = [w.encode() for w in words]
        long = [w for w, r in zip(words, raw, strict=True) if len(r) > LONG]
        if long:
            words, raw = [w for w, r in zip(words, raw, strict=True) if len(r) <= LONG], [r for r in raw if len(r) <= LONG]
        ids, at = self.merge(raw) if raw else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        ids, at = ids.tolist(), at.tolist()
        numbers, tokens = [self.numbers[i] for i in ids], [self.tokens[i] for i in ids]
        own = {
            w: (numbers[a], tokens[a]) if z - a == 1 else (" ".join(numbers[a:z]), " ".join(tokens[a:z]))
            for w, a, z in zip(words, at, at[1:])
        }
        for w in long:
            merged = self.merge_long(w.encode()).tolist()
            own[w] = " ".join([self.numbers[i] for i in merged]), " ".join([self.tokens[i] for i in merged])
        for c, parts in zip(listed, split, strict=True):
            if len(parts) == 1:
                self.known[c] = own[parts[0]]
            elif c in self.special:
                self.known[c] = str(self.special[c]), c
            else:
                self.known[c] = " ".join([own[w][0] for w in parts]), " ".join([own[w][1] for w in parts])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included; ids outside the vocabulary are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:  # the generation before the last is forgotten
            self.known, self.older = {}, self.known
        new = set().union(*cut).difference(self.known)
        met = new & self.older.keys()
        if met:
            self.known.update(zip(met, map(self.older.__getitem__, met)))
            new -= met
        if new:
            self.learn(new)
        out, get = [], self.known.__getitem__
        for chunks in cut:
            if chunks:
                ids, spelt = zip(*map(get, chunks), strict=True)
                ids = " ".join(ids if all(ids) else [x for x in ids if x])
                spelt = " ".join(spelt if all(spelt) else [x for x in spelt if x])
                out.append((ids.count(" ") + 1 if ids else 0, ids, spelt))
            else:
                out.append((0, "", ""))
        for c in [c for c in new if len(c) > 256]:
            del self.known[c]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][1].split()]


@lru_cache(maxsize=4)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False
) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with `outputs` also ids and decoded.

    A map over the input: no shuffle, and a lost task repeats only its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for block in blocks(batches, "text"):
            done = bpe.encode_batch(block.column(1).to_pylist())
            columns = [
                block.column(0),
                pa.array([n for n, _, _ in done], pa.int64()),
                pa.array([sha(ids) for _, ids, _ in done], pa.string()),
                pa.array([sha(text) for _, _, text in done], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [
                    pa.array([[int(i) for i in ids.split()] for _, ids, _ in done], pa.list_(pa.int32())),
                    pa.array([text for _, _, text in done], pa.string()),
                ]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * outputs
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
