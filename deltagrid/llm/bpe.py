"""Byte-level BPE encoding and decoding.

A word is split into bytes; a contiguous array holds the starts of its parts and, beside each, the rank of the pair that
starts there. The least rank is found by a scan, its right boundary is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Words longer than SHORT bytes take a heap over a linked list instead, so that a
text without spaces costs n log n; both give the same parts. Ids of words are kept in a bounded memo per worker.

Nulls and empty texts give an empty id list; a null id list decodes to null. Ids outside the vocabulary decode to
nothing. Rows are independent, so ties, repeats and empty tables need no rule; other columns pass through, and an input
column with an output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import replaced, schema_with, slices

SHORT = 128
#: Words that a worker remembers before it starts anew.
MEMO = 400_000
#: Matches handled at once, which bounds the memory for a very long text.
WORDS_AT_ONCE = 500_000
#: Characters from which a text is scanned piece by piece.
LONG = 1 << 20
NONE = 1 << 60


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """word -> its number; the ids of word k are flat[starts[k]:starts[k + 1]]."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        chars, model = byte_chars(), spec["model"]
        self.token = {i: bytes(chars[c] for c in t) for t, i in model["vocab"].items()}
        of = {b: i for i, b in self.token.items()}
        self.single = [of[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(chars[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.pairs[of[a], of[b]] = (rank, of[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.added.items()}
        most = max(self.token) + 1
        self.sizes = np.array([len(self.token.get(i, b"")) for i in range(most)])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes_of = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(most)), np.uint8)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        space = r"\p{White_Space}"
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?![^{space}])|{space}+")
        # the same for texts within Latin-1, where the classes are short enough to spell out and the scan is faster
        letter, number, blank = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
        self.latin_words = re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.starts = array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.parts(word.encode("utf8")))
        self.starts.append(len(self.flat))
        self[word] = n = len(self.starts) - 2
        return n

    def parts(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        return self.scan(ids) if len(ids) <= SHORT else self.heap(ids)

    def scan(self, ids: list[int]) -> list[int]:
        pairs, none = self.pairs, (NONE, 0)
        ranks = [pairs.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least is none or least[0] == NONE:
                break
            k = ranks.index(least)
            ids[k] = least[1]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), none)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(queue, (p[0], a, p[1]))
        return [i for i in ids if i >= 0]

    def words_of(self, text: str) -> Iterator[str]:
        """The words of a text, added tokens among them."""
        pattern = self.latin_words if text.isascii() or max(text) <= "\xff" else self.words
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                yield piece
            else:
                yield from (m[0] for m in pattern.finditer(piece))

    def numbers(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Blocks of word numbers (an added token is -1 - its id), each with (text, words) counts flattened; a very long text takes several."""
        block, counts = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > LONG or any(t in text for t in self.added):
                words = self.words_of(text)
                while part := list(islice(words, WORDS_AT_ONCE)):
                    yield np.fromiter((-1 - self.added[w] if w in self.added else self[w] for w in part), np.int64, len(part)), [(i, len(part))]
                continue
            found = (self.latin_words if text.isascii() or max(text) <= "\xff" else self.words).findall(text)
            block += found
            counts.append((i, len(found)))
            if len(block) >= WORDS_AT_ONCE // 4:
                yield np.fromiter(map(self.__getitem__, block), np.int64, len(block)), counts
                block, counts = [], []
        if block:
            yield np.fromiter(map(self.__getitem__, block), np.int64, len(block)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets between them."""
        parts: list[tuple[int, np.ndarray]] = []
        for block, counts in self.numbers(texts):
            starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32)  # views: gone before the memo grows
            plain = np.maximum(block, 0)
            lengths = np.where(block < 0, 1, starts[plain + 1] - starts[plain]) if len(starts) > 1 else np.ones(len(block), np.int64)
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(starts[plain] - ends + lengths, lengths)
            ids = flat[np.minimum(at, len(flat) - 1)] if len(flat) else np.zeros(ends[-1], np.int32)
            if (block < 0).any():
                ids[ends[block < 0] - 1] = -1 - block[block < 0]
            word = done = 0
            for i, n in counts:
                word += n
                parts.append((i, ids[done : ends[word - 1]]))
                done = ends[word - 1]
            del starts, flat
        parts.sort(key=lambda x: x[0])
        sizes = np.zeros(len(texts) + 1, np.int64)
        for i, x in parts:
            sizes[i + 1] += len(x)
        return np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.int32), np.cumsum(sizes).astype(np.int32)

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of id lists that stand one after the other."""
        inside = (ids >= 0) & (ids < len(self.sizes))
        safe = np.where(inside, ids, 0)
        n = np.where(inside, self.sizes[safe], 0)
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(self.places[safe] - ends + n, n)
        data, bounds = self.bytes_of[at].tobytes(), np.concatenate([[0], ends])[offsets]
        return [data[a:b].decode("utf8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else b"".join([self.token.get(i, b"") for i in ids]).decode("utf8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the ids of each text (array<int>)."""

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                if len(c) > MEMO:
                    c.forget()
                flat, offsets = c.encode(part.column(text).to_pylist())
                yield replaced(part, {out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{out}` array<int>", drop))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the text that each id list stands for; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                offsets = np.asarray(lists.offsets)
                texts = c.decode_flat(np.asarray(lists.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1)), offsets - offsets[0])
                yield replaced(part, {out: pa.array([None if null else t for t, null in zip(texts, lists.is_null().to_pylist(), strict=True)], pa.string())}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{out}` string", drop))
