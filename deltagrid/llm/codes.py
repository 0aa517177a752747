"""Token ids in directly addressable files.

An id is split into chunks of 8 bits, the lowest first. Level k holds the k-th chunk of all ids that have one, a bitmap
says which of them go on to level k + 1, and a rank directory counts the marks before every 512 bits. So the i-th id is read
by one byte, one stretch of 64 bytes of bitmap and one number a level, wherever it stands: nothing is decoded before it.

A file is a row of segments of SEGMENT ids, each with its levels and a table of the documents that end in it, and a footer
that says where each segment begins. Files hold documents in ascending order, file after file; a manifest names the files
in order with their ids and documents. Each write attempt makes files of names of its own, and the manifest is written
last, when all tasks have committed, so a lost executor or a second attempt leaves no file in it twice.

`coded` sorts documents into ranges by key (nulls first) and tokenizes them there. Rows of one key stand side by side in
the order of a hash of all columns; equal rows may be dealt to several tasks, so a common key does not fill one. Null and
empty texts have the end id only, an empty table makes a manifest without files. The key is an integer column; other
columns are not stored. Writers hold one segment and one batch, readers one segment and one document.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from .bpe import LONG, MEMO, WORDS_AT_ONCE, Codec, byte_chars
from .common import replaced, schema_with, shared_dir, slices

#: Ids in a segment.
SEGMENT = 1 << 20
#: Bits between two numbers of the rank directory.
STRIDE = 512
MAGIC = b"DACF0001"
MANIFEST = "manifest.json"
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


# ---- tokens


class Words(Codec):
    """A vocabulary of words with an end sign, as the library reads it: its normaliser, its word rules, its model a word; ids of words are kept in a memo."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        self.shown = {b: c for c, b in byte_chars().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        space = r"\p{White_Space}"
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+")
        letter, number, blank = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
        self.latin_words = re.compile(rf"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{number}]|[^{blank}{letter}{number}]+")
        self.forget()

    def parts(self, word: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize("".join(map(self.shown.__getitem__, word)))]

    def found(self, text: str) -> tuple[object, str]:
        """The word rule for a text without added tokens, and the text in normal form; Latin-1 is composed already."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words, self.library.normalizer.normalize_str(text)
        return self.latin_words, text.lower()

    def words_of(self, text: str) -> Iterator[str]:
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                yield piece
            elif piece:
                rule, normal = self.found(piece)
                yield from (m[0] for m in rule.finditer(normal))

    def numbers(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        number, block, counts = self.__getitem__, [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > LONG or any(t in text for t in self.added):
                words = self.tagged(text)
                while part := list(islice(words, WORDS_AT_ONCE)):
                    yield np.array(part, np.int64), [(i, len(part))]
                continue
            rule, normal = self.found(text)
            words = rule.findall(normal)
            block += words
            counts.append((i, len(words)))
            if len(block) >= WORDS_AT_ONCE // 4:
                yield np.fromiter(map(number, block), np.int64, len(block)), counts
                block, counts = [], []
        if block:
            yield np.fromiter(map(number, block), np.int64, len(block)), counts

    def tagged(self, text: str) -> Iterator[int]:
        """Numbers of the words of a text; an added token of the text itself is -1 - its id, one that only lower case makes is a word."""
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                yield -1 - self.added[piece]
            elif piece:
                rule, normal = self.found(piece)
                yield from (self[m[0]] for m in rule.finditer(normal))


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def coded(df: DataFrame, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) in ascending order of the key over partitions and in them; each list ends with `end`."""
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), hashed.alias("tie"))
    # equal rows may part, by the task that read them
    ranged = rows.repartitionByRange("doc_id", "tie", F.spark_partition_id()).sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches):
        c = words(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                if len(c) > MEMO:
                    c.forget()
                flat, offsets = c.encode(part.column("text").to_pylist())
                flat = np.insert(flat, offsets[1:], end)
                yield replaced(part, {"ids": pa.ListArray.from_arrays(pa.array(offsets + np.arange(len(offsets), dtype=np.int32)), pa.array(flat.astype(np.int32)))}, ("text",))

    return ranged.mapInArrow(run, schema_with(ranged, "ids array<int>", ("text",)))


# ---- the format


def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level; the last level marks nothing."""
    out, left = [], np.asarray(ids).astype(np.uint32)
    while True:
        on = left > 0xFF
        bits = np.zeros(-(-len(left) // STRIDE) * STRIDE, bool)
        bits[: len(left)] = on
        marks = bits.reshape(-1, STRIDE).sum(axis=1)
        out.append(((left & 0xFF).astype(np.uint8), np.packbits(bits, bitorder="little"), (np.cumsum(marks) - marks).astype("<u4")))
        if not on.any():
            return out
        left = left[on] >> 8


def pack(ids: np.ndarray, keys: list[int | None], ends: list[int]) -> bytes:
    """A segment: the ids' levels, and key and end of each document that ends in it."""
    found = levels(ids)
    head = np.array([len(ids), len(keys), len(found), *(len(c) for c, _, _ in found)], "<i8").tobytes()
    null = np.array([k is None for k in keys], np.uint8)
    table = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(ends, "<i8").tobytes() + null.tobytes()
    return b"".join([head, table, *(x.tobytes() for level in found for x in (level[2], level[1], level[0]))])


def _layout(head: np.ndarray, docs: int) -> list[tuple[int, int, int, int]]:
    """(chunks, where its directory, bitmap and chunks begin) of each level, from the beginning of the segment."""
    at, out = 8 * (3 + len(head)) + 17 * docs, []
    for n in head.tolist():
        blocks = -(-n // STRIDE)
        out.append((n, at, at + 4 * blocks, at + 4 * blocks + STRIDE // 8 * blocks))
        at = out[-1][3] + n
    return out


def unpack(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """All ids of a segment, and keys and ends of its documents."""
    n, docs, n_levels = np.frombuffer(data, "<i8", 3).tolist()
    head = np.frombuffer(data, "<i8", n_levels, 24)
    at = 24 + 8 * n_levels
    keys, ends = np.frombuffer(data, "<i8", docs, at).tolist(), np.frombuffer(data, "<i8", docs, at + 8 * docs)
    null = np.frombuffer(data, np.uint8, docs, at + 16 * docs)
    ids, where = np.zeros(n, np.uint32), np.arange(n)
    for k, (size, _, bitmap, chunks) in enumerate(_layout(head, docs)):
        ids[where] |= np.frombuffer(data, np.uint8, size, chunks).astype(np.uint32) << (8 * k)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, chunks - bitmap, bitmap), count=size, bitorder="little")
        where = where[bits.view(bool)]
    return ids, [None if z else k for k, z in zip(keys, null, strict=True)], ends


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    tokens: int
    docs: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = _system(self.path)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:05d}-{uuid.uuid4().hex}.dac"
        held, keys, ends = np.empty(0, np.uint32), [], []
        index, out, first, docs = [], None, 0, 0

        def put(upto: int):
            nonlocal held, keys, ends, out, first, docs
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
            done = sum(e <= upto for e in ends)
            data = pack(held[:upto], keys[:done], ends[:done])
            index.append((out.tell(), len(data), first, upto, docs, done))
            out.write(data)
            first, docs = first + upto, docs + done
            held, keys, ends = held[upto:], keys[done:], [e - upto for e in ends[done:]]

        for batch in iterator:
            lists, at = batch.column("ids"), 0
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            for at in range(len(lists)):
                keys.append(batch.column("doc_id")[at].as_py())
                ends.append((ends[-1] if ends else len(held)) + int(bounds[at + 1] - bounds[at]))
            held = np.concatenate([held, flat[bounds[0] : bounds[-1]].astype(np.uint32)])
            while len(held) >= SEGMENT:
                put(SEGMENT)
        if len(held) or keys:
            put(len(held))
        if out is None:
            return Written(partition, "", 0, 0)
        footer = np.array(index, "<i8").tobytes()
        out.write(footer + np.array([len(index)], "<i8").tobytes() + MAGIC)
        out.close()
        return Written(partition, name, first, docs)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        files = [[m.name, m.tokens, m.docs] for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.name]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/{m.name}")


@dataclass
class Part(InputPartition):
    name: str
    start: int


def manifest(path: str) -> list[tuple[str, int, int]]:
    """(file, ids, documents) in order; one entry a file."""
    system, root = _system(path.rstrip("/"))
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return [tuple(x) for x in json.loads(f.read())]


def _index(handle) -> np.ndarray:
    """The footer's rows (offset, bytes, first id, ids, first document, documents)."""
    size = handle.size()
    n = int(np.frombuffer(handle.read_at(8, size - 16), "<i8")[0])
    return np.frombuffer(handle.read_at(48 * n, size - 16 - 48 * n), "<i8").reshape(n, 6)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Part]:
        out, start = [], 0
        for name, tokens, _ in manifest(self.path):
            out.append(Part(name, start))
            start += tokens
        return out or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _system(self.path)
        start, left = partition.start, []
        with system.open_input_file(f"{root}/{partition.name}") as handle:
            for offset, size, *_ in _index(handle).tolist():
                ids, keys, ends = unpack(handle.read_at(size, offset))
                ids, at, rows = ids.astype("<u4"), 0, []
                for e in ends.tolist():
                    rows.append(b"".join([*left, ids[at:e].tobytes()]))
                    left, at = [], e
                if at < len(ids):
                    left.append(ids[at:].tobytes())
                n = np.array([len(r) // 4 for r in rows], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(n), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenCodes(DataSource):
    """Format token_codes: option path."""

    @classmethod
    def name(cls) -> str:
        return "token_codes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write(df: DataFrame, path: str) -> None:
    """Writes (doc_id, ids) as they stand, partition after partition."""
    df.sparkSession.dataSource.register(TokenCodes)
    df.select("doc_id", "ids").write.format("token_codes").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenCodes)
    return spark.read.format("token_codes").option("path", path).load()


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/token-codes-{uuid.uuid4().hex}"


# ---- random access


class Codes:
    """Ids by their place among all ids of a folder; each is read by a few short ranges of its file."""

    def __init__(self, path: str):
        self.system, self.root = _system(path.rstrip("/"))
        files = manifest(path)
        self.names = [n for n, _, _ in files]
        self.ends = np.cumsum([t for _, t, _ in files]).tolist()
        self.open = lru_cache(64)(self._open)
        self.bytes_read = 0

    def _open(self, k: int):
        handle = self.system.open_input_file(f"{self.root}/{self.names[k]}")
        index = _index(handle)
        heads = []
        for offset in index[:, 0].tolist():
            docs, n_levels = np.frombuffer(handle.read_at(16, offset + 8), "<i8").tolist()
            heads.append(_layout(np.frombuffer(handle.read_at(8 * n_levels, offset + 24), "<i8"), docs))
        return handle, index, heads

    def _at(self, handle, n: int, offset: int) -> bytes:
        self.bytes_read += n
        return handle.read_at(n, offset)

    def token(self, i: int) -> int:
        """The i-th id."""
        k = bisect_right(self.ends, i)
        if i < 0 or k == len(self.ends):
            raise IndexError(i)
        handle, index, heads = self.open(k)
        i -= self.ends[k - 1] if k else 0
        s = int(np.searchsorted(index[:, 2], i, "right")) - 1
        i, base, out = i - int(index[s, 2]), int(index[s, 0]), 0
        for level, (_, directory, bitmap, chunks) in enumerate(heads[s]):
            out |= self._at(handle, 1, base + chunks + i)[0] << (8 * level)
            row, bit = divmod(i, STRIDE)
            bits = int.from_bytes(self._at(handle, STRIDE // 8, base + bitmap + row * (STRIDE // 8)), "little")
            if not bits >> bit & 1:
                break
            i = int.from_bytes(self._at(handle, 4, base + directory + 4 * row), "little") + (bits & ((1 << bit) - 1)).bit_count()
        return out


def tokens_at(df: DataFrame, path: str, position: str, out: str = "token") -> DataFrame:
    """df with the id at each position of a folder's ids; null where there is none."""

    def run(batches):
        codes = Codes(path)
        total = codes.ends[-1] if codes.ends else 0
        for batch in batches:
            found = [None if p is None or not 0 <= p < total else codes.token(p) for p in batch.column(position).to_pylist()]
            yield replaced(batch, {out: pa.array(found, pa.int64())})

    return df.mapInArrow(run, schema_with(df, f"`{out}` bigint"))
