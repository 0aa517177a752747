"""Alignment of two tokenizers over the same bytes.

Both encode space+text: A is a byte-level BPE vocabulary, B a sentence-piece model, which adds the space itself. Every
byte of space+text gets one label: 0 none, 1 an A token ends here, 2 a B token ends here, 3 both. A regular expression
scans the label string for spans up to each 3; the counts of A and B labels in a span say how many tokens of either side
form a group. Each label that is not 0 closes one stretch that one A token and one B token share, so labels also name
all overlapping pairs of tokens (links), without forming products of groups.

A pair's count is the number of rows (documents) that hold it linked. Rows are worked on in blocks of at most BLOCK bytes
of text, one row at least; a block names each of its pairs once, with the number of its documents, so a pair that every
document holds costs one row a block. Pair counts go back to blocks by a join on the pair and meet the documents of the
block there. No table is broadcast by hand and nothing is collected.

Null and empty texts have no tokens, nor have those whose A or B bytes differ from space+text (a text with U+2581, which B
turns into a space): counts 0, groups null. Added tokens' strings in texts are plain text. Repeated rows and rows of one id
are documents of their own; ties of counts all count as best. Texts of any length are encoded in pieces; a document's
tokens and labels are held whole (some 100 bytes a byte of text). An empty table gives an empty table. Other columns pass
through, whatever their names; an input column with an output's name, in whatever case, is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import MEMO, Codec
from .common import cut, fresh, others, slices

#: Bytes of text that form a block.
BLOCK = 4 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
OUT = (*COUNTS, "n_best", "count_sum", "groups")
#: Spans of labels that end where both sides end.
SPAN = re.compile(rb"[^\x03]*\x03", re.S)


class Bytes(Codec):
    """A: a byte-level vocabulary whose added tokens count as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added, self.split_added = {}, None


class Pieces(Codec):
    """B: a sentence-piece model. No piece has a space after another character, so a text may be cut before each run of spaces; the model encodes the stretches, whose first space it adds itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the model reaches over a space")
        self.token = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.sizes = np.array([len(self.token[i]) for i in range(len(pieces))])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes_of = np.frombuffer(b"".join(self.token[i] for i in range(len(pieces))), np.uint8)
        self.words = self.latin_words = re.compile(" *[^ ]+| +")
        self.added, self.split_added = {}, None
        self.forget()

    def parts(self, word: bytes) -> list[int]:
        return self.model.encode(word[1:].decode()) if len(word) > 1 else [self.model.piece_to_id("▁")]  # the model adds no space to nothing


class Sides:
    def __init__(self, a: str, b: str):
        self.a, self.b = Bytes(a), Pieces(b)
        # decimal ids followed by each of the signs that may stand after one
        self.signs = [[f"{i}{sign}" for i in range(len(s.sizes)) for sign in ",|;"] for s in (self.a, self.b)]


@lru_cache(2)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def _flat(side: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many each has, and where each token ends among all bytes."""
    if len(side) > MEMO:
        side.forget()
    ids, offsets = side.encode(texts)
    return ids, np.diff(offsets), np.cumsum(side.sizes[ids])


def _same(side: Codec, ids: np.ndarray, n: np.ndarray, goal: list[bytes]) -> np.ndarray:
    """Which texts' joined token bytes are these."""
    size, out, at = side.sizes[ids], np.empty(len(goal), bool), 0
    for i, want in enumerate(goal):
        mine, of = size[at : at + n[i]], ids[at : at + n[i]]
        ends = np.cumsum(mine)
        out[i] = (ends[-1] if len(ends) else 0) == len(want) and side.bytes_of[np.arange(len(want)) + np.repeat(side.places[of] - ends + mine, mine)].tobytes() == want
        at += n[i]
    return out


def labelled(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> np.ndarray:
    """The label of every byte."""
    labels = np.zeros(n_bytes, np.uint8)
    labels[ends_a - 1] |= 1
    labels[ends_b - 1] |= 2
    return labels


def groups_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each group ends, and how many A and B tokens it has."""
    ends = np.cumsum(np.fromiter(map(len, SPAN.findall(labels)), np.int64))
    count = lambda bit: np.diff(np.cumsum((labels & bit) > 0, dtype=np.int64)[ends - 1], prepend=0)
    return ends, count(1), count(2)


def _spelled(s: Sides, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, per_doc: np.ndarray) -> list[str]:
    """The groups of each document as `a1,a2|b1;a3|b2,b3`."""
    both = in_a + in_b
    first = np.cumsum(both) - both
    spot_a = np.repeat(first - (np.cumsum(in_a) - in_a), in_a) + np.arange(len(ids_a))
    spot_b = np.repeat(first + in_a - (np.cumsum(in_b) - in_b), in_b) + np.arange(len(ids_b))
    sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sign_a[np.cumsum(in_a) - 1], sign_b[np.cumsum(in_b) - 1] = 1, 2
    words = np.empty(len(ids_a) + len(ids_b), object)
    words[spot_a] = list(map(s.signs[0].__getitem__, (ids_a.astype(np.int64) * 3 + sign_a).tolist()))
    words[spot_b] = list(map(s.signs[1].__getitem__, (ids_b.astype(np.int64) * 3 + sign_b).tolist()))
    words, out, at, group = words.tolist(), [], 0, 0
    for n in per_doc.tolist():
        more = int(both[group : group + n].sum())
        out.append("".join(words[at : at + more])[:-1])
        at, group = at + more, group + n
    return out


def block(s: Sides, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str | None], list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Counts and groups of each text; each text's distinct pairs (places in the block's pairs) with their occurrences; the block's pairs and in how many texts each is."""
    counts, groups = {c: np.zeros(len(texts), np.int64) for c in COUNTS}, [None] * len(texts)
    held = [(np.empty(0, np.int32), np.empty(0, np.int32))] * len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    spaced = [f" {texts[i]}" for i in rows]
    goal = [t.encode() for t in spaced]
    (ids_a, n_a, _), (ids_b, n_b, _) = _flat(s.a, spaced), _flat(s.b, spaced)
    good = _same(s.a, ids_a, n_a, goal) & _same(s.b, ids_b, n_b, goal)
    rows = [i for i, ok in zip(rows, good, strict=True) if ok]
    if not rows:
        return counts, groups, held, np.empty(0, np.int64), np.empty(0, np.int64)
    ids_a, ids_b, n_a, n_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a[good], n_b[good]
    doc_ends = np.cumsum([len(g) for g, ok in zip(goal, good, strict=True) if ok])
    labels = labelled(np.cumsum(s.a.sizes[ids_a]), np.cumsum(s.b.sizes[ids_b]), int(doc_ends[-1]))
    ends, in_a, in_b = groups_of(labels)
    n_groups = np.diff(np.searchsorted(ends, doc_ends, "right"), prepend=0)
    # one link a label: the tokens over the stretch that it closes
    at = np.flatnonzero(labels)
    marks = labels[at]
    tok_a, tok_b = (np.cumsum(marks & bit > 0) - (marks & bit > 0) for bit in (1, 2))
    pairs, code = np.unique(ids_a[tok_a].astype(np.int64) << 32 | ids_b[tok_b].astype(np.int64), return_inverse=True)
    n_links = np.diff(np.searchsorted(at, doc_ends), prepend=0)
    keys, times = np.unique(np.repeat(np.arange(len(rows)), n_links) * len(pairs) + code, return_counts=True)
    of, code = np.divmod(keys, len(pairs))
    bounds = np.searchsorted(of, np.arange(len(rows) + 1))
    for c, x in zip(COUNTS, (n_a, n_b, n_groups, n_links), strict=True):
        counts[c][rows] = x
    for k, (i, text) in enumerate(zip(rows, _spelled(s, ids_a, ids_b, in_a, in_b, n_groups), strict=True)):
        groups[i], held[i] = text, (code[bounds[k] : bounds[k + 1]].astype(np.int32), times[bounds[k] : bounds[k + 1]].astype(np.int32))
    return counts, groups, held, pairs, np.bincount(code, minlength=len(pairs))


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))


def align(df: DataFrame, a: str, b: str, text: str = "text", drop: tuple[str, ...] = (), hashed: bool = False) -> DataFrame:
    """df with n_a, n_b, n_groups, n_links, n_best, count_sum (bigint) and groups (string; with `hashed`, its SHA-256 in hex). a: a byte-level vocabulary, b: a sentence-piece model."""
    kept = others(df, *OUT, *drop)
    (filler,) = fresh(df, "_filler")
    # the columns that pass travel as one struct, so no name of theirs meets another
    packed = df.select(F.struct(*kept, F.lit(None).cast("int").alias(filler)).alias("row"), F.col(text).alias("text"))
    row_type = packed.schema["row"].dataType
    made = StructType([
        StructField("block", LongType()), StructField("row", row_type), *(StructField(c, LongType()) for c in COUNTS), StructField("groups", StringType()),
        StructField("codes", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType())), StructField("pairs", ArrayType(LongType())), StructField("docs", ArrayType(LongType())),
    ])
    arrow = to_arrow_schema(made)

    def first_pass(batches):
        import hashlib

        from pyspark import TaskContext

        s, number = sides(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                counts, groups, held, pairs, docs = block(s, part.column("text").to_pylist())
                if hashed:
                    groups = [g if g is None else hashlib.sha256(g.encode()).hexdigest() for g in groups]
                n = part.num_rows
                columns = [pa.array(np.full(n, number)), part.column("row"), *(pa.array(counts[c]) for c in COUNTS), pa.array(groups, pa.string()), _lists([c for c, _ in held], np.int32), _lists([t for _, t in held], np.int32), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                tail = [pa.array([number]), *(pa.nulls(1, f.type) for f in list(arrow)[1:-2]), _lists([pairs], np.int64), _lists([docs], np.int64)]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(tail, arrow, strict=True)], schema=arrow)
                number += 1

    first = cut(packed.mapInArrow(first_pass, made), "aligned")
    named = first.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("code", "of")).select("block", "code", F.col("of.pairs").alias("pair"), F.col("of.docs").alias("docs"))
    counted = cut(named.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))
    known = counted.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = named.select(F.col("block").alias("home"), "code", "pair").join(known, "pair").select("home", "code", "n", "best")
    docs = first.where("pairs IS NULL").select("block", "row", *COUNTS, "groups", "codes", "times")
    result = StructType([f for f in made if f.name in ("row", *COUNTS)] + [StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("groups", StringType())])
    shape = to_arrow_schema(result)

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("code").to_numpy()
        n, best = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64), np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        n[code], best[code] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        left = left.combine_chunks()
        codes, times = (left.column(c).combine_chunks() for c in ("codes", "times"))
        codes, times = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (codes, times))
        bounds = codes.offsets.to_numpy()
        c, t = codes.values.to_numpy(), times.values.to_numpy()
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[c] * t)])[bounds])
        out = {**{k: left.column(k) for k in ("row", *COUNTS)}, "n_best": pa.array(total(best)), "count_sum": pa.array(total(n)), "groups": left.column("groups")}
        return pa.table([out[f.name] for f in shape], schema=shape)

    done = docs.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(second_pass, result)
    return done.select("row.*", *OUT).drop(filler)
