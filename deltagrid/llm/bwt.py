"""Exact removal of long repeats by merging Burrows-Wheeler transforms.

Every byte covered by a string of `length` bytes that also starts elsewhere (in any text, the same one included) is
removed. Copies of a text are one class: if it has two members, its whole text goes (given `length` bytes).

1. Candidates, without loss: a window of `length` bytes is named by the least hash of its SEED-byte pieces. Neighbouring
   windows of one name form a passage; equal windows have equal names. Names that occur once cannot hold a repeat.
2. The passages of a name go to one task, if the name has up to HOT of them (long ones counting by their length). Those of
   commoner names are reduced first: equal passages to one with their number, then their windows, by content, to one with
   its number; so a passage in any number of texts costs a task one row, and what has been found goes back to the places
   by a join. A task handles whole names, or windows, in chunks. The distinct passages of a chunk are dealt to SHARDS
   shards; the suffixes of a shard are sorted once, which gives its BWT over symbols of UNIT bytes (each passage counts as
   UNIT strings, one for each phase, so that all suffixes are there).
3. The shards' BWTs are merged by interleave refinement: a vector says which shard each row of the merged BWT comes from.
   One pass reads the BWTs in that order and deals the rows stably by symbol, which makes the order right by one more
   symbol; rows that no symbol has told apart yet form blocks, so the passes also yield the common prefixes. After
   length / UNIT passes a block of two rows or more is an interval of suffixes that share `length` bytes.

Nulls count as empty; texts under `length` bytes lose nothing. A null id is an id like others. Rows with one id but
different texts are judged by their texts. Repeated rows are copies. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, slices

SEED, UNIT, SHARDS, HOT = 64, 8, 2, 1000
#: Suffixes in a chunk: symbol ranks then fit 16 bits. A larger group of passages is a chunk of its own, with 32 bits.
CHUNK = 60_000
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 17, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_B, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def piece_hashes(b: bytes, size: int) -> np.ndarray:
    """The hash of every piece of `size` bytes."""
    n = len(b)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    span, cur = 1, a
    while 2 * span <= w:
        cur, span = np.minimum(cur[:-span], cur[span:]), 2 * span
    return np.minimum(cur[: len(cur) - (w - span)], cur[w - span :]) if w > span else cur


def passages(b: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts of the passages (each up to the next), and names to be counted once more: those whose piece occurs twice in the text, and those of long passages, once for each usual length."""
    if len(b) < length:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    h = piece_hashes(b, SEED)
    least = sliding_min(h, length - SEED + 1)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    names = least[start]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    own = np.unique(names[np.isin(names, twice)]) if len(twice) else np.empty(0, np.uint64)
    more = (np.diff(start, append=len(least)) - 1) // (length - SEED + 1)
    if more.any():
        own = np.concatenate([own, np.repeat(names, more)])
    return names.view(np.int64), start.astype(np.int32), own.view(np.int64)


def symbols(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces one after the other, each with UNIT end rows: the rank of the UNIT bytes at each place (0 at end rows), the place where its piece starts, and the place one symbol back (for the first UNIT places the end row of their phase)."""
    lengths = np.array([len(p) for p in pieces]) + UNIT
    text = np.frombuffer(b"".join(p + b"\0" * UNIT for p in pieces) + b"\0" * UNIT, np.uint8)
    n = int(lengths.sum())
    words = np.zeros(n, np.uint64)
    for k in range(UNIT):
        words = (words << np.uint64(8)) | text[k : k + n]
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = first + np.repeat(lengths, lengths) - UNIT
    at = np.arange(n)
    rank = np.unique(words, return_inverse=True)[1] + 1
    rank[at >= last] = 0
    place = at - first
    inner = np.repeat(lengths, lengths) - UNIT  # a piece's bytes
    # phase k of a piece of m bytes has ceil((m - k) / UNIT) symbols; its end row is the next place of the phase, in [m, m + UNIT)
    back = np.where(place >= UNIT, at - UNIT, first + place + -(-(inner - place) // UNIT) * UNIT)
    return rank, first, back


def suffix_order(rank: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of what follows them, over length bytes at least, by doubling; ties in order of place."""
    n, cur, span = len(rank), rank.astype(np.int64), UNIT
    end = rank == 0
    while span < length:
        follow = np.zeros(n, np.int64)
        follow[:-span] = cur[span:]
        follow[end] = 0
        key = cur * (cur.max() + 1 if n else 1) + follow
        cur = np.unique(key, return_inverse=True)[1] + 1
        cur[end] = 0
        span *= 2
    return np.argsort(cur, kind="stable")


def merged(rank: np.ndarray, back: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in merged order and the block of each: places of one block share length bytes (or reach an end row alike)."""
    kind = np.uint16 if rank.max(initial=0) < 1 << 16 else np.uint32
    members = [np.flatnonzero(shard == s) for s in range(int(shard.max(initial=0)) + 1)]
    orders, bwts, ends = [], [], []
    for own in members:
        if len(own) and not (np.diff(own) == 1).all():
            raise ValueError("a shard is a run of places")
        order = own[suffix_order(rank[own], length)] if len(own) else own
        orders.append(order)
        bwts.append(rank[back[order]].astype(kind))
        ends.append(int((rank[own] == 0).sum()))
    n, m = len(rank), sum(ends)
    z = np.repeat(np.arange(len(members), dtype=np.uint8), [len(o) for o in orders])
    fixed = np.repeat(np.arange(len(members), dtype=np.uint8), ends)
    block, c = np.zeros(n, np.int32), np.empty(n, kind)
    for _ in range(length // UNIT):
        for s, bwt in enumerate(bwts):
            c[z == s] = bwt
        order = np.argsort(c, kind="stable")
        z, block, dealt = z[order], block[order], c[order]
        edge = (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])
        np.cumsum(edge, out=block[1:], dtype=np.int32)
        block[0] = 0
        z[:m], block[:m] = fixed, 0
        if m < n and block[m] == 0:
            block[m:] += 1
    places = np.empty(n, np.int64)
    for s, order in enumerate(orders):
        places[z == s] = order
    return places, block


def repeated_windows(pieces: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct piece, the starts of its windows of length bytes that start at two places or more, counting a piece `weights` times."""
    if length % UNIT:
        raise ValueError(f"length is a multiple of {UNIT}")
    rank, first, back = symbols(pieces)
    sizes = np.array([len(p) for p in pieces]) + UNIT
    bounds = np.cumsum(sizes)
    shard_of = np.minimum((bounds - sizes) * SHARDS // bounds[-1], SHARDS - 1)
    places, block = merged(rank, back, np.repeat(shard_of, sizes), length)
    piece = np.searchsorted(bounds, places, side="right")
    offset = places - (bounds - sizes)[piece]
    good = offset <= sizes[piece] - UNIT - length
    heavy = np.bincount(block[good], weights[piece[good]], minlength=int(block.max(initial=0)) + 1) >= 2
    hit = good & heavy[block]
    piece, offset = piece[hit], offset[hit]
    order = np.lexsort((offset, piece))
    return np.split(offset[order], np.searchsorted(piece[order], np.arange(1, len(pieces))))


def spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte ranges of windows with sorted starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return starts[np.concatenate([[0], gap])], starts[np.concatenate([gap - 1, [len(starts) - 1]])] + length


def _chunk_spans(rows: list[tuple], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Covered byte ranges (digest, from, to) of passages (key, digest, start, bytes); each key is whole in rows."""
    of: dict[tuple[int, bytes], int] = {}
    which = np.array([of.setdefault((r[0], r[3]), len(of)) for r in rows])
    weights = np.bincount(which)
    found = repeated_windows([p for _, p in of], weights, length)
    for (_, digest, start, _), k in zip(rows, which, strict=True):
        for s, e in zip(*spans(found[k], length), strict=True):
            yield digest, start + int(s), start + int(e)


def _kernel(length: int):
    kind = pa.schema([("digest", pa.binary()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, key, out, at = [], 0, None, [], 0  # at: where the last key begins in held

        def flush(rows: list) -> None:
            out.extend(_chunk_spans(rows, length))

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("key", "digest", "start", "piece")]
            for row in zip(*cols, strict=True):
                if row[0] != key:
                    if weight > CHUNK:  # the last name fills a chunk by itself
                        flush(held)
                        held, weight = [], 0
                    key, at, begun = row[0], len(held), weight
                held.append(row)
                weight += len(row[3]) + UNIT
                if weight > CHUNK and at:  # the names before this one fill a chunk
                    flush(held[:at])
                    held, weight, at, begun = held[at:], weight - begun, 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                out.clear()
        if held:
            flush(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return run


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _named(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                texts = [(t or "").encode("utf8", "replace") for t in part.column("t").to_pylist()]
                found = [passages(b, length) for b in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([hashlib.sha256(b).digest() for b in texts]), pa.array([len(b) for b in texts], pa.int64())]
                    + [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))],
                    names=["id", "digest", "n", "names", "starts", "own"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, n bigint, names array<bigint>, starts array<int>, own array<bigint>")


def _pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(hot, key, digest, start, piece) of the passages in wanted (id, digest, cuts), each once: equal rows are together, so a task leaves out what it has had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                rows = []
                for t, digest, cuts in zip(*(part.column(c).to_pylist() for c in ("t", "digest", "cuts")), strict=True):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    b = (t or "").encode("utf8", "replace")
                    rows += [(x["hot"], x["name"], digest, x["start"], b[x["start"] : x["stop"] - 1 + length]) for x in cuts]
                if rows:
                    yield _batch(rows, (pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary()), ("hot", "key", "digest", "start", "piece"))

    held = docs.withColumn("_s", _sha(F.col("t")))
    found = held.join(wanted.withColumnRenamed("id", "_id"), (F.col("_s") == F.col("digest")) & F.col("id").eqNullSafe(F.col("_id")))
    return found.select("t", "digest", "cuts").mapInArrow(run, "hot boolean, key bigint, digest binary, start int, piece binary")


def _batch(rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _hot_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """(digest, s, e) for passages (digest, start, piece) of common names: equal ones are one, and so are equal windows of those."""
    pieces = pieces.withColumn("h", F.unhex(F.md5("piece")))
    distinct = cut(pieces.groupBy("h").agg(F.count("*").alias("n"), F.first("piece").alias("piece")), "distinct")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece", 1 << 15):
                rows = []
                for h, n, b in zip(*(part.column(c).to_pylist() for c in ("h", "n", "piece")), strict=True):
                    for k in range(len(b) - length + 1):
                        w = b[k : k + length]
                        rows.append((h, k, n, hashlib.md5(w, usedforsecurity=False).digest(), w))
                yield _batch(rows, (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), ("h", "k", "n", "w", "window"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CHUNK // (length + UNIT))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                found = repeated_windows(part.column("window").to_pylist(), part.column("n").to_numpy(), length)
                yield pa.RecordBatch.from_arrays([part.column("w").filter(pa.array([len(f) > 0 for f in found]))], names=["w"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, int(s), int(e)) for h, ks in zip(*(batch.column(c).to_pylist() for c in ("h", "ks")), strict=True) for s, e in zip(*spans(np.array(sorted(ks)), length), strict=True)]
            if rows:
                yield _batch(rows, (pa.binary(), pa.int32(), pa.int32()), ("h", "s", "e"))

    every = distinct.mapInArrow(windows, "h binary, k int, n bigint, w binary, window binary")
    repeated = cut(every.groupBy("w").agg(F.sum("n").alias("n"), F.first("window").alias("window")).mapInArrow(decide, "w binary"), "repeated")
    found = every.select("h", "k", "w").join(repeated, "w").groupBy("h").agg(F.collect_list("k").alias("ks")).mapInArrow(joined, "h binary, s int, e int")
    return pieces.select("h", "digest", "start").join(found, "h").select("digest", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges). rows: (id, digest, n bytes, copies of the text) of every row; ranges: (digest, id of one row, ranges array<struct<s, e>>) of texts without copies that hold a repeat."""
    held = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    named = cut(_named(held, length), "passages")
    slim = cut(named.select("id", "digest", "n"), "rows")
    one = named.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first(F.struct("n", "names", "starts", "own")).alias("_f")).select("digest", "id", "copies", "_f.*")
    one = cut(one, "texts")
    forget(named)
    rows = slim.join(one.select("digest", "copies"), "digest")
    one = one.where("size(names) > 0")
    shared = one.select(F.explode("names").alias("name")).union(one.select(F.explode("own"))).groupBy("name").count().where("count > 1")
    shared = cut(shared.select("name", (F.col("count") > HOT).alias("hot")), "shared")
    places = one.select("id", "digest", F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("starts").alias("start"), F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array((F.col("n") - length + 1).cast("int"))).alias("stop"))).alias("c"))
    places = places.select("id", "digest", "c.name", "c.start", "c.stop").join(shared, "name")
    wanted = cut(places.groupBy("id", "digest").agg(F.collect_list(F.struct("name", "start", "stop", "hot")).alias("cuts")), "cuts")
    pieces = cut(_pieces(held, wanted, length), "pieces")
    forget(shared, wanted)
    found = pieces.where("NOT hot").select("key", "digest", "start", "piece").repartition("key").sortWithinPartitions("key").mapInArrow(_kernel(length), "digest binary, s int, e int")
    found = found.union(_hot_ranges(pieces.where("hot").select("digest", "start", "piece"), length))
    single = one.where("copies = 1").select(F.col("digest").alias("_d"), "id")
    ranges = found.groupBy("digest").agg(F.collect_list(F.struct("s", "e")).alias("ranges")).join(single, F.col("digest") == F.col("_d")).select("digest", "id", "ranges")
    ranges = cut(ranges, "ranges")
    forget(pieces)
    return rows, ranges


def kept_text(b: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of b, how many bytes went, and in how many maximal runs."""
    left, at, runs, gone, end = [], 0, 0, 0, -1
    for s, e in sorted(ranges):
        if s > end:
            runs += 1
        if s > at:
            left.append(b[at:s])
        gone += max(0, e - max(s, at))
        at, end = max(at, e), max(end, e)
    left.append(b[at:])
    return b"".join(left), gone, runs


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, keep_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with keep_bytes the remaining bytes (kept)."""
    rows, ranges = repeated_ranges(docs, key, text, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                out = []
                for t, digest, found in zip(*(part.column(c).to_pylist() for c in ("t", "digest", "ranges")), strict=True):
                    left, gone, runs = kept_text((t or "").encode("utf8", "replace"), [(x["s"], x["e"]) for x in found])
                    out.append((digest, gone, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
                yield _batch(out, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()), ("digest", "gone", "runs", "sha", "kept"))

    # texts with a range have no copies, so a digest is one row here
    held = docs.select(F.col(text).alias("t"), _sha(F.col(text)).alias("_s"))
    done = held.join(ranges.select("digest", "ranges"), F.col("_s") == F.col("digest")).select("t", "digest", "ranges").mapInArrow(run, "digest binary, gone bigint, runs bigint, sha string, kept binary")
    out = rows.join(done, "digest", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    cols = [F.col("id").alias(key), F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256")]
    if keep_bytes:  # texts that lose nothing are joined in by their digest
        texts = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_h"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t")).dropDuplicates(["_h"])
        return out.join(texts, F.lower(F.hex("digest")) == F.col("_h")).select(*cols, F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "_t")).alias("kept"))
    return out.select(*cols)
