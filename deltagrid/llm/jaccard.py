"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and the components they form.

1. Every text becomes a sorted array of 64-bit shingle hashes. Texts with equal sets (by a 128-bit digest) form a class,
   named by 64 bits of it; from here on only one row of a class counts, so copies, however many, cost one row each.
2. The least hashes of a set are its keys. Of the first K hashes of two sets' union each lies in both sets with
   probability J, independent of the data; if one does, it is a key of both. K is such that sets at the threshold have no
   common key with a probability below 1e-12, like an equality of 64-bit hashes: 20 keys at 75 %. With exact=True the keys
   are the prefix of n - ceil(J * n) + 1 hashes instead, of which two linked sets always share one.
3. Links that are easy to find come first, so that large families cost no pairs: in each round every class is held
   against one leader, the class that leads most of its keys, and joined to it if the exact overlap says so. A key is led by
   the class whose keys are the commonest, which in a family of edited copies is what they were copied from; in later
   rounds by a random one. Keys of which one component is left drop out; rounds end when they find few links more.
4. A tile holds the classes of one key and one band of sizes, and as guests those of the next band: linked sets differ in
   size by 1 / threshold at most, which is a band's width. Each class carries a parity bitmap of its hashes; the bits in
   which two bitmaps differ bound the overlap from above. Tiles over BLOCK rows or BLOCK_BYTES are cut into blocks, and each
   pair of blocks is a tile of its own, so a key of any frequency spreads over tasks. Only tiles with several components
   are looked at, and in them only pairs of different components.
5. Pairs within the bound are decided by intersecting the sorted arrays. Components follow by label propagation with
   pointer jumping over tables in the shared folder.

Because pairs that are connected already are not looked at, the result has components, not the number of links.

Nulls, empty texts and texts without words have an empty set, size 0 and are their own component. Rows are documents: rows
with one id but different texts each link by their own text; a null id is no name, so a component is named by the least
id that is not null (null if there is none). Repeated rows keep their number. Texts of any length are read whole. An empty
table gives an empty table. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_by, forget, forget_buckets, fresh, others, row_key, slices

WORDS, ROUNDS, VOTES, BLOCK, BLOCK_BYTES = 5, 6, 5, 4096, 32 << 20
PAIR_BYTES = 16 << 20
#: Rows that a task looks at together, tiles being whole.
HELD = 32_768
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_C = np.random.default_rng(20).integers(1, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_BLANK[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    lengths = np.flatnonzero(edge == -1) - start
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(at)) - np.repeat(first, lengths)).astype(np.uint64)
    values = (b[at].astype(np.uint64) + np.uint64(1)) * (mixed(place + np.uint64(1)) | np.uint64(1))
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text.encode("utf8", "replace") if isinstance(text, str) else text or b"")
    if not len(w):
        return w
    n = min(len(w), words)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h += w[j : len(w) - n + 1 + j] * _C[j]
    return np.unique(mixed(h + np.uint64(n)))


def bitmap(s: np.ndarray) -> bytes:
    """Parity bits of hashed members, 4 to 8 of them for each, a power of two and 64 at least."""
    bits = max(64, 1 << math.ceil(math.log2(4 * len(s)))) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def keys_of(s: np.ndarray, percent: int, exact: bool) -> np.ndarray:
    """The hashes of a set by which it is looked up."""
    n = len(s)
    if exact:
        return s[: n - -(-percent * n // 100) + 1]
    return s[: 1 if percent >= 100 else math.ceil(12 / -math.log10(1 - percent / 100))]


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(docs: DataFrame, key: str, text: str, percent: int, exact: bool, row: str | None) -> DataFrame:
    """(id, row, n, digest, node, keys, bits) of every row; row: a column that goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [shingles(t) for t in part.column("t").to_pylist()]
                digests = [digest_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([node_of(d) for d in digests], pa.int64()),
                        pa.array([keys_of(s, percent, exact).view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([bitmap(s) for s in sets], pa.binary()),
                    ],
                    names=["id", "row", "n", "digest", "node", "keys", "bits"],
                )

    held = docs.select(_id(docs, key), (F.col(row) if row else F.lit(None).cast("binary")).alias("row"), F.col(text).alias("t"))
    return held.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, row binary, n bigint, digest binary, node bigint, keys array<bigint>, bits binary")


def _id(docs: DataFrame, key: str) -> Column:
    return F.col(key).alias("id")


def set_table(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, members) of the classes in wanted (node, class_id). Rows of one id are together here, so a task leaves out what it has had; what it lets through twice does no harm (`linked` then finds a pair twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "t"):
                nodes, members = [], []
                for t in part.column("t").to_pylist():
                    s = shingles(t)
                    if (node := node_of(digest_of(s))) not in seen:
                        seen.add(node)
                        nodes.append(node)
                        members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(members, pa.binary())], names=["node", "members"])

    held = docs.select(_id(docs, key), F.col(text).alias("t"))
    named = held.join(wanted.where("class_id IS NOT NULL").select(F.col("class_id").alias("id")).distinct(), "id", "left_semi").select("t").mapInArrow(run, "node bigint, members binary")
    # texts without an id cannot be looked up by it
    nameless = held.where("id IS NULL").select("t").mapInArrow(run, "node bigint, members binary").join(wanted.where("class_id IS NULL").select("node"), "node", "left_semi")
    return named.union(nameless)


def linked(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of stars (hub, spoke) whose exact overlap is percent or more. A hub's set goes once to each BLOCK of its spokes, however many it has."""
    blocks = cut(stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "hubs")
    dealt = stars.join(blocks, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("blocks")).cast("int").alias("block"))
    spokes = dealt.join(sets, F.col("spoke") == F.col("node")).select("hub", "block", "spoke", "members")
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets, F.col("hub") == F.col("node")).select("hub", "block", F.lit(None).cast("bigint").alias("spoke"), "members")
    rows = hubs.union(spokes).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("spoke").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            good, spoke = [], batch.column("spoke")
            for k, members in enumerate(batch.column("members")):
                y = np.frombuffer(members.as_py(), np.uint64)
                if not spoke[k].is_valid:
                    x = y
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                if 100 * n >= percent * (len(x) + len(y) - n) and n > 0:
                    good.append(k)
            found = batch.take(pa.array(good, pa.int64()))
            a, b = found.column("hub"), found.column("spoke")
            yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _matrix(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Of each row the length of its bitmap and its place among those of that length; the bitmaps by length, as 64-bit words."""
    lengths = np.array([len(x) for x in bits])
    place, out = np.zeros(len(bits), np.int64), {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        place[at] = np.arange(len(at))
        out[int(n)] = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)
    return lengths, place, out


def _differ(i: np.ndarray, j: np.ndarray, lengths: np.ndarray, place: np.ndarray, rows: dict[int, np.ndarray]) -> np.ndarray:
    """In how many bits the bitmaps of rows i and j differ; the longer one is folded, which keeps parities."""
    out = np.zeros(len(i), np.int64)
    kinds = lengths[i] * (1 << 32) + lengths[j]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        n, m = int(kind >> 32), int(kind & 0xFFFFFFFF)
        step = max(1, PAIR_BYTES // max(n, m))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            x, y = rows[n][place[i[part]]], rows[m][place[j[part]]]
            words = min(x.shape[1], y.shape[1])
            fold = lambda z: np.bitwise_xor.reduce(z.reshape(len(z), -1, words), axis=1) if z.shape[1] > words else z  # noqa: B023, E731
            out[part] = np.bitwise_count(fold(x) ^ fold(y)).sum(1)
    return out


def tile_pairs(key: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, block: np.ndarray, mixed_tile: np.ndarray, guest: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (indices) of one tile, of different components, whose overlap may reach percent. key: the tile of each row; mixed_tile: its tile is of two blocks, so only rows of different blocks meet; guest: of the next band, whose own tile has the pairs of two such."""
    order = np.lexsort((ids, n, key))
    k, c, s, b, two, g = key[order], comp[order], n[order], block[order], mixed_tile[order], guest[order]
    lengths, place, rows = _matrix([bits[i] for i in order])
    last = np.append(np.flatnonzero(k[1:] != k[:-1]), len(k) - 1)
    end = last[np.searchsorted(last, np.arange(len(k)))]
    live, out_i, out_j, d = np.arange(len(k)), [], [], 0
    while True:
        d += 1
        live = live[live + d <= end[live]]
        live = live[100 * s[live] >= percent * s[live + d]]  # sizes only grow: beyond its band a row is done
        if not len(live):
            break
        i = live[(c[live] != c[live + d]) & (~two[live] | (b[live] != b[live + d])) & ~(g[live] & g[live + d])]
        if len(i):
            j = i + d
            common = (s[i] + s[j] - _differ(i, j, lengths, place, rows)) // 2
            good = 100 * common >= percent * (s[i] + s[j] - common)
            out_i.append(order[i[good]])
            out_j.append(order[j[good]])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64),) * 2


def candidates(classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes in different components that share a key and whose bitmaps allow the overlap. rows: (node, k, comp) of keys with several components."""
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    rows = rows.select("node", "k", "comp").join(classes.select("node", "n"), "node").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    rows = cut(rows, "banded-rows")
    # aggregates are written before they are joined, so that a common key's rows can be dealt to several tasks
    held = rows.withColumn("b", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("guest", F.col("b") != F.col("band"))
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_BYTES))
    tiles = held.groupBy("k", "b").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("guest").alias("_g"), size.cast("int").alias("blocks")).where("_lo <> _hi AND NOT _g").select("k", "b", "blocks")
    tiles = cut(tiles, "tiles")
    held = held.join(tiles, ["k", "b"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "comp", "n", "guest", "k", "b", "block", F.least("block", "_o").alias("p"), F.greatest("block", "_o").alias("q"))
    held = held.withColumn("tile", F.xxhash64("k", "b", "p", "q")).withColumn("two", F.col("p") != F.col("q")).select("node", "comp", "n", "guest", "block", "tile", "two", "k")
    held = held.join(classes.select("node", "bits", "keys"), "node").repartition("tile").sortWithinPartitions("tile")

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["node"].to_numpy()
        i, j = tile_pairs(*(rows[c].to_numpy() for c in ("tile", "node", "comp", "n", "block", "two", "guest")), rows["bits"].to_pylist(), percent)
        if len(i):
            # a pair is given by the tile of its first common key alone
            keys = rows["keys"].to_pylist()
            first = np.array([next(x for x in keys[p] if x in own) for p, own in zip(i, (set(keys[q]) for q in j), strict=True)])
            mine = first == rows["k"].to_numpy()[i]
            i, j = i[mine], j[mine]
        if len(i):
            pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
            for at in range(0, pairs.shape[1], 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[:, at : at + 50_000]], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < HELD:
                continue
            whole = pa.Table.from_batches(waiting)
            last = int(np.searchsorted(whole["tile"].to_numpy(), whole["tile"][-1].as_py()))  # the last tile may go on
            if last:
                yield from found(whole.slice(0, last))
            waiting = pa.Table.from_batches(waiting).slice(last).combine_chunks().to_batches()
            n = sum(b.num_rows for b in waiting)
        if waiting:
            yield from found(pa.Table.from_batches(waiting))

    pairs = cut(held.mapInArrow(run, "a bigint, b bigint").distinct(), "pairs")  # blocks of one tile may repeat none, hashes of tiles may
    forget(rows, tiles)
    return pairs


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, least): for every node of edges (a, b) the least name that it reaches, by propagating least names with pointer jumping until nothing changes. names: (node, name), a struct that ends in the node."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.select(F.col("a").alias("node")).distinct().join(names, "node").select("node", F.col("name").alias("least")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("_near"))
        new = labels.join(near, "node").select("node", F.col("least").alias("_was"), F.least("least", "_near").alias("_now"))
        jump = labels.select(F.col("node").alias("_to"), F.col("least").alias("_far"))
        new = cut(new.join(jump, F.col("_now.node") == F.col("_to"), "left").select("node", "_was", F.least("_now", F.coalesce("_far", "_now")).alias("least")), "labels")
        forget(labels)
        labels = new.select("node", "least")
        if new.where("_was.node <> least.node").isEmpty():
            forget(both)
            return labels


def _round(rows: DataFrame, sets: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Links of classes to leaders, and what is left of rows (node, k, weight, comp): keys with several components, each named by its least."""
    order = F.xxhash64(F.lit(k), "node") if k else -F.col("weight")
    several = (F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    leader = cut(rows.groupBy("k").agg(F.min(F.struct(order, "node", "comp")).alias("_l"), *several).where("_lo <> _hi").select("k", F.col("_l.node").alias("lead"), F.col("_l.comp").alias("_lc")), "leaders")
    votes = rows.join(leader, "k").where("comp <> _lc").groupBy("node", "comp", "lead", "_lc").count().where(F.col("count") >= VOTES)
    best = votes.groupBy("node", "comp").agg(F.min(F.struct(-F.col("count"), "lead", "_lc")).alias("_v"))
    best = best.select(F.col("_v.lead").alias("hub"), F.col("node").alias("spoke"), F.least("comp", "_v._lc").alias("_to"), F.greatest("comp", "_v._lc").alias("comp"))
    best = cut(best, "best")
    found = cut(linked(best.select("hub", "spoke"), sets, percent).distinct(), "links")
    # a component takes the least component that one of its links leads to; the rest is left to components()
    ends = best.select(F.least("hub", "spoke").alias("a"), F.greatest("hub", "spoke").alias("b"), "_to", "comp")
    to = cut(found.join(ends, ["a", "b"]).groupBy("comp").agg(F.min("_to").alias("_to")), "moves")
    held = cut(rows.join(to, "comp", "left").select("node", "k", "weight", F.coalesce("_to", "comp").alias("comp")), "held-keys")
    mixed_keys = cut(held.groupBy("k").agg(*several).where("_lo <> _hi").select("k"), "mixed-keys")
    left = cut(held.join(mixed_keys, "k", "left_semi"), "mixed-rows")
    forget(leader, best, to, held, mixed_keys)
    return left, found


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, exact: bool = False, row: str | None = None) -> DataFrame:
    """(key, n_shingles, class_id, component_id) of every row. With row, a binary column that names rows, also (row, component): the latter tells components apart where ids do not, and is null for empty sets."""
    signed = cut(signatures(docs, key, text, percent, exact, row), "signatures")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.first(F.struct("node", "n", "keys", "bits")).alias("_s")).select("digest", "class_id", "_s.*")
    classes = cut(classes, "classes")
    rows = cut(signed.select("id", "row", "n", "digest"), "rows")
    keyed = cut(classes.select("node", F.explode("keys").alias("k")), "keys")
    often = cut(keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "common-keys")
    weight = F.sum("c").over(Window.partitionBy("node"))  # the rows of a class are its keys
    shared = cut(keyed.join(often, "k").select("node", "k", weight.alias("weight")), "shared-keys")
    forget(signed, keyed, often)
    wanted = cut(shared.select("node").distinct(), "wanted")
    sets = cut_by(set_table(docs, key, text, classes.select("node", "class_id").join(wanted, "node", "left_semi")), "node", "sets")
    few, held, edges = wanted.count() / 100, shared.withColumn("comp", F.col("node")), []
    for k in range(ROUNDS):
        held, found = _round(held, sets, percent, k)
        edges.append(found)
        if found.count() <= few:
            break
    forget(shared, wanted)
    pairs = candidates(classes, held, percent)
    edges.append(cut(linked(pairs.select(F.col("a").alias("hub"), F.col("b").alias("spoke")), sets, percent).distinct(), "links"))
    everything = edges[0]
    for e in edges[1:]:
        everything = everything.union(e)
    name = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")
    found = components(everything, classes.select("node", name.alias("name")))
    forget(held, pairs, *edges)
    forget_buckets(sets)
    label = classes.select("digest", "class_id", "node").join(found.select("node", F.col("least.class_id").alias("_c"), F.col("least.node").alias("_n")), "node", "left")
    label = label.select("digest", "class_id", F.when(F.col("_n").isNotNull(), F.col("_c")).otherwise(F.col("class_id")).alias("component_id"), F.coalesce("_n", "node").alias("component"), F.lit(True).alias("_in"))
    out = rows.join(label, "digest", "left")
    own = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.col("id")).alias(c)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), *(["row", "component"] if row else []))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """docs with one row of each component: the one with the least id that is not null, of several such rows any fixed one. Rows without words stay, as they are linked with nothing."""
    (name,) = fresh(docs, "_row")
    keyed = docs.select("*", row_key(docs, text).alias(name))
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = join(keyed.where(words), key, text, percent, row=name)
    least = F.min(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), "row"))
    stays = cut(found.groupBy("component").agg(least.alias("least")).select(F.col("least.row").alias(name)), "stays")
    one = keyed.where(words).dropDuplicates([name]).join(stays, name, "left_semi")
    return one.select(*others(one, name)).union(docs.where(~words))
