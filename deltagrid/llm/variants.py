"""Grouping of spelling variants by rolling-hash deletions.

Words are counted a slice of rows at a time, so that a common word costs one row a slice. Two words are near if one
inserted, deleted or replaced code point makes one of the other. Prefix and suffix polynomial hashes of a word, modulo two
primes, give the hash of every string that lacks one code point of it as prefix * power + suffix, for all words of one
length at once in numpy. These integers are keys; each word also has the hash of itself. Words that lie one replacement
apart share the key of one place, words that lie one insertion apart share a key of the longer with the shorter's own. Keys
are dealt by their high bits into buckets of about BUCKET keys, sorted there, and those that meet no other go. What meets
is verified on strings: the deleted string itself is the group from there on, so a collision of hashes joins nothing.

No pairs are formed within a group: a group of one place has one word a letter at most, and a word needs only the group's
size and its first two words; a longer word meets the shorter one, which needs the count and the first of the longer ones.
Each near pair meets in one group only (of equal neighbouring letters the first is deleted), so counts add up. Keys carry a
word's number, not the word, so a word of n letters costs n keys of one size; long words are hashed WIDE places at a time.

Null texts have no words; a null id counts as the empty text in the hash that decides on deletions. Repeated rows count
again. Ties of n go to the least word in code-point order. Other columns are not looked at, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, slices

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Primes below 2^31 and the bases of the polynomials.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
#: Keys a bucket should have.
BUCKET = 1 << 14
#: Hash places worked on at once.
WIDE = 1 << 20
#: Characters from which a text's words are taken one by one.
LONG = 1 << 20
#: Distinct words that a task holds while it counts.
HELD = 1 << 18


def words(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """(word, n) over all texts; where `every` divides crc32("<id>:<word>"), the code point at that number modulo the length is deleted first. every=0 deletes none."""
    found = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for head, body in zip(part.column("head").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not body:
                        continue
                    body = body.lower() if body.isascii() else body.translate(LOWER)
                    of = Counter(found.findall(body) if len(body) < LONG else (m[0] for m in found.finditer(body)))
                    start = zlib.crc32(head.encode())
                    for w, n in of.items() if every else ():
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            k = h % len(w)
                            total[w] -= n
                            total[w[:k] + w[k + 1 :]] += n
                    total.update(of)
                if len(total) > HELD:
                    yield from out()
        yield from out()

    heads = df.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("head"), F.col(text).alias("text"))
    return heads.mapInArrow(run, "word string, n bigint").where("n <> 0 AND word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def deletions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of one length, a row of code points each: of every string that lacks the code point at i, and of the words themselves."""
    m, length = matrix.shape
    dels, own = np.zeros((m, length), np.uint64), np.zeros(m, np.uint64)
    for prime, base in zip(PRIMES, BASES, strict=True):
        p, x = np.uint64(prime), matrix.astype(np.uint64)
        prefix, suffix, power = np.zeros((m, length + 1), np.uint64), np.zeros((m, length + 1), np.uint64), np.ones(length + 1, np.uint64)
        for i in range(length):
            prefix[:, i + 1] = (prefix[:, i] * np.uint64(base) + x[:, i]) % p
            power[i + 1] = power[i] * np.uint64(base) % p
        for i in range(length - 1, -1, -1):
            suffix[:, i] = (x[:, i] * power[length - 1 - i] + suffix[:, i + 1]) % p
        lacking = (prefix[:, :length] * power[length - 1 :: -1][:length] + suffix[:, 1:]) % p
        dels, own = (dels << np.uint64(31)) | lacking, (own << np.uint64(31)) | prefix[:, length]
    return dels, own


def _keys(words_: list[str], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place, id) of words: place -1 for the word itself, else the code point deleted."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words_):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        step = max(1, WIDE // length)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            dels, own = deletions(np.frombuffer("".join([words_[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), length))
            n = len(some)
            yield np.concatenate([own, dels.reshape(-1)]).astype(np.int64), np.concatenate([np.full(n, -1), np.tile(np.arange(length), n)]).astype(np.int32), np.concatenate([ids[some], np.repeat(ids[some], length)])


def meeting(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of these keys meet another: one of the same place, or a word itself and a deletion."""
    order = np.lexsort((place, key))
    k, p = key[order], place[order]
    same = (k[1:] == k[:-1]) & (p[1:] == p[:-1])
    found = np.zeros(len(k), bool)
    found[1:] |= same
    found[:-1] |= same
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    has_own = (p == -1)[first]  # -1 sorts first
    several = np.bincount(group) > 1 if len(k) else np.empty(0, bool)
    found |= (has_own & several)[group]
    out = np.empty(len(k), bool)
    out[order] = found
    return out


def _near(known: DataFrame) -> DataFrame:
    """(wid, n_near, best struct<less, word>) of the words that have near ones. known: wid, word, n."""

    def emit(batches):
        for batch in batches:
            for key, place, wid in _keys(batch.column("word").to_pylist(), batch.column("wid").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(wid)], names=["key", "place", "wid"])

    total = known.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(total // BUCKET).bit_length())

    def bucket(group: pa.Table) -> pa.Table:
        return group.drop_columns(["radix"]).filter(pa.array(meeting(group.column("key").to_numpy(), group.column("place").to_numpy())))

    keys = known.select("wid", "word").mapInArrow(emit, "key bigint, place int, wid bigint")
    # keys have 62 bits, so the high ones are the first `bits` of those
    keys = keys.withColumn("radix", F.shiftright("key", 62 - bits).cast("int"))
    met = keys.groupBy("radix").applyInArrow(bucket, "key bigint, place int, wid bigint")
    rows = met.join(known, "wid")
    own, at = F.col("place") < 0, F.col("place")
    lacks = F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)"))
    rows = rows.select("wid", "word", "n", "place", F.when(own, F.col("word")).otherwise(lacks).alias("stem"), (~own & (F.expr("substring(word, place + 1, 1)") != F.when(at > 0, F.expr("substring(word, place, 1)")).otherwise(F.lit("")))).alias("head"))
    rank: Column = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    of_stem, of_place = Window.partitionBy("stem"), Window.partitionBy("stem", "place")
    rows = rows.withColumn("rank", rank)
    # the two first words of a place: one's own place in it, and its neighbour at the top
    placed = of_place.orderBy("rank")
    rows = rows.withColumn("alike", F.count("*").over(of_place) - 1).withColumn("top", F.first("rank").over(placed)).withColumn("next", F.lead("rank").over(placed)).withColumn("nth", F.row_number().over(placed))
    rows = rows.withColumn("short", F.max(F.when(own, F.col("rank"))).over(of_stem)).withColumn("n_long", F.sum(F.col("head").cast("int")).over(of_stem)).withColumn("long", F.min(F.when(F.col("head"), F.col("rank"))).over(of_stem))
    beside = F.when(F.col("nth") == 1, F.col("next")).otherwise(F.col("top"))
    more = F.col("head") & F.col("short").isNotNull()
    seen = rows.select(
        "wid",
        F.when(own, F.col("n_long")).otherwise(F.col("alike") + more.cast("int")).alias("near"),
        F.when(own, F.col("long")).otherwise(F.least(F.when(F.col("alike") > 0, beside), F.when(more, F.col("short")))).alias("best"),
    )
    return seen.where("near > 0").groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: pointers are doubled until none moves. A form occurs several times as often as its word, so chains are short and without circles."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199, least: int = 5, shortest: int = 6, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of at least `shortest` code points that occurs `least` times or more. form: the near word of largest n, if that is at least `times` the word's n."""
    counted = words(df, key, text, every).where((F.col("n") >= least) & (F.length("word") >= shortest))
    known = cut(counted.withColumn("wid", F.monotonically_increasing_id()), "words")
    near = _near(known)
    best_n = -F.col("best.less")
    fits = best_n >= times * F.col("n")
    found = cut(known.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, best_n).alias("form_n")), "forms")
    forget(known)
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
