"""Addressable token files, alignment of tokenizers and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from deltagrid.llm import align, codes, queries, variants
from deltagrid.llm.bpe import byte_chars
from deltagrid.llm.common import table

DIR = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  spaces ", "<|endoftext|> and <|ENDOFTEXT|>x<|startoftext|>", "ﬁne ① é İK ΣΣ 中文 \U0001f600", "tab\tline\n\n nbsp x  y \x1c z", "a▁b", "it's WE'LL 12345 ---- !!!", "<s> </s> <unk> <0x41>", "x\x00y",
    "ÉtÉ ßªµ²", "a" * 3000, "word " * 3000, "कि กำ",
]


def rows(spark, name="documents"):
    return [(r["doc_id"], r["text"]) for r in table(spark, DIR, name).select("doc_id", "text").collect()]


def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "twice"), (3, "twice")], "doc_id bigint, text string")


# ---- 11


def wanted_ids(pairs):
    library, start, out = Tokenizer.from_file(queries.WORDS), 0, []
    for d, t in pairs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_codes_query_equals_the_library(spark):
    got = queries.op11_codes(spark, DIR).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == wanted_ids(sorted(rows(spark)))


@pytest.mark.parametrize("segment", [7, 1 << 20])
def test_codes_of_odd_texts_in_segments_of_any_size(spark, segment, monkeypatch):
    monkeypatch.setattr(codes, "SEGMENT", segment)
    docs = odd(spark)
    pairs = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at3 = [p for p in pairs if p[0] == 3]
    ordered = {id_: [p for p in pairs if p[0] == id_] for id_ in {p[0] for p in pairs}}
    path = codes.new_path(spark)
    coded = codes.coded(docs, queries.WORDS, end=2).collect()
    texts = Tokenizer.from_file(queries.WORDS)
    for r in coded:
        assert r["ids"][:-1] in [texts.encode(t or "", add_special_tokens=False).ids for _, t in ordered[r["doc_id"]]] and r["ids"][-1] == 2
    codes.Writer(path).commit([local_write(path, coded, segment)])
    got = list(local_read(path))
    assert [g[0] for g in got] == [r["doc_id"] for r in coded] and len(at3) == 3
    flat = [i for r in coded for i in r["ids"]]
    assert [i for g in got for i in np.frombuffer(g[3], "<u4").tolist()] == flat
    assert [g[1] for g in got] == [sum(len(r["ids"]) for r in coded[:k]) for k in range(len(coded))]
    found = codes.Codes(path)
    assert [found.token(i) for i in range(0, len(flat), 5)] == flat[::5]
    assert found.bytes_read <= 2 * 69 * len(flat[::5])
    with pytest.raises(IndexError):
        found.token(len(flat))


def local_write(path, coded, segment):
    """What one task writes, in this process, where the segment's size is changed."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Here:
        @staticmethod
        def partitionId():
            return 0

    before, TaskContext.get = TaskContext.get, staticmethod(lambda: Here)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in coded], pa.int64()), pa.array([r["ids"] for r in coded], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        return codes.Writer(path).write(iter([batch.slice(0, 4), batch.slice(4)]))
    finally:
        TaskContext.get = before


def local_read(path):
    reader = codes.Reader(path)
    for part in reader.partitions():
        for batch in reader.read(part):
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "ids")), strict=True)


def test_levels_of_ids_up_to_32_bits(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**32, 5000) >> rng.integers(0, 32, 5000)
    back, keys, ends = codes.unpack(codes.pack(ids, [7, None], [10, 5000]))
    assert back.tolist() == ids.tolist() and keys == [7, None] and ends.tolist() == [10, 5000]
    assert [len(c) for c, _, _ in codes.levels(ids)] == [int((ids >> 8 * k > 0).sum()) if k else 5000 for k in range(4)]


def test_second_attempts_and_failed_writes_leave_nothing_twice(spark):
    path = codes.new_path(spark)
    codes.write(spark.createDataFrame([(1, [5, 300, 2])], "doc_id bigint, ids array<int>"), path)
    codes.write(spark.createDataFrame([(1, [5, 70000, 2])], "doc_id bigint, ids array<int>"), path)  # the folder's manifest is replaced as a whole
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in codes.read(spark, path).collect()] == [[5, 70000, 2]]
    got = codes.tokens_at(spark.createDataFrame([(0,), (1,), (9,), (None,), (-1,)], "p bigint"), path, "p").collect()
    assert [r["token"] for r in got] == [5, 70000, None, None, None]


def test_codes_of_an_empty_table_and_equal_rows(spark):
    path = codes.new_path(spark)
    codes.write(codes.coded(table(spark, DIR, "documents").select("doc_id", "text").limit(0), queries.WORDS, end=2), path)
    assert codes.read(spark, path).count() == 0
    with_more = spark.createDataFrame([(1, "same text", "x", "y")] * 50, "doc_id bigint, text string, ids string, tie string")
    path = codes.new_path(spark)
    codes.write(codes.coded(with_more, queries.WORDS, end=2), path)
    assert sorted(r["start"] for r in codes.read(spark, path).collect()) == [3 * k for k in range(50)]


# ---- 12


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(queries.VOCABULARY)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
        self.chars = byte_chars()

    def of(self, text):
        if not text:
            return None
        s = f" {text}"
        ia, ib = self.a.encode(s, add_special_tokens=False).ids, self.b.encode(text)
        ta = [bytes(self.chars[c] for c in self.a.id_to_token(i)) for i in ia]
        tb = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != s.encode() or b"".join(tb) != s.encode():
            return None
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        links, i, j = [], 0, 0
        while i < len(ia):
            links.append((ia[i], ib[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
        spans, i, j = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            n, m = sum(e <= c for e in ea[i:]), sum(e <= c for e in eb[j:])
            spans.append(",".join(map(str, ia[i : i + n])) + "|" + ",".join(map(str, ib[j : j + m])))
            i, j = i + n, j + m
        return len(ia), len(ib), len(spans), links, ";".join(spans)


def wanted_alignment(pairs):
    plain = Plain()
    found = [(d, plain.of(t)) for d, t in pairs]
    n, most = Counter(p for _, r in found if r for p in set(r[3])), defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    return [(d, 0, 0, 0, 0, 0, 0, None) if r is None else (d, *r[:3], len(r[3]), sum(n[p] == most[p[0]] for p in r[3]), sum(n[p] for p in r[3]), r[4]) for d, r in found]


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", *align.COUNTS, "n_best", "count_sum", "groups")) for r in df.collect()), key=str)


def test_alignment_query_equals_brute_force(spark):
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in wanted_alignment([(d, t if t is None else t) for d, t in rows(spark) if len(t or "") < 20_000])]
    small = table(spark, DIR, "documents").where("coalesce(length(text), 0) < 20000").select("doc_id", "text")
    got = align.align(small, queries.VOCABULARY, queries.PIECES, drop=("text",), hashed=True).withColumn("groups", F.coalesce("groups", F.lit("")))
    assert as_rows(got) == sorted(want, key=str)
    whole = queries.op12_alignment(spark, DIR)
    assert whole.count() == len(rows(spark)) and whole.where("n_links <> n_a + n_b - n_groups").count() == 0


def test_alignment_of_odd_texts_in_blocks_of_any_size(spark, monkeypatch):
    docs = odd(spark)
    want = sorted(wanted_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert as_rows(align.align(docs, queries.VOCABULARY, queries.PIECES)) == want
    assert sum(w[1] == 0 for w in want) == 3  # null, empty, and the text with U+2581


def test_alignment_of_an_empty_table_and_clashing_names(spark):
    assert align.align(odd(spark).limit(0), queries.VOCABULARY, queries.PIECES).count() == 0
    more = odd(spark).select("*", *(F.lit("kept").alias(c) for c in ("block", "row", "codes", "pairs", "home", "_filler", "N_A")))
    got = align.align(more, queries.VOCABULARY, queries.PIECES)
    assert got.where("block = 'kept' AND row = 'kept' AND codes = 'kept' AND pairs = 'kept' AND home = 'kept' AND _filler = 'kept'").count() == len(ODD) + 3
    assert dict(got.dtypes)["n_a"] == "bigint" and "N_A" not in got.columns


def test_labels_name_groups():
    ends, in_a, in_b = align.groups_of(align.labelled(np.array([2, 4, 7]), np.array([1, 4, 5, 7]), 7))
    assert ends.tolist() == [4, 7] and in_a.tolist() == [2, 1] and in_b.tolist() == [2, 2]


# ---- 13

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wanted_variants(pairs, every=199):
    seen = Counter()
    for d, t in pairs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 6 and k >= 5}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if v != w and one_apart(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def found_variants(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def test_variants_query_equals_brute_force(spark):
    assert found_variants(queries.op13_variants(spark, DIR)) == wanted_variants(rows(spark))


@pytest.mark.parametrize("same", [False, True])
def test_variants_of_few_letters(spark, same, monkeypatch):
    """Words over three letters, where almost all are near; with one hash for all keys strings alone decide."""
    if same:
        monkeypatch.setattr(variants, "PRIMES", (1, 1))
    rng = random.Random(5)
    pairs = [(i, " ".join(w for w in ("".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(60)) for _ in range(rng.choice((1, 1, 5, 30, 200))))) for i in range(8)]
    pairs += [(None, None), (None, "aaaaaa AAAAAA aaaaaaa " * 9), (3, ""), (3, "aaaaaaab " * 7)] + [(4, "bbbbbb")] * 6
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = found_variants(variants.group(docs))
    assert got == wanted_variants(pairs) and any(r[3] and r[3] != r[5] for r in got)


def test_variants_of_long_words(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    pairs = [(i, f"{long} " * 6) for i in range(2)] + [(9, (long[:777] + long[778:] + " ") * 70), (10, (long[:-1] + "ÿ ") * 5)]
    got = found_variants(variants.group(spark.createDataFrame(pairs, "doc_id bigint, text string"), every=0))
    assert {(r[1], r[2], len(r[0]), r[3] and len(r[3])) for r in got} == {(12, 2, 20_000, 19_999), (5, 1, 20_000, None), (70, 1, 19_999, None)}


def test_variants_of_an_empty_table(spark):
    out = variants.group(spark.createDataFrame([], T.StructType.fromDDL("doc_id bigint, text string")))
    assert out.count() == 0 and set(out.columns) == {"word", "n", "n_near", "form", "form_n", "root"}


def test_deletion_keys_equal_the_hash_of_what_is_left():
    word = "hèllo wörld"
    points = lambda s: np.array([[ord(c) for c in s]], np.uint32)
    dels, own = variants.deletions(points(word))
    assert [int(k) for k in dels[0]] == [int(variants.deletions(points(word[:i] + word[i + 1 :]))[1][0]) for i in range(len(word))]
    assert int(own[0]) < 1 << 62
