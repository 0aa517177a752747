"""Toxicity through a noisy channel.

A character language model (ORDER letters, counted over every document) says which letters are likely; tokens that may
be disguised - with a digit or sign that resembles a letter at any place, a letter twice or more in a row, a gap between
letters, or single letters with gaps - become lattices, in which a sign may stand for the letters it resembles, a run of
a letter for one or two of it, a gap for nothing or a word's end. The Viterbi path through the lattice, of any length and
over all states, is the restored word. Restored and plain words, and the first letters of each, are the
features of a logistic model fitted on a bounded sample of labelled rows (`rows`).

Null and empty texts have no features and so the score of the intercept. Texts of any length are read whole; scores
depend on the text alone, so repeated rows score alike, and an empty table gives an empty one. Without labels of both
classes every score is the share of class 1 (0.5 without labels). Other columns pass through; an input column named as
the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, schema_with, slices

ORDER, LETTERS = 4, 28
CONTEXTS = LETTERS ** (ORDER - 1)
#: What a sign may stand for, besides itself.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h"}
#: Costs (nats) of reading a sign as a letter, of dropping a gap, of shortening a run.
SIGN, GAP, RUN = 1.0, 0.5, 0.5
SIGNS = re.escape("".join(LOOKS))
DISGUISED = re.compile(rf"[{SIGNS}]|([^\W\d_])\1|[^\W\d_][\W\d_]+[^\W\d_]")
SPACED = re.compile(rf"(?<![\w{SIGNS}])[\w{SIGNS}](?:[ .\-_]{{1,2}}[\w{SIGNS}]){{3,}}(?![\w{SIGNS}])")
PLAIN = re.compile(r"[^\W\d_]+")
OPENS, ENDS = "\"'([{<-_", ".,;:!?\"'()[]{}&%#$*|<>-_"
MARKS = "".join(c for c in ENDS if c not in LOOKS)
PREFIXES, MEMO = (4, 5, 6, 7, 8), 500_000

_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[[*range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 27


#: Doubled letters, and whether two of them stand too near each other to be read one by one.
DOUBLED, NEAR = re.compile(r"([^\W\d_])\1+"), re.compile(r"([^\W\d_])\1+[^\W\d_]{0,2}([^\W\d_])\2")


def code(c: str) -> int:
    """1 to 26 for a to z, 27 for any other letter, 0 for what bounds words."""
    n = ord(c)
    return int(_CODE[n]) if n < 256 else 27 * c.isalpha()


def codes(text: str) -> np.ndarray:
    """The code of every character."""
    try:
        return _CODE[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kinds, which = np.unique(points, return_inverse=True)
        return np.array([code(chr(k)) for k in kinds], np.int64)[which]


def grams(texts: Iterator[str | None]) -> np.ndarray:
    """How often each run of ORDER letters occurs; anything else is a boundary."""
    total = np.zeros(LETTERS**ORDER, np.int64)
    for t in texts:
        if t:
            c = np.concatenate([np.zeros(ORDER - 1, np.int64), codes(t.lower()), np.zeros(1, np.int64)])
            at = c[: len(c) - ORDER + 1].copy()
            for k in range(1, ORDER):
                at = at * LETTERS + c[k : len(c) - ORDER + 1 + k]
            total += np.bincount(at, minlength=len(total))
    return total


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts over every text; at most LETTERS ** ORDER of them, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**ORDER, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                # a boundary between texts keeps runs from crossing
                total += grams(iter(["\n\n\n\n".join(t or "" for t in part.column(text).to_pylist())]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    summed = docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LETTERS**ORDER, np.int64)
    out[summed["gram"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


class Channel:
    """The language model's costs and the decoder."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape((LETTERS,) * ORDER).astype(float)
        levels = [c]
        for _ in range(ORDER - 1):
            levels.insert(0, levels[0].sum(0))
        p = (levels[0] + 1) / (levels[0].sum() + LETTERS)
        for level in levels[1:]:  # each order leans on the one below where it has seen little
            p = (level + 5 * p) / (level.sum(-1, keepdims=True) + 5)
        self.cost = (-np.log(p)).reshape(-1).astype(np.float32).tolist()

    def doubled(self, token: str) -> str:
        """`restore` for letters alone whose doubled ones have three others between them: after three letters all paths have joined, so each is decided for itself."""
        out, at = [], 0
        for m in DOUBLED.finditer(token):
            i, j, c = m.start(), m.end(), m[1]
            k = 0
            for x in token[max(0, i - ORDER + 1) : i]:
                k = k * LETTERS + code(x)
            after = [code(x) for x in token[j : j + ORDER - 1]]
            if len(after) < ORDER - 1:
                after.append(0)
            price, x = [RUN, RUN if j - i > 2 else 0.0], code(c)
            for copies in (1, 2):
                key = k
                for y in [x] * copies + after:
                    key = key * LETTERS + y
                    price[copies - 1] += self.cost[key]
                    key %= CONTEXTS
            out.append(token[at:i] + (c if price[0] <= price[1] else c + c))
            at = j
        return "".join(out) + token[at:]

    def restore(self, token: str) -> str:
        """The likeliest words behind a disguised token, with blanks between them."""
        if token.isalpha() and not NEAR.search(token):
            return self.doubled(token)
        return self.path(token)

    def path(self, token: str) -> str:
        """The Viterbi path through the token's lattice."""
        s, n = token, len(token)
        # by position and last letters: the cost and the way back; a way all others have joined is written out
        states, done = {0: {0: (0.0, None)}}, []
        for i in range(n):
            here = states.pop(i, {})
            if not here:
                continue
            if len(here) == 1 and not states:
                ((key, (cost, way)),) = here.items()
                done.append(spell(way))
                here = {key: (cost, None)}
            c, j = s[i], i + 1
            while j < n and s[j] == c:
                j += 1
            if c.isalpha():
                edges = [(j, c, 0.0)] if j - i == 1 else [(j, c, RUN), (j, c + c, RUN if j - i > 2 else 0.0)]
            elif c in LOOKS:
                edges = [(j, x * k, SIGN) for x in LOOKS[c] for k in (1, 2)[: j - i]] + [(j, " ", 2 * SIGN), (j, "", 3 * SIGN)]
            else:
                edges = [(j, "", GAP), (j, " ", 2 * GAP)]
            edges = [(states.setdefault(to, {}), letters, [code(x) for x in letters], price) for to, letters, price in edges]
            for key, (cost, way) in here.items():
                for to, letters, codes, price in edges:
                    k, total = key, cost + price
                    for x in codes:
                        k = k * LETTERS + x
                        total += self.cost[k]
                        k %= CONTEXTS
                    old = to.get(k)
                    if old is None or total < old[0]:
                        to[k] = (total, (way, letters))
        ends = [(cost + self.cost[k * LETTERS], k) for k, (cost, _) in states.get(n, {}).items()]
        return " ".join(("".join(done) + spell(states[n][min(ends)[1]][1])).split()) if ends else token


def spell(way: tuple | None) -> str:
    out = []
    while way:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


def features(word: str) -> set[str]:
    return {word} | {word[:n] for n in PREFIXES if len(word) > n}


def cores(token: str) -> set[str]:
    """What of a token to decode: it without the marks around it, and with those that may stand for letters."""
    found = {token.rstrip(ENDS).lstrip(OPENS), token.strip(MARKS)}
    return {c for c in found if DISGUISED.search(c)}


class Reader:
    """The features of texts; what a token yields is remembered."""

    def __init__(self, channel: Channel, known: dict[str, int] | None = None):
        self.channel, self.known, self.memo = channel, known, {}
        #: No feature of a word is known unless its first letters begin a known one.
        self.heads = None if known is None else {f[: PREFIXES[0]] for f in known}

    def of(self, token: str) -> tuple:
        got = self.memo.get(token)
        if got is None:
            words = PLAIN.findall(token)
            for core in cores(token):
                words += self.channel.restore(core).split()
            if self.heads is None:
                got = tuple(sorted(set().union(*map(features, words), set())))
            else:
                got = tuple(sorted({self.known[f] for w in words if w[: PREFIXES[0]] in self.heads for f in features(w) if f in self.known}))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = got
        return got

    def text(self, text: str | None) -> set:
        if not text:
            return set()
        low = text.lower()
        out: set = set()
        for token in set(low.split()):
            if got := self.of(token):
                out.update(got)
        for m in SPACED.finditer(low):
            for word in self.channel.restore(m[0]).split():
                out.update(self.of(word))
        return out


def restored(text: str, channel: Channel) -> str:
    """The text with its disguised tokens restored; tokens without a letter stay the numbers or marks they are."""
    low = SPACED.sub(lambda m: channel.restore(m[0]), text.lower())

    def read(m: re.Match) -> str:
        core = m[0].strip(MARKS)
        if not PLAIN.search(core) or not cores(core):
            return m[0]
        at = m[0].index(core)
        return m[0][:at] + channel.restore(core) + m[0][at + len(core) :]

    return re.sub(r"\S+", read, low)


def train(counts: np.ndarray, texts: list[str], labels: list[int], most: int = 600, rounds: int = 400, seed: int = 5) -> dict:
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    channel = Channel(counts)
    reader = Reader(channel)
    toxic = [reader.text(t) for t, k in zip(texts, y, strict=True) if k]
    hits, n1, n0 = Counter(f for b in toxic for f in b), y.sum(), (1 - y).sum()
    hits = {f: a for f, a in hits.items() if a >= 4}
    reader = Reader(channel, {f: f for f in hits})
    bags = [reader.text(t) for t in texts]
    other = Counter(f for b, k in zip(bags, y, strict=True) if not k for f in b)
    gain = {f: a * math.log((a + 0.5) / n1 * n0 / (other[f] + 0.5)) for f, a in hits.items() if a / n1 > 10 * other[f] / n0}
    chosen = sorted((f for f in gain if gain[f] > 12), key=lambda f: (-gain[f], f))[:most]
    known = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(y), len(chosen)), np.float32)
    for i, b in enumerate(bags):
        x[i, [known[f] for f in b if f in known]] = 1
    # copies with features left out, so that each feature also learns to speak alone
    rng, some = np.random.default_rng(seed), np.flatnonzero(x.any(1))
    thin = [x[some] * (rng.random((len(some), len(chosen))) < share) for share in (0.5, 0.25, 0.12)]
    left = [t.any(1) for t in thin]
    x, y = np.vstack([x, *(t[k] for t, k in zip(thin, left, strict=True))]).astype(np.float32), np.concatenate([y, *(y[some][k] for k in left)])
    w, bias = np.zeros(len(chosen), np.float32), float(math.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        g, gb = x.T @ e / len(y) + 1e-5 * w, float(e.mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8), 0)
        bias -= 0.05 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return {"counts": counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64), "known": {f: i for f, i in known.items() if w[i] > 0}, "weights": w, "bias": bias}


def scorer(model: dict):
    if "constant" in model:
        return lambda text: model["constant"]
    reader, w, bias = Reader(Channel(model["counts"]), model["known"]), model["weights"].tolist(), model["bias"]
    return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(w[i] for i in sorted(reader.text(text)))))))


def classify(df: DataFrame, model: dict, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the model's probability of class 1. The model goes along as a broadcast of at most LETTERS ** ORDER counts and `most` weights."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(held.value)
        for batch in batches:
            for part in slices(batch, text):
                yield replaced(part, {out: pa.array([score(t) for t in part.column(text).to_pylist()], pa.float64())}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{out}` double", drop))
