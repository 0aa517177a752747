"""Language identification of words by a linear-chain conditional random field.

All words of a text (runs of letters, lower-cased) form one chain. A word's features are its first and last letters, its
letter trigrams and, if it is in the lexicon of frequent training words, itself; each has a weight per language.
Transitions between neighbouring words' languages are learned with them, by gradient ascent on the likelihood with
forward-backward; so that changes of language occur in training, runs of words of labelled texts are also spliced
together (`splices` of them for each text). `label_words` gives the posterior of every word, for code-switched text; a
document's language is the one with the largest mean posterior, and that mean is its score.

Forward-backward runs over spans of SPAN words side by side: the product of a span's matrices carries messages over it,
so messages reach from one end of a text to the other and posteriors are those of the whole chain.

A null text and one without a letter have language `und`, score 0 and no word labels; so has every text if there is
nothing to learn from. Scores depend on the text alone, repeated rows score alike, ties go to the first language in code
point order, an empty table gives an empty one, and very long texts are read whole. Other columns pass through; input
columns named as an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import replaced, schema_with, slices

#: Words are letters with the marks on them. Texts within Latin-1, which has no marks, take the faster rule.
WORDS, LATIN = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")
SPAN, BUCKETS, MEMO = 64, 1 << 16, 500_000
UNKNOWN = "und"


def rule(text: str) -> re.Pattern:
    return LATIN if text.isascii() or max(text, default="") <= "\xff" else WORDS


def words_of(text: str) -> list[str]:
    return rule(text).findall(text)


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Hashed features of a word, whatever its length."""
    w = f"^{word}$"
    found = {"p" + w[:n] for n in (2, 3, 4)} | {"s" + w[-n:] for n in (2, 3, 4)} | {"g" + w[i : i + 3] for i in range(len(w) - 2)}
    if word in lexicon:
        found.add("w" + word)
    return sorted({zlib.crc32(f.encode("utf8", "replace")) % BUCKETS for f in found})


def sequences(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How texts of so many words fall into sequences: start of each, its length, its text."""
    n = -(-lengths // SPAN)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(lengths) - lengths, n) + k * SPAN
    return start, np.minimum(SPAN, lengths[doc] - k * SPAN), doc


def messages(x: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each span from the words before it in its text (weights of its first word's labels) and from those after it (of its last word's)."""
    k = x.shape[1]
    ahead, behind = np.ones((len(start), k), x.dtype), np.ones((len(start), k), x.dtype)
    follows = np.zeros(len(start), bool)
    follows[1:] = doc[1:] == doc[:-1]
    goes_on = np.append(follows[1:], False)
    chained = np.flatnonzero(follows | goes_on)
    if not len(chained):
        return ahead, behind
    s, z = start[chained], size[chained]
    through = np.zeros((len(chained), k, k), x.dtype)
    through[:, np.arange(k), np.arange(k)] = x[s]
    for t in range(1, int(z.max())):
        on = np.flatnonzero(z > t)
        step = (through[on].reshape(-1, k) @ a).reshape(-1, k, k) * x[s[on] + t][:, None, :]
        through[on] = step / step.sum((1, 2), keepdims=True)
    place = np.full(len(start), -1)
    place[chained] = np.arange(len(chained))
    # spans by their number in the text, so that all texts take a step together
    first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(start))))
    number = np.arange(len(start)) - first
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(int(number.max()) + 2))
    for i in range(1, int(number.max()) + 1):
        at = order[cuts[i] : cuts[i + 1]]
        m = np.einsum("nk,nkl->nl", ahead[at - 1], through[place[at - 1]]) @ a
        ahead[at] = m / m.sum(1, keepdims=True)
    for i in range(int(number.max()), 0, -1):
        at = order[cuts[i] : cuts[i + 1]]
        m = np.einsum("nkl,nl->nk", through[place[at]], behind[at]) @ a.T
        behind[at - 1] = m / m.sum(1, keepdims=True)
    return ahead, behind


def marginals(e: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, pairs: bool = False, doc: np.ndarray | None = None):
    """Posterior of each word's label from emissions e (words, labels), by forward-backward over all spans at once; with pairs also the expected transitions. doc: the text of each span, in order; spans of one text are one chain (without it, each is a text)."""
    x = np.exp(e - e.max(1, keepdims=True))
    a = np.exp(trans)
    doc = np.arange(len(start)) if doc is None else doc
    ahead, behind = messages(x, start, size, doc, a)
    order = np.argsort(-size, kind="stable")  # longest first: those that go on are always a prefix
    start, size, ahead, back = start[order], size[order], ahead[order], behind[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    forward, out = np.empty_like(x), np.empty_like(x)
    for t in range(longest):
        at = start[: live[t]] + t
        f = ahead * x[at] if t == 0 else (forward[at - 1] @ a) * x[at]
        forward[at] = f / f.sum(1, keepdims=True)
    both = np.zeros_like(a)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        post = forward[at] * back[:n]
        out[at] = post / post.sum(1, keepdims=True)
        if t:
            b = x[at] * back[:n]
            if pairs:
                joint = forward[at - 1][:, :, None] * a * b[:, None, :]
                both += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = b @ a.T
            back[:n] = b / b.sum(1, keepdims=True)
    return (out, both) if pairs else out


def spliced(docs: list[list[str]], labels: np.ndarray, n: int, rng: np.random.Generator) -> tuple[list[list[str]], list[np.ndarray]]:
    """n chains of runs of 3 to 24 words from labelled texts, and the label of each word."""
    full = [i for i, d in enumerate(docs) if d]
    words, golds = [], []
    for _ in range(n if full else 0):
        chain, gold = [], []
        while len(chain) < SPAN:
            i = full[rng.integers(len(full))]
            run, at = int(rng.integers(3, 25)), int(rng.integers(max(1, len(docs[i]) - 24)))
            part = docs[i][at : at + run]
            chain += part
            gold += [labels[i]] * len(part)
        words.append(chain[:SPAN])
        golds.append(np.array(gold[:SPAN], np.int64))
    return words, golds


def train(texts: list[str], labels: list[str], rounds: int = 6, batch: int = 128, rate: float = 0.15, seed: int = 9, splices: float = 1.0) -> dict:
    """Every word of a training text carries the text's label. Chains are fitted in spans of SPAN words."""
    langs = sorted(set(labels))
    if not langs:
        return {"langs": []}
    rng = np.random.default_rng(seed)
    docs = [words_of(t.lower()) for t in texts]
    y = np.array([langs.index(g) for g in labels], np.int64)
    seen = Counter(w for d in docs for w in set(d))
    lexicon = frozenset(w for w, n in seen.items() if n >= 3)
    types = {w: i for i, w in enumerate(seen)}
    feats = [features(w, lexicon) for w in types]
    width = max(map(len, feats), default=1)
    table = np.full((len(feats), width), BUCKETS)
    for i, f in enumerate(feats):
        table[i, : len(f)] = f
    more, golds = spliced(docs, y, int(splices * len(docs)) if len(langs) > 1 else 0, rng)
    gold = np.concatenate([np.repeat(y, [len(d) for d in docs]), *golds])
    docs = docs + more
    words = np.array([types[w] for d in docs for w in d], np.int64)
    start, size, _ = sequences(np.array([len(d) for d in docs], np.int64))
    w, trans = np.zeros((BUCKETS + 1, len(langs)), np.float32), np.zeros((len(langs), len(langs)), np.float32)
    gw, gt = np.full_like(w, 1e-3), np.full_like(trans, 1e-3)
    for _ in range(rounds):
        order = rng.permutation(len(start))
        for k in range(0, len(order), batch):
            s = order[k : k + batch]
            at = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in s])
            first = np.cumsum(size[s]) - size[s]
            f = table[words[at]]
            e = w[f].sum(1)
            post, both = marginals(e, first, size[s], trans, pairs=True)
            d = -post
            d[np.arange(len(d)), gold[at]] += 1
            d /= len(at) / 16
            g = np.zeros_like(w)
            for c in range(len(langs)):
                g[:, c] = np.bincount(f.ravel(), np.repeat(d[:, c], width), BUCKETS + 1)
            g -= 1e-4 * w
            g[BUCKETS] = 0
            t, inner = -both, np.ones(len(at), bool)
            inner[first] = False  # a span's first word follows none of the span
            inner = np.flatnonzero(inner)
            np.add.at(t, (gold[at[inner - 1]], gold[at[inner]]), 1)
            t = t / (len(at) / 16) - 1e-2 * trans
            gw += g * g
            gt += t * t
            w += rate * g / np.sqrt(gw)
            trans += rate * t / np.sqrt(gt)
    return {"langs": langs, "weights": w, "trans": np.clip(trans, -6, 6), "lexicon": lexicon}


class Labeller(dict):
    """word -> the row of its emissions."""

    def __init__(self, model: dict):
        self.model, self.n = model, len(model["langs"])
        self.rows = array("f")

    def __missing__(self, word: str) -> int:
        self.rows.extend(self.model["weights"][features(word, self.model["lexicon"])].sum(0).tolist())
        self[word] = k = len(self.rows) // self.n - 1
        return k

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of all words of all texts, and how many each text has."""
        if len(self) > MEMO:
            self.clear()
            self.rows = array("f")
        index, lengths = array("q"), []
        for t in texts:
            before = len(index)
            if t:
                index.extend(map(self.__getitem__, words_of(t.lower())))
            lengths.append(len(index) - before)
        sizes = np.array(lengths, np.int64)
        if not len(index):
            return np.empty((0, self.n), np.float32), sizes
        e = np.frombuffer(self.rows, np.float32).reshape(-1, self.n)[np.frombuffer(index, np.int64)]
        start, size, doc = sequences(sizes)
        return marginals(e, start, size, self.model["trans"], doc=doc), sizes


def predict(df: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred", score: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with each text's language and its score. The model goes along as a broadcast of BUCKETS weights per language and the lexicon of a bounded sample."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, labeller = held.value["langs"], None
        if langs:
            labeller = Labeller(held.value)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if labeller is not None:
                    post, sizes = labeller.posteriors(part.column(text).to_pylist())
                    has = np.flatnonzero(sizes)
                    if len(has):
                        mean = np.add.reduceat(post.astype(float), (np.cumsum(sizes) - sizes)[has]) / sizes[has][:, None]
                        best = mean.argmax(1)
                        scores[has] = np.clip(mean[np.arange(len(has)), best], 0, 1)
                        for i, b in zip(has, best, strict=True):
                            names[i] = langs[b]
                yield replaced(part, {lang: pa.array(names), score: pa.array(scores)}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{lang}` string; `{score}` double", drop))


def label_words(df: DataFrame, model: dict, text: str = "text", out: str = "words", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with every word of a text, its start (in characters), language and posterior; for code-switched text."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int64()), ("lang", pa.string()), ("p", pa.float64())]))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = held.value["langs"]
        labeller = Labeller(held.value) if langs else None
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                rows = []
                for t in part.column(text).to_pylist():
                    low = (t or "").lower()
                    post = labeller.posteriors([t])[0] if labeller is not None else []
                    rows.append([{"word": m[0], "start": m.start(), "lang": langs[p.argmax()], "p": float(p.max())} for m, p in zip(rule(low).finditer(low), post, strict=False)])
                yield replaced(part, {out: pa.array(rows, kind)}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{out}` array<struct<word:string,start:bigint,lang:string,p:double>>", drop))
