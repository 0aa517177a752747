"""A byte-level convolutional network in numpy for text quality.

Input channels are the bytes of the UTF-8 text and one more, which marks the bytes of a word that equals the word before
it. WIDTH-byte filters (a table of weights per offset, byte and filter) slide over the whole document; their rectified
outputs are max-pooled in overlapping chunks of 2 * STEP bytes at every STEP. The mean and the maximum over the chunks
go into one logistic unit, which gives the document's probability. Trained by Adam on a bounded sample of labelled rows
(`rows`, texts of at most `longest` bytes); scoring reads whole documents of any length.

Null and empty texts are one chunk of zero bytes and so have one fixed score. Scores depend on the text alone, so
repeated rows score alike; an empty table gives an empty one. Without labels of both classes every score is the share
of class 1 (0.5 without labels). Other columns pass through; an input column named as the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import replaced, schema_with, slices

WIDTH, FILTERS, STEP = 6, 16, 128
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, 0])
#: Odd multipliers for hashing words; bytes beyond the table's length share them in turn.
_RNG = np.random.default_rng(5)
MULTIPLY = _RNG.integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
OF_BYTE = _RNG.integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each with WIDTH zero bytes at least after it and in whole steps; the first step of each."""
    steps = np.array([(len(t) + WIDTH) // STEP + 1 for t in texts])
    flat = b"".join(t.ljust(n * STEP, b"\0") for t, n in zip(texts, steps, strict=True))
    return np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum(steps)])


def repeats(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 on bytes of words that equal the word before them in the same text."""
    inside = ~BLANK[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(b), np.float32)
    if len(start) < 2:
        return out
    lengths = end - start
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h = np.add.reduceat(OF_BYTE[b[at]] * MULTIPLY[place & 63], np.cumsum(lengths) - lengths)
    text = np.searchsorted(first * STEP, start, side="right")
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (lengths[1:] == lengths[:-1]) & (text[1:] == text[:-1])])
    out[at[np.repeat(same, lengths)]] = 1
    return out


def tables(p: dict) -> dict:
    """p with the weights of two neighbouring offsets summed for every pair of bytes, which halves the look-ups."""
    w = p.get("bytes")
    return p if w is None else p | {"pairs": [(w[j][:, None] + w[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]}


def blocks(p: dict, b: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each step, and where. Windows that start in a text's padding and reach into the next text respond like those of zero bytes, with 0."""
    n, span = len(b) // STEP, 32
    final = np.zeros(n, bool)
    final[first[1:] - 1] = True
    r, tail = repeats(b, first), np.concatenate([b, np.zeros(WIDTH + 1, np.uint8)]).astype(np.intp)
    pairs = p.get("pairs")
    index = (tail[:-1] << 8) | tail[1:] if pairs else tail
    weights, hop = (pairs, 2) if pairs else (p["bytes"], 1)
    best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
    sums, part = np.empty((span * STEP, FILTERS), np.float32), np.empty((span * STEP, FILTERS), np.float32)
    for k in range(0, n, span):
        s, e = k * STEP, min(n, k + span) * STEP
        z, y = sums[: e - s], part[: e - s]
        np.take(weights[0], index[s:e], axis=0, out=z, mode="clip")
        for j in range(1, WIDTH // hop):
            np.take(weights[j], index[s + j * hop : e + j * hop], axis=0, out=y, mode="clip")
            np.add(z, y, out=z)
        if r[s:e].any():
            z += r[s:e, None] * p["repeat"]
        z = z.reshape(-1, STEP, FILTERS)
        z[final[k : k + span], STEP - WIDTH + 1 :] = 0
        if places:
            where[k : k + span] = z.argmax(1) + np.arange(s, e, STEP)[:, None]
        half = STEP
        while half > 1:
            half //= 2
            z = np.maximum(z[:, :half], z[:, half : 2 * half])
        best[k : k + span] = z[:, 0]
    return best, where


def pooled(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which step holds each chunk's largest response; chunk k of a document spans its steps k and k + 1."""
    n = len(best)
    after = np.minimum(np.arange(n) + 1, n - 1)
    after[first[1:] - 1] = first[1:] - 1
    take = np.where(best[after] > best, after[:, None], np.arange(n)[:, None])
    chunk = np.maximum(np.take_along_axis(best, take, 0), 0)
    sizes = np.diff(first)
    mean = np.add.reduceat(chunk, first[:-1]) / sizes[:, None]
    top = np.maximum.reduceat(chunk, first[:-1])
    return np.hstack([mean, top]), chunk, take


def score(p: dict, texts: list[str | bytes | None]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    if "constant" in p:
        return np.full(len(texts), p["constant"])
    b, first = layout([t.encode("utf8", "replace") if isinstance(t, str) else t or b"" for t in texts])
    x, _, _ = pooled(blocks(p, b, first)[0] + p["bias"], first)
    # one text after the other in double precision, so that a score does not depend on the texts beside it
    return 1 / (1 + np.exp(-np.clip((x.astype(float) * p["out"]).sum(1) + p["out_bias"], -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 3) -> dict:
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    p = {"bytes": rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), "repeat": rng.normal(0, 2, FILTERS).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
    p["bytes"][:, 0] = 0
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    data = [t.encode("utf8", "replace") for t in texts]
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            b, first = layout([data[i] for i in ids])
            best, where = blocks(p, b, first, places=True)
            x, chunk, take = pooled(best + p["bias"], first)
            q = 1 / (1 + np.exp(-np.clip(x @ p["out"] + p["out_bias"], -30, 30)))
            dz = ((q - y[ids]) / len(ids)).astype(np.float32)
            dx = dz[:, None] * p["out"]
            sizes, doc = np.diff(first), np.repeat(np.arange(len(ids)), np.diff(first))
            d = (dx[:, :FILTERS] / sizes[:, None])[doc]
            top = x[:, FILTERS:][doc] == chunk
            d += dx[:, FILTERS:][doc] * top / np.maximum(np.add.reduceat(top, first[:-1], dtype=np.int64), 1)[doc]
            d *= chunk > 0
            g = {"out": x.T @ dz + 1e-4 * p["out"], "out_bias": dz.sum(keepdims=True), "bias": d.sum(0), "bytes": np.zeros_like(p["bytes"])}
            spot = np.take_along_axis(where, take, 0)
            tail, r, f = np.concatenate([b, np.zeros(WIDTH, np.uint8)]), repeats(b, first), np.broadcast_to(np.arange(FILTERS), spot.shape)
            for j in range(WIDTH):
                np.add.at(g["bytes"][j], (tail[spot + j], f), d)
            g["bytes"][:, 0] = 0
            g["repeat"] = (d * r[spot]).sum(0)
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def classify(df: DataFrame, model: dict, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the model's probability of class 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = tables(model)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                yield replaced(part, {out: pa.array(score(ready, part.column(text).to_pylist()).astype(float))}, drop)

    return df.mapInArrow(run, schema_with(df, f"`{out}` double", drop))
