"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Filters of `WIDTH` bytes (each a learned table of byte value
by place, which is an embedding and a convolution in one) slide over every chunk; rectified responses are max-pooled over the chunk. The
chunks' pooled features are combined by their maximum, mean and minimum over the document, and one hidden layer gives one probability.

Rows: one per input row. Null and empty texts are one chunk of padding and get the model's score of it. Labels of null are left out of
training; of several labels for an id the highest counts. With no labels, or only one kind, every score is 0.5. Texts of any length are trained on
and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_of_texts, groups_of, release_memory
from .toxicity import labelled_sample

#: Bytes of a chunk, bytes that two chunks share, filter width, step between filter places, filters, hidden units.
CHUNK, OVERLAP, WIDTH, STEP, FILTERS, HIDDEN = 1024, 128, 8, 2, 24, 24
#: Labelled documents that training reads at most (the first by a hash of their id).
MOST_LABELLED = 3000
#: Bytes of text handled at once.
BLOCK = 1 << 18
PLACES = (CHUNK - WIDTH) // STEP + 1


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks by CHUNK bytes, padded by byte 0; document of each chunk). The last chunk ends where the text ends."""
    rows, doc = [], []
    for d, t in enumerate(texts):
        starts = range(0, max(1, len(t) - OVERLAP), CHUNK - OVERLAP)
        for s in starts:
            rows.append(t[s : s + CHUNK].ljust(CHUNK, b"\0"))
            doc.append(d)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, CHUNK), np.array(doc)


def responses(chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Filter responses: chunk, place, filter."""
    out = np.zeros((len(chunks), PLACES, tables.shape[2]), np.float32)
    for k in range(WIDTH):
        out += tables[k][chunks[:, k : k + (PLACES - 1) * STEP + 1 : STEP]]
    return out


def pooled(chunks: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(max over the places, where it is)."""
    r = responses(chunks, p["tables"])
    at = r.argmax(1)
    return np.take_along_axis(r, at[:, None, :], 1)[:, 0] + p["bias"], at


def combine(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Maximum, mean and minimum of the chunks' features by document; doc is sorted and has no gaps."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))[:, None]
    return np.concatenate([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / count, np.minimum.reduceat(h, first)], 1)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 5) -> dict:
    """Adam on the log-loss, classes weighted evenly; gradients reach the tables at the places that won the max."""
    rng = np.random.default_rng(seed)
    p = {"tables": (rng.normal(0, 0.25, (WIDTH, 256, FILTERS))).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "w1": rng.normal(0, 0.12, (3 * FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, 0.2, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}
    if not len(texts) or labels.min() == labels.max():
        return {"tables": None}
    # byte classes start alike, so that rare bytes behave as their kind does
    kind = np.array([0 if b in (9, 10, 13, 32) else 1 if 65 <= b < 91 else 2 if 97 <= b < 123 else 3 if 48 <= b < 58 else 4 if b >= 128 else 5 if b else 6 for b in range(256)])
    p["tables"] = p["tables"] * 0.4 + rng.normal(0, 0.3, (WIDTH, 7, FILTERS)).astype(np.float32)[:, kind]
    y = labels.astype(np.float32)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, steps = 0, max(300, epochs * -(-len(texts) // batch))
    order = np.zeros(0, np.int64)
    while step < steps:
        if len(order) < min(batch, len(texts)):
            order = rng.permutation(len(texts))
        take, order = order[:batch], order[batch:]
        chunks, doc = chunks_of([texts[i] for i in take])
        runs = [pooled(chunks[i : i + 64], p) for i in range(0, len(chunks), 64)]
        raw, at = (np.concatenate(x) for x in zip(*runs, strict=True))
        h = np.maximum(raw, 0)
        f = combine(h, doc)
        a1 = np.maximum(f @ p["w1"] + p["b1"], 0)
        prob = 1 / (1 + np.exp(-(a1 @ p["w2"] + p["b2"])))
        g = (prob - y[take]) * weight[take] / len(take)
        grad = {"w2": a1.T @ g, "b2": g.sum(keepdims=True)}
        ga = np.outer(g, p["w2"]) * (a1 > 0)
        grad |= {"w1": f.T @ ga, "b1": ga.sum(0)}
        gf = ga @ p["w1"].T
        count = np.bincount(doc)[doc][:, None]
        top, low = f[doc, :FILTERS] == h, f[doc, 2 * FILTERS :] == h
        gh = (gf[doc, :FILTERS] * top + gf[doc, FILTERS : 2 * FILTERS] / count + gf[doc, 2 * FILTERS :] * low) * (raw > 0)
        grad["bias"] = gh.sum(0)
        gt = np.zeros_like(p["tables"])
        rows, cols = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
        for k in range(WIDTH):
            np.add.at(gt[k], (chunks[rows, at * STEP + k], np.broadcast_to(cols, at.shape)), gh)
        grad["tables"] = gt
        step += 1
        lr = rate * min(1, step / 50) * (0.1 + 0.9 * (1 - step / steps))
        for k, x in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def score_texts(texts: list[bytes], p: dict) -> np.ndarray:
    if p["tables"] is None:
        return np.full(len(texts), 0.5)
    out = np.zeros(len(texts))
    for a, b in groups_of([len(t) + CHUNK for t in texts], BLOCK):
        # one very long text is read in runs of chunks; the combination is of all its chunks
        chunks, doc = chunks_of(texts[a:b])
        h = np.concatenate([np.maximum(pooled(chunks[i : i + 64], p)[0], 0) for i in range(0, len(chunks), 64)])
        a1 = np.maximum(combine(h, doc) @ p["w1"] + p["b1"], 0)
        out[a:b] = 1 / (1 + np.exp(-np.clip(a1 @ p["w2"] + p["b2"], -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most: int = MOST_LABELLED) -> dict:
    """Train on at most `most` labelled documents for whose id `usable` (over the column id) holds."""
    return train(*labelled_sample(docs, labels, id_col, text_col, label_col, usable, most))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """id_col (with keep: all columns; score_col must be none of them) and the score, as the column score_col."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.2 MB whatever the input

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = [score_texts(own, shared.value) for _, _, own in blocks_of_texts(texts, BLOCK)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))
        release_memory()

    columns = [F.col(f"`{c}`") for c in docs.columns] if keep else [F.col(id_col)]
    return docs.select(*columns, score(F.col(text_col).cast("string").cast("binary")).alias(score_col))
