"""Toxicity by multiple-instance learning: only documents carry labels, sentences are the instances.

A sentence's score is a logistic function of its hashed words; a document's is the noisy-or of its sentences', 1 - prod(1 - p). Training
takes the gradient of the document's log-likelihood through the noisy-or, so the sentences that explain a label gain weight. Scoring gives
the document's probability and the sentences at or above a threshold.

Rows: one per input row. Null and empty texts have no sentence and score the model's prior of an empty text (0). Labels of null are left
out of training; of several labels for an id the highest counts. Without any labels the model is empty and every score 0. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, groups_of, span_hashes, utf8

BUCKETS = 1 << 20
#: Labelled documents that training reads at most (the first by a hash of their id).
MOST_LABELLED = 12000
#: Bytes of text handled at once.
BLOCK = 1 << 19
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass
class Instances:
    """Words of sentences: bucket and sentence of each word; first and last byte (in the block) and document of each sentence."""

    bucket: np.ndarray
    sentence: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def instances(texts: list[bytes]) -> tuple[Instances, np.ndarray]:
    w = Words(texts)
    n = len(w.start)
    if not n:
        z = np.zeros(0, np.int64)
        return Instances(z, z, z, z, z), w.base
    ends = _STOP[w.raw[w.end - 1]]
    lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
    new = np.ones(n, bool)
    new[1:] = ends[:-1] | (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.text[1:] != w.text[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (start < end) & _PUNCT[w.raw[np.minimum(start, len(w.raw) - 1)]]
        end -= (start < end) & _PUNCT[w.raw[np.maximum(end - 1, 0)]]
    some = np.flatnonzero(start < end)
    bucket = (span_hashes(w.raw, start[some], end[some]) >> np.uint64(44)).astype(np.int64)
    return Instances(bucket, sentence[some], w.start[first], w.end[np.append(first[1:], n) - 1], w.text[first]), w.base


def sentence_logits(x: Instances, weight: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.bincount(x.sentence, weight[x.bucket], len(x.doc))


def noisy_or(logits: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(log of prod(1 - p) of each document, p of each sentence)."""
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    return np.bincount(doc, -np.logaddexp(0, np.clip(logits, -30, 30)), docs), p


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 120, rate: float = 0.5, l1: float = 0.01, least: int = 4) -> dict:
    """Weights by bucket of words in at least `least` training documents. Full-batch gradient, momentum and an L1 shrink."""
    if not len(texts) or labels.min() == labels.max():
        return {"weight": np.zeros(BUCKETS, np.float32), "bias": -30.0}
    y, docs = labels.astype(float), len(texts)
    positive = max(1.0, y.sum())
    sentence, bucket, owner, many = [], [], [], 0
    df, of_positive = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for a, b in groups_of([len(t) for t in texts], BLOCK):
        x, _ = instances(texts[a:b])
        pair = np.unique(x.sentence * BUCKETS + x.bucket)  # a word counts once a sentence
        sentence.append((pair // BUCKETS + many).astype(np.int32))
        bucket.append((pair % BUCKETS).astype(np.int32))
        owner.append((x.doc + a).astype(np.int32))
        pair = np.unique((x.doc[pair // BUCKETS] + a) * BUCKETS + pair % BUCKETS)  # and here once a document
        df += np.bincount(pair % BUCKETS, minlength=BUCKETS)
        of_positive += np.bincount(pair % BUCKETS, y[pair // BUCKETS], BUCKETS)
        many += len(x.doc)
    sentence, bucket, owner = np.concatenate(sentence), np.concatenate(bucket), np.concatenate(owner)
    odds = np.log((of_positive + 0.5) / (df - of_positive + 0.5)) - np.log(positive / (docs - positive))
    usable = (df >= least) & (odds > 0.5)  # a sentence is offending by what it says: only words commoner in toxic documents can weigh
    keep = usable[bucket]
    sentence = sentence[keep]
    used, bucket = np.unique(bucket[keep], return_inverse=True)
    weight = np.where((odds[used] > 1.5) & (of_positive[used] >= 3), odds[used], 0.0)
    bias = -np.log(max(1, len(owner)) / positive)
    speed, scale = np.zeros_like(weight), np.sqrt(np.bincount(bucket, minlength=len(used)) + 1.0)
    class_weight = np.where(y > 0, 0.5 * docs / positive, 0.5 * docs / (docs - positive))
    told, sentence = np.unique(sentence, return_inverse=True)  # the other sentences of a document all weigh the same
    doc = owner[told]
    plain = np.bincount(owner, minlength=docs) - np.bincount(doc, minlength=docs)
    for _ in range(epochs):
        z = bias + np.bincount(sentence, weight[bucket], len(doc))
        log_none, p = noisy_or(z, doc, docs)
        none = np.exp(log_none - plain * np.log1p(np.exp(bias)))
        # d logL / dz of a sentence: -p where the label is 0, p * none / (1 - none) where it is 1
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0) * class_weight
        g = p * pull[doc]
        speed = 0.9 * speed + np.bincount(bucket, g[sentence], len(used)) / scale
        weight += rate * speed / 10
        weight = np.sign(weight) * np.maximum(np.abs(weight) - l1, 0)
        np.clip(weight, -8, 12, out=weight)
        bias += 0.2 * np.clip((g.sum() + (pull * plain).sum() / (1 + np.exp(-bias))) / positive, -1, 1)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = weight
    return {"weight": out, "bias": float(bias)}


def score_texts(texts: list[bytes], model: dict, locate: float | None = None):
    """Probabilities of the texts and, if `locate` is given, the (start, end, p) of the sentences at or above it, in bytes of their text."""
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    for a, b in groups_of([len(t) for t in texts], BLOCK):
        x, base = instances(texts[a:b])
        if not len(x.doc):
            continue
        pair = np.unique(x.sentence * BUCKETS + x.bucket)
        x.sentence, x.bucket = pair // BUCKETS, pair % BUCKETS
        log_none, p = noisy_or(sentence_logits(x, model["weight"], model["bias"]), x.doc, b - a)
        scores[a:b] = -np.expm1(log_none)
        if locate is not None:
            for s in np.flatnonzero(p >= locate):
                d = x.doc[s]
                spans[a + d].append((int(x.start[s] - base[d]), int(x.end[s] - base[d]), float(p[s])))
    return np.clip(scores, 0, 1), spans


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most: int = MOST_LABELLED) -> dict:
    """Train on at most `most` labelled documents for whose id `usable` (over the column id) holds."""
    texts, y = labelled_sample(docs, labels, id_col, text_col, label_col, usable, most)
    return train(texts, y)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most: int) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled texts: the first `most` ids by a hash, and of rows that repeat an id the least text; of repeated labels the
    highest. Both the broadcast side and what reaches the driver are bounded by `most` rows."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter(usable)
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    return [utf8(t) for t in texts["text"]], texts["y"].to_numpy(dtype=np.int64)


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """id_col, score and the offending sentences: array of (start, length in bytes, p)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            scores, spans = score_texts([utf8(t) for t in df["text"]], shared.value, locate)
            yield pd.DataFrame({"id": df["id"], "score": scores, "sentences": [[{"start": a, "length": b - a, "p": p} for a, b, p in s] for s in spans]})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["id"]
    out = base.mapInPandas(run, f"id {kind}, score double, sentences array<struct<start:int,length:int,p:double>>")
    return out.withColumnRenamed("id", id_col)
