"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per
document into a linear softmax, trained by stochastic gradient descent in numpy.

A document's tokens are its words and the 3- to 6-byte grams of each word with a blank on
either side, so a misspelt word shares most grams with the right one; a word that repeats
the one before it is a token of its own kind besides. Training runs on a bounded sample of
labelled rows, as many of either class; scoring takes every whole text, where only each
token's share of the two logits is needed: one number, as the softmax has two classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import LOWER, SEPARATOR, U, Words, text_chunks
from .stage import id_and_text

GRAMS = (3, 4, 5, 6)
_SPREAD = U(0x9E3779B97F4A7C15)
_REPEATED = 0xB5297A4D


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows of each class that training takes (the least by
    hash of id); one in `held` of them sets the scale and offset of the logit, not the vectors."""

    sample_rows: int = 2500
    held: int = 5
    buckets_log2: int = 17
    dim: int = 12
    epochs: int = 8
    batch: int = 32
    rate: float = 2.0
    weight_rate: float = 0.5
    min_docs: int = 3
    damping: float = 1e-6
    lower: bool = True
    seed: int = 5


def token_buckets(data: np.ndarray, off: np.ndarray, log2: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token of a chunk of texts."""
    shift = U(64 - log2)
    low = LOWER[data] if lower else data
    words = Words(low, off)
    docs = [np.repeat(np.arange(len(off) - 1), words.count)]
    hashes = words.hashes()
    buckets = [((hashes * _SPREAD) >> shift).astype(np.int32)]
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    again = again[~np.isin(again, words.off)]  # the first word of a document has none before it
    docs.append(docs[0][again])
    buckets.append(np.full(len(again), _REPEATED >> (32 - log2), np.int32))
    # every document with a blank before and after it
    n = len(off) - 1
    padded = np.full(len(low) + 2 * n, 32, np.uint8)
    doc_of = np.repeat(np.arange(n), np.diff(off) + 2)
    inside = np.ones(len(padded), bool)
    first = off[:-1] + 2 * np.arange(n)
    inside[first] = False
    inside[off[1:] + 2 * np.arange(n) + 1] = False
    padded[inside] = np.where(SEPARATOR[low], 32, low)
    blank = padded == 32
    x = padded.astype(np.uint64)
    code, clear = x, np.zeros(len(x), bool)
    for size in range(2, max(GRAMS) + 1):
        code = (code[:-1] << U(8)) | x[size - 1 :]
        clear = np.zeros(len(code), bool) if size == 2 else clear[:-1] | blank[size - 2 : len(blank) - 1]  # a blank inside
        if size in GRAMS:
            at = np.flatnonzero(~clear)
            docs.append(doc_of[at])
            buckets.append((((code[at] + U(size << 56)) * _SPREAD) >> shift).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets)


def document_features(data: np.ndarray, off: np.ndarray, log2: int, lower: bool = True):
    """For each document the distinct buckets and their counts."""
    doc, bucket = token_buckets(data, off, log2, lower)
    key, count = np.unique(doc.astype(np.int64) << log2 | bucket, return_counts=True)
    cut = np.searchsorted(key >> log2, np.arange(len(off)))
    key &= (1 << log2) - 1
    return [(key[a:b].astype(np.int32), count[a:b].astype(np.int32)) for a, b in zip(cut[:-1], cut[1:])]


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the trained network's logit for class 1.

    The vectors and the softmax weights are trained jointly; the pair of logits of a mean
    vector is linear, so the trained network folds into one weight a bucket. Without rows
    of both classes the score is the share of class 1, or one half without any."""
    n = len(features)
    ones = float(labels.sum()) if n else 0.0
    if not n or ones in (0.0, float(n)):
        p = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
        return np.zeros(1 << s.buckets_log2, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(s.seed)
    vectors = rng.normal(0, 0.05, (1 << s.buckets_log2, s.dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias = np.log(np.array([n - ones, ones], np.float32) / n)
    squares = np.full(1 << s.buckets_log2, s.damping, np.float32)
    seen = np.zeros(1 << s.buckets_log2, np.int32)
    for ids, _ in features:
        seen[ids] += 1
    rare = seen < s.min_docs  # these stay at zero: they count as tokens and say nothing
    vectors[rare] = 0
    for epoch in range(s.epochs):
        order = rng.permutation(n)
        step = 1.0 - 0.9 * epoch / max(1, s.epochs - 1)
        for lo in range(0, n, s.batch):
            rows = [i for i in order[lo : lo + s.batch] if len(features[i][0])]
            if not rows:
                continue
            ids = np.concatenate([features[i][0] for i in rows])
            share = np.concatenate([(features[i][1] / features[i][1].sum()).astype(np.float32) for i in rows])
            size = np.array([len(features[i][0]) for i in rows])
            mean = np.add.reduceat(vectors[ids] * share[:, None], np.cumsum(size) - size, axis=0)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            delta = p[:, 1]  # the two errors are opposite, so every vector moves along one direction
            direction = out[:, 1] - out[:, 0]
            pull = np.bincount(ids, np.repeat(delta, size) * share, 1 << s.buckets_log2).astype(np.float32)
            hit = np.flatnonzero((pull != 0) & ~rare)
            squares[hit] += pull[hit] ** 2
            vectors[hit] -= (s.rate * step * pull[hit] / np.sqrt(squares[hit]))[:, None] * direction[None, :]
            out -= s.weight_rate * step * (mean.T @ p) / len(rows)
            bias -= 0.05 * step * p.mean(0)
    direction = out[:, 1] - out[:, 0]
    return (vectors @ direction).astype(np.float32), float(bias[1] - bias[0])


def calibrate(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and offset of the logit by damped logistic regression, with the classes weighted
    to the share of class 1 among all labelled rows."""
    y = labels.astype(float)
    ones = y.mean()
    weight = np.where(y == 1, share / ones, (1 - share) / (1 - ones)) if 0 < ones < 1 else np.ones(len(y))
    x, beta, pull = np.stack([logits, np.ones(len(y))], 1), np.array([1.0, 0.0]), np.array([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + pull * (beta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Train on most rows and calibrate on the rest; folded into one weight a bucket and a bias."""
    held = np.arange(len(labels)) % s.held == 0
    own = [f for f, h in zip(features, held) if not h]
    weights, bias = train(own, labels[~held], s)
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        return weights, bias
    logits = np.array([(weights[i] * c).sum() / max(1.0, c.sum()) + bias for (i, c), h in zip(features, held) if h])
    scale, offset = calibrate(logits, labels[held], share)
    return weights * np.float32(scale), bias * scale + offset


def score_chunk(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float, lower: bool = True) -> np.ndarray:
    log2 = int(len(weights)).bit_length() - 1
    doc, bucket = token_buckets(data, off, log2, lower)
    n = len(off) - 1
    total = np.bincount(doc, weights[bucket], n)
    count = np.bincount(doc, minlength=n)
    return 1.0 / (1.0 + np.exp(-(total / np.maximum(count, 1) + bias)))


def _fit(share: float, s: Settings):
    """The labelled rows, all in one task, to one row: the weights and the bias."""

    def run(batches):
        rows = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, data, off in text_chunks(batch.column(1), 1 << 18):
                rows += zip(ids[lo:hi], labels[lo:hi], document_features(data, off, s.buckets_log2, s.lower))
        rows.sort(key=lambda r: (r[0], len(r[2][0]), r[2][0].tobytes()))  # rows may share an id
        weights, bias = fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), share, s)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    return run


def learn(docs: DataFrame, labelled: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on labelled (doc_id, label 0 or 1) rows. Rows with a null or other label are no
    label; of several rows of one doc_id the greatest label counts.

    One task of the cluster gets the texts of at most 2 * sample_rows ids and trains; the
    driver gets the weights, 4 * 2**buckets_log2 bytes."""
    rows = labelled.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    some = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows) for c in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most 2 * sample_rows ids, so it can be broadcast
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    taken = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    got = taken.repartition(1).mapInArrow(_fit(share, s), "weights binary, bias double").collect()
    if not got:  # a plan over no rows at all may have no task
        return fit([], np.zeros(0, np.int64), share, s)
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the chance of label 1 for every whole text; null and empty texts get
    the model's score of no tokens; rows without an id take no part, repeated rows each
    give a row, other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**buckets_log2 bytes
    lower = s.lower

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1), 1 << 18):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(score_chunk(data, off, weights, bias, lower))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs with the score of their texts beside them; no shuffle."""
    shared, lower, at = docs.sparkSession.sparkContext.broadcast(model), s.lower, docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            got = [score_chunk(data, off, weights, bias, lower) for _, _, data, off in text_chunks(batch.column(at), 1 << 18)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
