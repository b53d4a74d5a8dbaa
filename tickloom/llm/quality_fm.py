"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata of whole texts.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is taken in linear time as half of
sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2. Weights are fitted on the driver by Adam on at most max_rows labelled rows, half
of each label where there are enough, chosen by md5 of doc_id; the features of those rows are made on the executors.
Labels, lang, source and doc_id are never features.

Edge cases: null and empty texts have all features 0 and get the score of those; labels other than 0 and 1 are ignored, and of several labels
of one doc_id the smallest counts; without labels of both kinds every document gets 0.5 (kept); very long texts are read whole; an empty table gives no rows;
extra columns are ignored, or passed on by kept_documents.

Scale: two scans (one for the sample's texts, found by a broadcast of at most max_rows ids; one to score), no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import textscan
from tickloom.llm.shared import lean

BUCKETS, FACTORS, STATS = 1024, 8, 14
FEATURES = BUCKETS + STATS
#: Byte classes: 0 other, 1 upper case, 2 lower case, 3 digit, 4 mark, 5 space, 6 line feed, 7 beyond ASCII.
_CLASS = np.zeros(256, np.intp)
_CLASS[33:127] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 5, 6, 7


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers per text: word buckets (log counts, unit length), then statistics, not yet scaled."""
    data, at = textscan.raw_bytes(texts)
    n = len(at) - 1
    hashes, word_at, starts, ends = textscan.words(data, at)
    n_words = np.diff(word_at)
    doc = np.repeat(np.arange(n), n_words)
    counts = np.bincount(doc * BUCKETS + (hashes >> np.uint64(40)).astype(np.intp) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
    x = np.zeros((n, FEATURES), np.float32)
    tf = np.log1p(counts)
    x[:, :BUCKETS] = tf / np.maximum(np.sqrt((tf * tf).sum(1, keepdims=True)), 1e-9)
    size = np.diff(at)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + _CLASS.take(data), minlength=8 * n).reshape(n, 8)
    chars, w = np.maximum(size, 1), np.maximum(n_words, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    length = ends - starts
    final = _CLASS.take(data[ends - 1]) if len(ends) else np.zeros(0, np.intp)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    per = lambda v: np.bincount(doc, v, minlength=n)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = per(new[np.argsort(order, kind="stable")]) if len(order) else np.zeros(n)
    heads = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[order][heads], np.diff(np.append(heads, len(order))))
    stats = [
        kinds[:, 1] / letters,
        kinds[:, 4] / chars,
        kinds[:, 3] / chars,
        kinds[:, 7] / chars,
        kinds[:, 6] / w,
        per(length) / w,
        np.sqrt(np.maximum(per(length * length) / w - (per(length) / w) ** 2, 0)),
        np.log1p(n_words),
        np.log1p(size),
        distinct / w,
        most / w,
        per(same) / w,
        per(final == 4) / w,
        per(length == 1) / w,
    ]
    x[:, BUCKETS:] = np.stack(stats, 1)
    return x


class FactorisationMachine:
    """Weights, and the mean and deviation that scale the statistics."""

    def __init__(self, seed: int = 3):
        r = np.random.Generator(np.random.PCG64(seed))
        self.bias, self.weights = 0.0, np.zeros(FEATURES, np.float32)
        self.factors = (0.01 * r.standard_normal((FEATURES, FACTORS))).astype(np.float32)
        self.mean, self.deviation = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)
        self.random = r

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.deviation, -4, 4)
        return x

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((sums * sums).sum(1) - (x * x) @ (self.factors * self.factors).sum(1)), sums

    def fit(self, raw: np.ndarray, labels: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-3) -> None:
        self.mean, self.deviation = raw[:, BUCKETS:].mean(0), raw[:, BUCKETS:].std(0) + 1e-6
        x = self.scaled(raw)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        params = [np.zeros(1, np.float32), self.weights, self.factors]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = self.random.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xs, t = x[rows], t + 1
                self.bias = float(params[0][0])
                m, sums = self.margin(xs)
                g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
                grads = [g.sum(keepdims=True), xs.T @ g + decay * self.weights, xs.T @ (g[:, None] * sums) - ((xs * xs).T @ g)[:, None] * self.factors + decay * self.factors]
                for p, d, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.bias = float(params[0][0])

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.scaled(raw))[0].astype(np.float64), -30, 30)))


#: Column of the scores, unless another name is given.
SCORE = "_quality_score"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textscan.chunks(batches):
        x = features(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> FactorisationMachine | None:
    """Fit on at most max_rows rows of labels (doc_id, quality) that are not held out; None if one of the labels has none."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    order = [F.md5(F.col("_id").cast("string")), "_id"]
    sample = known.where("label = 0").orderBy(*order).limit(max_rows // 2).unionByName(known.where("label = 1").orderBy(*order).limit(max_rows // 2))
    rows = lean(docs).select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    # Rows that repeat a doc_id give one row, so max_rows bounds what reaches the driver.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(vectors, "doc_id bigint, label int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = np.array(found.column("label").to_pylist(), np.float32)
    if not 0 < y.sum() < len(y):
        return None
    model = FactorisationMachine()
    model.fit(np.stack([np.frombuffer(b.as_buffer(), np.float32) for b in found.column("x")]), y)
    return model


def scorer(model: FactorisationMachine | None, name: str) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.chunks(batches):
            s = np.full(part.num_rows, 0.5) if model is None else model.scores(features(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, name])

    return score


def score_documents(docs: DataFrame, model: FactorisationMachine | None, name: str = SCORE) -> DataFrame:
    """docs with the column name (0 to 1, higher: label 1 likelier)."""
    from pyspark.sql import types as T

    return lean(docs).mapInArrow(scorer(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least threshold."""
    name = SCORE
    while name in docs.columns:
        name += "_"
    return score_documents(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op1_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = F.col(SCORE)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
