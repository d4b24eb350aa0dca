"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A token is a run of word bytes or a run of other visible bytes, so that marks glued
to words are seen by themselves. Features are hashed unigrams and bigrams of tokens
(a token followed by itself is one bigram, whichever it is) and each word's shape, as frequencies scaled to unit length; a score is a sparse dot product
through the logistic function.

Training reads a bounded sample of labelled rows (``max_rows``). It runs in
``shards`` groups of equal expected size; each starts an epoch from the mean of all
shards' FTRL states (parameter mixing), so no task sees more than its share.

Defined cases
* null or empty text: no features, so the score is that of the bias alone.
* a doc_id with several labels: the mean decides, 0.5 counts as 1. Null labels or ids are ignored.
* no usable label at all: every score is 0.5.
* repeated rows: scored alike. Extra columns pass through; ``score`` and ``predicted`` replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.hashing import column_bytes, mini_batches, mix, span_hashes
from folioflow.store import materialize

_WORD, _MARK, _BLANK = 1, 2, 0
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _WORD
_KIND[128:] = _WORD
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.0001
    l2: float = 0.0001
    epochs: int = 4
    shards: int = 8
    max_rows: int = 16_000


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all rows, and each row's first feature (n + 1 bounds)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part, rel = data[lo:hi], offsets - lo
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[part]
    edge = np.empty(len(part) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[rel[rel < len(part)]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    kinds = kind[starts]
    seen = kinds != _BLANK
    starts, ends, kinds = starts[seen], ends[seen], kinds[seen]
    hashes = span_hashes(part, starts, ends)
    bounds = np.searchsorted(starts, rel)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[part])))
    upper = capitals[ends] - capitals[starts]
    # the shape of a word: lower case, capital first, capitals only, or mixed, with a coarse length
    length = ends - starts
    style = np.where(upper == 0, 0, np.where(upper == length, 2, np.where((upper == 1) & (_UPPER[part[starts]] == 1), 1, 3)))
    shape = kinds.astype(np.uint64) * np.uint64(64) + style.astype(np.uint64) * np.uint64(8) + np.minimum(np.log2(length + 1), 7).astype(np.uint64)
    with np.errstate(over="ignore"):
        second = np.zeros(len(hashes), np.uint64)
        second[1:] = mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
        second[1:][hashes[1:] == hashes[:-1]] = np.uint64(101)  # a repeated token is one feature, whichever it is
        second[bounds[:-1][bounds[:-1] < len(second)]] = np.uint64(77)
        forms = mix(shape + np.uint64(1 << 40))
    mask = np.uint64((1 << bits) - 1)
    out = np.empty(3 * len(hashes), np.int64)
    out[0::3], out[1::3], out[2::3] = (hashes & mask).astype(np.int64), (second & mask).astype(np.int64), (forms & mask).astype(np.int64)
    return out, bounds * 3


def _weights(z: np.ndarray, n: np.ndarray, p: FtrlParams) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def _ftrl_epoch(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, p: FtrlParams) -> int:
    """One pass of per-document updates over (buckets, values, label); the last cell is the bias."""
    seen = 0
    for at, value, label in rows:
        at, value = np.append(at, len(z) - 1), np.append(value, 1.0)
        w = _weights(z[at], n[at], p)
        score = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        gradient = (score - label) * value
        sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / p.alpha
        z[at] += gradient - sigma * w
        n[at] += gradient**2
        seen += 1
    return seen


def _sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(buckets, return_counts=True)
    value = np.log1p(count)
    return at, value / max(np.sqrt((value**2).sum()), 1e-9)


def _epoch_of_shard(start, p: FtrlParams):
    """Group function: one FTRL epoch over a shard, in id order, from the broadcast state."""

    def epoch(pdf):
        import pandas as pd

        z, n = (x.astype(np.float64) for x in start.value)
        pdf = pdf.sort_values(["doc_id", "at"])
        rows = ((np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(np.float64), y) for a, v, y in zip(pdf["at"], pdf["value"], pdf["label"]))
        seen = _ftrl_epoch(rows, z, n, p)
        return pd.DataFrame({"seen": [seen], "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

    return epoch


def training_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most about ``max_rows`` ids, chosen by hash: the share kept is the bound over the count."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = F.lit(float(max_rows)) / F.greatest(F.count(F.lit(1)), F.lit(1))
    total = one.agg(share.alias("share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return one.where(draw < total.scalar())


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> np.ndarray:
    """Weights (bias last) from documents (doc_id, text) and labels (doc_id, label).

    The sample's ids are broadcast (at most about ``max_rows``), so documents are only scanned.
    """
    p = params
    sample = F.broadcast(training_sample(labels, p.max_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(p.shards)).cast("int"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            at, value = [], []
            for i, j in mini_batches(offsets):
                buckets, bounds = features(data, offsets[i : j + 1], p.bits)
                for k in range(j - i):
                    a, v = _sparse(buckets[bounds[k] : bounds[k + 1]])
                    at.append(a.astype(np.int32).tobytes())
                    value.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("label"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "shard", "label", "at", "value"])

    examples = materialize(rows.select("doc_id", "shard", "label", "text").mapInArrow(vectors, "doc_id long, shard int, label int, at binary, value binary"))
    state = np.zeros((2, (1 << p.bits) + 1))
    for _ in range(p.epochs):
        start = docs.sparkSession.sparkContext.broadcast(state.astype(np.float32))
        parts = examples.groupBy("shard").applyInPandas(_epoch_of_shard(start, p), "seen long, z binary, n binary").collect()
        if parts:
            total = sum(r["seen"] for r in parts)
            state = np.stack([sum(np.frombuffer(r[k], np.float32).astype(np.float64) * (r["seen"] / total) for r in parts) for k in ("z", "n")])
        start.unpersist()
    return _weights(state[0], state[1], p)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, params: FtrlParams = FtrlParams()) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; no shuffle, only the text reaches Python besides what passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    bits = params.bits

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            result = np.empty(batch.num_rows)
            for i, j in mini_batches(offsets):
                buckets, bounds = features(data, offsets[i : j + 1], bits)
                for k in range(j - i):
                    a, v = _sparse(buckets[bounds[k] : bounds[k + 1]])
                    result[i + k] = w[a] @ v
            result = 1 / (1 + np.exp(-np.clip(result + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(result), pa.array((result >= threshold).astype(np.int32))], names=[*(f.name for f in kept), "score", "predicted"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scored, schema)
