"""Language-model scoring by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). The class is a softmax over
weights of hashed features of the history: the previous word, the word before it
(a skip feature), the two together, and a bias. Within a class, a word has
(c + 1) / (N_class + V_class + 1): one count is left for all unseen words of the class.
The end of text and the most frequent words are classes of their own; every other word
belongs to the class of its last two bytes, seen or unseen.

Features look at histories through ``PREVIOUS`` x ``SKIP`` hash buckets, so all training
data reduce, without sampling, to counts of (history bucket, class): a table of bounded
size whose making shuffles what the corpus holds. Training is rounds of distributed
gradients over that table: each shard sums observed minus expected feature counts, and
the driver takes a step scaled by the curvature (weights are of fixed size).

Scoring reads a table of class log-probabilities per history bucket in batches. Counts of
the ``top_words`` most frequent words are broadcast (16 bytes each, at most that many);
all other words of a document meet the count table in a join, summed per document.

Defined cases
* null or empty text: the end token alone. null doc_id: takes part in training.
* repeated rows: each counts and is scored by itself.
* no training rows: N = V = 0, all words unknown, class probabilities uniform.
* empty table: empty result. Only the id and text columns are read; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.hashing import column_bytes, mini_batches, mix, span_hashes, word_spans
from folioflow.store import materialize

CLASSES, SINGLES = 64, 47
SUFFIX_CLASSES = CLASSES - SINGLES - 1
PREVIOUS, SKIP, PAIRS = 1024, 64, 4096
CONTEXTS = PREVIOUS * SKIP
END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x57A27057A27057A3)
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class MaxentParams:
    rounds: int = 8
    shards: int = 6
    prior: float = 4.0
    top_words: int = 500_000


@dataclass
class Vocabulary:
    """What tasks need of the corpus counts; arrays are sorted by word hash."""

    singles: np.ndarray  # word hashes
    single_class: np.ndarray
    top: np.ndarray  # word hashes
    top_log: np.ndarray  # log10(count + 1)
    class_log: np.ndarray  # log10(N_class + V_class + 1) by class
    tokens: int = 0
    distinct: int = 0


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with one end per row, their suffix classes, and each row's first token (n + 1 bounds)."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    rows = len(offsets) - 1
    bounds = first + np.arange(rows + 1)
    out, kind = np.full(len(hashes) + rows, END), np.zeros(len(hashes) + rows, np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(first))
    out[place] = hashes
    if len(hashes):
        tail = _LOWER[data[ends - 1]] * 31 + np.where(ends - starts > 1, _LOWER[data[ends - 2]], 0)
        kind[place] = tail % SUFFIX_CLASSES + SINGLES + 1
    return out, kind, bounds


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values in a sorted table, and whether each is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def classes_of(hashes: np.ndarray, kind: np.ndarray, singles: np.ndarray, single_class: np.ndarray) -> np.ndarray:
    at, there = find(singles, hashes)
    return np.where(there, single_class[at] if len(single_class) else 0, kind)


def contexts_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """History bucket of every token: previous word's bucket times SKIP plus the bucket of the one before."""
    back1, back2 = np.empty_like(hashes), np.empty_like(hashes)
    back1[1:], back2[2:] = hashes[:-1], hashes[:-2]
    head = bounds[:-1]
    back1[head] = back2[head] = START
    second = (head + 1)[head + 1 < bounds[1:]]
    back2[second] = START
    return ((back1 % np.uint64(PREVIOUS)) * np.uint64(SKIP) + (back2 >> np.uint64(32)) % np.uint64(SKIP)).astype(np.int64)


def pair_bucket(context: np.ndarray) -> np.ndarray:
    return (mix(context.astype(np.uint64) + np.uint64(1)) % np.uint64(PAIRS)).astype(np.int64)


def _batches_of_tokens(batch: pa.RecordBatch, column: int):
    data, offsets = column_bytes(batch.column(column))
    for i, j in mini_batches(offsets):
        yield i, j, *tokens_of(data, offsets[i : j + 1])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, kind, n) over all tokens of ``docs`` (text); tasks send one row per word of an Arrow batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(h, k) for _, _, h, k, _ in _batches_of_tokens(batch, 0)]
            if parts:
                hashes, kinds = (np.concatenate(x) for x in zip(*parts))
                word, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kinds[first].astype(np.int32)), pa.array(n)], names=["word", "kind", "n"])

    return docs.select("text").mapInArrow(work, "word long, kind int, n long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


def _cut(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach; read off a histogram of a few hundred steps."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["step"], r["words"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    total, cut = 0, 1 << 62
    for _, words, least in steps:
        total += words
        if total > most:
            break
        cut = least
    return cut


def vocabulary(counts: DataFrame, params: MaxentParams) -> tuple[Vocabulary, int]:
    """What tasks need, and the count from which a word counts as frequent."""
    end = int(END.view(np.int64))
    frequent = counts.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(SINGLES).collect()
    by_class = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    size, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for kind, (n, v) in by_class.items():
        size[kind], distinct[kind] = n, v
    total, words = int(size.sum()), int(distinct.sum())
    for k, r in enumerate(frequent, 1):
        size[k], distinct[k] = r["n"], 1
        size[r["kind"]] -= r["n"]
        distinct[r["kind"]] -= 1
    cut = _cut(counts, params.top_words)
    top = counts.where(F.col("n") >= cut).select("word", "n").toPandas()
    word = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    singles = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    by_hash = np.argsort(singles)
    return Vocabulary(singles[by_hash], by_hash.astype(np.int64) + 1, word[order], np.log10(top["n"].to_numpy(np.float64)[order] + 1), np.log10(size + distinct + 1), total, words), cut


def count_histories(docs: DataFrame, shared) -> DataFrame:
    """(context, class, n) over all tokens; at most CONTEXTS * CLASSES rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            cells = [contexts_of(h, b) * CLASSES + classes_of(h, k, v.singles, v.single_class) for _, _, h, k, b in _batches_of_tokens(batch, 0)]
            if cells:
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    summed = docs.select("text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return summed.select(F.expr(f"cell div {CLASSES}").alias("context"), (F.col("cell") % CLASSES).alias("class"), "n")


def log_table(weights: np.ndarray) -> np.ndarray:
    """log10 P(class | history bucket), CONTEXTS x CLASSES."""
    table = np.empty((CONTEXTS, CLASSES), np.float32)
    for at in range(0, CONTEXTS, 8192):
        context = np.arange(at, min(CONTEXTS, at + 8192))
        logits = _logits(weights, context)
        logits -= logits.max(axis=1, keepdims=True)
        table[context] = (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)
    return table


def _logits(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    return weights[0] + weights[1 + context // SKIP] + weights[1 + PREVIOUS + context % SKIP] + weights[1 + PREVIOUS + SKIP + pair_bucket(context)]


def _feature_sums(context: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` by feature of their history."""
    out = np.zeros((1 + PREVIOUS + SKIP + PAIRS, CLASSES))
    out[0] = values.sum(axis=0)
    for base, bucket in ((1, context // SKIP), (1 + PREVIOUS, context % SKIP), (1 + PREVIOUS + SKIP, pair_bucket(context))):
        order = np.argsort(bucket, kind="stable")
        at, first = np.unique(bucket[order], return_index=True)
        out[base + at] += np.add.reduceat(values[order], first, axis=0)
    return out


def _shard_gradient(start):
    """Group function: observed and expected feature counts of a shard's histories."""

    def work(pdf):
        import pandas as pd

        context, row = np.unique(pdf["context"].to_numpy(), return_inverse=True)
        observed = np.zeros((len(context), CLASSES))
        np.add.at(observed, (row, pdf["class"].to_numpy()), pdf["n"].to_numpy())
        logits = _logits(start.value, context)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        expected = p / p.sum(axis=1, keepdims=True) * observed.sum(axis=1, keepdims=True)
        return pd.DataFrame({"observed": [_feature_sums(context, observed).astype(np.float32).tobytes()], "expected": [_feature_sums(context, expected).astype(np.float32).tobytes()]})

    return work


def train(docs: DataFrame, shared, params: MaxentParams) -> np.ndarray:
    """Weights (feature x class) from all of ``docs`` (text)."""
    spark = docs.sparkSession
    table = materialize(count_histories(docs, shared).withColumn("shard", F.pmod(F.xxhash64("context"), F.lit(params.shards))))
    weights = np.zeros((1 + PREVIOUS + SKIP + PAIRS, CLASSES), np.float32)
    for _ in range(params.rounds):
        start = spark.sparkContext.broadcast(weights)
        parts = table.groupBy("shard").applyInPandas(_shard_gradient(start), "observed binary, expected binary").collect()
        if not parts:
            break
        observed, expected = (sum(np.frombuffer(r[k], np.float32).astype(np.float64) for r in parts).reshape(weights.shape) for k in ("observed", "expected"))
        # four features are active at once, so each takes a fourth of its Newton step
        step = (observed - expected - params.prior * weights * 0.05) / (4 * np.maximum(expected, 0.25 * observed) + params.prior)
        weights = (weights + np.clip(step, -1.5, 1.5)).astype(np.float32)
        start.unpersist()
    return weights


def lm_scores(docs: DataFrame, held_out: Column, params: MaxentParams = MaxentParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row; learns from the rest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    learn = rows.where("not held_out").select("text")
    counts = materialize(count_words(learn))
    vocab, cut = vocabulary(counts, params)
    shared = spark.sparkContext.broadcast(vocab)
    weights = train(learn, shared, params)
    model = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = shared.value, log_table(model.value).ravel()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, known, word_log, model_log, rare, times = [], [], [], [], [], []
            for _, _, h, k, b in _batches_of_tokens(batch, 1):
                kind = classes_of(h, k, v.singles, v.single_class)
                given = table[contexts_of(h, b) * CLASSES + kind].astype(np.float64) - v.class_log[kind]
                at, there = find(v.top, h)
                own = np.where(there, v.top_log[at], 0.0) if len(v.top) else np.zeros(len(h))
                n.append(np.diff(b))
                for values, out in ((there.astype(np.int64), known), (own, word_log), (given, model_log)):
                    out.append(np.add.reduceat(values, b[:-1]))
                for lo, hi in zip(b[:-1], b[1:]):
                    word, times_here = np.unique(h[lo:hi][~there[lo:hi]], return_counts=True)
                    rare.append(word.view(np.int64))
                    times.append(times_here.astype(np.int32))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(y) for y in x]))).astype(np.int32)), pa.array(np.concatenate(x), kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(batch.num_rows)), batch.column(0), batch.column(2), *(pa.array(np.concatenate(x)) for x in (n, known, word_log, model_log)), lists(rare, pa.int64()), lists(times, pa.int32())],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "word_log", "model_log", "rare", "times"],
            )
            uid += batch.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    part = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(work, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, word_log double, model_log double, rare array<long>, times array<int>"))
    met = part.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("uid", F.col("w.rare").alias("word"), F.col("w.times").alias("times")).join(counts.where(F.col("n") < cut).select("word", "n"), "word")
    extra = met.groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    word_log = F.col("word_log") + F.coalesce("more_log", F.lit(0.0))
    return part.drop("rare", "times").join(extra, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (word_log - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.distinct + 1))).alias("base_score"),
        (word_log + F.col("model_log")).alias("score"),
    )
