"""The two trained models against plain Python that knows no hash buckets, batches or shards."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import maxent, quality

WORDS = "the Night river stone LAMP walks slowly under ten bridges home eBay tea".split()


def text_of(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(str(draw.choice(WORDS)) + str(draw.choice(["", "", ".", "!!"])) for _ in range(n))


def plain_features(text):
    tokens = [(m.group(), 1 if m.group(1) else 2) for m in re.finditer(r"([0-9A-Za-z]+)|[^0-9A-Za-z\s]+", text or "")]
    names = []
    for k, (token, kind) in enumerate(tokens):
        low = token.lower()
        before = tokens[k - 1][0].lower() if k else None
        upper = sum("A" <= c <= "Z" for c in token)
        style = 0 if not upper else 2 if upper == len(token) else 1 if upper == 1 and token[0].isupper() else 3
        names += [("word", low), ("pair", "start" if before is None else "same" if before == low else (before, low)), ("shape", kind, style, min(int(math.log2(len(token) + 1)), 7))]
    value = {name: math.log1p(n) for name, n in Counter(names).items()}
    length = max(math.sqrt(sum(v * v for v in value.values())), 1e-9)
    return {name: v / length for name, v in value.items()} | {"bias": 1.0}


def plain_ftrl(rows, p):
    z, n = Counter(), Counter()
    weight = lambda k: -math.copysign(max(abs(z[k]) - p.l1, 0), z[k]) / ((p.beta + math.sqrt(n[k])) / p.alpha + p.l2)
    dot = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    for _ in range(p.epochs):
        for _, text, label in sorted(rows):
            x = plain_features(text)
            w, score = {k: weight(k) for k in x}, dot(x)
            for k, v in x.items():
                g = (score - label) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / p.alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return lambda text: dot(plain_features(text))


def test_quality_equals_plain_ftrl(spark):
    params = quality.FtrlParams(shards=1, epochs=3)
    rows = [(i, text_of(i, 5 + i % 40), i % 2) for i in range(60)] + [(60, "", 1), (61, "tea tea tea ??", 0), (62, text_of(9, 30_000), 1)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(100, text_of(100, 20)), (101, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    found = {r["doc_id"]: r["score"] for r in quality.score(df, quality.train(df, labels, params)).collect()}
    want = plain_ftrl(rows, params)
    assert len(found) == 65
    for r in df.collect():
        assert abs(found[r["doc_id"]] - want(r["text"])) < 2e-3


def test_maxent_score_equals_plain_model(spark):
    params = maxent.MaxentParams(rounds=3, shards=2)
    texts = [text_of(i, 3 + i % 25) for i in range(40)] + ["", None, "unseenword tea", text_of(7, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    found = {r["doc_id"]: r for r in maxent.lm_scores(df, held, params).collect()}

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()) + [None]

    learn = [tokens(t) for i, t in enumerate(texts) if i % 5]
    counts = Counter(w for ts in learn for w in ts)
    hashed = {}
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, _, _ = maxent.tokens_of(data, np.array([0, len(data)]))
        hashed |= dict(zip(tokens(t), h))
    frequent = sorted((w for w in counts if w), key=lambda w: (-counts[w], int(hashed[w].view(np.int64))))[: maxent.SINGLES]

    def kind(w):
        if w is None:
            return 0
        if w in frequent:
            return frequent.index(w) + 1
        tail = ord(w[-1]) * 31 + (ord(w[-2]) if len(w) > 1 else 0)
        return tail % maxent.SUFFIX_CLASSES + maxent.SINGLES + 1

    def histories(ts):
        one, two = maxent.START, maxent.START
        for w in ts:
            context = int(one % np.uint64(maxent.PREVIOUS)) * maxent.SKIP + int((two >> np.uint64(32)) % np.uint64(maxent.SKIP))
            yield ("all", ("one", context // maxent.SKIP), ("two", context % maxent.SKIP), ("both", int(maxent.pair_bucket(np.array([context]))[0]))), kind(w)
            one, two = hashed[w], one

    weights = {}
    zero = np.zeros(maxent.CLASSES)

    def chances(features):
        logits = sum((weights.get(f, zero) for f in features), zero)
        p = np.exp(logits - logits.max())
        return p / p.sum()

    seen = Counter((f, k) for ts in learn for f, k in histories(ts))
    for _ in range(params.rounds):
        observed, expected = {}, {}
        for (features, k), times in seen.items():
            p = chances(features) * times
            for f in features:
                observed.setdefault(f, np.zeros(maxent.CLASSES))[k] += times
                expected[f] = expected.get(f, zero) + p
        for f, o in observed.items():
            w, e = weights.get(f, zero), expected[f]
            weights[f] = w + np.clip((o - e - params.prior * w * 0.05) / (4 * np.maximum(e, 0.25 * o) + params.prior), -1.5, 1.5)
    size, distinct = Counter(), Counter()
    for w, n in counts.items():
        size[kind(w)] += n
        distinct[kind(w)] += 1
    total, base = sum(counts.values()), lambda w: math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1))
    for i, t in enumerate(texts):
        want = sum(math.log10(chances(f)[k]) + math.log10((counts[w] + 1) / (size[k] + distinct[k] + 1)) for w, (f, k) in zip(tokens(t), histories(tokens(t))))
        own = found[i]
        assert own["held_out"] == (i % 5 == 0) and own["n_tokens"] == len(tokens(t)) and own["train_tokens"] == total
        assert own["n_known"] == sum(counts[w] > 0 for w in tokens(t))
        assert abs(own["base_score"] - sum(map(base, tokens(t)))) < 1e-6 * max(1, len(tokens(t)))
        assert abs(own["score"] - want) < 1e-3 * max(1.0, abs(want))
