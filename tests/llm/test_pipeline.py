"""Every stage of the pipeline on its predecessor's rows, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import quality, sentencepiece
from folioflow.store import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each one."""
    extra = [(900_001, None, "xx", None, 0), (900_002, "", "xx", "a", 0), (900_003, None, None, None, None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    own = docs.join(good, "doc_id").where("n_chars > 1500").orderBy("doc_id").first()
    # the same words on shorter lines: no line matches, the whole does
    said = own["text"].split()
    rewrapped = "\n".join(" ".join(said[i : i + 7]) for i in range(0, len(said), 7))
    extra.append((900_004, rewrapped, own["lang"], own["source"], len(rewrapped)))
    docs = materialize(docs.union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(own):
    return {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()


def near(a, b):
    common = len(a & b)
    return 100 * common >= 75 * (len(a) + len(b) - common) and common > 0


def test_quality_stage(spark, stages):
    before, after = stages[0], stages[1]
    assert after.columns == COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label").where("crc32(cast(doc_id as string)) % 5 <> 0")
    scored = quality.score(before, quality.train(before, labels)).where("score >= 0.3").select(*COLUMNS)
    assert sorted(map(str, after.collect())) == sorted(map(str, scored.collect()))


def test_quality_stage_rejects(spark):
    """All labels of the larger sample, held out or not: most bad documents go and nearly all good ones stay."""
    path = SF.replace("0.001", "0.01")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{path}/documents.parquet"), path).select("doc_id").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    good, bad = ([i for i, q in marks.items() if q == x] for x in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i not in kept for i in bad) >= 0.5 * len(bad)


def test_line_stage(stages):
    before, after = (sorted(s.collect(), key=lambda r: r["doc_id"]) for s in stages[1:3])
    seen, by_shingle, want = [], defaultdict(set), {}
    for r in before:
        if r["text"] is None:
            want[r["doc_id"]] = None
            continue
        kept = []
        for line in r["text"].split("\n"):
            own = shingles(words(line.lower()))
            rivals = {k for s in own for k in by_shingle[s]}
            if not any(near(seen[k], own) for k in rivals):
                kept.append(line)
            for s in own:
                by_shingle[s].add(len(seen))
            seen.append(own)
        want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert any(want[r["doc_id"]] != r["text"] for r in before)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after)


def test_near_duplicate_stage(stages):
    before, after = (s.collect() for s in stages[2:4])
    ascii_lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {r["doc_id"]: shingles(words((r["text"] or "").translate(ascii_lower))) for r in before}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near(sets[a], sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    kept = {i for i in ids if find(i) == i}
    assert len(kept) < len(ids)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] in kept)


def test_mixing_stage(stages):
    before, after = (s.collect() for s in stages[3:5])
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    total = Counter()
    for r in before:
        total[r["source"]] += size[r["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    # water filling: cap whoever is above twice its size, share the rest again
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else unit * weight[s]
        if not full:
            break
        budget -= sum(target[s] for s in full)
        open_ -= full
    copies = Counter(r["doc_id"] for r in after)
    own = {r["doc_id"]: r for r in before}
    assert {str(r) for r in after} <= {str(r) for r in before}
    for i, r in own.items():
        rate = target[r["source"]] / total[r["source"]] if total[r["source"]] else 0.0
        assert math.floor(rate + 1e-9) <= copies[i] <= math.ceil(rate - 1e-9) <= 2
    for s in order:
        largest = max(size[i] for i, r in own.items() if r["source"] == s)
        taken = sum(copies[i] * size[i] for i, r in own.items() if r["source"] == s)
        assert abs(taken - target[s]) <= 0.25 * target[s] + 2 * largest


def test_encoding_stage(stages):
    before, after = stages[4], stages[5]
    vocabulary = sentencepiece.as_unigram(sentencepiece.load_vocabulary())
    assert after.columns == [c for c in COLUMNS if c != "text"] + ["ids", "n_tokens"]
    decoded = sentencepiece.decode(after, vocabulary).select("doc_id", "decoded").collect()
    assert sorted(map(str, decoded)) == sorted(map(str, before.select("doc_id", F.col("text").alias("decoded")).collect()))
    table = {piece: (k, score) for piece, k, score in vocabulary.pieces}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        text = texts[r["doc_id"]]
        if text is not None:
            # a plain Viterbi over the whole text, without units
            assert r["ids"] == (sentencepiece.long_unit_ids(" " + text, table, vocabulary) if text else []) and r["n_tokens"] == len(r["ids"])


def test_run_applies_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "source mixing", "SentencePiece encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == docs.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))
