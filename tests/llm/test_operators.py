"""Each operator on small fixtures: brute force, round trips, and nulls, empties, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ann, linedup, maxent, mixing, neardup, quality, sentencepiece, tiff, toolchat, urllist

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "nu", "xi", "rho", "tau", "phi", "chi"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, size=(400, 1))
    x[7] = x[300] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    found = {}
    for r in ann.search(df, lambda c: c % 20 == 0, ann.AnnParams(tables=16, probes=10)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 20):
        scores = x @ x[q]
        best = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
        mine = [v for _, v, _ in sorted(found[q])]
        hits += len(set(best) & set(mine))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found[q])
    assert hits / 400 >= 0.9 and [v for _, v, _ in sorted(found[20])][:2] in ([7, 300], sorted([7, 300]))
    small = ann.search(df.where("vec_id < 5"), lambda c: c == 0).collect()
    assert len(small) == 4
    assert ann.search(df.limit(0), lambda c: c == 0).count() == 0


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "outlier", "one side"])
def test_ann_uneven_norms(spark, shape):
    rng, n = np.random.default_rng(1), 3000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "uniform":
        x *= rng.uniform(0.5, 2, size=(n, 1))
    elif shape == "lognormal":
        x *= np.exp(rng.normal(scale=0.5, size=(n, 1)))
    elif shape == "outlier":
        x[7] *= 100
    else:  # a few queries lie opposite to all others
        x = x * 0.1 + np.eye(64)[0]
        x[::600] *= -1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, lambda c: c % 100 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, n, 100):
        scores = x @ x[q]
        hits += len(set([i for i in np.argsort(-scores) if i != q][:20]) & set(found[q]))
        assert len(found[q]) == 20
    assert hits / (20 * n / 100) >= 0.9


def test_mixing(spark):
    rows = [(i, prose(i, 10 + i), ["a", "b", None][i % 3]) for i in range(90)] + [(200, None, "a"), (201, "", "b"), (202, "x", "z"), (202, "x", "z"), (None, "y y", "z")]
    df = documents(spark, rows).withColumn("size", F.lit("clash"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    per = {r["source"]: (r["source_size"], r["target"]) for r in plan}
    total = sum(s for s, _ in per.values())
    assert abs(sum(t for _, t in per.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in per.values())
    assert all(r["taken"] <= 2 * r["size"] for r in plan)
    assert mixing.mix_documents(df).count() == sum(r["copies"] for r in plan) and mixing.mix_documents(df).columns == df.columns
    assert mixing.mix_plan(df.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_neardup(spark):
    rows, rng = [], random.Random(3)
    for k in range(30):
        base = prose(k, 80).split()
        for c in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(80)] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(text), "s"))
    base = prose(99, 90).split()
    for c in range(70):  # one family larger than a small bucket
        text = list(base)
        text[c] = f"own{c}"
        rows.append((len(rows), " ".join(text), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "a b", "s"), (903, "A  b", "s"), (None, "a b", "s")]
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = documents(spark, rows).withColumn("kept", F.lit("clash"))
    found = neardup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert neardup.drop_near_duplicates(df).count() == sum(r["kept"] for r in found)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_neardup_shared_template(spark):
    template = [f"t{k}" for k in range(400)]
    own = lambda i: [f"d{i}w{k}" for k in range(100)]
    words = {i: template + own(i) for i in range(400)}
    for i in range(60):  # 396 + 30 or more of 496 shingles are shared
        words[200 + i] = template + own(i)[: 30 + i % 8] + own(200 + i)[30 + i % 8 :]
    texts = {i: " ".join(w) for i, w in words.items()}
    planted = {(i, 200 + i) for i in range(60)}
    sets = {i: shingles(t) for i, t in texts.items()}
    close = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert close == planted and all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i, j in planted)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert all(c == i or (c, i) in planted for i, c in found.items())
    assert sum(found[j] == i for i, j in planted) >= 0.97 * len(planted)


def test_sentencepiece(spark):
    import sentencepiece as library

    texts = ["hello world", " two  spaces", "", None, "tab\tand\nline ▁ x \x01 中文 🙂 zzz", "the the the", "a" * 300, prose(1, 40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    vocabulary = sentencepiece.load_vocabulary()
    out = sentencepiece.decode(sentencepiece.encode(df, vocabulary, top_units=8), vocabulary).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == texts
    model = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    for r in out:
        if r["doc_id"] in (0, 1, 2, 5, 7):
            assert r["ids"] == model.encode(texts[r["doc_id"]])
    assert sentencepiece.encode(df.limit(0), vocabulary).count() == 0


def test_sentencepiece_long_runs(spark):
    import sentencepiece as library

    texts = [f"q{c * n}z" for c in "=-_* a" for n in (300, 500, 5000)] + ["a" * 100_000, " " * 400, "=" * 100_000, "x" * 140_001, "é▁" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = sentencepiece.load_vocabulary()
    out = sentencepiece.decode(sentencepiece.encode(df, vocabulary), vocabulary).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == texts
    model = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    for r in out[:-1]:  # the library reads the last text's U+2581 as spaces
        assert r["ids"] == model.encode(texts[r["doc_id"]])


def test_quality(spark):
    good = [(i, prose(i, 60), "s") for i in range(120)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 60).split()), "s") for i in range(60)]
    df = documents(spark, good + bad + [(2000, None, "s"), (2001, "", "s")]).withColumn("score", F.lit("clash"))
    labels = df.where("doc_id < 2000").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("label")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, label int"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = quality.score(df, quality.train(df, labels.where(~held | held.isNull()))).where(held & (F.col("doc_id") < 2000)).collect()
    assert sum((r["doc_id"] < 1000) == (r["predicted"] == 1) for r in out) / len(out) > 0.9
    none = quality.score(df, quality.train(df, labels.limit(0))).where("doc_id >= 2000").collect()
    assert [r["score"] for r in none] == [0.5, 0.5]
    assert quality.score(df.limit(0), np.zeros((1 << 18) + 1)).count() == 0


def test_toolchat(spark):
    calls = [("c", 1, "a", "add", '{"y": 2, "x": 1}', None), ("c", 2, "b", "add", '{"x": "1", "y": 2, "z": 0}', ["a", "lost"]), ("c", 3, "d", "add", "{bad", ["b", "a"]), ("c", 4, "e", "none", "{}", ["f"]), ("c", 5, "f", "add", '{"x":1}', ["e"]), ("c", 9, "a", "add", "{}", None), ("c", 1, None, "add", "{}", None)]
    results = [("c", 2, "a", "3"), ("c", 7, "a", "4"), ("c", 1, "b", "early"), ("c", 8, "x", "orphan"), (None, 1, "a", "-")]
    schemas = [("add", "x", "integer", True), ("add", "y", "number", True)]
    linked = toolchat.link_calls(
        spark.createDataFrame(calls, "conv_id string, turn int, call_id string, tool string, arguments string, after array<string>"),
        spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string"),
        spark.createDataFrame(schemas, "tool string, name string, kind string, required boolean"),
    )
    found = {r["call_id"]: r for r in linked.collect()}
    assert found["a"]["message"] == '{"arguments":{"x":1,"y":2},"id":"a","result":"3","tool":"add"}' and found["a"]["n_calls"] == 2 and found["a"]["valid"]
    assert found["b"]["errors"] == ["kind:x", "unknown:z", "after:lost"] and found["b"]["status"] == "early" and found["b"]["level"] == 1
    assert found["d"]["level"] == 2 and found["d"]["errors"] == ["arguments"]
    assert found["e"]["level"] is None and found["e"]["errors"] == ["tool", "cycle"] and found["f"]["errors"] == ["missing:y", "cycle"]
    assert found["x"]["status"] == "orphan" and set(found) == {"a", "b", "d", "e", "f", "x"}
    chain = [("k", n, f"n{n}", "add", "{}", [f"n{n - 1}"] if n else []) for n in range(20)] + [("k", 50, "p", "add", "{}", ["q"]), ("k", 51, "q", "add", "{}", ["p"])]
    rows = toolchat.first_calls(spark.createDataFrame(chain, "conv_id string, turn int, call_id string, tool string, arguments string, after array<string>"))
    assert {r["call_id"]: r["level"] for r in toolchat.levels(rows).collect()} == {**{f"n{n}": n for n in range(20)}, "p": None, "q": None}


@pytest.mark.parametrize("size", [1, 63, 64, 300, 5000])
def test_tiff_codecs(size):
    for data in (bytes(random.Random(size).randrange(256) for _ in range(size)), b"a" * size, (b"the cat " * size)[:size]):
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data and tiff.lzw_decode(tiff.lzw_encode(data)) == data
        payload = tiff.payload_of(data)
        for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for predictor in (1, 2):
                for tile in (0, 32, 64):
                    ((_, _, _, pixels),) = tiff.read_pages(tiff.write_page(payload, 64, compression, predictor, tile))
                    assert pixels == payload


def test_tiff(spark):
    df = documents(spark, [(1, "héllo", "s"), (2, None, "s"), (3, "", "s"), (4, prose(1, 900), "s"), (4, prose(1, 900), "s")]).withColumn("media", F.lit("clash"))
    out = tiff.media_digest(tiff.page_features(tiff.decode_pages(tiff.encode_texts(df)))).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "héllo", 4: prose(1, 900)}.get(r["doc_id"], "").encode()
        payload = tiff.payload_of(text)
        assert r["n_bytes"] == len(text) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    broken = tiff.decode_pages(spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, media binary")).collect()
    assert [r["page"] for r in broken] == [-1, -1] and all(r["error"] for r in broken)
    assert tiff.encode_texts(df.limit(0)).count() == 0


def test_urllist(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/x", "2024-01-05"), (2, "http://a.bad.com/x", "2024-02-05"), (3, "HTTPS://Ok.org:80/p/q?z", "2024-03-01"), (4, None, "2024-01-05"), (5, "nonsense", None), (1, "http://a.bad.com/x", "2024-01-05"), (6, "http://notbad.com/", "2024-01-05")],
        "page_id int, url string, fetched_at string",
    ).withColumn("host", F.lit("clash"))
    entries = spark.createDataFrame([("domain", "bad.com", True, "2024-01-01"), ("domain", "bad.com", False, "2024-02-01"), ("prefix", "ok.org/p", True, "2023-01-01"), ("domain", "ok.org", True, "2020-01-01"), (None, "x", True, "2020-01-01")], "kind string, value string, listed boolean, since string")
    entries = entries.withColumn("since", F.col("since").cast("timestamp"))
    out = urllist.judge(captures, entries).orderBy("page_id").collect()
    assert [(r["page_id"], r["blocked"], r["entry_value"]) for r in out] == [(1, True, "bad.com"), (1, True, "bad.com"), (2, False, None), (3, True, "ok.org/p"), (4, False, None), (5, False, None), (6, False, None)]
    assert urllist.judge(captures, entries.limit(0)).where("blocked").count() == 0 and urllist.judge(captures.limit(0), entries).count() == 0


def test_urllist_case(spark):
    captures = spark.createDataFrame([(1, "http://host.org/Docs/x"), (2, "http://host.org/docs/x"), (3, "http://bad.com/"), (4, "http://HOST.org/Docs")], "page_id int, url string").withColumn("fetched_at", F.lit("2024-03-01"))
    entries = spark.createDataFrame([("prefix", "Host.org/Docs", True, "2024-01-01"), ("domain", "bad.com", True, "2024-01-01"), ("domain", "Bad.com", False, "2024-02-01")], "kind string, value string, listed boolean, since string")
    out = urllist.judge(captures, entries.withColumn("since", F.col("since").cast("timestamp"))).orderBy("page_id").collect()
    assert [(r["blocked"], r["entry_value"]) for r in out] == [(True, "host.org/Docs"), (False, None), (False, None), (True, "host.org/Docs")]


def test_linedup(spark):
    rng, pool = random.Random(5), [prose(k, rng_n) for k, rng_n in enumerate([3, 12, 40, 60, 25] * 8)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(3)]
        words = lines[1].split()
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, "\n".join([lines[0], " ".join(words), "", lines[2]]), "s"))
    rows += [(100 + k, prose(77, 60) + f" tail{k}", "s") for k in range(45)] + [(900, None, "s"), (901, "", "s"), (None, pool[0], "s")]
    seen, expected = [], {}
    for i, text, _ in rows:
        if i is None or text is None:
            continue
        for n, line in enumerate(text.split("\n")):
            own = shingles(line)
            if own and any(100 * len(own & s) >= 75 * len(own | s) for s in seen):
                expected.setdefault(i, []).append(n)
            seen.append(own)
    df = documents(spark, rows).withColumn("line_no", F.lit("clash"))
    found = {r["doc_id"]: r["removed"] for r in linedup.removed_lines(df).collect()}
    assert {k: v for k, v in found.items() if v} == expected
    out = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(df).collect()}
    for i, text, _ in rows:
        lines = None if text is None else text.split("\n")
        assert out[i] == (None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in expected.get(i, [])))
    assert linedup.dedup_lines(df.limit(0)).count() == 0


def test_maxent(spark):
    rows = [(i, prose(i, 30), "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "unseen " * 5, "s"), (None, "alpha1", "s"), (5, prose(5, 30), "s")]
    df = documents(spark, rows).withColumn("score", F.lit("clash"))
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)) | F.coalesce(F.col("doc_id") == 102, F.lit(False))
    out = maxent.lm_scores(df, held, maxent.MaxentParams(rounds=3, top_words=50)).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    counts = {}
    for i, t, _ in rows:
        if not (i is not None and (i % 7 == 2 or i == 102)):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for r in out:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        own = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in own)) and r["score"] < 0
    table = maxent.log_table(np.random.default_rng(0).normal(size=(1 + maxent.PREVIOUS + maxent.SKIP + maxent.PAIRS, maxent.CLASSES)).astype(np.float32))
    assert np.allclose((10.0 ** table[:100]).sum(axis=1), 1, atol=1e-4)
    assert maxent.lm_scores(df.limit(0), held).count() == 0
