"""Cases that broke operators once: ties, lost links, repeated ids, clashing names, files that ask for too much, long texts."""

import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ann, linedup, mixing, neardup, quality, sentencepiece, tiff, urllist

from .test_operators import documents, prose, shingles


def similar(a, b, percent=75):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def removed_by_brute_force(rows):
    """{row index: line numbers that an earlier line matches}; rows (id, text) with distinct ids, in order."""
    lines = [(i, n, shingles(line)) for i, t in sorted(rows) for n, line in enumerate((t or "").split("\n"))]
    gone = {}
    for k, (i, n, own) in enumerate(lines):
        if any(similar(own, other) for _, _, other in lines[:k]):
            gone.setdefault(i, []).append(n)
    return gone


def test_ann_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((600, 8))
    x[:, 0] = 1.0
    x[1:, 1:] = rng.normal(size=(599, 7)).round(3)
    x[0, 1:] = 0.0  # every other vector has inner product 1 with the query
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, lambda c: c == 0, ann.AnnParams(tables=8, probes=16)).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(1, 21)) and {r["score"] for r in found} == {1.0}


def test_ann_short_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(1200)] + [(2000 + i, rng.normal(size=5).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, lambda c: c == 2000).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(2001, 2015))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_linedup_families(spark, edits):
    """A family larger than a short list, with variants that are far from its first line and near each other."""
    rng = random.Random(edits)
    base = prose(1, 40).split()
    variants = []
    for v in range(3):
        text = list(base)
        for at in rng.sample(range(40), 4):
            text[at] = f"variant{v}at{at}"
        variants.append(text)
    rows = [(0, " ".join(base))]
    for k in range(1, 130):
        text = list(rng.choice([base, *variants]))
        for at in rng.sample(range(40), rng.randrange(edits + 1)):
            text[at] = f"edit{k}at{at}"
        rows.append((k, prose(1000 + k, 12) + "\n" + " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed_by_brute_force(rows)
    assert {r["doc_id"]: r["removed"] for r in linedup.removed_lines(df).collect() if r["removed"]} == want


def test_linedup_phrases_bring_no_lines_together(spark, monkeypatch):
    """Lines that share a phrase and little else are not held against the phrase's first line; near copies among them are found."""
    rng = random.Random(5)
    phrase = "considerations notwithstanding extraordinarily misunderstood responsibilities acknowledgements institutionalised".split()
    rows = []
    for k in range(160):
        text = rows[rng.randrange(len(rows))][1].split() if k % 4 == 3 else prose(3000 + k, 40).split()
        if k % 4 == 3:
            text[rng.choice((0, 8, 20, 46))] = f"edit{k}"
        else:
            text[10:10] = phrase
        rows.append((k, " ".join(text)))
    seen, whole = [], linedup._differences

    def counted(members, *rest):
        seen.append(members.count())
        return whole(members, *rest)

    monkeypatch.setattr(linedup, "_differences", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed_by_brute_force(rows)
    assert len(want) >= 30
    for most in (linedup.MOST_COMMON, 2):  # with a bound below the tokens of the phrase, the others keep their lists
        monkeypatch.setattr(linedup, "MOST_COMMON", most)
        assert {r["doc_id"]: r["removed"] for r in linedup.removed_lines(df).collect() if r["removed"]} == want
    assert seen[0] == 0 < seen[1]


def test_linedup_rows_that_share_an_id(spark):
    line = prose(7, 9)
    rows = [(1, prose(1, 8)), (2, line + "\nunrelated second line that stays in place"), (2, prose(3, 8) + "\n" + prose(4, 8)), (3, line), (None, line), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit(1)).withColumn("lost", F.lit(2)).withColumn("own_id", F.lit(3))
    out = linedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = sorted((r["doc_id"], r["text"]) for r in out.where("doc_id is not null and text is not null").collect())
    assert texts == sorted([(1, prose(1, 8)), (2, line + "\nunrelated second line that stays in place"), (2, prose(3, 8) + "\n" + prose(4, 8)), (3, ""), (5, "")])


@pytest.mark.parametrize("family", [6, 2])
def test_neardup_of_one_template(spark, family):
    """Many documents share most of their shingles, and only families within are similar enough."""
    rng = random.Random(family)
    base, rows = prose(5, 150).split(), []
    for k in range(180 // family):
        own = list(base)
        for at in rng.sample(range(0, 150, 6), 6):
            own[at] = f"family{k}at{at}"
        for c in range(family):
            text = list(own)
            text[rng.randrange(150)] = f"edit{k}c{c}"
            rows.append((len(rows), " ".join(text)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wrong = [r["doc_id"] for r in neardup.near_duplicates(df).collect() if r["component_id"] != find(r["doc_id"])]
    assert len(wrong) <= 0.01 * len(rows)


def test_clashing_names(spark):
    rows = [(i, prose(i % 4, 30), "ab"[i % 2]) for i in range(8)] + [(None, None, None)]
    df = documents(spark, rows)
    for name in ("plan_source", "copy", "gone_id", "key", "packed", "rare", "rare_key", "hash", "n", "kept"):
        df = df.withColumn(name, F.lit(7))
    assert mixing.mix_documents(df).columns == df.columns
    assert neardup.drop_near_duplicates(df).columns == df.columns
    encoded = sentencepiece.encode(df)
    assert set(encoded.columns) == set(df.columns) - {"text"} | {"ids"} and all(r["key"] == r["rare"] == 7 for r in encoded.collect())
    captures = spark.createDataFrame([(1, "http://ok.org/Path/x", "2024-01-05 00:00:00"), (2, "http://bad.com/", "2024-03-01 00:00:00")], "asked_url int, url string, fetched_at string").withColumn("bucket", F.lit(1)).withColumn("k", F.lit(2))
    entries = spark.createDataFrame([("prefix", "OK.org/Path", True, "2024-01-01"), ("domain", "Bad.com", True, "2024-01-01"), ("domain", "bad.com", False, "2024-02-01")], "kind string, value string, listed boolean, since string").withColumn("since", F.to_timestamp("since"))
    judged = {r["asked_url"]: r["blocked"] for r in urllist.judge(captures, entries).collect()}
    assert judged == {1: True, 2: False}


def test_tiff_that_asks_for_too_much(spark):
    fields = [(256, 4, 1, 200_000), (257, 4, 1, 200_000), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, 200_000), (279, 4, 1, 10)]
    bomb = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    df = spark.createDataFrame([(1, bytearray(bomb)), (2, bytearray(tiff.write_page(b"x" * 128)))], "id int, media binary")
    rows = {r["id"]: r for r in tiff.decode_pages(df).collect()}
    assert "can hold" in rows[1]["error"] and bytes(rows[2]["pixels"]) == b"x" * 128


@pytest.mark.parametrize("scheme", ["inflate", "packbits_decode", "lzw_decode"])
def test_tiff_decodes_no_more_than_a_page_holds(scheme):
    """A strip whose data hold far more than its page: only the page's bytes are made."""
    size = 2_000_000 if scheme == "lzw_decode" else 40_000_000
    encode = {"inflate": zlib.compress, "packbits_decode": tiff.packbits_encode, "lzw_decode": tiff.lzw_encode}[scheme]
    data = b"\x81\0" * (size // 128) if scheme == "packbits_decode" else encode(bytes(size))
    tracemalloc.start()
    made = getattr(tiff, scheme)(data, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[:4096] == bytes(4096) and len(made) < 4096 + 4096 and peak < 2_000_000


def test_tiff_deflate_ends_early():
    whole = zlib.compress(bytes(range(256)) * 16)
    assert tiff.inflate(whole, 4096) == bytes(range(256)) * 16
    with pytest.raises(ValueError):
        tiff.inflate(whole[: len(whole) // 2], 4096)


def _tiff(order, pages):
    """A file of uncompressed pages (width, height, samples, pixels), by hand."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    out, at = bytearray(mark + struct.pack(order + "I", 0)), 4
    for width, height, samples, pixels in pages:
        offset = len(out)
        out += pixels + b"\0" * (len(pixels) % 2)
        out[at : at + 4] = struct.pack(order + "I", len(out))
        short = lambda v: struct.pack(order + "HH", v, 0)
        long = lambda v: struct.pack(order + "I", v)
        bits = short(8) if samples == 1 else long(len(out) + 2 + 12 * 7 + 4)
        entries = [(256, 4, 1, long(width)), (257, 4, 1, long(height)), (258, 3, samples, bits), (259, 3, 1, short(1)), (273, 4, 1, long(offset)), (277, 3, 1, short(samples)), (279, 4, 1, long(len(pixels)))]
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries)
        at = len(out)
        out += struct.pack(order + "I", 0)
        if samples > 1:
            out += struct.pack(order + "H" * samples, *[8] * samples)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages_orders_colours(spark, order):
    pages = [(3, 2, 1, bytes(range(6))), (2, 2, 3, bytes(range(12)))]
    found = list(tiff.read_pages(_tiff(order, pages)))
    assert found == pages


def test_long_texts(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(120_000))
    df = documents(spark, [(1, long, "a"), (2, long, "a"), (3, "short text of six words here", "b")])
    plan = {r["doc_id"]: r["size"] for r in mixing.mix_plan(df).collect()}
    assert plan == {1: 120_000, 2: 120_000, 3: 6}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["removed"] for r in linedup.removed_lines(df).collect()} == {1: [], 2: [0], 3: []}
    decoded = {r["doc_id"]: r["decoded"] for r in sentencepiece.decode(sentencepiece.encode(df)).collect()}
    assert decoded[1] == decoded[2] == long


def _library(unigram):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece.default_model(), "rb") as file:
        model.ParseFromString(file.read())
    if unigram:
        model.trainer_spec.model_type = 1
        scores = {k: score for _, k, score in sentencepiece.as_unigram(sentencepiece.load_vocabulary()).pieces}
        for k, piece in enumerate(model.pieces):
            piece.score = scores.get(k, piece.score)
    return library.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.mark.parametrize("unigram", [True, False])
def test_pieces_are_the_librarys(spark, unigram):
    texts = ["a" * 300, "=" * 500, "xy z" * 5000, "", " ", "日本 x\n\ty", "  two  blanks ", "é" * 1000, "\U0001f600 ok", *[prose(k, 60) for k in range(20)], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = sentencepiece.load_vocabulary()
    vocabulary = sentencepiece.as_unigram(vocabulary) if unigram else vocabulary
    own = _library(unigram)
    for r in sentencepiece.decode(sentencepiece.encode(df, vocabulary, top_units=40), vocabulary).collect():
        text = texts[r["doc_id"]]
        assert (r["ids"], r["decoded"]) == ((None, None) if text is None else (own.encode(text), text))


def test_lattice_tasks_follow_the_count_of_units(spark, monkeypatch):
    """A task of the lattice sorts a bounded count of units, however few bytes these have."""
    dealt, whole = [], sentencepiece.lattice_ids

    def counted(units, vocabulary):
        dealt.append((units.count(), units.rdd.getNumPartitions()))
        return whole(units, vocabulary)

    monkeypatch.setattr(sentencepiece, "UNITS_A_TASK", 4)
    monkeypatch.setattr(sentencepiece, "lattice_ids", counted)
    df = spark.createDataFrame([(k, f"word{k} {prose(k, 60)}") for k in range(200)], "doc_id long, text string")
    assert sentencepiece.encode(df, sentencepiece.as_unigram(sentencepiece.load_vocabulary())).count() == 200
    units, tasks = dealt[0]
    assert tasks >= units // 4 > 2


def test_rare_units_keep_their_share(spark):
    """However few units there are, half of them at least are looked up by the join, so that its rows grow with the texts; hashes do not travel with counts."""
    vocabulary = sentencepiece.as_unigram(sentencepiece.load_vocabulary())
    for n in (40, 400):
        df = spark.createDataFrame([(" ".join(f"w{j}x" for j in range(k, n)),) for k in range(0, n, 10)], "text string")
        units = sentencepiece.count_units(df, vocabulary.pairs)
        assert units.columns == ["unit", "n"]
        frequent, cut, _ = sentencepiece.frequent_units(sentencepiece.encode_units(units, vocabulary), 10_000)
        assert 0 < len(frequent.hashes) <= units.count() // 2 and cut > 1


def test_neardup_work_grows_with_the_rows(spark, monkeypatch):
    """Families of two in one template: rows that meet in lists keep their share when documents double, and components equal brute force."""
    met, whole = [], neardup._apart

    def counted(lists, percent):
        sides = lists.groupBy("leader", "token").agg(F.count("id").alias("all"), F.count_if("listed").alias("under"))
        met[-1] += sides.agg(F.coalesce(F.sum(F.col("all") * F.col("under")), F.lit(0))).first()[0]
        return whole(lists, percent)

    monkeypatch.setattr(neardup, "_apart", counted)
    base = prose(5, 150).split()
    for documents_made in (200, 400):
        rng, rows = random.Random(documents_made), []
        for k in range(documents_made // 2):
            own = list(base)
            for at in rng.sample(range(0, 150, 6), 6):
                own[at] = f"family{k}at{at}"
            for c in range(2):
                text = list(own)
                text[rng.randrange(150)] = f"edit{k}c{c}"
                rows.append((len(rows), " ".join(text)))
        sets = [shingles(t) for _, t in rows]
        want = {i: i - i % 2 if similar(sets[i], sets[i - i % 2]) else i for i in range(len(rows))}
        met.append(0)
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want
        assert met[-1] <= 10 * len(rows)


def test_neardup_looks_components_up_once_a_member(spark, monkeypatch):
    """A large group of one template: its members, and not the rows of what each holds beyond its leader, look components up."""
    looked, whole = [], neardup._with_component

    def counted(rows, found):
        looked.append((sorted(rows.columns), rows.count()))
        return whole(rows, found)

    monkeypatch.setattr(neardup, "_with_component", counted)
    base, rng = prose(5, 150).split(), random.Random(3)
    rows = []
    for k in range(100):
        own = list(base)
        for at in rng.sample(range(0, 150, 6), 6):
            own[at] = f"family{k}at{at}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:75], f"edit{k}", *own[76:]]))]
    sets = [shingles(t) for _, t in rows]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i - i % 2 if similar(sets[i], sets[i - i % 2]) else i for i in range(len(rows))}
    assert looked[0][1] > neardup.SMALL and all(columns == ["id", "leader"] for columns, _ in looked)


def test_linedup_orders_tokens_without_a_count(spark):
    """Tokens are ranked by what a line shows by itself, so plans hold no table of counts."""
    text = "\n".join(["a b", "", "the of\tand  in to shingle", " one Two three four five ", "one two three four five", "x x x x x x x"])
    lines = linedup.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    sets = linedup.tokenised(lines)
    assert len(sets._jdf.queryExecution().toString()) < 50_000
    found = {r["line_no"]: r["tokens"] for r in sets.collect()}
    assert [len(found[k]) for k in range(6)] == [1, 0, 2, 1, 1, 1]
    assert found[3] == found[4] and all(x == sorted(x) for x in found.values())
    rank = [x >> linedup.HASH_BITS for x in found[2]]
    assert rank == [63 - len("shingle"), 63 - len("to")]


def test_neardup_prefixes_join_no_counts(spark):
    """Tokens of several components, those in one component counted before them, the rarest first, without a join as large as all tokens of a group."""
    held = {1: (1, [10, 11, 12, 13]), 2: (2, [11, 12, 13, 14]), 3: (2, [12, 14, 15]), 4: (4, [12, 13])}
    rows = [(0, t, i, c, 4, len(own)) for i, (c, own) in held.items() for t in own]
    found = neardup._prefixes(spark.createDataFrame(rows, "leader long, token long, id long, component long, n long, d long"), 75)
    assert "Join" not in found._jdf.queryExecution().toString()
    at = {(r["id"], r["token"]): (r["at"], r["listed"]) for r in found.collect()}
    assert at == {(1, 11): (1, False), (2, 11): (1, False), (4, 13): (0, True), (4, 12): (1, False)}
