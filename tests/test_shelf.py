"""Versioned tables, the parsed-book cache, production with resume, change detection, rejects and entities."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import cleaning, formats
from folioflow.functions.entities import unescaped_html
from folioflow.functions.speech import ABBREVIATIONS, expand_abbreviations
from folioflow.operators import library, production
from folioflow.plans import narration, shelf
from folioflow.sources import cache, epub, epub_writer, files, versions
from folioflow.sources.epub_writer import archive


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, path, fmt="parquet"):
    return versions.Versions(spark, str(path), "k", {"t": ("k string, n int", ["n"]), "u": ("k string, m int", [])}, 4, fmt)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_versions_replace_by_key(spark, tmp_path, fmt):
    store = table(spark, tmp_path / "s", fmt)
    make = lambda xs, schema: spark.createDataFrame(xs, schema)
    keys = lambda *ks: make([(k,) for k in ks], "k string")
    assert store.read("t").count() == 0 and store.lookup("t", "a").count() == 0
    assert store.replace(keys(*"abcde"), t=make([(k, n) for k in "abcde" for n in range(3)], "k string, n int"), u=make([("a", 1), ("b", 2)], "k string, m int")) == 1
    # a replaced key loses its rows in tables to drop, too; others stay as they are, and a key without rows is gone
    assert store.replace(keys("b"), t=make([("b", 7)], "k string, n int")) == 2
    assert rows(store.read("u")) == [("a", 1), ("b", 2)] and rows(store.lookup("t", "b")) == [("b", 7)]
    store.replace(keys(), t=make([("b", n) for n in range(3)], "k string, n int"))
    assert store.replace(keys("a", "z"), drop=["u"], t=make([("a", 9)], "k string, n int")) == 4
    assert rows(store.read("t")) == sorted([("a", 9), *((k, n) for k in "bcde" for n in range(3))]) and rows(store.read("u")) == [("b", 2)]
    assert rows(store.lookup("t", "a", "e", "nobody")) == [("a", 9), ("e", 0), ("e", 1), ("e", 2)]
    asked = make([("a", 9, "x"), ("b", 7, "y"), ("b", 1, "z")], "k string, n int, why string")
    assert sorted(r["why"] for r in store.lookups("t", asked, ["k", "n"]).collect()) == ["x", "z"]
    assert store.replace(keys()) == 4
    store.replace(keys("b"), drop=["t", "u"])
    assert rows(store.lookup("t", "b")) == [] and rows(store.read("u")) == []


def test_lookup_reads_one_bucket(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "s"), "k", {"t": ("k string, n int", ["n"])}, 16)
    store.replace(spark.createDataFrame([], "k string"), t=spark.createDataFrame([(f"k{i}", i) for i in range(400)], "k string, n int"))
    found = store.lookup("t", "k7")
    assert rows(found) == [("k7", 7)]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [(bucket" in scan
    files_of = lambda df: df.select(F.input_file_name()).distinct().count()
    bucket = store.read("t").select(store.bucket_of(F.lit("k7"))).first()[0]
    whole = spark.read.parquet(str(tmp_path / "s" / "t" / "version=1"))
    assert files_of(found) == 1 and files_of(whole) >= 16 and files_of(whole.where(F.col("bucket") == bucket)) <= 2


def test_crash_between_data_and_commit(spark, tmp_path, monkeypatch):
    store = table(spark, tmp_path / "s", "json")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    store.replace(first.select("k"), t=first)

    def stop(*_):
        raise RuntimeError("power cut")

    later = spark.createDataFrame([("a", 5)], "k string, n int")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", stop)
        with pytest.raises(RuntimeError):
            store.replace(later.select("k"), t=later)
    assert rows(store.read("t")) == [("a", 1), ("b", 2)]
    # a task that fails while writing leaves the old version too, and the next change takes the same number
    broken = later.withColumn("n", F.when(F.col("k") == "a", F.raise_error(F.lit("task"))).cast("int"))
    with pytest.raises(Exception, match="task"):
        store.replace(later.select("k"), t=broken)
    assert rows(store.read("t")) == [("a", 1), ("b", 2)]
    assert store.replace(later.select("k"), t=later) == 2 and rows(store.read("t")) == [("a", 5), ("b", 2)]


def book_files(spark, texts):
    return spark.createDataFrame([(k, f"{k}.txt", n, t) for n, (k, t) in enumerate(texts.items())], "book_id string, source string, doc_id int, text string")


def test_cache_parses_once_and_drops_dependents(spark, tmp_path):
    shelf_ = cache.open_cache(spark, str(tmp_path / "c"), 4)
    found = book_files(spark, {"a": "Bir cümle. İki cümle.", "b": "Üç.", "c": "   "})
    assert {r["book_id"] for r in cache.parse_new(shelf_, found, shelf._parse, 1).collect()} == {"a", "b", "c"}

    def never(_):
        raise AssertionError("nothing to parse")

    assert cache.parse_new(shelf_, found.where("book_id <> 'c'"), never, 1).count() == 0
    audio = spark.createDataFrame([("a", "m-x", 1, "0001.mp3", 10), ("b", "m-x", 1, "0001.mp3", 20), ("lost", "m-x", 1, "f", 1)], "book_id string, variant string, page_no int, file string, duration_ms long")
    cache.add_audio(shelf_, audio)
    cache.add_audio(shelf_, audio.where("book_id = 'b'").withColumn("duration_ms", F.lit(30).cast("long")))
    assert rows(shelf_.read("audio").select("book_id", "duration_ms")) == [("a", 10), ("b", 30)] and shelf_.read("pages").count() == 2
    assert {r["book_id"] for r in cache.parse_new(shelf_, found.where("book_id = 'b'"), shelf._parse, 2).collect()} == {"b"}
    assert rows(shelf_.read("audio").select("book_id")) == [("a",)] and rows(shelf_.read("books").select("book_id", "parser_version")) == [("a", 1), ("b", 2)]
    asked = cache.page_request(spark.createDataFrame([("a:1",), ("x:a:2",), ("a",), ("a:one",)], "spec string"))
    assert [tuple(r) for r in asked.collect()] == [("a:1", "a", 1), ("x:a:2", "x:a", 2), ("a", "", None), ("a:one", "a", None)]
    said = cache.spoken_sentences(shelf_.lookups("pages", asked.select("book_id", "page_no"), ["book_id", "page_no"]).select("book_id", "page_no", "text", "sentences"))
    assert [r["sentence"] for r in said.orderBy("sent_no").collect()] == ["Bir cümle.", "İki cümle."]


def test_cache_parses_blank_files_once(spark, tmp_path):
    shelf_ = cache.open_cache(spark, str(tmp_path / "c"), 4)
    found = book_files(spark, {"a": "Bir cümle.", "b": "Üç.", "c": " \n ", "d": ""})
    assert {r["book_id"] for r in cache.parse_new(shelf_, found, shelf._parse, 1).collect()} == {"a", "b", "c", "d"}

    def never(_):
        raise AssertionError("nothing to parse")

    assert cache.parse_new(shelf_, found, never, 1).count() == 0
    assert rows(shelf_.read("books").select("book_id", "parser_version")) == [("a", 1), ("b", 1)]
    # a version that finds nothing in a book leaves it, one that finds text in a blank file makes it a book
    later = book_files(spark, {"b": " ", "c": "Artık dolu."})
    assert cache.parse_new(shelf_, later, shelf._parse, 2).count() == 2 and cache.parse_new(shelf_, later, never, 2).count() == 0
    assert rows(shelf_.read("books").select("book_id", "parser_version")) == [("a", 1), ("b", 1), ("c", 2)] and shelf_.read("pages").count() == 3
    assert cache.parse_new(shelf_, found.where("book_id <> 'c'"), never, 1).count() == 0


def test_parsed_cache_counts_blank_documents_once(spark, tmp_path):
    texts = ["Bir cümle.", "", "  ", "İki.", "\n"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0,), (2,), (3,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    found = shelf.parsed_cache(spark, str(tmp_path)).orderBy("source").select("source", "parser_version", "pages", "chars", "audio_pages", "parsed_again").collect()
    assert [tuple(r) for r in found] == [("doc0", 2, 1, 10, 0, 0), ("doc3", 2, 1, 4, 0, 0)]


def test_production_takes_up_what_is_left(spark, tmp_path):
    shelf_ = cache.open_cache(spark, str(tmp_path / "c"), 4)
    texts = {f"b{k}": "\n".join(f"Sayfa satırı {j} burada. {'KIRIK' if j in (5, 80) and k < 2 else 'Sağlam'} cümle. — ......" for j in range(120)) for k in range(3)}
    cache.parse_new(shelf_, book_files(spark, texts), shelf._parse, 1)
    pages = shelf_.read("pages").select("book_id", "page_no", "text", "sentences").collect()
    wanted = shelf_.read("pages").select("book_id", "page_no").where("page_no <> 2")
    same = lambda text, heading: text
    first = {(r["book_id"], r["page_no"]): r for r in production.run_production(shelf_, production.mock_engine("KIRIK"), wanted.union(wanted), same).collect()}
    assert set(first) == {(p["book_id"], p["page_no"]) for p in pages if p["page_no"] != 2}
    for p in pages:
        if p["page_no"] == 2:
            continue
        r, samples = first[p["book_id"], p["page_no"]], 0
        said = [p["text"][s["start"] : s["end"]] for s in p["sentences"]]
        for text, s in zip(said, p["sentences"]):
            samples += (len(text) * 80 if any(c.isalnum() for c in text) else 0) + {"sentence": 2000, "paragraph": 4800}[s["gap"]]
        if any("KIRIK" in t for t in said):
            bad = next(t for t in said if "KIRIK" in t)
            assert (r["state"], r["duration_ms"], r["error"]) == ("failed", None, f"cannot read 'KIRIK' in: {bad}"[:200])
        else:
            assert (r["state"], r["duration_ms"]) == ("produced", round(samples / 8))
    failed = {k for k, r in first.items() if r["state"] == "failed"}
    assert failed and len(failed) < len(first)
    again = {(r["book_id"], r["page_no"]): r["state"] for r in production.run_production(shelf_, production.mock_engine(), wanted, same).collect()}
    assert {k for k, s in again.items() if s == "produced"} == failed and {k for k, s in again.items() if s == "skipped"} == set(first) - failed
    assert {r["state"] for r in production.run_production(shelf_, production.mock_engine(), wanted, same).collect()} == {"skipped"}


def test_engine_that_does_not_load(spark):
    def load():
        raise OSError("no voice")

    page = spark.createDataFrame([("b", 1, "Bir.", [(0, 4, "paragraph")])], "book_id string, page_no int, text string, sentences array<struct<start:int,end:int,gap:string>>")
    (r,) = production.produce(page, production.Engine("x", "y", 8000, load)).collect()
    assert (r["state"], r["error"]) == ("failed", "no voice")
    (r,) = production.produce(page, production.mock_engine(), keep_pcm=True).collect()
    assert len(r["pcm"]) == 2 * (4 * 80 + 4800) and [tuple(s) for s in r["spans"]] == [(0, 40)]


def test_change_signature(spark):
    entries = [(b, f"f{k}", 1000 * k + b) for b in range(3) for k in range(50)]
    frame = lambda xs: spark.createDataFrame(xs, "book_id int, name string, s long").select("book_id", "name", F.timestamp_seconds("s").alias("mtime"))
    signature = lambda df: dict(map(tuple, library.change_signature(df).collect()))
    one = signature(frame(entries).coalesce(1))
    shuffled = entries[:]
    random.Random(1).shuffle(shuffled)
    assert one == signature(frame(shuffled).repartition(7)) and len(set(one.values())) == 3
    now = [e for e in entries if e != (1, "f3", 3001)] + [(1, "new", 5), (3, "first", 1)]
    now = [(b, n, s + 1) if (b, n) == (0, "f0") else (b, n, s) for b, n, s in now]
    assert rows(library.changed_entries(frame(entries), frame(now))) == [(0, "f0", "changed"), (1, "f3", "removed"), (1, "new", "added"), (3, "first", "added")]
    # two entries that trade names or times are another multiset, a repeated entry too
    assert signature(frame([(0, "a", 1), (0, "b", 2)])) != signature(frame([(0, "a", 2), (0, "b", 1)]))
    assert signature(frame([(0, "a", 1)])) != signature(frame([(0, "a", 1), (0, "a", 1)]))


def test_rejects_add_up(spark, tmp_path):
    side = tmp_path / "ses"
    side.mkdir()
    texts = {"0001.json": '{"sayfa": 1, "dosya": "0001.mp3",\n "sure_ms": 40, "zamanlar": [[0, 40]], "uretim_sn": 0.5}', "0002.json": "{", "0003.json": '{"sayfa": 3}', "0004.json": '{"sure_ms": "x"}', "0005.json": "\n"}
    for name, text in texts.items():
        (side / name).write_text(text)
    (side / "0001.mp3").write_bytes(b"x")
    good, refused = files.sidecars(spark, str(tmp_path))
    assert [(r["page_no"], r["duration_ms"], r["spans"][0]["end_ms"], r["synth_s"]) for r in good.collect()] == [(1, 40, 40, 0.5)]
    assert {r["path"][-9:]: r["reason"] for r in refused.collect()} == {"0002.json": "not json", "0003.json": "no duration", "0004.json": "type", "0005.json": "not json"}
    inbox = tmp_path / "in.epub"
    inbox.mkdir()
    for name in ("a.EPUB", "b.pdf", "c.txt", "noext", ".pdf", "d.pdf.part"):
        (inbox / name).write_bytes(name.encode())
    found, refused = files.book_files(spark, str(inbox))
    assert {(r["path"].rsplit("/", 1)[1], r["kind"]) for r in found.collect()} == {("a.EPUB", "epub"), ("b.pdf", "pdf")}
    # hidden files are not listed at all
    assert {(r["path"].rsplit("/", 1)[1], r["detail"]) for r in refused.collect()} <= {("c.txt", "txt"), ("noext", "none"), (".pdf", "none"), ("d.pdf.part", "part")}


def test_listings(spark, tmp_path):
    for name in ("001 - Bir.mp3", "012 - İki.mp3", "x.mp3", "tr_TR-dfki-medium.onnx", "tr_TR-b-low.onnx"):
        (tmp_path / name).write_bytes(b"12345")
    listed = files.listing(spark, str(tmp_path))
    assert {(r["name"], r["size"]) for r in listed.collect()} >= {("001 - Bir.mp3", 5)} and "content" not in listed.columns
    assert {(r["name"], r["chapter"]) for r in files.chapter_files(listed.where("name like '%mp3'")).collect()} == {("001 - Bir.mp3", 0), ("012 - İki.mp3", 11), ("x.mp3", None)}
    assert [r["voice"] for r in files.voices(listed).collect()] == ["dfki"]
    texts = spark.createDataFrame([('{"genel_adres": "https://x/", "kullanici": "u"}',), ("{",), (None,)], "value string")
    assert [tuple(r) for r in files.settings(texts).collect()] == [("https://x/", "u"), (None, None), (None, None)]
    books = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", None)], "book_id string, mtime int")
    assert [r["book_id"] for r in library.newest_first(books).collect()] == ["c", "a", "b", "d"]


ENTITIES = [
    "a &amp; b", "&lt;p&gt;", "&ampx &notit; &notin; &not; &ltx", "&unknown; &x &;", "&#65;&#x41;&#X41", "&#0;|&#128;|&#x9f;|&#129;|&#13;", "&#xD800;|&#x110000;|&#99999999999999999999;", "&#1;|&#11;|&#xFFFE;|&#x1FFFF;|&#xFDD0;|&#127;",
    "&#x1F600; &#128512", "&amp;lt;", "&hellip;&mdash;&nbsp;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&Aacute&eacute", "&frac12 &frac34;", "& plain & text &", "&#", "&#x", "&#xg;", "&copyright;", "&GT;&gt&AMP", "é&uumlö", "", "&zwj;&acE;",
]


def test_entities_as_the_language_decodes_them(spark):
    found = spark.createDataFrame([(k, t) for k, t in enumerate(ENTITIES)], "k int, t string").select("k", unescaped_html(F.col("t")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in found] == [html.unescape(t) for t in ENTITIES]
    assert spark.range(1).select(unescaped_html(F.lit(None).cast("string"))).first()[0] is None


def test_abbreviations_at_once_equal_the_rules_in_order(spark):
    r = random.Random(4)
    pieces = ["Dr.", "Prof. ", "Yrd.Doç.", "Yrd. Doç. ", "[ed.n.]", "[Ç. N.]", "y.n.", "M.Ö. ", "M.S.", "vb.", "vs. ", "s. 4", "Sf.12", "no. 5", "No.", "A.Ş.", "Ltd. Şti.", "xDr.", "bkz.", "Bkz. ", " ", "5", "a", "Örn.", "haz.", "dr.", "op.", "Op.", "]", "[", "é", "cad. Cad."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(1500)]
    chain = F.col("t")
    for rule, spoken in ABBREVIATIONS:
        chain = F.regexp_replace(chain, "(?U)" + rule, spoken)
    wrong = spark.createDataFrame([(t,) for t in texts], "t string").select("t", expand_abbreviations(F.col("t")).alias("a"), chain.alias("b")).where("a <> b").collect()
    assert wrong == []


def test_lines_and_page_names(spark):
    text = "a\r\nb\rc\n\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l\n"
    texts = [text, "", "x", "\n", None, "son\r\n\r\n"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", cleaning.line_breaks(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in found] == [None if t is None else t.splitlines() for t in texts]
    (r,) = spark.range(1).select(formats.variant_path(F.lit("b"), F.lit("piper"), F.lit("dfki")).alias("p"), formats.percent_encoded(F.lit("a b/ç~*.mp3")).alias("e"), formats.local_name(F.lit("{urn:x}item")).alias("l")).collect()
    assert tuple(r) == ("b/ses/piper-dfki", "a%20b/%C3%A7~%2A.mp3", "item")


def test_summary_line_is_json(spark):
    outcome = spark.createDataFrame([("b", 1, "failed", None, 'x"ğ'), ("b", 2, "produced", 1500, None)], "book_id string, page_no int, state string, duration_ms long, error string")
    (r,) = library.summary_line(library.run_summary(outcome)).collect()
    assert json.loads(r["line"]) == {"book_id": "b", "selected": 2, "skipped": 0, "produced": 1, "failed": 1, "audio_s": 1.5, "first_failures": [{"page_no": 1, "error": 'x"ğ'}]} and r["ok"] is False


def test_archive_limits(spark, monkeypatch):
    many = archive([(f"c{k}", "<p>x</p>") for k in range(30)])
    large = archive([("big", "<p>" + "0" * 200_000 + "</p>")])
    books = spark.createDataFrame([("many", bytearray(many)), ("large", bytearray(large)), ("fine", bytearray(archive([("a", "<p>Metin.</p>")])))], "book_id string, content binary")
    assert {r["book_id"] for r in epub.read_epubs(books)[2].collect()} == set()
    monkeypatch.setattr(epub, "MOST_ENTRIES", 20)
    monkeypatch.setattr(epub, "MOST_BYTES", 100_000)
    totals = {r["book_id"]: r for r in epub.archive_totals(books).collect()}
    assert totals["many"]["entries"] > 30 and totals["large"]["total"] > 200_000 and totals["fine"]["problem"] is None
    _, blocks, refused = epub.read_epubs(books)
    assert {r["book_id"] for r in refused.collect()} == {"many", "large"} and {r["book_id"] for r in blocks.collect()} == {"fine"}


def test_the_manifest_says_what_is_read(spark):
    odd = archive([("a", "<p>\0 Bir.</p>"), ("b", "<p>İki.</p>")], nav=[("a.xhtml", "Bölüm")], extra={"OPS/loose.xhtml": "<p>Dışarıda.</p>", "OPS/cover.bin": "\1\2"})
    books = spark.createDataFrame([("odd", bytearray(odd)), ("empty", bytearray(epub_writer._written({})))], "book_id string, content binary")
    members = {(r["book_id"], r["name"], r["reason"]) for r in epub.members(books).collect()}
    assert members == {("odd", n, None) for n in ("META-INF/container.xml", "OPS/book.opf", "OPS/a.xhtml", "OPS/b.xhtml", "OPS/nav.xhtml")} | {("empty", None, "no text")}
    assert [r["text"] for r in epub.read_epubs(books)[1].orderBy("block_no").collect()] == ["\0 Bir.", "İki."]


def test_queries_on_the_smallest_tables(spark):
    assert narration.heading_sentences(spark, "/root/testdata/sf0.001").where("gap = 'heading'").count() > 0


def test_pages_are_filled_in_the_pass_that_numbers_them(spark):
    """One row a page, as numbering, offsets and grouping give, for pages that run over Arrow batches, with rows dealt once."""
    from pyspark.sql import functions as F

    from folioflow.operators import pagination

    rows = [(f"b{b}", c, k, s, f"Satır {b} {c} {k} {s} " + "ğé" * (k % 90), gap) for b in range(3) for c in range(2) for k in range(60) for s, gap in enumerate(("sentence", "heading" if k % 9 == 0 else "paragraph"))]
    df = spark.createDataFrame(rows, "book_id string, chapter int, block_no int, sent_no int, sentence string, gap string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = pagination.filled_pages(df, 300)
        want = pagination.page_texts(pagination.greedy_pages(df, 300)).select(*found.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found.select(F.countDistinct("book_id")).first()[0] == 3
