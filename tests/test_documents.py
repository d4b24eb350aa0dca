"""Headers, pages, paragraphs, timeline, library and e-books on small fixtures."""

import hashlib
import itertools
import random
import re
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import cleaning
from folioflow.operators import chapters, headers, library, pagination, segmentation, timeline
from folioflow.sources import epub
from folioflow.sources.epub_writer import archive
from folioflow.sources.markup import blocks_of


def lines(spark, pages):
    rows = [("b", p, n, t) for p, page in enumerate(pages, 1) for n, t in enumerate(page)]
    return spark.createDataFrame(rows, "book_id string, page_no int, line_no int, text string")


def kept(df):
    out = {}
    for r in df.orderBy("page_no", "line_no").collect():
        out.setdefault(r["page_no"], []).append(r["text"])
    return out


def test_headers(spark):
    pages = [["Kitabın Adı", *(x + "abcdefghij"[n - 1] for x in "ABC"), str(n)] for n in range(1, 11)]
    pages[4][4] = "- 5 -"
    pages[6] = ["KİTABIN ADI", "Bölüm 3", "gövde", "Sayfa 7"]
    found = kept(headers.drop_headers(lines(spark, pages)))
    assert found[1] == ["Aa", "Ba", "Ca"] and found[5] == ["Ae", "Be", "Ce"] and found[7] == ["Bölüm 3", "gövde"]
    short = [["x", "y"] for _ in range(10)]
    assert kept(headers.drop_headers(lines(spark, short)))[3] == ["x", "y"]


def test_pages(spark):
    text = " ".join(["Bu cümle burada bitiyor ve sayfayı doldurmaya yarıyor."] * 5)
    blocks = [("b", 0, 0, "Birinci", True)] + [("b", 0, n, text, False) for n in range(1, 13)] + [("b", 1, 13, "İkinci", True), ("b", 1, 14, text, False)]
    sentences = segmentation.sentences(spark.createDataFrame(blocks, "book_id string, chapter int, block_no int, text string, is_heading boolean"))
    pages = pagination.page_texts(pagination.greedy_pages(sentences)).orderBy("page_no").collect()
    assert [p["page_no"] for p in pages] == list(range(1, len(pages) + 1)) and len(pages) > 2
    assert all(800 < len(p["text"]) <= 1505 for p in pages[:-2]) and pages[-1]["chapter"] == 1 and pages[-1]["text"].startswith("İkinci")
    for p in pages:
        parts = [p["text"][s["start"] : s["end"]] for s in p["sentences"]]
        assert all(x and x == x.strip() for x in parts)


def test_paragraphs_and_bookmarks(spark):
    pages = [["Giriş satırı burada uzun uzun devam eder ve bir sonraki sat-", "ıra geçer.", "", "Bölüm Bir", "İlk gövde."], ["— Evet, dedi.", "Devam eden satır uzunca bir şeydir ve sürer"], ["ikinci sayfada biter."]]
    titles = spark.createDataFrame([("b", 1, ["Bölüm Bir"]), ("b", 3, ["Kayıp"])], "book_id string, page_no int, titles array<string>")
    found = chapters.paragraphs(lines(spark, pages), titles).orderBy("block_no").collect()
    assert [r["text"] for r in found][:3] == ["Giriş satırı burada uzun uzun devam eder ve bir sonraki satıra geçer.", "Bölüm Bir", "İlk gövde."]
    assert [r["is_heading"] for r in found][:3] == [False, True, False] and found[-1]["text"].endswith("ikinci sayfada biter.")
    assert [tuple(b) for b in found[-1]["bounds"]][0] == (0, 2) and found[-1]["bounds"][1]["page"] == 3


def plain_paragraphs(pages, titles):
    """(text, chapter, is_heading, bounds) of a book: all lines as events, then groups of them, then their texts."""
    lengths = [len(x) for page in pages for x in page if len(x) > 20]
    typical = statistics.median(lengths) if lengths else 60
    squeeze = lambda x: re.sub(r"\W+", "", x.lower())
    events, chapter = [], -1 if titles.get(0) else 0
    for number, page in enumerate(pages, 1):
        waiting = list(titles.get(number - 1, []))
        for line in page:
            heading = bool(waiting and squeeze(line) and squeeze(line) in squeeze(waiting[0]))
            chapter += heading
            del waiting[:heading]
            events.append((number, line, heading, max(chapter, 0)))
        chapter += len(waiting)
        events += [(number, "", False, 0)] * bool(waiting)
    closes = lambda e: not e[1] or e[2] or e[1][-1] in ".!?…:\"”»’)" and len(e[1]) < typical * 0.8
    opens = [bool(e[1]) and (e[2] or bool(re.match(r"[—–-]\s", e[1])) or k == 0 or closes(events[k - 1])) for k, e in enumerate(events)]
    out = []
    for _, group in itertools.groupby(zip(itertools.accumulate(opens), events), key=lambda x: x[0]):
        held = [e for _, e in group if e[1]]
        if not held:
            continue
        hyphen = [e[1][-1] == "-" and e[1][-2:-1].isalpha() for e in held]
        text, bounds = "", []
        for k, (number, line, *_) in enumerate(held):
            if k == 0 or number != held[k - 1][0]:
                bounds.append((len(text) + (k > 0), number))
            glue = "" if k == 0 or hyphen[k - 1] else " "
            text = (text[:-1] if k and hyphen[k - 1] and line[0] in cleaning.LOWER else text) + glue + line
        out.append((re.sub(r"(?<=[a-zçğıöşüâîû])\d{1,2}(?=[\s.,;:!?)\"”’]|$)", "", text).strip(), held[0][3], held[0][2], bounds))
    return out


def found_paragraphs(spark, pages, titles):
    given = spark.createDataFrame([("b", n, list(t)) for n, t in titles.items()], "book_id string, page_no int, titles array<string>")
    all_pages = spark.createDataFrame([("b", n) for n in range(len(pages))], "book_id string, page_no int")
    rows = [("b", n, k, x) for n, page in enumerate(pages) for k, x in enumerate(page)]
    got = chapters.paragraphs(spark.createDataFrame(rows, "book_id string, page_no int, line_no int, text string"), given, all_pages).orderBy("block_no").collect()
    assert [r["block_no"] for r in got] == list(range(len(got)))
    return [(r["text"], r["chapter"], r["is_heading"], [(b["pos"], b["page"] + 1) for b in r["bounds"]]) for r in got]


BOOKS = {
    "title on a page without lines": ([["Uzunca bir satır burada devam eder ve"], [], ["sonraki sayfada biter."]], {1: ["Resimli"]}),
    "titles of the first page": ([["Bir", "metin"], ["Son"]], {0: ["Bir", "Yok"], 1: ["Yok"]}),
    "hyphens over pages": ([["bir kel-"], ["", "sinin"], ["Anka-"], ["Ra-", "ya -", "- gitti", "x-", "-"]], {}),
    "blank and dialogue": ([["", "— Evet.", "", "", "— Hayır", "dedi."], [""], ["Kısa."], ["Sonra12 geldi"]], {3: ["!!"]}),
    "empty": ([[], []], {0: ["A"]}),
}


@pytest.mark.parametrize("name", list(BOOKS))
def test_paragraphs_equal_a_plain_fold(spark, name):
    pages, titles = BOOKS[name]
    assert found_paragraphs(spark, pages, titles) == plain_paragraphs(pages, titles)


def test_random_paragraphs_equal_a_plain_fold(spark):
    r = random.Random(2)
    lines = ["", "Bölüm bir", "Bölüm iki", "kelime kelime kelime kelime kel-", "ime.", "— Evet.", "Uzun bir satır ki hiç bitmez ve sürüp gider,", "Kısa.", "- x", "İstanbul-", "a1 b2", "..."]
    pages = [[r.choice(lines) for _ in range(r.randrange(6))] for _ in range(120)]
    titles = {n: [r.choice(["Bölüm bir", "Bölüm iki", "Yok", "IV. Bölüm bir!"]) for _ in range(r.randrange(1, 4))] for n in range(120) if r.random() < 0.3}
    assert found_paragraphs(spark, pages, titles) == plain_paragraphs(pages, titles)


def test_documents_equal_a_plain_fold(spark):
    """Every source of sf0.001 as a book, in both directions of the scan."""
    from folioflow.plans import narration

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text").orderBy("doc_id").collect()
    books = {}
    for r in docs:
        books.setdefault(r["source"], []).append((r["doc_id"], [" ".join(unicodedata.normalize("NFC", x).translate(dict.fromkeys(map(ord, cleaning.INVISIBLE))).split()) for x in r["text"].splitlines()]))
    expected = set()
    for source, pages in books.items():
        for k, (text, chapter, _, bounds) in enumerate(plain_paragraphs([p for _, p in pages], {})):
            expected.add((source, k, chapter, hashlib.md5(text.encode()).hexdigest(), pages[bounds[0][1] - 1][0], len(bounds), bounds[-1][0]))
    got = narration.page_paragraphs(spark, "/root/testdata/sf0.001").collect()
    assert {(r["book_id"], r["block_no"], r["chapter"], r["md5"], r["first_page"], r["n_pages"], r["last_pos"]) for r in got} == expected


def test_chapter_titles(spark):
    titles = spark.createDataFrame([("b", 3, ["İki"]), ("b", 1, ["Bir", "Bir buçuk"]), ("c", 0, ["Ön"]), ("c", 5, ["Son"])], "book_id string, page_no int, titles array<string>")
    books = spark.createDataFrame([("b", "Kitap adı", 0), ("c", None, 0), ("d", "", 0)], "book_id string, book_title string, first_page int")
    assert sorted(map(tuple, chapters.chapter_titles(titles, books).collect())) == [("b", 0, "Kitap adı"), ("b", 1, "Bir"), ("b", 2, "Bir buçuk"), ("b", 3, "İki"), ("c", 0, "Ön"), ("c", 1, "Son"), ("d", 0, "Kitap")]


def test_headers_count_pages_without_lines(spark):
    pages = [["Kitap", f"ilk {x}", "gövde", f"son {x}", str(n)] for n, x in enumerate("pqrs")] + [[] for _ in range(16)]
    all_pages = spark.createDataFrame([("b", n) for n in range(1, 21)], "book_id string, page_no int")
    assert kept(headers.drop_headers(lines(spark, pages)))[1] == ["ilk p", "gövde", "son p"]
    # six of twenty pages would have to show the line; bare page numbers go all the same
    assert kept(headers.drop_headers(lines(spark, pages), pages=all_pages))[1] == ["Kitap", "ilk p", "gövde", "son p"]


def test_edge_lines_that_stay(spark):
    """A sentence that happens to stand at a page's edge, elsewhere on each page, is no header."""
    pages = [[f"üst {x} {'p' * k}" for k in range(n % 6)] + ["— Evet."] + [f"alt {x} {'q' * k}" for k in range(3)] for n, x in enumerate("abcdefghijklmnopqrst")]
    found = kept(headers.drop_headers(lines(spark, pages)))
    assert all(found[n + 1] == page for n, page in enumerate(pages))


def test_headings_stay_whole(spark):
    long = "Bölüm başlığı. " * 100
    blocks = spark.createDataFrame([("b", 0, long, True), ("b", 1, "Bir. İki.", False)], "book_id string, block_no int, text string, is_heading boolean")
    assert [(r["sent_no"], r["gap"]) for r in segmentation.sentences(blocks).orderBy("block_no", "sent_no").collect()] == [(0, "heading"), (0, "sentence"), (1, "paragraph")]


def test_greedy_pages_over_batches(spark):
    """Books and chapters that cross Arrow batches, against a plain count; other columns go along."""
    r = random.Random(6)
    rows = [(b, c, k, 0, "x" * r.randrange(1, 400), r.choice(["sentence", "paragraph", "paragraph", "heading"]), k * 7) for b in ("a", "b", "c") for c in range(4) for k in range(c * 60, c * 60 + 60)]
    df = spark.createDataFrame(rows, "book_id string, chapter int, block_no int, sent_no int, sentence string, gap string, extra int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        found = {(x["book_id"], x["block_no"]): (x["page_no"], x["extra"]) for x in pagination.greedy_pages(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    page = used = 0
    last = None
    for b, c, k, _, text, gap, extra in rows:
        if last != (b, c):
            page, used = (1 if last is None or last[0] != b else page + 1), 0
        elif used and (used + len(text) > 1500 or gap == "heading" and used > 900):
            page, used = page + 1, 0
        used, last = used + len(text) + 1, (b, c)
        assert found[b, k] == (page, extra)


def test_timeline(spark):
    rows = [("b", 1, 0, "Başlık", "heading"), ("b", 1, 1, "Dr. Ali 1923'te geldi.", "paragraph"), ("b", 1, 2, "— ......", "sentence")]
    timed = timeline.timeline(spark.createDataFrame(rows, "book_id string, page_no int, sent_no int, sentence string, gap string"))
    found = timed.orderBy("sent_no").collect()
    assert found[1]["spoken"] == "Doktor Ali bin dokuz yüz yirmi üçte geldi." and found[1]["start_ms"] == found[0]["end_ms"] + 900
    assert found[2]["start_ms"] == found[2]["end_ms"]
    (page,) = timeline.page_durations(timed).collect()
    assert page["duration_ms"] == found[2]["end_ms"] + 250


def test_library(spark):
    pages = spark.createDataFrame([("b", 0, 1), ("b", 0, 2), ("b", 1, 3)], "book_id string, chapter int, page_no int")
    audio = spark.createDataFrame([("b", 1, 10, "0001.mp3"), ("b", 2, 20, "0002.mp3")], "book_id string, page_no int, duration_ms long, file string")
    assert [tuple(r) for r in library.complete_chapters(pages, audio).collect()] == [("b", 0, 2)]
    manifest = library.chapter_manifest(pages, audio, spark.createDataFrame([("b", 0, "Bölüm 1")], "book_id string, chapter int, title string"))
    assert manifest.collect()[0]["file_name"] == "001 - Bölüm 1.mp3"
    assert library.playlist(manifest).collect()[0]["playlist"] == "#EXTM3U\n001 - Bölüm 1.mp3\n"


def test_markup():
    assert blocks_of('<p>Metin<a epub:type="noteref" href="#n1">1</a> sürer.</p><aside epub:type="footnote">not</aside>') == [("Metin sürer.", False)]
    assert blocks_of("<p>Dopamin salgılanır<sup>2</sup>; x+1 değil<sup>a</sup>.</p>") == [("Dopamin salgılanır; x+1 değila.", False)]


def test_epub(spark):
    body = "<html><head><title>t</title></head><body>{}</body></html>"
    chapters_ = [("a", body.format("<h1>Bir</h1><p>x<br/>y &amp; z</p><script>s</script>")), ("b", body.format("<p>Ara</p>")), ("c", body.format("<h1>Üç</h1><p>son</p>"))]
    locked = {"META-INF/encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="{}"/></EncryptedData></e>'}
    books = {
        "nav": archive(chapters_[:2], "Deneme Kitabı", "Ayşe Yazar", nav=[("a.xhtml#bas", "Bölüm 1"), ("b.xhtml#bas", "Bölüm 2")]),
        "ncx": archive(chapters_[:2], ncx=[("a.xhtml", "NCX 1"), ("b.xhtml", "NCX 2")]),
        "none": archive(chapters_),
        "drm": archive(chapters_, extra={k: v.format("http://x/aes128-cbc") for k, v in locked.items()}),
        "fonts": archive(chapters_[1:2], extra={k: v.format("http://www.idpf.org/2008/embedding") for k, v in locked.items()}),
        "bad": b"no archive",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "book_id string, content binary")
    info, blocks, rejects = epub.read_epubs(files)
    found = {}
    for r in blocks.orderBy("book_id", "block_no").collect():
        found.setdefault(r["book_id"], []).append((r["text"], r["chapter"], r["is_heading"], r["chapter_title"]))
    assert found["nav"] == [("Bir", 0, True, "Bölüm 1"), ("x", 0, False, "Bölüm 1"), ("y & z", 0, False, "Bölüm 1"), ("Ara", 1, False, "Bölüm 2")]
    assert [x[3] for x in found["ncx"]] == ["NCX 1"] * 3 + ["NCX 2"]
    assert [(x[1], x[3]) for x in found["none"]] == [(0, "Bir")] * 4 + [(1, "Üç")] * 2
    assert len(found["fonts"]) == 1
    assert {r["book_id"]: r["reason"] for r in rejects.collect()} == {"drm": "DRM", "bad": "unreadable: BadZipFile"}
    assert info.where("book_id = 'nav'").select("title", "author", "lang").first() == ("Deneme Kitabı", "Ayşe Yazar", "tr")


def test_chapter_rules(spark):
    marks = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("b", 1, 3), ("c", 2, 1)], "book_id string, level int, ord int")
    assert {tuple(r) for r in chapters.bookmark_level(marks).collect()} == {("b", 1), ("c", 2)}
    assert spark.range(1).select(segmentation.source_page(F.expr("array(struct(0 as pos, 7 as page), struct(20 as pos, 8 as page))"), F.lit(19))).first()[0] == 7


def test_source_pages_beyond_sixty(spark, tmp_path):
    from folioflow.plans import narration

    spark.createDataFrame([(1, 51_300), (2, 100)], "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["doc_id"], r["at"]): r["page"] for r in narration.source_pages(spark, str(tmp_path)).collect()}
    assert found == {(d, at): max(1, (at - 40) // 513 + 1) for d, n in ((1, 51_300), (2, 100)) for at in range(0, n + 1, 350)}
