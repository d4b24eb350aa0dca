"""Queries on stores, listings and sources of the library, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import entities, formats
from folioflow.operators import library, pagination, production, segmentation, selection
from folioflow.plans.oracles import BLANK, PAGED, SENTENCES
from folioflow.sources import cache, epub, files, versions
from folioflow.sources.epub_writer import pack_books
from folioflow.store import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/folioflow-{kind}-{uuid.uuid4().hex}"


def _book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as book files, one for each content; the least document names it."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", formats.content_id(F.encode("text", "UTF-8")).alias("book_id"))
    least = docs.groupBy("book_id").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(least, ["book_id", "doc_id"], "left_semi").select("book_id", F.concat(F.lit("doc"), "doc_id").alias("source"), "doc_id", "text")


def _parse(found: DataFrame) -> DataFrame:
    blocks = found.select("book_id", F.lit(0).alias("chapter"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"), F.lit(False).alias("is_heading"))
    return pagination.filled_pages(segmentation.sentences(blocks))


def _filled_cache(spark: SparkSession, sf_dir: str) -> tuple[versions.Versions, DataFrame]:
    """A cache with all documents parsed by version 1, and audio for the pages of labelled ones."""
    found = _book_files(spark, sf_dir)
    shelf = cache.open_cache(spark, _folder(spark, "shelf"), 16)
    cache.parse_new(shelf, found, _parse, 1)
    labelled = found.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("book_id")
    made = shelf.read("pages").join(labelled, "book_id", "left_semi").select("book_id", formats.variant_key(F.lit("mock"), F.lit("sine")).alias("variant"), "page_no", formats.page_file_name(F.col("page_no"), "mp3").alias("file"), (F.length("text") * 10).cast("long").alias("duration_ms"))
    cache.add_audio(shelf, made)
    return shelf, found


def parsed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books after three runs: all files by version 1, all again (nothing left to parse), a third of them by version 2, which loses their audio."""
    shelf, found = _filled_cache(spark, sf_dir)
    again = cache.parse_new(shelf, found, _parse, 1).count()
    cache.parse_new(shelf, found.where("doc_id % 3 = 0"), _parse, 2)
    audio = shelf.read("audio").groupBy("book_id").agg(F.count(F.lit(1)).alias("audio_pages"), F.sum("duration_ms").alias("audio_ms"))
    return shelf.read("books").join(audio, "book_id", "left").select("book_id", "parser_version", "source", "pages", "chars", F.coalesce("audio_pages", F.lit(0)).cast("long").alias("audio_pages"), F.coalesce("audio_ms", F.lit(0)).cast("long").alias("audio_ms"), F.lit(again).cast("long").alias("parsed_again"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with something to speak of the pages that texts ``book:page`` ask for, one for every label; most books have no page 2 or 3."""
    shelf, found = _filled_cache(spark, sf_dir)
    asked = found.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat("book_id", F.lit(":"), F.col("doc_id") % 3 + 1).alias("spec"))
    pages = shelf.lookups("pages", cache.page_request(asked).select("doc_id", "book_id", "page_no"), ["book_id", "page_no"])
    said = cache.spoken_sentences(pages.select("doc_id", "page_no", "text", "sentences"), speak=lambda text, heading: text)
    return said.select("doc_id", "page_no", "sent_no", F.md5("sentence").alias("md5"))


def produced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all pages: the first engine fails on pages with an ü, the second, which gets only those, on two of them in a row."""
    shelf = cache.open_cache(spark, _folder(spark, "shelf"), 16)
    cache.parse_new(shelf, _book_files(spark, sf_dir), _parse, 1)
    wanted = materialize(shelf.read("pages").select("book_id", "page_no"))
    same = lambda text, heading: text
    first, second = (production.run_production(shelf, production.mock_engine(refused), wanted, same) for refused in ("ü", "üü"))
    both = first.select("book_id", "page_no", F.col("state").alias("first")).join(second.withColumnRenamed("state", "second"), ["book_id", "page_no"])
    return both.select("book_id", "page_no", "first", "second", "duration_ms", "error")


def _shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents each as an e-book, a file a document, whose lines stand in markup of several kinds.

    By place in the book: files 3 and 4 have no heading, 7 is outside the reading order, 8 is no page, 9 has an item before it of the same id, 2 and 5
    are in the contents. By book: contents as nav, ncx or none; titles missing; parts encrypted as fonts or otherwise; archives cut off.
    """
    place, number = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", place.alias("p"), number.alias("b"))
    safe = lambda x: formats.escaped_html(x)
    forms = [
        lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>")), lambda x: F.concat(F.lit("<div>"), safe(x), F.lit("<sup>3</sup></div>")),
        lambda x: F.concat(F.lit("<ul><li>"), safe(x), F.lit('<a epub:type="noteref" href="#n1">[1]</a></li></ul>')),
        lambda x: F.concat(F.lit("<blockquote><em> "), safe(x), F.lit("</em><script>var x = 1;</script><img src='x'/></blockquote>")),
        lambda x: F.concat(F.lit('<aside epub:type="footnote"><p>'), safe(x), F.lit("</p></aside>")),
    ]
    line = lambda x, i: F.coalesce(*[F.when(i % len(forms) == k, form(x)) for k, form in enumerate(forms)])
    head = F.when(F.col("p").isin(3, 4), "").otherwise(F.concat(F.lit("<h2>Title <i>"), "doc_id", F.lit("</i></h2>")))
    markup = F.concat(F.lit("<html><head><title>t</title><style>p {}</style></head><body>"), head, F.array_join(F.transform(F.split("text", "\n"), line), "\n"), F.lit("</body></html>"))
    b = F.col("b")
    return docs.select(
        F.concat(F.lit("b"), "b").alias("book_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("bölüm "), "doc_id", F.lit(".xhtml")).alias("name"), markup.alias("markup"), F.when(F.col("p").isin(2, 5), F.concat(F.lit("Part "), "doc_id")).alias("label"),
        (F.col("p") != 7).alias("linear"), F.when(F.col("p") == 8, "image/svg+xml").otherwise("application/xhtml+xml").alias("media_type"), (F.col("p") == 9).alias("twice"), F.when(b % 4 == 1, "").otherwise(F.concat(F.lit("Kitap "), "b")).alias("title"),
        F.concat(F.lit("Yazar & "), "b").alias("author"), F.when(b % 2 == 0, "en").otherwise("").alias("lang"), F.when(b % 3 == 0, "nav").when(b % 3 == 1, "ncx").otherwise("none").alias("contents"),
        F.when(b % 7 == 3, "http://www.idpf.org/2008/embedding").when(b % 7 == 4, "http://www.w3.org/2001/04/xmlenc#aes128-cbc").alias("scheme"), F.when(b % 11 == 10, 200).alias("broken"),
    )


def shelved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of e-books that were packed from documents: texts, headings, chapters and their titles."""
    _, blocks, _ = epub.read_epubs(pack_books(_shelved(spark, sf_dir)))
    return blocks.select("book_id", "block_no", F.md5("text").alias("md5"), "is_heading", "chapter", "chapter_title")


def shelved_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same e-books say of themselves, or why they are refused, and how many members their archives list."""
    packed = materialize(pack_books(_shelved(spark, sf_dir)))
    books, _, refused = epub.read_epubs(packed)
    totals = epub.archive_totals(packed).select("book_id", "entries")
    return totals.join(books, "book_id", "left").join(refused, "book_id", "left").select("book_id", "entries", "title", "author", "lang", "reason")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as directory entries of their customers."""
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.concat(F.lit("f"), "o_orderkey").alias("name"), F.col("o_orderdate").cast("timestamp").alias("mtime"), F.col("o_orderkey").alias("k"))


def change_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.change_signature(_listing(spark, sf_dir))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries before and after: some rewritten, some gone, some new."""
    before = _listing(spark, sf_dir)
    touched = before.where("k % 19 <> 0").withColumn("mtime", F.when(F.col("k") % 17 == 0, F.timestamp_seconds(F.unix_seconds("mtime") + 3600)).otherwise(F.col("mtime")))
    after = touched.union(before.where("k % 23 = 0").withColumn("name", F.concat("name", F.lit("x"))))
    return library.changed_entries(before.drop("k"), after.drop("k"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "N", "produced").when((F.col("l_returnflag") == "A") | (F.col("l_suppkey") % 4 == 0), "skipped").otherwise("failed")
    return lines.select(F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_no"), state.alias("state"), (F.col("l_quantity") * 10).cast("long").alias("duration_ms"), F.concat(F.lit('no "'), "l_linestatus", F.lit('" ğ')).alias("error"))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON summaries of runs through the JSON sink: all books, then those of every fifth supplier anew with a later line."""
    lines = materialize(library.summary_line(library.run_summary(_outcomes(spark, sf_dir))))
    sink = versions.json_documents(spark, _folder(spark, "json"), "book_id", "book_id long, line string, ok boolean", 8)
    sink.replace(lines.select("book_id"), documents=lines)
    later = materialize(lines.where("book_id % 5 = 0").withColumn("line", F.concat("line", F.lit("\n"))))
    sink.replace(later.select("book_id"), documents=later)
    return sink.read("documents").select("book_id", "line", "ok")


def _sidecar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as page records, some of them broken in one of three ways."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    k = (F.col("conv_id") * 10 + F.col("turn")) % 7
    head = F.concat(F.lit('{"sayfa": '), "turn", F.lit(', "dosya": "'), formats.page_file_name(F.col("turn"), "mp3"), F.lit('"'))
    ms = F.when(k == 1, "").when(k == 2, ', "sure_ms": "long"').otherwise(F.concat(F.lit(', "sure_ms": '), F.col("n") * 10))
    tail = F.when(k == 3, "").otherwise(F.concat(F.lit(', "zamanlar": [[0, '), F.col("n") * 10, F.lit("]]}")))
    return turns.select(F.concat(F.lit("b"), "conv_id", F.lit("/"), formats.page_file_name(F.col("turn"))).alias("path"), F.concat(head, ms, tail).alias("value"))


def sidecar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good page records and refused ones side by side."""
    good, refused = files.parse_sidecars(_sidecar_texts(spark, sf_dir))
    ok = good.select("path", F.lit("ok").alias("outcome"), "page_no", "file", "duration_ms", F.get("spans", F.lit(0))["end_ms"].alias("end_ms"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("page_no", "int"), ("file", "string"), ("duration_ms", "long"), ("end_ms", "long"))]
    return ok.union(refused.select("path", "reason", *none))


def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with suffixes of several kinds: those that are read, and those refused, with what was found."""
    suffix = F.element_at(F.array(*map(F.lit, (".epub", ".PDF", ".txt", "", ".epub.bak", ".x.Epub"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    found = _read(spark, sf_dir, "part").select(F.concat(F.lit("/in/d.epub/"), "p_partkey", suffix).alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    good, refused = files.dispatch(found)
    return good.select("path", "kind", "book_id", F.lit(None).cast("string").alias("reason")).union(refused.select("path", "detail", F.lit(None).cast("string"), "reason"))


def unescaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents whose letters were written as references of every kind: the texts come back."""
    text = F.col("text")
    # names with and without semicolon, an unknown one, numbers in both bases
    for plain, written in (("&", "&amp;"), ("é", "&eacute;"), ("ü", "&uuml"), ("ö", "&#246;"), ("ß", "&#xDF;"), (" the ", " &#116;he "), ("ç", "&CCEDIL;"), ("ş", "&#X15f;"), ("k", "&#0107;"), ("- ", "&#45; ")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    # a column of its own, as it is used twice and decoding is the costly part
    docs = _read(spark, sf_dir, "documents").select("doc_id", entities.unescaped_html(text).alias("whole"))
    return docs.withColumn("paragraphs", files.paragraphs_of(F.col("whole"))).select("doc_id", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "|")).alias("md5"), F.md5("whole").alias("whole_md5"))


def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose numbers a list of ranges selects; overlapping ranges give a turn once."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    chosen = last.select("conv_id", F.explode(selection.selected_pages(F.lit("1-2,2-3,9"), F.col("last"))).alias("turn"))
    return selection.selected_rows(turns, chosen.union(chosen), ["conv_id", "turn"])


def trial_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trials of an engine for each line number; one engine took no time."""
    trials = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), F.col("l_linenumber") % 5).alias("engine"), F.col("l_quantity").cast("double").alias("audio_s"), F.when(F.col("l_linenumber") % 5 == 3, 0.0).otherwise(F.col("l_linenumber").cast("double")).alias("generation_s"))
    return library.real_time_factor(trials)


def library_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings texts of customers: whole, without a field, and broken."""
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, F.concat(F.lit('{"genel_adres": "https://x/'), "c_custkey", F.lit('/", "kullanici": "u"}'))).when(k == 1, '{"kullanici": "v"}').when(k == 2, "{broken").otherwise(None)
    found = _read(spark, sf_dir, "customer").select(value.alias("value"))
    return files.settings(found).groupBy("base", "owner").agg(F.count(F.lit(1)).alias("n"))


def chapter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter numbers of file names, and voices of model names."""
    names = _read(spark, sf_dir, "part").select("p_partkey", formats.chapter_file_name(F.col("p_partkey") % 1000, F.col("p_name")).alias("name"))
    voices = files.voices(names.select(F.concat(F.lit("tr_TR-"), F.element_at(F.split("name", " "), 3), F.when(F.col("p_partkey") % 2 == 0, "-medium.onnx").otherwise("-low.onnx")).alias("name")).distinct())
    return files.chapter_files(names).select(F.col("p_partkey").cast("string").alias("item"), F.col("chapter")).union(voices.select("voice", F.lit(None).cast("int")))


def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio folders of variants, download names, escapes and local names of markup."""
    c = _read(spark, sf_dir, "customer")
    name = F.concat("c_name", F.lit(" ğ+/~*ü"))
    return c.select(
        "c_custkey", formats.variant_path(F.col("c_name"), F.lower("c_mktsegment"), F.concat(F.lit("v"), "c_nationkey"), formats.page_file_name(F.col("c_nationkey"))).alias("path"), formats.percent_encoded(name).alias("encoded"),
        formats.percent_decoded(formats.percent_encoded(name)).alias("decoded"), formats.escaped_html(F.concat(F.lit("<a b='"), "c_name", F.lit("'>\"&"))).alias("escaped"), formats.local_name(F.concat(F.lit("{http://www.w3.org/}"), "c_mktsegment")).alias("local"),
    )


QUERIES: dict[str, Query] = {
    "parsed_cache": parsed_cache,
    "page_requests": page_requests,
    "produced_pages": produced_pages,
    "shelved_blocks": shelved_blocks,
    "shelved_books": shelved_books,
    "change_signatures": change_signatures,
    "snapshot_changes": snapshot_changes,
    "summary_lines": summary_lines,
    "sidecar_records": sidecar_records,
    "file_dispatch": file_dispatch,
    "unescaped_text": unescaped_text,
    "selected_pages": selected_pages,
    "trial_factors": trial_factors,
    "library_settings": library_settings,
    "chapter_listing": chapter_listing,
    "variant_paths": variant_paths,
}

BOOKS = "ids AS (SELECT doc_id, sha1(text)[1:12] AS book_id FROM documents), named AS (SELECT book_id, min(doc_id) AS doc_id FROM ids GROUP BY 1), labelled AS (SELECT book_id, doc_id FROM named WHERE doc_id IN (SELECT doc_id FROM labels))"
MARK = "md5(length(name) || '|' || name || '|' || epoch_us(mtime))"
LISTING = "listing AS (SELECT o_custkey AS book_id, 'f' || o_orderkey AS name, o_orderdate::TIMESTAMP AS mtime, o_orderkey AS k FROM orders)"

SQL: dict[str, str] = {
    "parsed_cache": f"""WITH RECURSIVE {SENTENCES}{PAGED.format(target=1500)}, {BOOKS}, texts AS (SELECT doc_id, page_no, (sum(step) - arg_max(step - n, r))::BIGINT AS n FROM placed GROUP BY 1, 2),
      sums AS (SELECT doc_id, count(*)::INT AS pages, sum(n)::BIGINT AS chars FROM texts GROUP BY 1)
      SELECT b.book_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS parser_version, 'doc' || doc_id AS source, pages, chars, CASE WHEN doc_id % 3 <> 0 AND l.book_id IS NOT NULL THEN pages ELSE 0 END::BIGINT AS audio_pages,
        CASE WHEN doc_id % 3 <> 0 AND l.book_id IS NOT NULL THEN chars * 10 ELSE 0 END::BIGINT AS audio_ms, 0::BIGINT AS parsed_again FROM named b JOIN sums USING (doc_id) LEFT JOIN (SELECT book_id FROM labelled) l ON l.book_id = b.book_id""",
    "page_requests": rf"""WITH RECURSIVE {SENTENCES}{PAGED.format(target=1500)}, {BOOKS}
      SELECT doc_id, page_no::INT AS page_no, sent AS sent_no, md5(sentence) AS md5 FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY r) - 1)::INT AS sent FROM placed) JOIN labelled USING (doc_id) WHERE page_no = doc_id % 3 + 1 AND regexp_matches(sentence, '[\pL\pN]')""",
    "produced_pages": rf"""WITH RECURSIVE {SENTENCES}{PAGED.format(target=1500)}, {BOOKS}, said AS (SELECT book_id, page_no, r, sentence, last, regexp_matches(sentence, '[\pL\pN]') AS ok FROM placed JOIN named USING (doc_id)),
      p AS (SELECT book_id, page_no, bool_or(ok AND contains(sentence, 'ü')) AS f1, bool_or(ok AND contains(sentence, 'üü')) AS f2, arg_min(sentence, r) FILTER (ok AND contains(sentence, 'üü')) AS bad, sum(CASE WHEN ok THEN length(sentence) * 80 ELSE 0 END + CASE WHEN last THEN 4800 ELSE 2000 END) AS samples FROM said GROUP BY 1, 2)
      SELECT book_id, page_no::INT AS page_no, CASE WHEN f1 THEN 'failed' ELSE 'produced' END AS "first", CASE WHEN NOT f1 THEN 'skipped' WHEN f2 THEN 'failed' ELSE 'produced' END AS "second", CASE WHEN NOT f2 THEN round_even(samples / 8.0, 0)::BIGINT END AS duration_ms,
        CASE WHEN f2 THEN ('cannot read ' || chr(39) || 'üü' || chr(39) || ' in: ' || bad)[1:200] END AS error FROM p""",
    "shelved_blocks": rf"""WITH d AS (SELECT doc_id, doc_id % 10 AS p, doc_id // 10 AS b, text FROM documents), open AS (SELECT * FROM d WHERE NOT coalesce(b % 7 = 4, false) AND b % 11 <> 10),
      lines AS (SELECT doc_id, p, b, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM open WHERE p NOT IN (7, 8)),
      blocks AS (SELECT doc_id, p, b, -1 AS i, 'Title ' || doc_id AS text, true AS head FROM open WHERE p NOT IN (3, 4, 7, 8) UNION ALL SELECT doc_id, p, b, i, trim(regexp_replace(line, '{BLANK}+', ' ', 'g')), false FROM lines WHERE i % 5 <> 4),
      full_blocks AS (SELECT * FROM blocks WHERE text <> ''), tocs AS (SELECT b FROM open WHERE b % 3 <> 2 AND p IN (2, 5) GROUP BY 1),
      files AS (SELECT DISTINCT doc_id, p, b FROM full_blocks), named AS (SELECT f.*, CASE WHEN t.b IS NOT NULL AND p IN (2, 5) THEN 'Part ' || doc_id WHEN t.b IS NULL AND p NOT IN (3, 4) THEN 'Title ' || doc_id END AS name, row_number() OVER (PARTITION BY f.b ORDER BY doc_id) = 1 AS is_first FROM files f LEFT JOIN tocs t USING (b)),
      chapters AS (SELECT *, (sum((name IS NOT NULL OR is_first)::INT) OVER (PARTITION BY b ORDER BY doc_id) - 1)::INT AS chapter FROM named),
      titled AS (SELECT *, first_value(coalesce(name, CASE WHEN b % 4 = 1 THEN 'Giriş' ELSE 'Kitap ' || b END)) OVER (PARTITION BY b, chapter ORDER BY doc_id) AS title FROM chapters)
      SELECT 'b' || x.b AS book_id, (row_number() OVER (PARTITION BY x.b ORDER BY x.doc_id, i) - 1)::INT AS block_no, md5(text) AS md5, head AS is_heading, chapter, title AS chapter_title FROM full_blocks x JOIN titled USING (doc_id)""",
    "shelved_books": """WITH d AS (SELECT doc_id // 10 AS b, count(*) AS n FROM documents GROUP BY 1)
      SELECT 'b' || b AS book_id, CASE WHEN b % 11 = 10 THEN 0 ELSE n + 3 + (b % 3 <> 2)::INT + (b % 7 IN (3, 4))::INT END::BIGINT AS entries, CASE WHEN r IS NULL THEN CASE WHEN b % 4 = 1 THEN '' ELSE 'Kitap ' || b END END AS title, CASE WHEN r IS NULL THEN 'Yazar & ' || b END AS author,
        CASE WHEN r IS NULL THEN CASE WHEN b % 2 = 0 THEN 'en' ELSE 'tr' END END AS lang, r AS reason FROM (SELECT *, CASE WHEN b % 11 = 10 THEN 'unreadable: BadZipFile' WHEN b % 7 = 4 THEN 'DRM' END AS r FROM d)""",
    "change_signatures": f"WITH {LISTING}, m AS (SELECT book_id, {MARK} AS h FROM listing) SELECT book_id, count(*) || '-' || sum(('0x' || h[1:15])::BIGINT::HUGEINT) || '-' || sum(('0x' || h[16:30])::BIGINT::HUGEINT) AS signature FROM m GROUP BY 1",
    "snapshot_changes": f"""WITH {LISTING} SELECT book_id, name, 'removed' AS change FROM listing WHERE k % 19 = 0 UNION ALL SELECT book_id, name, 'changed' FROM listing WHERE k % 19 <> 0 AND k % 17 = 0
      UNION ALL SELECT book_id, name || 'x', 'added' FROM listing WHERE k % 23 = 0""",
    "summary_lines": r"""WITH o AS (SELECT l_suppkey AS b, l_orderkey * 10 + l_linenumber AS p, CASE WHEN l_returnflag = 'N' THEN 'produced' WHEN l_returnflag = 'A' OR l_suppkey % 4 = 0 THEN 'skipped' ELSE 'failed' END AS s, (l_quantity * 10)::BIGINT AS ms, 'no "' || l_linestatus || '" ğ' AS e FROM lineitem),
      f AS (SELECT b, list(to_json({'page_no': p, 'error': e})::VARCHAR ORDER BY p, e)[1:5] AS f FROM o WHERE s = 'failed' GROUP BY 1),
      g AS (SELECT b, count(*) AS n, count(*) FILTER (s = 'skipped') AS k, count(*) FILTER (s = 'produced') AS d, count(*) FILTER (s = 'failed') AS x, round_even(coalesce(sum(ms) FILTER (s = 'produced'), 0) / 1000.0, 1)::DOUBLE AS a FROM o GROUP BY 1)
      SELECT b AS book_id, '{"book_id":' || b || ',"selected":' || n || ',"skipped":' || k || ',"produced":' || d || ',"failed":' || x || ',"audio_s":' || a || ',"first_failures":[' || coalesce(array_to_string(f, ','), '') || ']}' || CASE WHEN b % 5 = 0 THEN chr(10) ELSE '' END AS line, x = 0 AS ok
      FROM g LEFT JOIN f USING (b)""",
    "sidecar_records": """WITH t AS (SELECT 'b' || conv_id || '/' || printf('%04d', turn) || '.json' AS path, (conv_id * 10 + turn) % 7 AS k, turn::INT AS turn, length(text) * 10 AS ms FROM conversations)
      SELECT path, CASE k WHEN 1 THEN 'no duration' WHEN 2 THEN 'type' WHEN 3 THEN 'not json' ELSE 'ok' END AS outcome, CASE WHEN k NOT IN (1, 2, 3) THEN turn END AS page_no,
        CASE WHEN k NOT IN (1, 2, 3) THEN printf('%04d', turn) || '.mp3' END AS file, CASE WHEN k NOT IN (1, 2, 3) THEN ms END AS duration_ms, CASE WHEN k NOT IN (1, 2, 3) THEN ms END AS end_ms FROM t""",
    "file_dispatch": """SELECT '/in/d.epub/' || p_partkey || ['.epub', '.PDF', '.txt', '', '.epub.bak', '.x.Epub'][p_partkey % 6 + 1] AS path, ['epub', 'pdf', 'txt', 'none', 'bak', 'epub'][p_partkey % 6 + 1] AS kind,
      CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN sha1(p_name)[1:12] END AS book_id, CASE WHEN p_partkey % 6 NOT IN (0, 1, 5) THEN 'suffix' END AS reason FROM part""",
    "unescaped_text": rf"""WITH s AS (SELECT doc_id, replace(text, 'ç', '&CCEDIL;') AS text FROM documents), p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{BLANK}+', ' ', 'g'))), lambda x: x <> '') AS p FROM s)
      SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS md5, md5(text) AS whole_md5 FROM p""",
    "selected_pages": "WITH t AS (SELECT conv_id, turn, length(text)::INT AS chars, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, chars FROM t WHERE turn IN (1, 2, 3, 9) AND turn <= last",
    "trial_factors": "WITH t AS (SELECT 'e' || l_linenumber % 5 AS engine, l_quantity::DOUBLE AS a, CASE WHEN l_linenumber % 5 = 3 THEN 0.0 ELSE l_linenumber END::DOUBLE AS g FROM lineitem) SELECT engine, sum(a) AS audio_s, sum(g) AS generation_s, CASE WHEN sum(g) > 0 THEN sum(a) / sum(g) END AS factor FROM t GROUP BY 1",
    "library_settings": "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'https://x/' || c_custkey || '/' END AS base, CASE c_custkey % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'v' END AS owner, count(*) AS n FROM customer GROUP BY 1, 2",
    "chapter_listing": "SELECT p_partkey::VARCHAR AS item, (p_partkey % 1000 - 1)::INT AS chapter FROM part UNION ALL SELECT DISTINCT string_split(printf('%03d', p_partkey % 1000) || ' - ' || trim(p_name[1:60]) || '.mp3', ' ')[3], NULL FROM part WHERE p_partkey % 2 = 0",
    "variant_paths": r"""SELECT c_custkey, c_name || '/ses/' || lower(c_mktsegment) || '-v' || c_nationkey || '/' || printf('%04d', c_nationkey) || '.json' AS path, replace(c_name, '#', '%23') || '%20%C4%9F%2B/~%2A%C3%BC' AS encoded, c_name || ' ğ+/~*ü' AS decoded,
      '&lt;a b=&#x27;' || c_name || '&#x27;&gt;&quot;&amp;' AS escaped, c_mktsegment AS local FROM customer""",
}
