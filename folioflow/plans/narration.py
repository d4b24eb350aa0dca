"""Queries over the driver's tables that apply the narration operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import cleaning, formats, numbers
from folioflow.functions.speech import spoken_form
from folioflow.operators import chapters, headers, library, pagination, segmentation, selection, timeline
from folioflow.sources import epub, files, markup

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a book of one chapter, a block per line."""
    return _read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _lines(spark, sf_dir).select("doc_id", "block_no", "text", F.lit(False).alias("is_heading"))
    return segmentation.sentences(blocks).select("doc_id", "block_no", "sent_no", "gap", F.length("sentence").alias("chars"), F.md5("sentence").alias("md5"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.sentences(_lines(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter"), "block_no", "text", F.lit(False).alias("is_heading")))


def _paged(spark: SparkSession, sf_dir: str, target: int = pagination.TARGET) -> DataFrame:
    return pagination.greedy_pages(_sentences(spark, sf_dir), target)


def greedy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents to sentences to pages of about 1500 characters."""
    sized = _sentences(spark, sf_dir).withColumn("n", F.length("sentence")).drop("sentence")
    gap = F.when(F.col("gap") == "sentence", 1).otherwise(2)
    paged = pagination.greedy_pages(sized, size=F.col("n"))
    return paged.groupBy(F.col("book_id").alias("doc_id"), "page_no").agg(F.count(F.lit(1)).alias("n_sentences"), (F.sum(F.col("n") + gap) - F.max_by(gap, F.struct("block_no", "sent_no"))).cast("long").alias("n_chars"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pagination.page_texts(_paged(spark, sf_dir))
    return pages.select(F.col("book_id").alias("doc_id"), "page_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), F.size("sentences").alias("n_sentences"), F.get("sentences", F.size("sentences") - 1)["start"].alias("last_start"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", numbers.cardinal(n).alias("cardinal"), numbers.ordinal(F.col("o_custkey")).alias("ordinal"), numbers.cardinal(n * 7919 * 1000003 - 5 * 10**12).alias("large"))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4100).alias("n"))
    made = parts.withColumn("roman", numbers.roman(F.col("n")))
    return made.select("p_partkey", "roman", numbers.roman_value(F.col("roman")).alias("back"), numbers.roman_value(F.concat("roman", F.lit("I"))).alias("plus_one"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", cleaning.composed(F.col("text")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    clean = lines.withColumn("clean", cleaning.clean_line(F.col("text"), nfc=False))
    return clean.select(
        "doc_id", "block_no", F.md5("clean").alias("clean"), F.md5(cleaning.without_footnote_marks(F.col("clean"))).alias("unmarked"), F.md5(cleaning.header_key(F.col("clean"))).alias("header_key"),
        cleaning.is_dialogue(F.col("clean")).alias("dialogue"),
    )


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", cleaning.title_key(F.col("p_name")).alias("title_key"), cleaning.turkish_lower(F.upper("p_type")).alias("turkish_lower"))


def _headers(share: float) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _lines(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), F.col("block_no").alias("line_no"), "text")
        return headers.drop_headers(lines, share).groupBy("book_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_no").alias("line_sum"), F.sum(F.length("text")).cast("long").alias("n_chars"))

    return query


def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken form of every line, first lines as headings."""
    return _lines(spark, sf_dir).select("doc_id", "block_no", spoken_form(F.col("text"), F.col("block_no") == 0).alias("spoken"))


def spoken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of spoken forms on texts that orders fill with numbers; some are headings."""
    k, n = F.col("o_orderkey") % 20, F.col("o_orderkey") % 3000 + 1
    m = n % 100 + 1
    letters = numbers.roman(m)
    texts = [
        F.concat(F.lit("Dr. Selim "), n, F.lit("'te geldi.")), F.concat(m, F.lit(". yüzyılda")), F.concat(F.lit("bkz. s. "), n, F.lit(", No. "), m), F.concat(letters, F.lit(". Abdülhamit")), F.concat(F.lit("BÖLÜM "), letters),
        F.concat(letters, F.lit(". Kısım")), F.lit("Ali & Veli * x | y"), F.concat(F.lit("Bilgi için https://ornek.com/"), n, F.lit(" ve a"), n, F.lit("@b.co adresine")), F.concat(m, F.lit(".500’den fazla")), F.lit("Elma vb. şeyler [ed.n.]....."),
        F.lit("Prof. Dr. Av. Op. Uzm. Sn. Hz. Doç. Yrd. Doç. x"), F.concat(F.lit("M.Ö. "), n, F.lit(" ve M.S. "), m), F.lit("Cad. Sok. Mah. Ltd. Şti. A.Ş."), F.lit("Örn. çev. haz. vs. vd. [ç.n.] y. n. x"), F.lit("x 🙝 y ★ z\t\tq"),
        F.lit("Aleko"), F.lit("Bitti!"), F.concat(n, F.lit(". Bölüm")), F.concat(F.lit("~ "), n, F.lit(" ~")), F.lit("  - Ali"),
    ]
    text = F.coalesce(*[F.when(k == i, t) for i, t in enumerate(texts)])
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), k.isin(4, 5, 15, 16).alias("heading"))
    return rows.select("o_orderkey", "text", spoken_form(F.col("text"), F.col("heading")).alias("spoken"))


def audio_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sentences of one page; read as written, so that SQL can follow."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.lit(1).alias("page_no"), F.col("turn").alias("sent_no"), F.col("text").alias("sentence"))
    gap = F.when(F.col("sent_no") == 0, "heading").when(F.col("sent_no") % 3 == 2, "paragraph").otherwise("sentence")
    timed = timeline.timeline(turns.withColumn("gap", gap), speak=lambda text, heading: text)
    return timed.select(F.col("book_id").alias("conv_id"), F.col("sent_no").alias("turn"), "start_ms", "end_ms")


def page_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.lit(1).alias("page_no"), F.col("turn").alias("sent_no"), F.col("text").alias("sentence"), F.lit("paragraph").alias("gap"))
    return timeline.page_durations(timeline.timeline(turns, speak=lambda text, heading: text)).select(F.col("book_id").alias("conv_id"), "duration_ms", formats.duration(F.col("duration_ms")).alias("shown"))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns selected by an expression built from the conversation's length."""
    turns = _read(spark, sf_dir, "conversations")
    books = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("last"))
    expression = F.when(F.col("conv_id") % 4 == 0, "").when(F.col("conv_id") % 4 == 1, F.concat(F.lit("2-3,1,"), "last")).when(F.col("conv_id") % 4 == 2, "5-3,2-").otherwise(F.concat(F.lit("1-"), F.col("last") + 7))
    return books.select("conv_id", "last", F.explode(selection.selected_pages(expression, F.col("last"))).alias("page_no"))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.still_to_produce(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), _read(spark, sf_dir, "labels"), ["doc_id"])


def _book_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.floor(F.col("doc_id") / 2).alias("chapter"), F.col("doc_id").alias("page_no"), "n_chars")
    audio = _read(spark, sf_dir, "labels").join(pages.select("book_id", F.col("page_no").alias("doc_id"), "n_chars"), "doc_id").select("book_id", F.col("doc_id").alias("page_no"), (F.col("n_chars") * 10).alias("duration_ms"), formats.page_file_name(F.col("doc_id"), "mp3").alias("file"))
    return pages.withColumn("book_id", F.lit("all")), audio.withColumn("book_id", F.lit("all"))


def complete_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.complete_chapters(*_book_pages(spark, sf_dir)).select("chapter", "pages")


def chapter_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chapter_durations(*_book_pages(spark, sf_dir)).select("chapter", "duration_ms")


def chapter_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, audio = _book_pages(spark, sf_dir)
    titles = pages.select("book_id", "chapter").distinct().withColumn("title", F.concat(F.lit("Part: "), "chapter"))
    return library.chapter_manifest(pages, audio, titles).select("chapter", "file_name", F.array_join("files", ",").alias("files"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books, orders as chapters, order status as variant, lines as pages."""
    orders = _read(spark, sf_dir, "orders")
    lines = _read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("l_quantity"))
    names = formats.chapter_file_name(F.col("o_orderkey") % 1000, F.col("o_orderpriority"))
    listed = orders.select(F.col("o_custkey").alias("book_id"), F.lower("o_orderstatus").alias("variant"), F.col("o_orderkey").alias("chapter"), names.alias("name"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("size"))
    titles = orders.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter"), F.col("o_orderpriority").alias("title"))
    pages = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("book_id"), F.col("l_orderkey").alias("chapter"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("page_no"), "l_quantity")
    audio = pages.select("book_id", "page_no", (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"))
    return library.catalog(listed, titles, library.chapter_durations(pages.select("book_id", "chapter", "page_no"), audio))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)


def variant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.variant_totals(_catalog(spark, sf_dir)).withColumn("shown", formats.duration(F.col("duration_ms")))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _catalog(spark, sf_dir).select("book_id", "chapter", F.col("name").alias("file_name"))
    return library.playlist(entries).select("book_id", F.md5("playlist").alias("playlist_md5"))


def stale_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("variant"), F.col("o_orderdate").alias("mtime"))
    built = orders.where("book_id % 3 <> 0").groupBy("book_id", "variant").agg(F.min("mtime").alias("built_at"))
    return library.needs_archive(orders, built)


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "N", "produced").when(F.col("l_returnflag") == "A", "skipped").otherwise("failed")
    outcome = lines.select(F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_no"), state.alias("state"), (F.col("l_quantity") * 10).cast("long").alias("duration_ms"), F.lit("x").alias("error"))
    found = library.run_summary(outcome)
    return found.select("book_id", "selected", "skipped", "produced", "failed", "audio_s", F.array_join(F.transform("first_failures", lambda x: x["page_no"].cast("string")), ",").alias("first_failures"))


def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type for each user, as physical pages are runs of one source page."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.lit(0).alias("chapter"), F.col("event_id").alias("block_no"), F.lit(0).alias("sent_no"), F.col("event_type").alias("source_page"))
    return pagination.physical_pages(events).select("book_id", "block_no", "page_no")


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup of physical pages at every 350th character, with a page border each 500 + 13 * page characters from 40 on."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    bounds = F.transform(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 500).cast("int")), lambda k: F.named_struct(F.lit("pos"), k * 513 + 40, F.lit("page"), k + 1))
    at = F.explode(F.sequence(F.lit(0), F.col("n_chars").cast("int"), F.lit(350))).alias("at")
    return docs.select("doc_id", bounds.alias("b"), at).select("doc_id", "at", segmentation.source_page(F.col("b"), F.col("at")).alias("page"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    size = F.abs(F.col("c_acctbal") * 1000).cast("long")
    return c.select(
        "c_custkey", formats.byte_size(size).alias("size"), formats.duration(F.abs(F.col("c_acctbal") * 1000).cast("long")).alias("duration"), formats.initials(F.concat("c_mktsegment", F.lit(" "), "c_name")).alias("initials"),
        formats.safe_name(F.concat("c_name", F.lit(' <"a/b">: ?'), "c_mktsegment")).alias("safe"), formats.archive_folder(F.concat(F.lit(" x|"), "c_name")).alias("folder"),
        formats.book_link(F.lit("https://books.example/x/"), F.col("c_custkey").cast("string")).alias("link"), formats.ascii_name(F.concat("c_name", F.lit("ö+ş"))).alias("ascii"),
    )


def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    header = F.when(n % 6 == 0, F.concat(F.lit("bytes="), n % 50, F.lit("-"), n % 97)).when(n % 6 == 1, F.concat(F.lit("bytes="), n % 120, F.lit("-"))).when(n % 6 == 2, F.concat(F.lit("bytes=-"), n % 150)).when(n % 6 == 3, "bytes=-").when(n % 6 == 4, "items=1-2")
    ranged = formats.byte_range(header, F.lit(100).cast("long"))
    return _read(spark, sf_dir, "part").select("p_partkey", ranged["status"].alias("status"), ranged["start"].alias("start"), ranged["end"].alias("end"))


def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    owner, login = F.when(F.col("c_custkey") % 3 > 0, F.lower("c_mktsegment")), F.when(F.col("c_custkey") % 4 > 0, F.when(F.col("c_custkey") % 5 > 1, F.col("c_mktsegment")).otherwise("x"))
    ident = F.left(F.sha1("c_name"), F.when(F.col("c_custkey") % 2 == 0, 12).otherwise(11))
    return c.select("c_custkey", formats.may_access(owner, login).alias("allowed"), formats.is_book_id(ident).alias("is_book"), formats.is_variant(F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey"))).alias("is_variant"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", formats.content_id(F.encode("text", "UTF-8")).alias("book_id"))


def corpus_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.corpus_paragraphs(_read(spark, sf_dir, "documents")).select("doc_id", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "|")).alias("md5"))


def book_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median line length, characters and mean by source."""
    lines = _lines(spark, sf_dir).select(F.col("source").alias("book_id"), "text")
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("n_chars"))
    totals = docs.groupBy("book_id").agg(F.sum("n_chars").alias("n_chars"), (F.sum("n_chars") / F.count(F.lit(1))).alias("mean_chars"))
    return chapters.typical_length(lines).join(totals, "book_id").join(chapters.scanned_books(docs, 2400).select("book_id", F.lit(True).alias("s")), "book_id", "left").select("book_id", "typical", "n_chars", "mean_chars", F.col("s").isNotNull().alias("rejected"))


def _bookmarks(spark: SparkSession, sf_dir: str, level: Column | None = None) -> DataFrame:
    """Parts as bookmarks of their brand; if no ``level`` is given, levels differ by brand, and some brands have a lone bookmark or two above."""
    if level is None:
        level = F.when(F.col("p_partkey") % 97 == 0, F.col("p_partkey") % 3).otherwise(3 + F.right("p_brand", F.lit(1)).cast("int") % 4 + F.col("p_size") % 3).cast("int")
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), level.alias("level"), (F.col("p_partkey") % 11).alias("page_no"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  "))).alias("title"))


def bookmark_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.bookmark_level(_bookmarks(spark, sf_dir))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by page; a seventh of all bookmarks lies on the level that is chosen."""
    marks = _bookmarks(spark, sf_dir, F.col("p_size") % 7)
    return chapters.page_titles(marks).select("book_id", "page_no", F.array_join("titles", "|").alias("titles"))


def toc_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as files of a book; some orders have a table of contents, some files a heading."""
    li = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    spine = li.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("path"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("H"), "l_partkey")).alias("first_heading"), F.when(F.col("l_orderkey") % 2 == 0, "B").otherwise("").alias("book_title"))
    toc = li.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("path"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("T"), "l_suppkey")).otherwise("").alias("label"))
    return chapters.spine_chapters(spine, toc).select("book_id", "ord", "chapter", "title")


def _block_columns(blocks: DataFrame) -> DataFrame:
    last = F.get("bounds", F.size("bounds") - 1)
    return blocks.select(
        "book_id", "block_no", "chapter", "is_heading", F.length("text").alias("n_chars"), F.md5("text").alias("md5"), F.get("bounds", F.lit(0))["page"].alias("first_page"), F.size("bounds").alias("n_pages"), last["pos"].alias("last_pos"), last["page"].cast("long").alias("last_page")
    )


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as pages of a book: lines to paragraphs across pages."""
    pages = _read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), "text")
    return _block_columns(chapters.paragraphs(chapters.page_lines(pages), pages=pages))


def _bookmarked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages, each thirteenth without text, and bookmarks: on some pages a first line, a last line, a title that no line shows."""
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), "text")
    lines = F.split("text", "\n")
    marks = F.array(
        F.struct((F.col("page_no") % 5 == 0).alias("on"), F.concat(F.lit("Bölüm: "), F.element_at(lines, 1)).alias("title")),
        F.struct((F.col("page_no") % 10 == 0).alias("on"), F.concat(F.element_at(lines, -1), F.lit("  !")).alias("title")),
        F.struct((F.col("page_no") % 7 == 0).alias("on"), F.lit("Kayıp Başlık").alias("title")),
    )
    marked = docs.select("book_id", "page_no", F.posexplode(marks).alias("ord", "m")).where("m.on").select("book_id", F.lit(0).alias("level"), "page_no", "ord", "m.title")
    return docs.withColumn("text", F.when(F.col("page_no") % 13 == 0, "").otherwise(F.col("text"))), marked


def _bookmarked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, marked = _bookmarked_pages(spark, sf_dir)
    return chapters.paragraphs(chapters.page_lines(pages), chapters.page_titles(marked), pages)


def bookmarked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with headings and chapters from bookmarks, on pages with and without lines."""
    return _block_columns(_bookmarked_blocks(spark, sf_dir))


def bookmark_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the chapters that ``bookmarked_paragraphs`` numbers."""
    pages, marked = _bookmarked_pages(spark, sf_dir)
    books = pages.groupBy("book_id").agg(F.min("page_no").alias("first_page")).withColumn("book_title", F.when(F.col("book_id") != "src1", F.concat(F.lit("T "), "book_id")))
    return chapters.chapter_titles(chapters.page_titles(marked), books).select("book_id", "chapter", F.md5("title").alias("md5"))


def heading_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of bookmarked books: headings stay whole, and each sentence knows the page that it begins on."""
    blocks = _bookmarked_blocks(spark, sf_dir)
    return segmentation.sentences(blocks.select("book_id", "block_no", "text", "is_heading")).select("book_id", "block_no", "sent_no", "gap", F.md5("sentence").alias("md5"))


def sparse_page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header removal where two of three pages have no text: the share counts all pages."""
    pages = _read(spark, sf_dir, "documents").select(F.lit("all").alias("book_id"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Kitap "), F.col("doc_id") % 4, F.when(F.col("doc_id") % 6 == 0, " a").otherwise(" b"), F.lit("\n"), "text")).alias("text"))
    lines = chapters.page_lines(pages.where("text is not null"))
    return headers.drop_headers(lines, 0.2, pages=pages).groupBy("book_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_no").alias("line_sum"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_blocks(_read(spark, sf_dir, "pages").select("page_id", "html"))


def html_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's navigation, read as a table of contents."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("<nav>"), F.lit('<nav epub:type="toc">')).alias("html"))
    return markup.markup_contents(pages)


def epub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a language packed as e-books of up to 25 chapters and read back."""
    from folioflow.sources.epub_writer import pack

    pages = _read(spark, sf_dir, "pages").withColumn("book_id", F.concat(F.lit("b"), F.floor(F.col("page_id") / 25)))
    _, blocks, _ = epub.read_epubs(pack(pages, "book_id", "page_id", "html"))
    return blocks


def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), F.col("block_no").alias("line_no"), "text")
    return headers.edge_lines(lines).where("edge is not null").select("book_id", "page_no", "line_no", "edge")


def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sentences(spark, sf_dir).withColumn("n", F.length("sentence")).drop("sentence")
    return pagination.sentence_offsets(pagination.greedy_pages(sized, 600, F.col("n")), F.col("n")).select(F.col("book_id").alias("doc_id"), "block_no", "sent_no", "page_no", "start", "end")


QUERIES: dict[str, Query] = {
    "greedy_pages": greedy_pages,
    "sentences": sentences,
    "page_texts": page_texts,
    "sentence_offsets": sentence_offsets,
    "number_words": number_words,
    "roman_numerals": roman_numerals,
    "clean_lines": clean_lines,
    "title_keys": title_keys,
    "header_candidates": header_candidates,
    "drop_headers": _headers(0.3),
    "drop_headers_low": _headers(0.05),
    "spoken_lines": spoken_lines,
    "spoken_rules": spoken_rules,
    "audio_timeline": audio_timeline,
    "page_durations": page_durations,
    "page_selection": page_selection,
    "resume": resume,
    "complete_chapters": complete_chapters,
    "chapter_durations": chapter_durations,
    "chapter_manifest": chapter_manifest,
    "catalog": catalog,
    "variant_totals": variant_totals,
    "playlists": playlists,
    "stale_archives": stale_archives,
    "run_summaries": run_summaries,
    "page_islands": page_islands,
    "source_pages": source_pages,
    "display_formats": display_formats,
    "byte_ranges": byte_ranges,
    "access_rules": access_rules,
    "content_ids": content_ids,
    "corpus_paragraphs": corpus_paragraphs,
    "book_statistics": book_statistics,
    "bookmark_levels": bookmark_levels,
    "page_titles": page_titles,
    "toc_chapters": toc_chapters,
    "page_paragraphs": page_paragraphs,
    "bookmarked_paragraphs": bookmarked_paragraphs,
    "bookmark_chapters": bookmark_chapters,
    "heading_sentences": heading_sentences,
    "sparse_page_headers": sparse_page_headers,
    "html_blocks": html_blocks,
    "html_contents": html_contents,
    "epub_blocks": epub_blocks,
}
