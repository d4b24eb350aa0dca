"""Chapters from tables of contents and bookmarks; paragraphs from page lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.binding import let
from folioflow.functions.cleaning import clean_line, collapse, composed, ends_in_hyphen, ends_like_paragraph, is_dialogue, line_breaks, short_of, starts_small, title_key, without_footnote_marks
from folioflow.store import materialize


def bookmark_level(bookmarks: DataFrame) -> DataFrame:
    """(book_id, level): the smallest level with at least two entries, else the smallest."""
    counts = bookmarks.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("book_id").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("level"))), F.min("level")).alias("level"))


def page_titles(bookmarks: DataFrame) -> DataFrame:
    """(book_id, page_no, titles): titles of the chosen level by page, in order, blank ones left out."""
    chosen = bookmarks.join(bookmark_level(bookmarks), ["book_id", "level"], "left_semi").withColumn("title", collapse(F.col("title"))).where("title <> ''")
    return chosen.groupBy("book_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles"))


def spine_chapters(spine: DataFrame, toc: DataFrame, default: str = "Giriş") -> DataFrame:
    """``spine`` (book_id, ord, path, first_heading, book_title) with chapter and title.

    A file starts a chapter if the table of contents names it (first non-empty label), or if the
    book has no such table and the file has a heading, or if it is the book's first; others inherit.
    """
    labels = toc.where("label <> ''").groupBy("book_id", "path").agg(F.min_by("label", "ord").alias("label"))
    books = labels.groupBy("book_id").agg(F.lit(True).alias("has_toc"))
    joined = spine.join(labels, ["book_id", "path"], "left").join(books, "book_id", "left")
    name = F.coalesce("label", F.when(F.col("has_toc").isNull(), F.col("first_heading")))
    order = Window.partitionBy("book_id").orderBy("ord")
    starts = joined.withColumn("__name", name).withColumn("__start", F.col("__name").isNotNull() | (F.row_number().over(order) == 1))
    own = F.when(F.col("__start"), F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.when(F.col("book_title") != "", F.col("book_title")), F.lit(default)))
    return (
        starts.withColumn("chapter", (F.sum(F.col("__start").cast("int")).over(order) - 1).cast("int"))
        .withColumn("title", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("__name", "__start", "label", "has_toc")
    )


def scanned_books(pages: DataFrame, least: int = 80) -> DataFrame:
    """(book_id, mean_chars) of books with under ``least`` characters a page; ``pages`` has one row per page, empty ones included."""
    return pages.groupBy("book_id").agg((F.sum("n_chars") / F.count(F.lit(1))).alias("mean_chars")).where(F.col("mean_chars") < least)


def typical_length(lines: DataFrame, longer_than: int = 20, default: float = 60.0, size: Column | None = None) -> DataFrame:
    """(book_id, typical): median length of lines longer than 20 characters; 60 if there are none. ``size`` stands for the length of ``text`` where that was taken before."""
    n = F.length("text") if size is None else size
    return lines.groupBy("book_id").agg(F.coalesce(F.median(F.when(n > longer_than, n)), F.lit(default)).alias("typical"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page_no, line_no, text) of cleaned lines of ``pages`` (book_id, page_no, text); pages without text have none."""
    each = pages.select("book_id", "page_no", composed(F.col("text")).alias("text")).select("book_id", "page_no", F.posexplode(line_breaks(F.col("text"))).alias("line_no", "text"))
    return each.withColumn("text", clean_line(F.col("text"), nfc=False))


def _headed(rows: Column, titles: Column) -> Column:
    """struct(at, found) of a page: how many of its titles its lines show, and which line shows which.

    A page's titles wait in order: a line whose squeezed text lies in the first waiting title
    takes it, and the next title comes up. The fold runs over one page's lines.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line_no:int,title:string>>").alias("found"))

    def step(state: Column, row: Column, keys: Column) -> Column:
        seen = let(title_key(row["text"]), lambda key: (key != "") & F.coalesce(F.get(keys, state["at"]).contains(key), F.lit(False)))
        hit = F.when(state["at"] < F.size(keys), seen).otherwise(False)
        found = F.struct(row["line_no"].cast("int").alias("line_no"), F.get(titles, state["at"]).alias("title"))
        return F.when(hit, F.struct((state["at"] + 1).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))).otherwise(state)

    found = let(F.transform(titles, lambda t: title_key(t)), lambda keys: F.aggregate(rows, start, lambda state, row: step(state, row, keys)))
    return F.when(F.size(titles) > 0, found).otherwise(start)


def _filled_pages(lines: DataFrame, titles: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """One row a page, as a table: its lines in order, its titles and ``_headed``.

    All that lines show by themselves is looked up here, once a line, as what is made of pages is read several times.
    """
    keys = ["book_id", "page_no"]
    all_pages = (lines if pages is None else pages).select(*keys)
    if titles is None:
        none = F.array().cast("array<string>")
        titled = lines.select(*keys, none.alias("titles")).limit(0)
    else:
        titled = titles.select(*keys, "titles")
        all_pages = all_pages.union(titled.select(*keys))
    text = F.col("text")
    own = F.struct("line_no", "text", F.length(text).alias("n"), (text != "").alias("filled"), is_dialogue(text).alias("dialogue"), ends_like_paragraph(text).alias("ends"), ends_in_hyphen(text).alias("hyphen"), starts_small(text).alias("small"))
    rows = lines.select(*keys, own.alias("row")).groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = all_pages.distinct().join(rows, keys, "left").join(titled, keys, "left")
    whole = whole.select(*keys, F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)).alias("rows"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    return materialize(whole.withColumn("headed", let(F.col("rows"), lambda r: let(F.col("titles"), lambda t: _headed(r, t)))))


def _marked_pages(filled: DataFrame) -> DataFrame:
    """Pages with what their lines do to paragraphs, and how many of their titles they never show.

    The lengths that are typical of a book come as a table, one row a book, so that Spark may split a book of many pages where they meet.
    """
    keys = ["book_id", "page_no"]
    typical = materialize(typical_length(filled.select("book_id", F.explode("rows.n").alias("n")), size=F.col("n")))

    def line(r: Column, found: Column) -> Column:
        title = F.get(F.filter(found, lambda f: f["line_no"] == r["line_no"]), F.lit(0))["title"]
        return let(title, lambda t: F.struct(
            r.alias("r"), t.isNotNull().alias("heading"), (t.isNotNull() | r["dialogue"]).alias("opens"), (~r["filled"] | t.isNotNull() | (r["ends"] & short_of(r["n"], F.col("typical")))).alias("closes"),
        ))

    # a line opens a paragraph by itself or after one that closes; the first of a page may depend on pages before
    def flagged(found: Column) -> Column:
        return let(F.transform("rows", lambda r: line(r, found)), lambda ls: F.transform(ls, lambda x, i: F.struct(
            *[x["r"][c].alias(c) for c in ("line_no", "text", "n", "filled", "hyphen", "small")], x["heading"].alias("heading"), x["closes"].alias("closes"),
            (x["r"]["filled"] & (x["opens"] | F.coalesce(F.get(ls, i - 1)["closes"] & (i > 0), F.lit(False)))).alias("starts"))))

    return filled.join(typical, "book_id", "left").select(*keys, "titles", (F.size("titles") - F.col("headed.at")).alias("left"), flagged(F.col("headed.found")).alias("lines"))


def _page_scan(marked: DataFrame) -> DataFrame:
    """(book_id, page_no, carry, before, chapters_before, opens) by windows over one row a page.

    carry: whether the page's first line opens a paragraph whatever it is; before: paragraphs that opened on pages before;
    chapters_before: titles of pages before; opens: 1 if the book's first page has a title, else 0.
    """
    book = Window.partitionBy("book_id").orderBy("page_no")
    earlier = book.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("lines")
    summary = marked.select(
        "book_id", "page_no", n.alias("n"), F.size(F.filter("lines.starts", lambda x: x)).alias("starts"), F.size(F.filter("lines.heading", lambda x: x)).alias("shown"), "left", F.size("titles").alias("titles"),
        F.coalesce(F.get("lines.filled", F.lit(0)) & ~F.get("lines.starts", F.lit(0)), F.lit(False)).alias("waits"),
        F.when(F.col("left") > 0, True).when(n > 0, F.get("lines.closes", n - 1)).alias("closes"),
    )
    carried = summary.withColumn("carry", F.coalesce(F.last("closes", ignorenulls=True).over(earlier), F.lit(True)))
    opened = F.col("starts") + F.when(F.col("carry") & F.col("waits"), 1).otherwise(0)
    return carried.select(
        "book_id", "page_no", "carry", F.coalesce(F.sum(opened).over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("shown") + F.col("left")).over(earlier), F.lit(0)).alias("chapters_before"),
        F.when(F.first("titles").over(book) > 0, 1).otherwise(0).alias("opens"),
    )


def _bounds(rows: Column) -> Column:
    """Where each page begins in a paragraph's text: array of (pos, page). A hyphen that goes still counts, as the next line comes after it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<struct<pos:int,page:int>>").alias("found"))

    def step(state: Column, row: Column) -> Column:
        before = F.get(rows, state["i"] - 1)
        later = state["i"] > 0
        first = ~later | (before["page_no"] != row["page_no"])
        bound = F.struct((state["n"] + F.when(later, 1).otherwise(0)).cast("int").alias("pos"), row["page_no"].cast("int").alias("page"))
        blank = F.when(later & ~before["hyphen"], 1).otherwise(0)
        gone = F.when(later & before["hyphen"] & row["small"], 1).otherwise(0)
        return F.struct((state["n"] - gone + blank + row["n"]).alias("n"), (state["i"] + 1).alias("i"), F.when(first, F.concat(state["found"], F.array(bound))).otherwise(state["found"]).alias("found"))

    return F.aggregate(rows, start, step)["found"]


def _joined(rows: Column) -> Column:
    """A paragraph's text from its lines, as ``joined_part`` joins them."""

    def part(row: Column, i: Column) -> Column:
        dropped = row["hyphen"] & F.coalesce(F.get(rows, i + 1)["small"], F.lit(False))
        body = F.when(dropped, F.left(row["text"], row["n"] - 1)).otherwise(row["text"])
        return F.when((i == 0) | F.coalesce(F.get(rows, i - 1)["hyphen"], F.lit(False)), body).otherwise(F.concat(F.lit(" "), body))

    return F.array_join(F.transform(rows, part), "")


def paragraphs(lines: DataFrame, titles: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Blocks (book_id, block_no, text, chapter, is_heading, bounds) from cleaned lines (book_id, page_no, line_no, text).

    ``titles`` (book_id, page_no, titles) are bookmarks as ``page_titles`` makes them, on any page; ``pages`` (book_id, page_no)
    lists all pages, which matters for pages without lines: titles there begin chapters too.

    A paragraph begins at the first line, after a blank line or a heading, at a line of
    dialogue, after a short line that ends a sentence, and after a page with titles left over. None of
    these depends on paragraphs before, so the fold becomes a scan in two levels: flags within each page, windows over
    one row a page, and numbers within each page again.
    """
    marked = _marked_pages(_filled_pages(lines, titles, pages))
    page = Window.partitionBy("book_id", "page_no").orderBy("line_no")
    each = marked.select("book_id", "page_no", "lines").join(_page_scan(marked), ["book_id", "page_no"])
    each = each.select("book_id", "page_no", "carry", "before", "chapters_before", "opens", F.posexplode("lines").alias("i", "l"))
    starts = F.col("l.starts") | (F.col("carry") & (F.col("i") == 0) & F.col("l.filled"))
    numbered = each.select("book_id", "page_no", *[F.col(f"l.{c}").alias(c) for c in ("line_no", "text", "n", "hyphen", "small", "heading", "filled")], "before", "chapters_before", "opens", starts.cast("int").alias("starts"))
    numbered = numbered.withColumn("block_no", (F.col("before") + F.sum("starts").over(page) - 1).cast("int"))
    numbered = numbered.withColumn("chapter", F.greatest(F.col("chapters_before") + F.sum(F.col("heading").cast("int")).over(page) - F.col("opens"), F.lit(0)).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("page_no", "line_no", "text", "n", "hyphen", "small")))
    made = numbered.where("filled").groupBy("book_id", "block_no").agg(rows.alias("r"), F.min("chapter").alias("chapter"), F.max("heading").alias("is_heading"))
    text = F.trim(without_footnote_marks(let(F.col("r"), _joined)))
    return made.select("book_id", "block_no", text.alias("text"), "chapter", "is_heading", let(F.col("r"), _bounds).alias("bounds"))


def chapter_titles(titles: DataFrame, books: DataFrame, default: str = "Kitap") -> DataFrame:
    """(book_id, chapter, title) as ``paragraphs`` numbers them; ``books`` has book_id, book_title (or null) and first_page.

    Chapter 0 is the book's own title, unless its first page has a bookmark.
    """
    pages = titles.where(F.size("titles") > 0).join(books, "book_id")
    own = books.join(titles.where(F.size("titles") > 0).select("book_id", F.col("page_no").alias("first_page")), ["book_id", "first_page"], "left_anti")
    opening = own.select("book_id", F.lit(0).alias("chapter"), F.coalesce(F.nullif("book_title", F.lit("")), F.lit(default)).alias("title"))
    earlier = Window.partitionBy("book_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.when(F.min("page_no").over(Window.partitionBy("book_id")) == F.col("first_page"), 0).otherwise(1)
    placed = pages.withColumn("base", F.coalesce(F.sum(F.size("titles")).over(earlier), F.lit(0)) + shift)
    return opening.union(placed.select("book_id", "base", F.posexplode("titles").alias("i", "title")).select("book_id", (F.col("base") + F.col("i")).cast("int").alias("chapter"), "title"))
