"""Small e-book archives, for tests and round trips."""

from __future__ import annotations

import io
import zipfile
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'


def archive(chapters: list[tuple[str, str]], title: str = "", author: str = "", lang: str = "tr", nav: list[tuple[str, str]] | None = None, ncx: list[tuple[str, str]] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """An e-book of (file stem, markup); nav and ncx list (href, label)."""
    items = "".join(f'<item id={quoteattr(n)} href={quoteattr(n + ".xhtml")} media-type="application/xhtml+xml"/>' for n, _ in chapters)
    items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav is not None else ""
    items += '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx is not None else ""
    refs = "".join(f"<itemref idref={quoteattr(n)}/>" for n, _ in chapters)
    meta = f"<dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(lang)}</dc:language>"
    package = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{items}</manifest><spine{" toc=" + quoteattr("ncx") if ncx is not None else ""}>{refs}</spine></package>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        def put(name: str, text: str) -> None:
            out.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)  # a fixed date, so equal books have equal bytes

        put("mimetype", "application/epub+zip")
        put("META-INF/container.xml", CONTAINER)
        put("OPS/book.opf", package)
        for name, text in chapters:
            put(f"OPS/{name}.xhtml", text)
        if nav is not None:
            links = "".join(f"<li><a href={quoteattr(h)}>{escape(t)}</a></li>" for h, t in nav)
            put("OPS/nav.xhtml", f'<html><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        if ncx is not None:
            points = "".join(f"<navPoint><navLabel><text>{escape(t)}</text></navLabel><content src={quoteattr(h)}/></navPoint>" for h, t in ncx)
            put("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for name, text in (extra or {}).items():
            put(name, text)
    return buffer.getvalue()


def _written(members: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in members.items():
            out.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def book(files: list[dict], title: str, author: str, lang: str, contents: str, scheme: str | None) -> bytes:
    """An e-book whose package spells out what readers must cope with.

    ``files`` have name (in folder ``text``), markup, label, linear, media_type and twice (an item of the same id before it that leads nowhere).
    ``contents`` is nav (in a folder of its own), ncx or none; ``scheme`` names the encryption of a part.
    """
    href = lambda f: "text/" + quote(f["name"])
    labelled = [f for f in files if f["label"] is not None]
    items, refs = [], []
    for n, f in enumerate(files):
        lost = [("lost.xhtml", f["media_type"])] if f["twice"] else []
        items += [f'<item id="f{n}" href={quoteattr(h)} media-type={quoteattr(m)}/>' for h, m in [*lost, (href(f), f["media_type"])]]
        refs.append(f'<itemref idref="f{n}"{"" if f["linear"] else " linear=" + quoteattr("no")}/>')
    members = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER}
    if contents == "nav":
        items.append('<item id="toc" href="nav/toc.xhtml" media-type="application/xhtml+xml" properties="scripted nav"/>')
        refs.insert(0, '<itemref idref="toc"/>')
        links = "".join(f'<li><a href={quoteattr("../" + href(f) + "#top")}> {escape(f["label"])}</a></li><li><a href={quoteattr("../" + href(f) + "#more")}>later</a></li>' for f in labelled)
        members["OPS/nav/toc.xhtml"] = f'<html><body><nav epub:type="landmarks"><a href="x">x</a></nav><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    elif contents == "ncx":
        items.append('<item id="toc" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
        points = "".join(f'<navPoint><navLabel><text>{escape(f["label"])}</text></navLabel><content src={quoteattr("./" + href(f))}/></navPoint>' for f in labelled)
        members["OPS/toc.ncx"] = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>'
    if scheme is not None:
        members["META-INF/encryption.xml"] = f'<encryption><EncryptedData><EncryptionMethod Algorithm={quoteattr(scheme)}/></EncryptedData></encryption>'
    meta = f"<dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator>" + (f"<dc:language>{escape(lang)}</dc:language>" if lang else "")
    spine = f'<spine{" toc=" + quoteattr("toc") if contents == "ncx" else ""}>{"".join(refs)}</spine>'
    members["OPS/book.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{"".join(items)}</manifest>{spine}</package>'
    return _written(members | {"OPS/text/" + f["name"]: f["markup"] for f in files})


def _place(row: dict) -> tuple:
    """Sorts rows by ord, nulls last."""
    return row["ord"] is None, row["ord"] or 0


def _packed(group: pa.Table, content: bytes) -> pa.Table:
    return pa.table({"book_id": pa.array(group.column("book_id")[:1].to_pylist(), pa.string()), "content": pa.array([content], pa.binary())})


def pack_books(files: DataFrame) -> DataFrame:
    """(book_id, content) of files (book_id, ord and the columns of ``book``); the book's own columns repeat on each. A book must fit a task.

    ``broken`` cuts an archive off after so many bytes.
    """

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=_place)
        one = rows[0]
        content = book(rows, one["title"], one["author"], one["lang"], one["contents"], one["scheme"])
        return _packed(group, content if one["broken"] is None else content[: int(one["broken"])])

    return files.groupBy("book_id").applyInArrow(build, "book_id string, content binary")


def pack(pages: DataFrame, book_col: str, order_col: str, markup_col: str) -> DataFrame:
    """(book_id, content): each book's pages, in order, as chapters of an archive. A book must fit a task."""

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=_place)
        chapters = [(f"p{r['ord']}", r["markup"] or "") for r in rows]
        return _packed(group, archive(chapters, title=str(rows[0]["book_id"]), nav=[(f"{n}.xhtml#top", f"Part {k}") for k, (n, _) in enumerate(chapters) if k % 2 == 0]))

    rows = pages.select(F.col(book_col).cast("string").alias("book_id"), F.col(order_col).alias("ord"), F.col(markup_col).alias("markup"))
    return rows.groupBy("book_id").applyInArrow(build, "book_id string, content binary")
