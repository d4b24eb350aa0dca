"""Display and parsing helpers of the library: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_size(n: Column) -> Column:
    """Whole MB from 2^20 bytes on, else whole KB; half goes to even."""
    return F.when(n >= 1 << 20, F.concat(F.bround(n / (1 << 20), 0).cast("long"), F.lit(" MB"))).otherwise(F.concat(F.bround(n / 1024, 0).cast("long"), F.lit(" KB")))


def duration(ms: Column) -> Column:
    """Minutes, or hours and minutes; half a minute goes to even."""
    minutes = F.bround(ms / 60000, 0).cast("long")
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60), F.lit(" sa "), minutes % 60, F.lit(" dk"))).otherwise(F.concat(minutes, F.lit(" dk")))


def initials(name: Column) -> Column:
    words = F.slice(F.array_remove(F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " "), ""), 1, 2)
    letters = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return F.when(letters == "", "?").otherwise(letters)


def safe_name(title: Column, default: str = "Bölüm") -> Column:
    """Title without characters that file systems refuse, at most 60, trimmed."""
    name = F.trim(F.left(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', ""), F.lit(60)))
    return F.when(name == "", default).otherwise(name)


def archive_folder(title: Column) -> Column:
    """As safe_name, with control characters and outer spaces kept."""
    return F.regexp_replace(title, r'[<>:"/\\|?*]', "")


def chapter_file_name(number: Column, title: Column, suffix: str = "mp3") -> Column:
    return F.concat(F.format_string("%03d", number.cast("int")), F.lit(" - "), safe_name(title), F.lit(f".{suffix}"))


def page_file_name(number: Column, suffix: str = "json") -> Column:
    return F.concat(F.format_string("%04d", number.cast("int")), F.lit(f".{suffix}"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(status, start, end) of a Range header: ``bytes=a-b``, ``a-`` or ``-n``; end is inclusive. Other headers mean the whole file."""
    first, last = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    ranged = F.coalesce(header.rlike(r"^bytes=\d*-\d*$"), F.lit(False))
    start = F.when(first != "", first.try_cast("long")).when(last != "", F.greatest(F.lit(0), size - last.try_cast("long"))).otherwise(F.lit(0))
    end = F.when((first != "") & (last != ""), F.least(last.try_cast("long"), size - 1)).otherwise(size - 1)
    bad = (start > end) | (start >= size)
    return (
        F.when(~ranged, F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("start"), (size - 1).cast("long").alias("end")))
        .when(bad, F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))
        .otherwise(F.struct(F.lit(206).alias("status"), start.cast("long").alias("start"), end.cast("long").alias("end")))
    )


def book_link(base: Column, book_id: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/k/"), book_id, F.lit("/"))


def content_id(content: Column) -> Column:
    """First 12 hex digits of the SHA-1 of a file's bytes."""
    return F.substring(F.sha1(content), 1, 12)


def is_book_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{12}$")


def is_variant(text: Column) -> Column:
    return text.rlike("^[a-z]+-[a-z0-9]+$")


def variant_key(engine: Column, voice: Column) -> Column:
    """Name of an engine and voice, as ``is_variant`` accepts it."""
    return F.concat_ws("-", engine, voice)


def variant_path(book_id: Column, engine: Column, voice: Column, file: Column | None = None) -> Column:
    """Where a variant's audio of a book lies, or one file of it."""
    return F.concat_ws("/", book_id, F.lit("ses"), variant_key(engine, voice), *([] if file is None else [file]))


def local_name(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^.*\}", "")


def may_access(owner: Column, login: Column) -> Column:
    """Refused only if an owner is set and another login is given; case does not matter."""
    return ~(F.coalesce(owner != "", F.lit(False)) & F.coalesce(login != "", F.lit(False)) & (F.lower(owner) != F.lower(login)))


def ascii_name(name: Column) -> Column:
    """Download name for clients that read ASCII only."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._ -]", "_")


def percent_encoded(name: Column) -> Column:
    """UTF-8 percent encoding that leaves letters, digits, _ . - ~ and / alone."""
    out = F.url_encode(name)
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def percent_decoded(text: Column) -> Column:
    """Percent decoding that keeps the plus sign."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def escaped_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out
