"""Character references of web text, decoded by one tokenising pattern and constant maps: Column -> Column."""

from __future__ import annotations

import html.entities
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.binding import let

# a reference is a number, or a name of up to 32 characters with or without its semicolon
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def _named() -> dict[str, str]:
    """Names of the standard, as Python lists them; those that stand without a semicolon too are listed twice."""
    return dict(html.entities.html5)


def _bare() -> list[str]:
    """Names that need no semicolon, longest first."""
    return sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _windows() -> dict[int, str]:
    """Numbers of the C1 range mean the characters of code page 1252, where it has one."""
    found = {0: REPLACEMENT, 0x0D: "\r"}
    for n in range(0x80, 0xA0):
        try:
            found[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            found[n] = chr(n)
    return found


def _constant(pairs: dict) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()]))


def _looked_up(pairs: dict[str, str], key: Column, buckets: int = 512) -> Column:
    """Value of ``key`` in a constant map, else null. Spark looks through a map entry by entry, so entries lie in an array of small maps by checksum."""
    held: list[dict[str, str]] = [{} for _ in range(buckets)]
    for k, v in pairs.items():
        held[zlib.crc32(k.encode()) % buckets][k] = v
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.try_element_at(F.get(F.array(*[_constant(some) if some else empty for some in held]), (F.crc32(key) % buckets).cast("int")), key)


def _is_dropped(n: Column) -> Column:
    """Control characters and non-characters that the standard leaves out."""
    return n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0x7F) | (n == 0xB) | n.between(0xFDD0, 0xFDEF) | n.bitwiseAND(0xFFFE).eqNullSafe(0xFFFE)


def _character(n: Column) -> Column:
    """The character of a code point, by way of UTF-32; null stands for a number too large to read."""
    read = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n.between(0x20, 0x7E), F.char(n))
        .when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), REPLACEMENT)
        .otherwise(F.coalesce(F.when((n < 0x20) | n.between(0x80, 0x9F), F.try_element_at(_constant(_windows()), n.cast("int"))), F.when(_is_dropped(n), "").otherwise(read)))
    )


def _number(reference: Column) -> Column:
    """Value of a numeric reference; null beyond 15 digits, which is beyond any character."""
    digits = F.rtrim(F.regexp_replace(reference, r"^&#[xX]?0*(?=[0-9a-fA-F])", ""), F.lit(";"))
    hexadecimal = F.lower(F.substring(reference, 3, 1)) == "x"
    value = F.when(hexadecimal, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
    return F.when(F.length(digits) <= 15, value)


def _decoded(reference: Column) -> Column:
    """A reference's text: its own if the whole name is known, else that of the longest known name that it begins with."""

    def by_name(names: Column) -> Column:
        begun = let(F.regexp_extract(names, "^(?:" + "|".join(_bare()) + ")", 0), lambda bare: F.when(bare != "", F.concat(_looked_up(_named(), bare), F.substring(names, F.length(bare) + 1, F.lit(40)))))
        return F.coalesce(_looked_up(_named(), names), begun, reference)

    return F.when(reference.startswith("&#"), let(_number(reference), _character)).otherwise(let(F.substring(reference, 2, 40), by_name))


def unescaped_html(text: Column) -> Column:
    """``text`` with its character references decoded once; texts without an ampersand are left alone.

    What is no reference, or one of an unknown name, stays as it is, and what a reference decodes to is not read again.
    """

    def rebuilt(t: Column) -> Column:
        gaps, found = F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), 0)
        pairs = F.zip_with(gaps, F.transform(found, lambda m: let(m, _decoded)), lambda gap, made: F.concat(gap, F.coalesce(made, F.lit(""))))
        return F.when(t.contains("&"), F.array_join(pairs, "")).otherwise(t)

    return let(text, rebuilt)
