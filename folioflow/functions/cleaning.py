"""Line cleaning: Column -> Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.binding import let

# fixed values
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "​‌‍⁠﻿­"
LOWER = "abcçdefgğhıijklmnoöprsştuüvyzâîûqwx"
# blanks as the source format sees them: Unicode white space and the four separators that Java leaves out
BLANK = r"(?U)[\s\x1c-\x1f]+"
# wider than need be, so that one look at each character tells whether a text needs work: blanks besides the space, and all that cleaning replaces
ODD_BLANK = r"[\x00-\x1f\x85\xa0\u1680\u2000-\u3000]"
ODD = r"[\x00-\x1f\x85\xa0\xad\u1680\u2000-\uffff]"
PAGE_NUMBER = r"(?iuU)^[\s\-–—.]*(?:sayfa\s*|s\.\s*|page\s*)?(\d{1,4}|[ivxlcdm]{1,8})[\s\-–—.]*$"
FOOTNOTE = r"(?U)(?<=[a-zçğıöşüâîû])\d{1,2}(?=[\s.,;:!?)\"”’]|$)"
MARKED = r"(?U)[a-zçğıöşüâîû]\d"
DIALOGUE = r"(?U)^[—–-]\s"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
PARAGRAPH_END = r"[.!?…:\"”»’)]$"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def composed(text: Column) -> Column:
    """Canonical composition; only texts with a character from U+0300 on reach Python, all others travel as nulls."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)), text)


def collapse(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends. Texts with single spaces only are left alone."""
    uneven = text.contains("  ") | text.startswith(" ") | text.endswith(" ") | text.rlike(ODD_BLANK)
    return F.when(uneven, F.trim(F.regexp_replace(text, BLANK, " "))).otherwise(text)


def trimmed(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.when(F.left(text, F.lit(1)).rlike(BLANK) | F.right(text, F.lit(1)).rlike(BLANK), F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(text)


def clean_line(text: Column, nfc: bool = True) -> Column:
    """A line without ligatures, invisible characters and uneven blanks, in composed form.

    ``nfc`` False leaves composition out: composing a whole page before it is cut into lines gives the same lines for one trip to Python a page.
    """

    def cleaned(t: Column) -> Column:
        for ligature, letters in LIGATURES.items():
            t = F.replace(t, F.lit(ligature), F.lit(letters))
        return F.trim(F.regexp_replace(F.translate(t, "\x02" + INVISIBLE, "-"), BLANK, " "))

    def by_need(t: Column) -> Column:
        return F.when(t.contains("  ") | t.startswith(" ") | t.endswith(" ") | t.rlike(ODD), cleaned(t)).otherwise(t)

    return let(composed(text) if nfc else text, by_need)


def without_footnote_marks(text: Column) -> Column:
    """Most texts have no digit behind a letter, which is seen without looking back at every character."""
    return let(text, lambda t: F.when(t.rlike(MARKED), F.regexp_replace(t, FOOTNOTE, "")).otherwise(t))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def header_key(text: Column) -> Column:
    """Key under which running headers are counted: lower case, digit runs as #."""
    return let(F.regexp_replace(turkish_lower(text), r"(?U)\d+", "#"), trimmed)


def title_key(text: Column) -> Column:
    """Word characters in default lower case."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def is_dialogue(text: Column) -> Column:
    return F.left(text, F.lit(2)).rlike(DIALOGUE)


def ends_paragraph(text: Column, typical: Column) -> Column:
    return ends_like_paragraph(text) & short_of(F.length(text), typical)


def ends_like_paragraph(text: Column) -> Column:
    """One mark, and a line break that a pattern's end allows behind it, lie in the last three characters."""
    return F.right(text, F.lit(3)).rlike(PARAGRAPH_END)


def short_of(length: Column, typical: Column) -> Column:
    return length < typical * 0.8


def line_breaks(text: Column) -> Column:
    """Lines of a page's text, at every break that Unicode knows, as an array; a break at the very end opens no line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ends_in_hyphen(line: Column) -> Column:
    """Whether a word may go on in the next line."""
    return F.right(line, F.lit(4)).rlike(r"(?U)\p{L}-$")


def starts_small(line: Column) -> Column:
    """Whether the first letter is a small one."""
    return F.coalesce(F.lit(LOWER).contains(F.nullif(F.left(line, F.lit(1)), F.lit(""))), F.lit(False))


def joined_part(line: Column, before: Column, after: Column) -> Column:
    """What ``line`` adds to a paragraph between its neighbours (null where there is none).

    A trailing hyphen after a letter goes if the next line starts in lower case, else stays; other lines meet at a space.
    """
    dropped = ends_in_hyphen(line) & starts_small(after)
    body = F.when(dropped, F.left(line, F.length(line) - 1)).otherwise(line)
    return F.when(before.isNull() | ends_in_hyphen(before), body).otherwise(F.concat(F.lit(" "), body))


def join_lines(before: Column, after: Column) -> Column:
    """Two lines as one; an empty one before the other leaves no mark."""
    last = F.nullif(before, F.lit(""))
    return F.concat(F.coalesce(joined_part(last, F.lit(None).cast("string"), after), F.lit("")), joined_part(after, last, F.lit(None).cast("string")))
