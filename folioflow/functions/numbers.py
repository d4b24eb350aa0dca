"""Turkish number words and Roman numerals as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.binding import let

# fixed values
ONES = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
SCALES = [(10**12, "trilyon"), (10**9, "milyar"), (10**6, "milyon"), (10**3, "bin")]
ORDINALS = {
    "bir": "birinci", "iki": "ikinci", "üç": "üçüncü", "dört": "dördüncü", "beş": "beşinci", "altı": "altıncı", "yedi": "yedinci",
    "sekiz": "sekizinci", "dokuz": "dokuzuncu", "on": "onuncu", "yirmi": "yirminci", "otuz": "otuzuncu", "kırk": "kırkıncı", "elli": "ellinci",
    "altmış": "altmışıncı", "yetmiş": "yetmişinci", "seksen": "sekseninci", "doksan": "doksanıncı", "yüz": "yüzüncü", "bin": "bininci",
    "milyon": "milyonuncu", "milyar": "milyarıncı", "trilyon": "trilyonuncu", "sıfır": "sıfırıncı",
}
ROMAN_PLACES = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]
ROMAN = r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def _whole(n: Column, by: int) -> Column:
    """Whole quotient of a long."""
    return F.call_function("div", n, F.lit(by).cast("long"))


def _group(n: Column, scale: int, name: str) -> Column:
    """Words of the three digits of ``n`` at ``scale``, each followed by a blank; one look-up in a constant table."""
    words = ("" if k == 0 else f"{name} " if (scale, k) == (1000, 1) else f"{spelt(k)} {name} " if name else f"{spelt(k)} " for k in range(1000))
    return F.get(_table(words), (_whole(n, scale) % 1000).cast("int"))


def _below_trillion(n: Column) -> Column:
    return F.concat(*[_group(n, scale, name) for scale, name in SCALES[1:]], _group(n, 1, ""))


def cardinal(n: Column) -> Column:
    """Cardinal words of a long; a count of trillions is itself spelt out."""

    def words(n: Column) -> Column:
        size = F.abs(n)
        trillions = F.when(size < SCALES[0][0], "").otherwise(F.concat(_below_trillion(_whole(size, SCALES[0][0])), F.lit(f"{SCALES[0][1]} ")))
        sign = F.when(n < 0, "eksi ").otherwise("")
        return F.when(n == 0, "sıfır").otherwise(F.rtrim(F.concat(sign, trillions, _below_trillion(size % SCALES[0][0]))))

    return let(n.cast("long"), words)


def ordinal(n: Column) -> Column:
    """Cardinal words with the last one in ordinal form."""
    forms = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])

    def last_changed(words: Column) -> Column:
        return F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.element_at(forms, F.element_at(words, -1)))), " ")

    return let(F.split(cardinal(n), " "), last_changed)


def spelt(n: int) -> str:
    """Cardinal words of 0 to 9999, for tables."""
    if n == 0:
        return "sıfır"
    thousands, rest = divmod(n, 1000)
    hundreds, below = divmod(rest, 100)
    parts = [ONES[thousands] if thousands > 1 else "", "bin" if thousands else "", ONES[hundreds] if hundreds > 1 else "", "yüz" if hundreds else "", TENS[below // 10], ONES[below % 10]]
    return " ".join(p for p in parts if p)


def _table(words) -> Column:
    """Constant array; one literal, so that plans stay small where a lookup stands in several lambdas."""
    return F.split(F.lit("|".join(words)), r"\|")


def small_cardinal(n: Column) -> Column:
    """Cardinal words of 0 to 9999, else null."""
    return F.get(_table(spelt(k) for k in range(10_000)), n.cast("int"))


def small_ordinal(n: Column) -> Column:
    """Ordinal words of 0 to 9999, else null."""

    def last_changed(words: str) -> str:
        head, _, last = words.rpartition(" ")
        return f"{head} {ORDINALS[last]}".strip()

    return F.get(_table(last_changed(spelt(k)) for k in range(10_000)), n.cast("int"))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999, else null."""
    text = F.concat(*[_pick(place, _whole(n, 10**k) % 10) for k, place in reversed(list(enumerate(ROMAN_PLACES)))])
    return F.when((n > 0) & (n < 4000), text)


def roman_value(text: Column) -> Column:
    """Value of a canonical Roman numeral, else null."""
    values = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    digits = F.transform(F.split(text, ""), lambda c: F.element_at(values, c))
    total = let(digits, lambda ds: F.aggregate(F.transform(ds, lambda d, i: F.when(F.get(ds, i + 1) > d, -d).otherwise(d)), F.lit(0), lambda a, x: a + x))
    return F.when((F.length(text) > 0) & text.rlike(f"^{ROMAN}$"), total)
