"""Literal cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import cleaning, formats, numbers
from folioflow.functions.sentences import split_sentences
from folioflow.functions.speech import spoken_form
from folioflow.operators import chapters
from folioflow.operators.selection import selected_pages


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


WHOLE = ["Dr. Selim geldi.", "Prof. Ayşe Hanım derse girdi.", "Elma, armut vb. meyveler aldı.", "Şirket A.Ş. adına imzaladı.", "M.Ö. 500 yılında oldu.", "A. Haluk Bey geldi.", "Bkz. Ek 3 ve sonrası.", "3. Bölüm başladı.", "19. yüzyılda yaşadı.", "Fiyat 2,5 liraydı."]
SPLIT = {
    "Geldi. Gitti! Ne oldu? Bilmem.": ["Geldi.", "Gitti!", "Ne oldu?", "Bilmem."],
    "Konakta 3.500 cilt vardı. Hepsi eskiydi.": ["Konakta 3.500 cilt vardı.", "Hepsi eskiydi."],
    "Ne? dedi adam. Sonra sustu.": ["Ne? dedi adam.", "Sonra sustu."],
    'Ama... Hayır, gitmedi. "Gel!" Sonra döndü.': ["Ama...", "Hayır, gitmedi.", '"Gel!"', "Sonra döndü."],
    "— Hoş geldiniz, dedi. — Sağ olun.": ["— Hoş geldiniz, dedi.", "— Sağ olun."],
}


def test_sentences(spark):
    assert apply(spark, WHOLE, split_sentences) == [[x] for x in WHOLE]
    assert apply(spark, list(SPLIT), split_sentences) == list(SPLIT.values())
    assert apply(spark, ["", "   ", None], split_sentences) == [[], [], None]
    long = ", ".join(["uzun bir yan cümle daha"] * 80) + "."
    (pieces,) = apply(spark, [long], split_sentences)
    assert len(pieces) > 1 and all(len(p) <= 900 for p in pieces) and " ".join(pieces) == long


def test_numbers(spark):
    pairs = {0: "sıfır", 7: "yedi", 10: "on", 100: "yüz", 101: "yüz bir", 1000: "bin", 1923: "bin dokuz yüz yirmi üç", 2000: "iki bin", 3500: "üç bin beş yüz", 1000000: "bir milyon", 21450007: "yirmi bir milyon dört yüz elli bin yedi", -3: "eksi üç", 10**15: "bin trilyon"}
    assert apply(spark, list(pairs), numbers.cardinal, "long") == list(pairs.values())
    assert apply(spark, [None], numbers.cardinal, "long") == [None]
    places = {1: "birinci", 3: "üçüncü", 4: "dördüncü", 6: "altıncı", 19: "on dokuzuncu", 40: "kırkıncı", 100: "yüzüncü", 1000: "bininci"}
    assert apply(spark, list(places), numbers.ordinal, "long") == list(places.values())
    letters = {"IV": 4, "XIV": 14, "MCMXXIII": 1923, "IIII": None, "MIX": 1009, "VX": None, "ABC": None, "": None}
    assert apply(spark, list(letters), numbers.roman_value) == list(letters.values())


SPOKEN = {
    "Dr. Selim geldi.": "Doktor Selim geldi.", "19. yüzyılda": "on dokuzuncu yüzyılda", "1923'te kuruldu": "bin dokuz yüz yirmi üçte kuruldu", "3.500'den fazla": "üç bin beş yüzden fazla",
    "II. Abdülhamit": "ikinci Abdülhamit", "Elma vb. şeyler": "Elma ve benzeri şeyler", "bkz. s. 45": "bakınız sayfa 45", "Ali * Veli": "Ali Veli",
    "söz konusudur, [ed.n.]": "söz konusudur, editörün notu", "bir deyimdir. [ç.n.]": "bir deyimdir. çevirmenin notu", "Ali & Veli 🙝🙟": "Ali ve Veli", "Bilgi için https://ornek.com adresine": "Bilgi için adresine",
}


def test_spoken(spark):
    assert apply(spark, list(SPOKEN), spoken_form) == list(SPOKEN.values())
    headings = {"BÖLÜM IV": "BÖLÜM dört.", "Aleko": "Aleko.", "I. Kısım": "birinci Kısım."}
    assert apply(spark, list(headings), lambda c: spoken_form(c, F.lit(True))) == list(headings.values())


def test_cleaning(spark):
    assert apply(spark, ["ﬁkir ve​  ﬂüt\x02", None, ""], cleaning.clean_line) == ["fikir ve flüt-", None, ""]
    assert apply(spark, ["konağın3 kapısı, 1923 yılında"], cleaning.without_footnote_marks) == ["konağın kapısı, 1923 yılında"]
    joins = spark.createDataFrame([("kitap okuyan kel-", "sinin evi"), ("Ankara-", "İstanbul yolu"), ("bir", "iki"), ("", "iki")], "a string, b string")
    assert [r[0] for r in joins.select(cleaning.join_lines(F.col("a"), F.col("b"))).collect()] == ["kitap okuyan kelsinin evi", "Ankara-İstanbul yolu", "bir iki", "iki"]
    assert apply(spark, ["KİTABIN ADI 12"], cleaning.header_key) == ["kitabın adı #"]


@pytest.mark.parametrize("text, last, expected", [("1-20,35", 40, [*range(1, 21), 35]), ("", 3, [1, 2, 3]), ("5-3", 9, []), ("5-", 9, [5]), ("0-2,2-3,99", 4, [1, 2, 3])])
def test_selection(spark, text, last, expected):
    assert apply(spark, [text], lambda c: selected_pages(c, F.lit(last))) == [expected]


def test_formats(spark):
    assert apply(spark, [1024 * 5 // 2, 1 << 20, 3 << 19], formats.byte_size, "long") == ["2 KB", "1 MB", "2 MB"]
    assert apply(spark, [90000, 150000, 3600000], formats.duration, "long") == ["2 dk", "2 dk", "1 sa 0 dk"]
    assert apply(spark, ["bytes=10-19", "bytes=-5", "bytes=-", None, "bytes=200-"], lambda c: formats.byte_range(c, F.lit(100)).cast("string")) == ["{206, 10, 19}", "{206, 95, 99}", "{206, 0, 99}", "{200, 0, 99}", "{416, null, null}"]


def test_paragraph_lines_are_looked_up_once(spark):
    """Patterns run where lines become rows of a page; what reads the pages' table has none of them."""
    lines = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(["— Bir kelime bölün-", "mez. Kısa.", "", "İki3 satır-", "Üç"])], "book_id string, page_no int, line_no int, text string")
    marked = chapters._marked_pages(chapters._filled_pages(lines, None, None))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan
    made = chapters.paragraphs(lines).orderBy("block_no").select("text", "bounds").collect()
    assert [r["text"] for r in made] == ["— Bir kelime bölünmez. Kısa.", "İki satır-Üç"]
    assert [[tuple(b) for b in r["bounds"]] for r in made] == [[(0, 1)], [(0, 1)]]
