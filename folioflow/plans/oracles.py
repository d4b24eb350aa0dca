"""The same queries as SQL for DuckDB. Words and letters are written out here, so that an error in the library's tables shows."""

from __future__ import annotations

# fixed values
ONES = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
SCALES = [(10**9, "milyar"), (10**6, "milyon"), (10**3, "bin")]
ORDINALS = {
    "bir": "birinci", "iki": "ikinci", "üç": "üçüncü", "dört": "dördüncü", "beş": "beşinci", "altı": "altıncı", "yedi": "yedinci", "sekiz": "sekizinci", "dokuz": "dokuzuncu", "on": "onuncu",
    "yirmi": "yirminci", "otuz": "otuzuncu", "kırk": "kırkıncı", "elli": "ellinci", "altmış": "altmışıncı", "yetmiş": "yetmişinci", "seksen": "sekseninci", "doksan": "doksanıncı", "yüz": "yüzüncü",
    "bin": "bininci", "milyon": "milyonuncu", "milyar": "milyarıncı", "trilyon": "trilyonuncu", "sıfır": "sıfırıncı",
}
ROMAN_PLACES = [
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"],
]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LOWER = "abcçdefgğhıijklmnoöprsştuüvyzâîûqwx"
ABBREVIATIONS = [
    "dr", "prof", "doç", "doc", "yrd", "av", "sn", "st", "vb", "vs", "vd", "örn", "bkz", "no", "nr", "s", "sf", "ss", "c", "haz", "çev", "ed", "mah", "cad", "sok", "apt",
    "tel", "alb", "yzb", "bnb", "org", "gen", "kur", "ltd", "şti", "hz", "mr", "mrs", "ms", "bay", "bayan", "op", "uzm", "ord", "müh",
]
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents)"

CLOSERS = "[\"''”»’)\\]]*"

SPLIT = rf"""toks AS (
  SELECT doc_id, block_no, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS t FROM lines
), looked AS (
  SELECT *, lead(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id, block_no ORDER BY i) AS nt, regexp_extract(t, '((?:[.!?]+|…){CLOSERS})$', 1) AS tail FROM toks
), worded AS (
  SELECT *, regexp_extract(t[1:length(t) - length(tail)], '[\pL\pN_.]+$') AS word FROM looked
), marked AS (
  SELECT *, tail <> '' AND nt IS NOT NULL AND NOT contains('{LOWER},;:', nt[1:1]) AND NOT (
    tail[1:1] = '.' AND word <> '' AND (lower(word) IN ({_quoted(ABBREVIATIONS)}) OR contains(word, '.') OR regexp_matches(word, '^\p{{Lu}}$') OR (regexp_matches(word, '^\d{{1,2}}$') AND regexp_matches(nt, '^\p{{Lu}}')))) AS ends FROM worded
), grouped AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM marked
), whole AS (
  SELECT doc_id, block_no, sid, regexp_replace(regexp_replace(string_agg(t, ' ' ORDER BY i), '^{BLANK}+', ''), '{BLANK}+$', '') AS s FROM grouped GROUP BY doc_id, block_no, sid
), cut AS (
  SELECT doc_id, block_no, sid, 0 AS k, NULL::VARCHAR AS piece, s AS rest, false AS done FROM whole WHERE s <> ''
  UNION ALL
  SELECT doc_id, block_no, sid, k + 1, CASE WHEN go THEN rest[1:cut_at + 1] ELSE rest END, CASE WHEN go THEN ltrim(rest[cut_at + 2:], ' ') ELSE '' END, NOT go FROM (
    SELECT *, length(rest) > 900 AND cut_at > 0 AS go FROM (
      SELECT *, CASE WHEN clause < 300 THEN CASE WHEN strpos(back, ' ') > 0 THEN length(back) - strpos(back, ' ') ELSE -1 END ELSE clause END AS cut_at FROM (
        SELECT *, greatest(CASE WHEN strpos(back, ' ;') > 0 THEN length(back) - strpos(back, ' ;') - 1 ELSE -1 END, CASE WHEN strpos(back, ' ,') > 0 THEN length(back) - strpos(back, ' ,') - 1 ELSE -1 END) AS clause
        FROM (SELECT *, reverse(rest[1:900]) AS back FROM cut WHERE NOT done))))
), sents AS (
  SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY sid, k) - 1 AS sent_no, piece AS sentence, lead(piece) OVER (PARTITION BY doc_id, block_no ORDER BY sid, k) IS NULL AS last FROM cut WHERE piece IS NOT NULL
)"""

SENTENCES = f"{LINES}, {SPLIT}"

PAGED = """, numbered AS (
  SELECT *, length(sentence) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, sent_no) AS r FROM sents
), walk AS (
  SELECT doc_id, r, 1 AS page_no, n + 1 AS used FROM numbered WHERE r = 1
  UNION ALL
  SELECT b.doc_id, b.r, CASE WHEN w.used + b.n > {target} THEN w.page_no + 1 ELSE w.page_no END, CASE WHEN w.used + b.n > {target} THEN b.n + 1 ELSE w.used + b.n + 1 END
  FROM walk w JOIN numbered b ON b.doc_id = w.doc_id AND b.r = w.r + 1
), placed AS (
  SELECT n.*, w.page_no, n.n + CASE WHEN last THEN 2 ELSE 1 END AS step FROM numbered n JOIN walk w USING (doc_id, r)
), offsets AS (
  SELECT *, coalesce(sum(step) OVER (PARTITION BY doc_id, page_no ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM placed
)"""


def _below_thousand(n: str) -> str:
    h, t, o = f"(({n}) // 100)", f"((({n}) // 10) % 10)", f"(({n}) % 10)"
    ones, tens = f"[{_quoted(ONES)}]", f"[{_quoted(TENS)}]"
    return f"concat_ws(' ', CASE WHEN {h} = 0 THEN NULL WHEN {h} = 1 THEN 'yüz' ELSE {ones}[{h} + 1] || ' yüz' END, nullif({tens}[{t} + 1], ''), nullif({ones}[{o} + 1], ''))"


def _below_trillion(n: str) -> str:
    parts = []
    for scale, name in SCALES:
        g = f"((({n}) // {scale}) % 1000)"
        one = f"WHEN {g} = 1 THEN '{name}' " if scale == 1000 else ""
        parts.append(f"CASE WHEN {g} = 0 THEN NULL {one}ELSE {_below_thousand(g)} || ' {name}' END")
    return f"concat_ws(' ', {', '.join(parts)}, nullif({_below_thousand(f'(({n}) % 1000)')}, ''))"


def cardinal_sql(n: str) -> str:
    size = f"abs({n})"
    words = f"concat_ws(' ', CASE WHEN {size} >= 1000000000000 THEN {_below_trillion(f'({size} // 1000000000000)')} || ' trilyon' END, nullif({_below_trillion(f'({size} % 1000000000000)')}, ''))"
    return f"CASE WHEN ({n}) = 0 THEN 'sıfır' WHEN ({n}) < 0 THEN 'eksi ' || {words} ELSE {words} END"


def ordinal_sql(n: str) -> str:
    forms = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ORDINALS.items()) + "}"
    return f"(SELECT array_to_string(list_concat(w[:-2], [{forms}[w[-1]]]), ' ') FROM (SELECT string_split({cardinal_sql(n)}, ' ') AS w))"


def roman_sql(n: str) -> str:
    places = " || ".join(f"[{_quoted(p)}][(({n}) // {10**k}) % 10 + 1]" for k, p in reversed(list(enumerate(ROMAN_PLACES))))
    return f"CASE WHEN ({n}) BETWEEN 1 AND 3999 THEN {places} END"


def _clean(text: str) -> str:
    out = f"nfc_normalize({text})"
    for ligature, letters in LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    out = f"replace({out}, chr(2), '-')"
    for c in INVISIBLE:
        out = f"replace({out}, chr({ord(c)}), '')"
    return f"trim(regexp_replace({out}, '{BLANK}+', ' ', 'g'))"


LOWERED = "lower(translate({0}, 'İI', 'iı'))"


def _header_key(text: str) -> str:
    return f"trim(regexp_replace({LOWERED.format(text)}, '\\d+', '#', 'g'))"


EDGES = rf"""{LINES}, filled AS (
  SELECT source AS book_id, doc_id AS page_no, block_no AS line_no, text, regexp_matches(text, '[^\s]') AS full_line FROM lines
), ranked AS (
  SELECT *, count(*) FILTER (full_line) OVER (PARTITION BY page_no ORDER BY line_no) AS up, count(*) FILTER (full_line) OVER (PARTITION BY page_no) AS total FROM filled
), edges AS (
  SELECT *, CASE WHEN NOT full_line OR total <= 2 THEN NULL WHEN total - up + 1 <= 2 THEN -(total - up + 1) WHEN up <= 2 THEN up END AS edge FROM ranked
)"""


def _headers(share: float) -> str:
    return rf"""WITH {EDGES}, keyed AS (SELECT *, {_header_key('text')} AS key FROM edges), pages AS (SELECT book_id, count(DISTINCT page_no) AS pages FROM edges GROUP BY 1),
hits AS (SELECT book_id, edge, key FROM keyed JOIN pages USING (book_id) WHERE edge IS NOT NULL AND key <> '' GROUP BY book_id, edge, key, pages HAVING count(*) >= greatest(3, floor(pages * {share})))
SELECT book_id, page_no, count(*) AS n_lines, sum(line_no)::BIGINT AS line_sum, sum(length(text))::BIGINT AS n_chars FROM keyed k
WHERE edge IS NULL OR NOT (EXISTS (SELECT 1 FROM hits h WHERE h.book_id = k.book_id AND h.edge = k.edge AND h.key = k.key)
  OR regexp_matches(text, '^[\s\-–—.]*(?:[sS][aA][yY][fF][aA]\s*|[sS]\.\s*|[pP][aA][gG][eE]\s*)?(\d{{1,4}}|[ivxlcdmIVXLCDMıİ]{{1,8}})[\s\-–—.]*$'))
GROUP BY 1, 2"""


TITLE_KEY = r"regexp_replace(lower({0}), '[^\pL\pN_]+', '', 'g')"
PAGE_PARTS = r"regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
NO_MARKS = "marks AS (SELECT NULL::VARCHAR AS book_id, NULL::BIGINT AS page_no, NULL::INT AS ord, NULL::VARCHAR AS title, false AS is_on WHERE false)"
MARKS = """marks AS (
  SELECT source AS book_id, doc_id AS page_no, unnest([0, 1, 2]) AS ord, unnest(['Bölüm: ' || string_split(text, chr(10))[1], string_split(text, chr(10))[-1] || '  !', 'Kayıp Başlık']) AS title, unnest([doc_id % 5 = 0, doc_id % 10 = 0, doc_id % 7 = 0]) AS is_on FROM documents)"""
BLOCKS = rf"""titles AS (
  SELECT book_id, page_no, title, {TITLE_KEY.format('title')} AS key, row_number() OVER (PARTITION BY book_id, page_no ORDER BY ord) AS k FROM (SELECT book_id, page_no, ord, trim(regexp_replace(title, '{BLANK}+', ' ', 'g')) AS title FROM marks WHERE is_on) WHERE title <> ''
), split AS (SELECT book_id, page_no, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT book_id, page_no, {PAGE_PARTS} AS parts FROM paged)
), raw AS (SELECT book_id, page_no, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM split
), clean AS (SELECT book_id, page_no, line_no, {_clean('line')} AS text FROM raw
), hits AS (
  SELECT book_id, page_no, 0::BIGINT AS k, -1::BIGINT AS line_no FROM titles WHERE k = 1
  UNION ALL
  SELECT h.book_id, h.page_no, h.k + 1, min(c.line_no) FROM hits h JOIN titles t ON t.book_id = h.book_id AND t.page_no = h.page_no AND t.k = h.k + 1
    JOIN (SELECT *, {TITLE_KEY.format('text')} AS key FROM clean) c ON c.book_id = h.book_id AND c.page_no = h.page_no AND c.line_no > h.line_no AND c.key <> '' AND contains(t.key, c.key) GROUP BY h.book_id, h.page_no, h.k
), leftover AS (
  SELECT book_id, page_no, count(*) - coalesce(max(n), 0) AS n FROM titles LEFT JOIN (SELECT book_id, page_no, max(k) AS n FROM hits GROUP BY 1, 2) USING (book_id, page_no) GROUP BY 1, 2
), typical AS (SELECT book_id, coalesce(median(length(text)) FILTER (length(text) > 20), 60.0) AS typical FROM clean GROUP BY 1
), events AS (
  SELECT c.book_id, c.page_no, c.line_no, text, h.k IS NOT NULL AS heading, (h.k IS NOT NULL)::BIGINT AS chapters FROM clean c LEFT JOIN hits h ON h.book_id = c.book_id AND h.page_no = c.page_no AND h.line_no = c.line_no
  UNION ALL SELECT book_id, page_no, 1000000000, '', false, n FROM leftover WHERE n > 0
), told AS (
  SELECT e.*, text <> '' AS filled, text = '' OR heading OR (regexp_matches(text, '[.!?…:"”»’)]$') AND length(text) < typical * 0.8) AS closes, heading OR regexp_matches(text, '^[—–-]\s') AS opens FROM events e LEFT JOIN typical USING (book_id)
), flagged AS (
  SELECT *, filled AND (opens OR coalesce(lag(closes) OVER w, true)) AS starts, sum(chapters) OVER w AS chapter_no FROM told WINDOW w AS (PARTITION BY book_id ORDER BY page_no, line_no)
), paras AS (SELECT *, sum(starts::INT) OVER (PARTITION BY book_id ORDER BY page_no, line_no) - 1 AS block_no FROM flagged
), near AS (
  SELECT *, lag(text) OVER w AS prev, lead(text) OVER w AS next, lag(page_no) OVER w AS prev_page FROM paras WHERE filled WINDOW w AS (PARTITION BY book_id, block_no ORDER BY page_no, line_no)
), glued AS (
  SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '\pL-$') THEN '' ELSE ' ' END || CASE WHEN regexp_matches(text, '\pL-$') AND next IS NOT NULL AND contains('{LOWER}', next[1:1]) THEN text[:-2] ELSE text END AS part,
    (prev IS NOT NULL AND regexp_matches(prev, '\pL-$') AND contains('{LOWER}', text[1:1]))::INT AS gone FROM near
), measured AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY book_id, block_no ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + gone + 1, 0) AS pos FROM glued
), blocks AS (
  SELECT book_id, block_no::INT AS block_no, greatest(min(chapter_no) - any_value(coalesce(o.opens, 0)), 0)::INT AS chapter, bool_or(heading) AS is_heading,
    trim(regexp_replace(string_agg(part, '' ORDER BY page_no, line_no), '([a-zçğıöşüâîû])\d{{1,2}}([\s.,;:!?)"”’]|$)', '\1\2', 'g')) AS text, min(page_no)::INT AS first_page, count(DISTINCT page_no)::INT AS n_pages,
    arg_max(pos, page_no * 10000000000 + line_no) FILTER (prev_page IS NULL OR prev_page <> page_no)::INT AS last_pos, max(page_no) AS last_page
  FROM measured LEFT JOIN (SELECT book_id, 1 AS opens FROM titles JOIN (SELECT book_id, min(page_no) AS page_no FROM paged GROUP BY 1) USING (book_id, page_no) GROUP BY 1) o USING (book_id) GROUP BY book_id, block_no
)"""
BLOCK_COLUMNS = "SELECT book_id, block_no, chapter, is_heading, length(text)::INT AS n_chars, md5(text) AS md5, first_page, n_pages, last_pos, last_page FROM blocks"
PAGED_TEXT = "paged AS (SELECT source AS book_id, doc_id AS page_no, {0} AS text FROM documents)"
SPARSE = "CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END"

BOOK = "pages AS (SELECT doc_id // 2 AS chapter, doc_id AS page_no, n_chars FROM documents), audio AS (SELECT doc_id AS page_no, n_chars * 10 AS duration_ms FROM labels JOIN documents USING (doc_id))"
CATALOG = r"""entries AS (
  SELECT o_custkey AS book_id, lower(o_orderstatus) AS variant, o_orderkey AS chapter, floor(o_totalprice * 100)::BIGINT AS size,
    printf('%03d', o_orderkey % 1000) || ' - ' || coalesce(nullif(trim(regexp_replace(o_orderpriority, '[<>:"/\\|?*\x00-\x1f]', '', 'g')[1:60]), ''), 'Bölüm') || '.mp3' AS name,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS own_title,
    coalesce((SELECT sum(l_quantity::BIGINT * 1000) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R'), 0)::BIGINT AS duration_ms
  FROM orders)"""
SHOWN = "CASE WHEN m >= 60 THEN (m // 60) || ' sa ' || (m % 60) || ' dk' ELSE m || ' dk' END"


def _minutes(ms: str) -> str:
    return f"round_even(({ms}) / 60000.0, 0)::BIGINT"


SQL: dict[str, str] = {
    "sentences": f"WITH RECURSIVE {SENTENCES} SELECT doc_id, block_no, sent_no, CASE WHEN last THEN 'paragraph' ELSE 'sentence' END AS gap, length(sentence) AS chars, md5(sentence) AS md5 FROM sents",
    "greedy_pages": f"WITH RECURSIVE {SENTENCES}{PAGED.format(target=1500)} SELECT doc_id, page_no, count(*) AS n_sentences, (sum(step) - arg_max(step - n, r))::BIGINT AS n_chars FROM placed GROUP BY 1, 2",
    "page_texts": f"""WITH RECURSIVE {SENTENCES}{PAGED.format(target=1500)}, texts AS (
      SELECT doc_id, page_no, string_agg(sentence || CASE WHEN last THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY r) AS t, arg_max(step - n, r) AS tail, count(*) AS n_sentences, arg_max(start, r) AS last_start FROM offsets GROUP BY 1, 2)
      SELECT doc_id, page_no, length(t) - tail AS n_chars, md5(t[1:length(t) - tail]) AS text_md5, n_sentences, last_start FROM texts""",
    "sentence_offsets": f"WITH RECURSIVE {SENTENCES}{PAGED.format(target=600)} SELECT doc_id, block_no, sent_no, page_no, start, start + n AS \"end\" FROM offsets",
    "number_words": f"SELECT o_orderkey, {cardinal_sql('o_orderkey')} AS cardinal, {ordinal_sql('o_custkey')} AS ordinal, {cardinal_sql('(o_orderkey * 7919 * 1000003 - 5000000000000)')} AS large FROM orders",
    "roman_numerals": f"SELECT p_partkey, {roman_sql('n')} AS roman, CASE WHEN n BETWEEN 1 AND 3999 THEN n END AS back, CASE WHEN n BETWEEN 1 AND 3999 AND n % 10 NOT IN (3, 4, 8, 9) THEN n + 1 END AS plus_one FROM (SELECT p_partkey, p_partkey * 37 % 4100 AS n FROM part)",
    "clean_lines": rf"""WITH {LINES}, c AS (SELECT doc_id, block_no, {_clean('text')} AS clean FROM lines)
      SELECT doc_id, block_no, md5(clean) AS clean, md5(regexp_replace(clean, '([a-zçğıöşüâîû])\d{{1,2}}([\s.,;:!?)"”’]|$)', '\1\2', 'g')) AS unmarked, md5({_header_key('clean')}) AS header_key, regexp_matches(clean, '^[—–-]\s') AS dialogue FROM c""",
    "title_keys": f"SELECT p_partkey, regexp_replace(lower(p_name), '[^\\pL\\pN_]+', '', 'g') AS title_key, {LOWERED.format('upper(p_type)')} AS turkish_lower FROM part",
    "header_candidates": f"WITH {EDGES} SELECT book_id, page_no, line_no, edge FROM edges WHERE edge IS NOT NULL",
    "drop_headers": _headers(0.3),
    "drop_headers_low": _headers(0.05),
    "spoken_rules": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 20 AS k, o_orderkey % 3000 + 1 AS n, (o_orderkey % 3000 + 1) % 100 + 1 AS m FROM orders), r AS (SELECT *, {roman_sql('m')} AS r FROM o), w AS (SELECT *, {cardinal_sql('n')} AS nw, {cardinal_sql('m')} AS mw, {ordinal_sql('m')} AS mo, {cardinal_sql('(m * 1000 + 500)')} AS th FROM r)
      SELECT o_orderkey, CASE k WHEN 0 THEN 'Dr. Selim ' || n || chr(39) || 'te geldi.' WHEN 1 THEN m || '. yüzyılda' WHEN 2 THEN 'bkz. s. ' || n || ', No. ' || m WHEN 3 THEN r || '. Abdülhamit' WHEN 4 THEN 'BÖLÜM ' || r WHEN 5 THEN r || '. Kısım' WHEN 6 THEN 'Ali & Veli * x | y'
          WHEN 7 THEN 'Bilgi için https://ornek.com/' || n || ' ve a' || n || '@b.co adresine' WHEN 8 THEN m || '.500’den fazla' WHEN 9 THEN 'Elma vb. şeyler [ed.n.].....' WHEN 10 THEN 'Prof. Dr. Av. Op. Uzm. Sn. Hz. Doç. Yrd. Doç. x' WHEN 11 THEN 'M.Ö. ' || n || ' ve M.S. ' || m
          WHEN 12 THEN 'Cad. Sok. Mah. Ltd. Şti. A.Ş.' WHEN 13 THEN 'Örn. çev. haz. vs. vd. [ç.n.] y. n. x' WHEN 14 THEN 'x 🙝 y ★ z' || chr(9) || chr(9) || 'q' WHEN 15 THEN 'Aleko' WHEN 16 THEN 'Bitti!' WHEN 17 THEN n || '. Bölüm' WHEN 18 THEN '~ ' || n || ' ~' ELSE '  - Ali' END AS text,
        CASE k WHEN 0 THEN 'Doktor Selim ' || nw || 'te geldi.' WHEN 1 THEN mo || ' yüzyılda' WHEN 2 THEN 'bakınız sayfa ' || n || ', numara ' || m WHEN 3 THEN CASE WHEN length(r) > 1 THEN mo ELSE r || '.' END || ' Abdülhamit' WHEN 4 THEN 'BÖLÜM ' || mw || '.' WHEN 5 THEN mo || ' Kısım.' WHEN 6 THEN 'Ali ve Veli x y'
          WHEN 7 THEN 'Bilgi için ve adresine' WHEN 8 THEN th || 'den fazla' WHEN 9 THEN 'Elma ve benzeri şeyler editörün notu...' WHEN 10 THEN 'Profesör Doktor Avukat Operatör Uzman Sayın Hazreti Doçent Yardımcı Doçent x' WHEN 11 THEN 'milattan önce ' || n || ' ve milattan sonra ' || m
          WHEN 12 THEN 'Caddesi Sokağı Mahallesi Limitet Şirketi Anonim Şirketi' WHEN 13 THEN 'örneğin çeviren hazırlayan vesaire ve diğerleri çevirmenin notu yazarın notu x' WHEN 14 THEN 'x y z q' WHEN 15 THEN 'Aleko.' WHEN 16 THEN 'Bitti!' WHEN 17 THEN n || '. Bölüm' WHEN 18 THEN n::VARCHAR ELSE '- Ali' END AS spoken FROM w""",
    "audio_timeline": r"""WITH s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\pL\pN]') THEN length(text) * 80 ELSE 0 END AS speech, CASE WHEN turn = 0 THEN 7200 WHEN turn % 3 = 2 THEN 4800 ELSE 2000 END AS silence FROM conversations),
      t AS (SELECT *, coalesce(sum(speech + silence) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
      SELECT conv_id, turn, round_even(start / 8.0, 0)::BIGINT AS start_ms, round_even((start + speech) / 8.0, 0)::BIGINT AS end_ms FROM t""",
    "page_durations": rf"""WITH s AS (SELECT conv_id, round_even(sum(CASE WHEN regexp_matches(text, '[\pL\pN]') THEN length(text) * 80 ELSE 0 END + 4800) / 8.0, 0)::BIGINT AS duration_ms FROM conversations GROUP BY 1), m AS (SELECT *, {_minutes('duration_ms')} AS m FROM s)
      SELECT conv_id, duration_ms, {SHOWN} AS shown FROM m""",
    "page_selection": """WITH b AS (SELECT conv_id, count(*)::INT AS last FROM conversations GROUP BY 1), p AS (SELECT conv_id, last, unnest(range(1, last + 1))::INT AS page_no FROM b)
      SELECT * FROM p WHERE CASE conv_id % 4 WHEN 0 THEN true WHEN 1 THEN page_no BETWEEN 2 AND 3 OR page_no = 1 OR page_no = last WHEN 2 THEN page_no = 2 ELSE true END""",
    "resume": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "complete_chapters": f"WITH {BOOK} SELECT chapter, count(*) AS pages FROM pages LEFT JOIN (SELECT DISTINCT page_no, true AS ok FROM audio) a USING (page_no) GROUP BY 1 HAVING bool_and(ok IS NOT NULL)",
    "chapter_durations": f"WITH {BOOK} SELECT chapter, sum(duration_ms)::BIGINT AS duration_ms FROM pages JOIN audio USING (page_no) GROUP BY 1",
    "chapter_manifest": f"""WITH {BOOK} SELECT chapter, printf('%03d', chapter + 1) || ' - Part ' || chapter || '.mp3' AS file_name, string_agg(printf('%04d', page_no) || '.mp3', ',' ORDER BY page_no) AS files FROM pages LEFT JOIN (SELECT DISTINCT page_no, true AS ok FROM audio) a USING (page_no) GROUP BY 1 HAVING bool_and(ok IS NOT NULL)""",
    "catalog": f"WITH {CATALOG} SELECT book_id, variant, chapter, coalesce(own_title, regexp_replace(name, '\\.[^.]*$', '')) AS title, name, size, duration_ms FROM entries",
    "variant_totals": f"WITH {CATALOG}, t AS (SELECT book_id, variant, count(*) AS chapters, sum(size)::BIGINT AS size, sum(duration_ms)::BIGINT AS duration_ms, {_minutes('sum(duration_ms)')} AS m FROM entries GROUP BY 1, 2) SELECT book_id, variant, chapters, size, duration_ms, row_number() OVER (PARTITION BY book_id ORDER BY variant) = 1 AS is_first, {SHOWN} AS shown FROM t",
    "playlists": f"WITH {CATALOG} SELECT book_id, md5('#EXTM3U' || chr(10) || string_agg(name || chr(10), '' ORDER BY chapter, name)) AS playlist_md5 FROM entries GROUP BY 1",
    "stale_archives": "SELECT o_custkey AS book_id, o_orderstatus AS variant FROM orders GROUP BY 1, 2 HAVING o_custkey % 3 = 0 OR min(o_orderdate) < max(o_orderdate)",
    "run_summaries": """WITH o AS (SELECT l_suppkey AS book_id, l_orderkey * 10 + l_linenumber AS page_no, l_returnflag AS f, (l_quantity * 10)::BIGINT AS ms FROM lineitem)
      SELECT book_id, count(*) AS selected, count(*) FILTER (f = 'A') AS skipped, count(*) FILTER (f = 'N') AS produced, count(*) FILTER (f = 'R') AS failed, round_even(coalesce(sum(ms) FILTER (f = 'N'), 0) / 1000.0, 1)::DOUBLE AS audio_s,
        coalesce(array_to_string(list_sort(list(page_no) FILTER (f = 'R'))[1:5], ','), '') AS first_failures FROM o GROUP BY 1""",
    "page_islands": "WITH e AS (SELECT user_id AS book_id, event_id AS block_no, event_type <> lag(event_type, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) AS changed FROM events) SELECT book_id, block_no, sum(changed::INT) OVER (PARTITION BY book_id ORDER BY block_no)::INT AS page_no FROM e",
    "source_pages": """WITH a AS (SELECT doc_id, n_chars, unnest(range(0, n_chars + 1, 350)) AS p FROM documents)
      SELECT doc_id, p AS "at", greatest(1, least(floor((p - 40) / 513.0)::INT + 1, n_chars // 500 + 1))::INT AS page FROM a""",
    "display_formats": rf"""WITH c AS (SELECT *, abs(c_acctbal * 1000)::BIGINT AS v FROM customer), d AS (SELECT *, trunc(abs(c_acctbal * 1000))::BIGINT AS size, {_minutes('trunc(abs(c_acctbal * 1000))')} AS m FROM c)
      SELECT c_custkey, CASE WHEN size >= 1048576 THEN round_even(size / 1048576.0, 0)::BIGINT || ' MB' ELSE round_even(size / 1024.0, 0)::BIGINT || ' KB' END AS size, {SHOWN} AS duration, upper(c_mktsegment[1:1] || c_name[1:1]) AS initials,
        trim(regexp_replace(c_name || ' <"a/b">: ?' || c_mktsegment, '[<>:"/\\|?*\x00-\x1f]', '', 'g')[1:60]) AS safe, ' x' || c_name AS folder, 'https://books.example/x/k/' || c_custkey || '/' AS link, regexp_replace(c_name || 'ö+ş', '[^A-Za-z0-9._ -]', '_', 'g') AS ascii FROM d""",
    "byte_ranges": """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey % 50 AS a, p_partkey % 97 AS b, p_partkey % 120 AS c, p_partkey % 150 AS d FROM part),
      r AS (SELECT *, CASE k WHEN 0 THEN a WHEN 1 THEN c WHEN 2 THEN greatest(0, 100 - d) ELSE 0 END AS s, CASE k WHEN 0 THEN least(b, 99) ELSE 99 END AS e FROM p)
      SELECT p_partkey, CASE WHEN k > 3 THEN 200 WHEN s > e THEN 416 ELSE 206 END AS status, CASE WHEN k > 3 THEN 0 WHEN s <= e THEN s END AS start, CASE WHEN k > 3 THEN 99 WHEN s <= e THEN e END AS "end" FROM r""",
    "access_rules": """SELECT c_custkey, NOT (c_custkey % 3 > 0 AND c_custkey % 4 > 0 AND NOT c_custkey % 5 > 1) AS allowed, c_custkey % 2 = 0 AS is_book, regexp_matches(lower(c_mktsegment) || '-' || c_nationkey, '^[a-z]+-[a-z0-9]+$') AS is_variant FROM customer""",
    "content_ids": "SELECT item_id, sha1(text)[1:12] AS book_id FROM benchmark",
    "corpus_paragraphs": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{BLANK}+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents) SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS md5 FROM p""",
    "book_statistics": f"""WITH {LINES}, l AS (SELECT source AS book_id, coalesce(median(length(text)) FILTER (length(text) > 20), 60.0) AS typical FROM lines GROUP BY 1), d AS (SELECT source AS book_id, sum(n_chars)::BIGINT AS n_chars, sum(n_chars) / count(*) AS mean_chars FROM documents GROUP BY 1)
      SELECT book_id, typical, n_chars, mean_chars, mean_chars < 2400 AS rejected FROM l JOIN d USING (book_id)""",
    "bookmark_levels": "WITH c AS (SELECT p_brand AS book_id, CASE WHEN p_partkey % 97 = 0 THEN p_partkey % 3 ELSE 3 + right(p_brand, 1)::INT % 4 + p_size % 3 END::INT AS level, count(*) AS n FROM part GROUP BY 1, 2) SELECT book_id, coalesce(min(level) FILTER (n >= 2), min(level)) AS level FROM c GROUP BY 1",
    "page_titles": "WITH b AS (SELECT p_brand AS book_id, p_size % 7 AS level, p_partkey % 11 AS page_no, p_partkey AS ord, p_name AS title FROM part), c AS (SELECT book_id, level, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT book_id, coalesce(min(level) FILTER (n >= 2), min(level)) AS level FROM c GROUP BY 1) SELECT book_id, page_no, string_agg(title, '|' ORDER BY ord) AS titles FROM b JOIN t USING (book_id, level) WHERE ord % 5 <> 0 GROUP BY 1, 2",
    "page_paragraphs": f"WITH RECURSIVE {PAGED_TEXT.format('text')}, {NO_MARKS}, {BLOCKS} {BLOCK_COLUMNS}",
    "bookmarked_paragraphs": f"WITH RECURSIVE {PAGED_TEXT.format(SPARSE)}, {MARKS}, {BLOCKS} {BLOCK_COLUMNS}",
    "bookmark_chapters": f"""WITH RECURSIVE {PAGED_TEXT.format(SPARSE)}, {MARKS}, {BLOCKS}, own AS (SELECT book_id, min(page_no) AS page_no FROM paged GROUP BY 1), shifts AS (SELECT book_id, CASE WHEN (book_id, page_no) IN (SELECT (book_id, page_no) FROM titles) THEN 0 ELSE 1 END AS shift FROM own)
      SELECT book_id, 0 AS chapter, md5(CASE WHEN book_id = 'src1' THEN 'Kitap' ELSE 'T ' || book_id END) AS md5 FROM shifts WHERE shift = 1
      UNION ALL SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY page_no, k) - 1 + shift)::INT, md5(title) FROM titles JOIN shifts USING (book_id)""",
    "heading_sentences": f"""WITH RECURSIVE {PAGED_TEXT.format(SPARSE)}, {MARKS}, {BLOCKS}, lines AS (SELECT book_id AS doc_id, block_no, text FROM blocks WHERE NOT is_heading), {SPLIT}
      SELECT doc_id AS book_id, block_no, sent_no::INT AS sent_no, CASE WHEN last THEN 'paragraph' ELSE 'sentence' END AS gap, md5(sentence) AS md5 FROM sents UNION ALL SELECT book_id, block_no, 0, 'heading', md5(text) FROM blocks WHERE is_heading""",
    "sparse_page_headers": f"""WITH base AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Kitap ' || doc_id % 4 || CASE WHEN doc_id % 6 = 0 THEN ' a' ELSE ' b' END || chr(10) || text END AS text FROM documents),
      split AS (SELECT doc_id AS page_no, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, {PAGE_PARTS} AS parts FROM base WHERE text IS NOT NULL)),
      l AS (SELECT page_no, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM split), c AS (SELECT page_no, line_no, {_clean('line')} AS text FROM l),
      n AS (SELECT *, CASE WHEN text <> '' THEN count(*) FILTER (text <> '') OVER (PARTITION BY page_no ORDER BY line_no) END AS up, count(*) FILTER (text <> '') OVER (PARTITION BY page_no) AS total FROM c),
      e AS (SELECT *, {_header_key('text')} AS key, CASE WHEN up IS NULL OR total <= 2 THEN NULL WHEN total - up + 1 <= 2 THEN -(total - up + 1) WHEN up <= 2 THEN up END AS edge FROM n),
      hits AS (SELECT edge, key FROM e WHERE edge IS NOT NULL AND key <> '' GROUP BY 1, 2 HAVING count(*) >= greatest(3, (SELECT floor(count(*) * 0.2) FROM documents)))
      SELECT 'all' AS book_id, page_no, count(*) AS n_lines, sum(line_no)::BIGINT AS line_sum FROM e WHERE edge IS NULL OR NOT (EXISTS (SELECT 1 FROM hits h WHERE h.edge = e.edge AND h.key = e.key)
        OR regexp_matches(text, '^[\\s\\-–—.]*(?:[sS][aA][yY][fF][aA]\\s*|[sS]\\.\\s*|[pP][aA][gG][eE]\\s*)?(\\d{{1,4}}|[ivxlcdmIVXLCDMıİ]{{1,8}})[\\s\\-–—.]*$')) GROUP BY 2""",
    "toc_chapters": """WITH s AS (SELECT l_orderkey AS book_id, l_linenumber AS ord, CASE WHEN l_orderkey % 3 = 0 AND l_suppkey % 2 = 0 THEN 'T' || l_suppkey END AS label, CASE WHEN l_partkey % 3 = 0 THEN 'H' || l_partkey END AS head, CASE WHEN l_orderkey % 2 = 0 THEN 'B' ELSE '' END AS book FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
      n AS (SELECT *, coalesce(label, CASE WHEN count(label) OVER (PARTITION BY book_id) = 0 THEN head END) AS name, row_number() OVER (PARTITION BY book_id ORDER BY ord) = 1 AS is_first FROM s),
      c AS (SELECT *, (sum((name IS NOT NULL OR is_first)::INT) OVER (PARTITION BY book_id ORDER BY ord) - 1)::INT AS chapter FROM n)
      SELECT book_id, ord, chapter, first_value(coalesce(name, nullif(book, ''), 'Giriş')) OVER (PARTITION BY book_id, chapter ORDER BY ord) AS title FROM c""",
}
