"""The opN queries and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import ann, convrepair, linedup, manifest, maxent, mixing, neardup, quality, sentencepiece, suffixdedup, tiff, toolchat, urllist


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return ann.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes from each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::DOUBLE AS total FROM sized GROUP BY source
), ranked AS (SELECT source, total, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM per
), capped AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * total AS most FROM ranked
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM capped
), fixed AS (
  SELECT source, total::BIGINT AS source_size,
    least(most, coalesce((SELECT remaining / open_weight FROM levels WHERE most / weight > remaining / open_weight ORDER BY most / weight, place LIMIT 1) * weight, most)) AS target
  FROM levels
), rated AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN fixed f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, rate,
  (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER * size)::BIGINT AS taken
FROM rated
"""


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by Viterbi over unigram scores, with the size and md5 of what they decode to."""
    vocabulary = sentencepiece.as_unigram(sentencepiece.load_vocabulary())
    encoded = sentencepiece.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = sentencepiece.decode(encoded, vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("decoded_chars"), F.md5("decoded").alias("decoded_md5"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    weights = quality.train(docs, labels)
    return quality.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations linked as tool calls and results.

    The table holds plain turns, so they are read as a protocol: a user turn t is call ``c<t>`` of
    tool ``ask`` (every third of ``look``) with its text and length as arguments, the assistant's turn after it
    is the result, and a call comes after the user's turn before unless t is a multiple of 8.
    Every fifth turn's length is sent as text, which the schema refuses.
    """
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'")
    length = F.length("text")
    text = F.substring(F.to_json(F.array("text")), F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    arguments = F.concat(F.lit('{ "text" : '), text, F.lit(', "length" : '), F.when(F.col("turn") % 5 == 4, F.concat(F.lit('"'), length, F.lit('"'))).otherwise(length.cast("string")), F.lit(" }"))
    calls = asked.select(
        "conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"), F.when(F.col("turn") % 3 == 0, "look").otherwise("ask").alias("tool"), arguments.alias("arguments"),
        F.when(F.col("turn") % 8 != 0, F.array(F.concat(F.lit("c"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame([(t, n, k, True) for t in ("ask", "look") for n, k in (("text", "string"), ("length", "integer"))], "tool string, name string, kind string, required boolean")
    linked = toolchat.link_calls(calls, results, schemas)
    return linked.select("conv_id", "call_id", "tool", "call_turn", "result_turn", "level", "n_calls", "n_results", F.array_join("errors", ",").alias("errors"), "valid", "status", F.md5("message").alias("message_md5"))


OP6_SQL = r"""
WITH calls AS (
  SELECT conv_id, 'c' || turn AS call_id, min(turn) AS call_turn, count(*) AS n_calls, arg_min(text, text) AS text FROM conversations
  WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), linked AS (
  SELECT c.*, CASE WHEN call_turn % 8 <> 0 THEN 'c' || (call_turn - 2) END AS dep, CASE WHEN call_turn % 3 = 0 THEN 'look' ELSE 'ask' END AS tool FROM calls c
), ordered AS (
  SELECT a.*, dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM linked b WHERE b.conv_id = a.conv_id AND b.call_id = a.dep) AS lost FROM linked a
), chain AS (
  SELECT *, sum(CASE WHEN dep IS NULL OR lost THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn) AS run FROM ordered
), levelled AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, call_turn % 2, run ORDER BY call_turn) - 1)::INTEGER AS level FROM chain
), results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, count(*) AS n_results, min(text) AS content FROM conversations
  WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, tool, call_turn, result_turn, level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
    concat_ws(',', CASE WHEN call_turn % 5 = 4 THEN 'kind:length' END, CASE WHEN lost THEN 'after:' || dep END) AS errors, c.text, content, c.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered
  FROM levelled c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, call_id, tool, call_turn, result_turn, level, n_calls, n_results, errors, errors = '' AS valid,
  CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
  md5('{' || CASE WHEN called THEN '"arguments":{"length":' || CASE WHEN call_turn % 5 = 4 THEN '"' || length(text) || '"' ELSE length(text)::VARCHAR END || ',"text":' || to_json(text)::VARCHAR || '},' ELSE '' END
    || '"id":' || to_json(call_id)::VARCHAR || CASE WHEN answered THEN ',"result":' || to_json(content)::VARCHAR ELSE '' END || CASE WHEN called THEN ',"tool":' || to_json(tool)::VARCHAR ELSE '' END || '}') AS message_md5
FROM joined
"""


def _hex(value, start: int):
    return F.conv(F.substring(F.md5(value), start, 4), 16, 10).cast("int")


def op8_urllist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched.

    The table has neither fetch times nor a list, so both follow from it by rule: page p is
    fetched p * 7919 mod 90 days and p mod 24 hours after 2024-01-01; a quarter of the hosts are listed on
    one day and taken off on a later one, some are listed again for good, and others have their /en pages listed.
    """
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    days = lambda n: F.timestamp_seconds(F.unix_seconds(start) + n * 86400)
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.unix_seconds(start) + F.col("page_id") * 7919 % 90 * 86400 + F.col("page_id") % 24 * 3600))
    hosts = pages.select(urllist.host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    first, pick = _hex(F.col("h"), 1) % 60, _hex(F.col("h"), 9) % 16
    off = first + 5 + _hex(F.col("h"), 5) % 40
    row = lambda kind, value, listed, since: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(listed).alias("listed"), days(since).alias("since"))
    events = F.when(pick < 2, F.array(row("domain", F.col("h"), True, first), row("domain", F.col("h"), False, off))).when(
        pick < 4, F.array(row("domain", F.col("h"), True, first), row("domain", F.col("h"), False, off), row("domain", F.col("h"), True, off + 7))
    ).when(pick < 6, F.array(row("prefix", F.concat("h", F.lit("/en")), True, first)))
    entries = hosts.select(F.explode(events).alias("e")).select("e.*")
    return urllist.judge(captures, entries).select("page_id", "url", "fetched_at", "host", "blocked", "entry_kind", "entry_value", "entry_since")


OP8_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919 % 90) * 86400 + page_id % 24 * 3600) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])\.?(?::\d*)?(?:[/?#]|$)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) AS segment
  FROM pages
), hosts AS (
  SELECT h, ('0x' || substr(md5(h), 1, 4))::INTEGER % 60 AS d, ('0x' || substr(md5(h), 9, 4))::INTEGER % 16 AS pick,
    ('0x' || substr(md5(h), 1, 4))::INTEGER % 60 + 5 + ('0x' || substr(md5(h), 5, 4))::INTEGER % 40 AS off_day FROM (SELECT DISTINCT host AS h FROM captures WHERE host <> '')
), spans AS (
  SELECT 'domain' AS kind, h, h AS value, d AS from_day, off_day AS to_day FROM hosts WHERE pick < 4
  UNION ALL SELECT 'domain', h, h, off_day + 7, NULL FROM hosts WHERE pick IN (2, 3)
  UNION ALL SELECT 'prefix', h, h || '/en', d, NULL FROM hosts WHERE pick IN (4, 5)
), active AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(from_day) AS since, TIMESTAMP '2024-01-01' + to_days(to_day) AS until FROM spans)
, hits AS (
  SELECT c.page_id, kind, value, since, row_number() OVER (PARTITION BY c.page_id ORDER BY kind = 'prefix' DESC, length(value) DESC, value DESC) AS r
  FROM captures c JOIN active s ON ((s.kind = 'domain' AND (c.host = s.value OR c.host LIKE '%.' || s.value)) OR (s.kind = 'prefix' AND c.host = s.h AND c.segment = 'en')) AND s.since <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until)
)
SELECT c.page_id, c.url, c.fetched_at, c.host, h.page_id IS NOT NULL AS blocked, h.kind AS entry_kind, h.value AS entry_value, h.since AS entry_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as TIFF pages and read back: digests and a feature of the pixels."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tiff.media_digest(tiff.page_features(tiff.decode_pages(tiff.encode_texts(docs))))


def op9_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line of the corpus matches."""
    return linedup.removed_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), words AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM lines
), sets AS (
  SELECT doc_id, line_no, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), items AS (SELECT doc_id, line_no, len(s) AS n, unnest(s) AS x FROM sets
), gone AS (
  SELECT DISTINCT b_doc, b_line FROM (
    SELECT b.doc_id AS b_doc, b.line_no AS b_line, a.doc_id, a.line_no
    FROM items a JOIN items b ON a.x = b.x AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line_no < b.line_no))
    GROUP BY ALL HAVING count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 75)
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(list(g.b_line::INTEGER ORDER BY g.b_line) FILTER (g.b_line IS NOT NULL), []::INTEGER[]) AS removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.b_doc GROUP BY d.doc_id, d.text
"""


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learnt outside the held-out seventh."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return maxent.lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


# CRC-32 of a text of ASCII characters: a fold over eight bit steps a byte
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1), lambda k: [ascii(({0})[k])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def op11_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of passages of 200 bytes that occur again."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixdedup.remove_repeats(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_convrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a stated rule, their faults, and the cheapest repair.

    The remainder by 20 of a checksum of ``conv_id:turn`` decides: 0 drops the row, 1 empties its text, 2 takes out its
    terminators, 3 repeats it, 4 gives it to the user.
    """
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1])) % 20
    role = F.when(kind == 4, "user").otherwise(filled[2])
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled[3], "[.!?]", "")).otherwise(filled[3])
    damaged = rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    report, _ = convrepair.repair(damaged)
    whole = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", convrepair.null_key(F.col("conv_id")).alias("conv"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = F.sha2(F.lit(""), 256)
    return whole.join(report.drop("conv_id"), "conv", "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


OP12_SQL = f"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM filled WHERE kind <> 0
), placed AS (
  SELECT *, coalesce('s' || conv_id, 'n') AS conv, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS t FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY t) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault, lag(ini) OVER (PARTITION BY conv ORDER BY t) || ini AS pair FROM placed
), priced AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS k FROM judged
), back AS (
  SELECT conv, max(t) + 1 AS t, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM priced GROUP BY conv
  UNION ALL
  SELECT conv, t, least(m0, 5 + least(m2, 5 + m3)), least(m1, 5 + least(m2, 5 + m3)), least(m2, 5 + m3), least(m3, 5 + m2) FROM (
    SELECT p.conv, p.t, least(2 + v0, p.k + 1 + v2, CASE ini WHEN 's' THEN p.k + v1 WHEN 'u' THEN p.k + v2 ELSE 1000000 END) AS m0, least(2 + v1, p.k + 1 + v2, CASE ini WHEN 'u' THEN p.k + v2 ELSE 1000000 END) AS m1,
      least(2 + v2, p.k + 1 + v3, CASE ini WHEN 'a' THEN p.k + v3 ELSE 1000000 END) AS m2, least(2 + v3, p.k + 1 + v2, CASE ini WHEN 'u' THEN p.k + v2 ELSE 1000000 END) AS m3
    FROM back b JOIN priced p ON p.conv = b.conv AND p.t = b.t - 1)
), togo AS (SELECT conv, t, [v0, v1, v2, v3] AS v FROM back
), walk AS (
  SELECT conv, 1::BIGINT AS t, 0 AS q, '' AS audit, NULL::VARCHAR AS lines FROM togo WHERE t = 1
  UNION ALL
  SELECT conv, CASE WHEN step = 'I' THEN t ELSE t + 1 END, CASE step WHEN 'D' THEN q WHEN 'K' THEN kept ELSE made END, audit || step,
    CASE step WHEN 'D' THEN lines WHEN 'K' THEN concat_ws(chr(10), lines, role || ':' || text) ELSE concat_ws(chr(10), lines, CASE made WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN step = 'R' THEN text ELSE '' END) END FROM (
    SELECT *, CASE WHEN text IS NULL THEN 'I' WHEN 2 + after[q + 1] = here[q + 1] THEN 'D' WHEN 5 + here[made + 1] = here[q + 1] THEN 'I' WHEN kept IS NOT NULL AND k + after[kept + 1] = here[q + 1] THEN 'K' ELSE 'R' END AS step FROM (
      SELECT w.*, p.role, p.text, p.k, g.v AS here, h.v AS after, CASE WHEN q = 2 THEN 3 ELSE 2 END AS made, CASE WHEN q = 0 AND ini = 's' THEN 1 WHEN q <> 2 AND ini = 'u' THEN 2 WHEN q = 2 AND ini = 'a' THEN 3 END AS kept
      FROM walk w JOIN togo g ON g.conv = w.conv AND g.t = w.t LEFT JOIN togo h ON h.conv = w.conv AND h.t = w.t + 1 LEFT JOIN priced p ON p.conv = w.conv AND p.t = w.t
      WHERE h.t IS NOT NULL OR q IN (1, 2)))
), best AS (SELECT conv, arg_max(audit, t * 1000000 + length(audit)) AS audit, arg_max(coalesce(lines, ''), t * 1000000 + length(audit)) AS lines FROM walk GROUP BY conv
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(g.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('s' || conv_id, 'n') AS conv FROM conversations) o LEFT JOIN counted c USING (conv) LEFT JOIN best b USING (conv) LEFT JOIN togo g ON g.conv = o.conv AND g.t = 1
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, roots and proof of every document, checked against texts of which half lost their line ends."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = manifest.digest_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    proved = manifest.dataset_proofs(docs, docs.columns, "doc_id", "source", claimed)
    return manifest.verify(proved, F.col("claimed")).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS claimed FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, n, 0 AS level, pos, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, n, level, pos // 3
), ranked AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT n, 0 AS level, pos, digest FROM ranked
  UNION ALL
  SELECT (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY n, level, pos // 3
), sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), top_sides AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), walk AS (
  SELECT r, tree, 0 AS level, pos, claimed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT w.r, w.tree, w.level + 1, w.pos // 3, sha256(s.l || w.h || s.r), w.proof || s.l || s.r FROM walk w JOIN sides s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos
), under AS (SELECT w.r, k.pos, w.h, w.proof, k.digest AS subroot FROM (SELECT r, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY r, tree) w JOIN ranked k ON w.tree = k.tree
), over_walk AS (
  SELECT r, 0 AS level, pos, h, proof, subroot FROM under
  UNION ALL
  SELECT w.r, w.level + 1, w.pos // 3, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, w.subroot FROM over_walk w JOIN top_sides s ON w.level = s.level AND w.pos = s.pos
), done AS (SELECT r, any_value(subroot) AS subroot, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM over_walk GROUP BY r)
SELECT p.doc_id, p.leaf, d.subroot, t.digest AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = t.digest AS verified
FROM placed p JOIN done d ON p.r = d.r CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_neardup": op3_neardup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_toolcalls": op6_toolcalls,
    "op7_tiff": op7_tiff,
    "op8_urllist": op8_urllist,
    "op9_linedup": op9_linedup,
    "op10_lm": op10_lm,
    "op11_suffixdedup": op11_suffixdedup,
    "op12_convrepair": op12_convrepair,
    "op13_manifest": op13_manifest,
}

SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op6_toolcalls": OP6_SQL,
    "op8_urllist": OP8_SQL,
    "op9_linedup": OP9_SQL,
    "op12_convrepair": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
