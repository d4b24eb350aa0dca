"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line (text between line feeds) is the set of its five-word shingles, words in lower
case; a line of fewer words is one shingle, a blank line is empty and never removed. A
line is removed if an earlier line of the corpus, in order of (doc_id, line number), has
at least ``percent`` per cent Jaccard similarity with it, whether or not that earlier
line is itself kept. Results therefore do not depend on processing order.

1. Lines with equal text are grouped by two 64-bit hashes; all but the first go.
2. Tokens (shingles) are ordered by how rare they are likely to be, which takes no count: those
   that end in longer words first, then by hash. A token is 6 bits of rank above 57 bits of hash.
   Any order gives the same result.
3. Each line lists its prefix, n - ceil(t n) + 1 rarest tokens; two similar lines share
   a prefix token. Length and positional filters drop most chance meetings.
   Tokens that more than ``SMALL`` prefixes list (at most ``MOST_COMMON``, the most listed) are
   phrases that otherwise different lines share. Two lines that share no other prefix token both
   list one of these, so the lines that do are listed anew among themselves, in an order that has
   these tokens last; their first lists are dropped.
4. A token's list of up to ``SMALL`` lines yields its pairs, which are verified on full sets.
5. In a longer list (a family of near copies) every line is verified against the list's
   first line, its leader. Lines that still have no match are joined with the others by
   what sets them apart: with D(x) the symmetric difference of x and the leader,
   |x ^ y| = |D(x) ^ D(y)|, so similar lines share much of D, and prefix and positional
   filters on D (tokens that the leader lacks first) find them without meeting the
   family's common part again. In a long list of D tokens, too, only lines that its first line
   does not match meet the others.

Bounds in step 5, with c = (100 - percent) / (100 + percent), l the leader's size: two lines
match if |D(a)| + |D(b)| - 2 o <= c (|a| + |b|), o their common part. b is not matched by the
leader, so |D(b)| > c (|b| + l), which gives o > (|D(a)| + c (l - |a|)) / 2; and
o >= |D| - c (|a| + |b|) >= |D| - |own| (100 - percent) / percent for both.

The lines copied most often are left out of steps 3 to 5 by a broadcast of at most
``MAX_GROUPS`` groups (about 40 bytes each), so hot lines never reach a list.

Defined cases
* null text: no lines, stays null. Null doc_id: the row passes unchanged and takes no part.
* rows that repeat a doc_id: equal texts are one document and lose the same lines; different texts
  are documents of their own, in order of a hash of the text.
* a document that loses all lines keeps an empty text. Ties cannot occur, as positions differ.
* empty and very long texts: no lines, and one row per line. Empty table: empty result.
* extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.broadcasts import small_side
from folioflow.llm.names import free_names
from folioflow.store import materialize

SHINGLE = 5
SMALL = 32
MAX_GROUPS = 300_000
MOST_COMMON = 16_384
RANK_BITS = 6
HASH_BITS = 57
WORD_GAP = r"[\x20\x09-\x0D]+"


def keyed(docs: DataFrame, copy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``copy``: 0, or a hash of the text where different texts share an id."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ids = materialize(ids)
    if not ids.limit(1).count():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    twice = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h")).join(small_side(ids, 4_000_000), "id", "left_semi")
    many = materialize(twice.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("id"))
    if not many.limit(1).count():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    (own,) = free_names(docs, "repeated_id")
    joined = docs.join(small_side(many.withColumnRenamed("id", own), 4_000_000), F.col(id_col).cast("long") == F.col(own), "left")
    return joined.withColumn(copy, F.when(F.col(own).isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(text_col), F.lit(1 << 30)))).drop(own)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copy: str | None = None) -> DataFrame:
    """(doc_id, line_no, line), one row per line with an id; line_no holds ``copy`` above 32 bits of the line's number."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    above = F.shiftleft(F.col(copy), 32) if copy else F.lit(0)
    lines = rows.select(F.col(id_col).cast("long").alias("doc_id"), above.alias("above"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", (F.col("above") + F.col("line_no")).cast("long").alias("line_no"), "line")


def words_of_line(line: Column) -> Column:
    """Words in lower case. Most lines hold no white space but blanks, and one-character splits are fast."""
    other = reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in "\t\x0b\x0c\r"])
    plain = F.when(other, F.regexp_replace(line, WORD_GAP, " ")).otherwise(line)
    return F.array_remove(F.split(F.lower(plain), " "), "")


def tokenised(lines: DataFrame) -> DataFrame:
    """``lines`` with tokens: distinct, those first that are likely rare.

    Shingles come from hashes of words by way of pairs and fours, so that no shingle is a row of its own.
    """
    w, pairs, fours = free_names(lines, "w", "pairs", "fours")
    n = F.size(w)
    rank = F.lit((1 << RANK_BITS) - 1).cast("long")
    below = 64 - HASH_BITS
    # a word is its hash above the rank of its length
    word = lambda x: F.shiftleft(F.xxhash64(x), RANK_BITS).bitwiseOR(rank - F.least(F.length(x).cast("long"), rank))
    part = lambda x, at: F.slice(x, F.lit(at), F.greatest(n - (SHINGLE - 1), F.lit(0)))
    both = lambda x, y: F.xxhash64(x, y)

    def token(four: Column, last: Column) -> Column:
        # never null, so that Spark sorts plain longs
        return F.coalesce(F.shiftleft(last.bitwiseAND(rank), HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(four, last), below)), F.lit(0).cast("long"))

    rows = lines.withColumn(w, F.transform(words_of_line(F.col("line")), word))
    rows = rows.withColumn(pairs, F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), both))
    rows = rows.withColumn(fours, F.zip_with(part(pairs, 1), part(pairs, 3), both))
    long = F.sort_array(F.array_distinct(F.zip_with(fours, part(w, SHINGLE), token)))
    short = F.array(F.shiftrightunsigned(F.xxhash64(w), below))
    none = F.array().cast("array<long>")
    return rows.withColumn("tokens", F.when(n >= SHINGLE, long).when(n > 0, short).otherwise(none)).drop(w, pairs, fours)


def hashed_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2) of lines with a word."""
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def exact_groups(hashed: DataFrame) -> DataFrame:
    """(h1, h2, n, first_doc, first_line) of lines whose text occurs more than once."""
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first")).where("n > 1")
    return groups.select("h1", "h2", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def _most_copied(groups: DataFrame, most: int) -> DataFrame:
    """The groups with the most copies, at most ``most`` of them; whole steps of a histogram."""
    steps = sorted(((r["step"], r["groups"]) for r in groups.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("groups")).collect()), reverse=True)
    total, cut = 0, 1 << 30
    for step, count in steps:
        total += count
        if total > most:
            break
        cut = step
    return groups.where(F.floor(F.log2("n") * 8) >= cut)


_PAIR = ["a_doc", "a_line", "b_doc", "b_line"]


def _side(x: str, rows: DataFrame, key: list[str]) -> DataFrame:
    names = {"doc_id": f"{x}_doc", "line_no": f"{x}_line"}
    return rows.select(*key, *[F.col(c).alias(names.get(c, f"{x}_{c}")) for c in rows.columns if c not in key])


def _near(a: DataFrame, b: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs of rows (doc_id, line_no, n, d, at) that share ``key``, a before b, which length and position allow.

    n is a line's size, d that of the set whose token number ``at`` is the key: its own, or its difference from a leader.
    """
    before = (F.col("a_doc") < F.col("b_doc")) | ((F.col("a_doc") == F.col("b_doc")) & (F.col("a_line") < F.col("b_line")))
    n, m = F.col("a_n"), F.col("b_n")
    common = F.least(F.col("a_d") - F.col("a_at"), F.col("b_d") - F.col("b_at"))  # for the first token that two lines share
    lengths = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    enough = common * 2 * (100 + percent) >= (F.col("a_d") + F.col("b_d")) * (100 + percent) - (n + m) * (100 - percent)
    return _side("a", a, key).join(_side("b", b, key), key).where(before & lengths & enough).select(*_PAIR)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line_no) of the later lines of pairs that are similar enough."""
    own = lambda x: sets.select(F.col("doc_id").alias(f"{x}_doc"), F.col("line_no").alias(f"{x}_line"), F.col("tokens").alias(f"{x}_tokens"))
    joined = pairs.join(own("b"), ["b_doc", "b_line"]).join(own("a"), ["a_doc", "a_line"])
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    good = joined.where(shared * 100 >= (F.size("a_tokens") + F.size("b_tokens") - shared) * percent)
    return good.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")).distinct()


def _lines_named(named: DataFrame, docs: DataFrame, id_col: str, text_col: str, copy: str) -> DataFrame:
    """(doc_id, line_no, line) of the lines named; only their documents are read."""
    (own,) = free_names(docs, "named_id")
    own_docs = docs.join(small_side(named.select(F.col("doc_id").alias(own)).distinct(), 4_000_000), F.col(id_col).cast("long") == F.col(own), "left_semi")
    return lines_of(own_docs, id_col, text_col, copy).join(small_side(named, 2_000_000), ["doc_id", "line_no"], "left_semi")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (leader, token, doc_id, line_no, n, d, at, first, later) of the prefixes of the members' differences from their leaders.

    ``first``: the row may stand for the earlier line of a pair; ``later``: for the later one, which has no match yet.
    """
    lead = sets.select(F.col("doc_id").alias("lead_doc"), F.col("line_no").alias("lead_line"), F.col("tokens").alias("lead"))
    met = members.join(sets, ["doc_id", "line_no"]).join(lead, ["lead_doc", "lead_line"])
    met = met.select("lead_doc", "lead_line", "doc_id", "line_no", "open", F.size("tokens").alias("n"), F.size("lead").alias("l"), F.concat(F.array_except("tokens", "lead"), F.array_except("lead", "tokens")).alias("diff"))
    met = met.withColumn("d", F.size("diff"))
    far = F.expr(f"d - ({100 - percent} * n) div {percent}")
    up, down = 100 + percent, 100 - percent
    as_first = F.col("d") + 1 - F.greatest(F.expr(f"(d * {up} + {down} * (l - n)) div {2 * up} + 1"), far)
    as_later = F.when(F.col("open"), F.col("d") + 1 - F.greatest(F.lit(1), far)).otherwise(0)
    met = met.withColumn("as_first", as_first.cast("int")).withColumn("as_later", as_later.cast("int"))
    rows = met.select("lead_doc", "lead_line", "doc_id", "line_no", "n", "d", "as_first", "as_later", F.posexplode(F.slice("diff", F.lit(1), F.greatest("as_first", "as_later", F.lit(0)))).alias("at", "token"))
    return rows.select(F.xxhash64("lead_doc", "lead_line").alias("leader"), "token", "doc_id", "line_no", "n", "d", "at", (F.col("at") < F.col("as_first")).alias("first"), (F.col("at") < F.col("as_later")).alias("later"))


def _token_lists(once: DataFrame, percent: int, last: list[int] | None = None) -> DataFrame:
    """(token, doc_id, line_no, n, d, at, size): the prefix rows whose token several lines list; the tokens ``last`` end the order."""
    sets = tokenised(once)
    if last:
        among = f"x in ({', '.join(f'{x}L' for x in last)})"
        sets = sets.withColumn("tokens", F.expr(f"concat(filter(tokens, x -> not {among}), filter(tokens, x -> {among}))"))
    n = F.size("tokens")
    prefix = F.slice("tokens", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    # an outer explode, as Spark would push the inner one's size filter below the projection and evaluate the tokens again
    listed = sets.select("doc_id", "line_no", n.alias("n"), F.posexplode_outer(prefix).alias("at", "token")).where("token is not null")
    sized = listed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("size > 1")
    return sized.select("token", "doc_id", "line_no", "n", F.col("n").alias("d"), "at", "size")


def _without_common(shared: DataFrame, lines_named: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``shared`` with the lists of common tokens made anew: among their lines, these tokens last. New lists have negative tokens."""
    common = materialize(shared.where(f"size > {SMALL}").select("token", "size").distinct().orderBy(F.desc("size"), "token").limit(MOST_COMMON).select("token"))
    last = [r["token"] for r in common.collect()]
    if not last:
        return shared
    common = F.broadcast(common)
    held = materialize(shared.join(common, "token", "left_semi").select("doc_id", "line_no").distinct())
    anew = _token_lists(lines_named(held), percent, last).withColumn("token", F.bitwise_not("token"))
    return materialize(shared.join(common, "token", "left_anti").unionByName(anew))


def later_matches(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", copy: str | None = None) -> DataFrame:
    """(doc_id, line_no) of every line with an earlier match; line_no as in ``lines_of``, with the column ``copy`` or one made here."""
    if copy is None:
        (copy,) = free_names(docs, "copy")
        docs = keyed(docs, copy, id_col, text_col)
    docs = docs.select(id_col, text_col, copy)
    lines = lines_of(docs, id_col, text_col, copy)
    hashed = materialize(hashed_lines(lines))
    groups = materialize(exact_groups(hashed))
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line"))
    copies = hashed.join(groups, ["h1", "h2"]).where(later).select("doc_id", "line_no")

    hot = small_side(_most_copied(groups, MAX_GROUPS).drop("n"), MAX_GROUPS)
    once = lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")).join(hot, ["h1", "h2"], "left")
    once = once.where(F.col("first_doc").isNull() | ~later).select("doc_id", "line_no", "line")
    lines_named = lambda named: _lines_named(named, docs, id_col, text_col, copy)
    shared = _without_common(materialize(_token_lists(once, percent)), lines_named, percent)

    line, row = ["doc_id", "line_no"], ["doc_id", "line_no", "n", "d", "at"]
    key = ["token"]
    small, large = shared.where(f"size <= {SMALL}").select(*key, *row), shared.where(f"size > {SMALL}").select(*key, *row)
    heads = large.groupBy(*key).agg(F.min(F.struct(*row)).alias("f")).select(*key, "f.*")
    pairs = materialize(_near(small, small, key, percent).union(_near(heads, large, key, percent)).distinct())
    ends = F.array(*[F.struct(F.col(f"{x}_doc").alias("doc_id"), F.col(f"{x}_line").alias("line_no")) for x in "ab"])
    named = materialize(pairs.select(F.explode(ends).alias("k")).select("k.*").union(large.select(*line)).distinct())
    sets = materialize(tokenised(lines_named(named)).select("doc_id", "line_no", "tokens"))
    found = materialize(_similar(pairs, sets, percent))

    members = large.join(heads.select(*key, F.col("doc_id").alias("lead_doc"), F.col("line_no").alias("lead_line")), key).where("doc_id <> lead_doc or line_no <> lead_line")
    members = members.select("lead_doc", "lead_line", *line).distinct().join(found.withColumn("gone", F.lit(True)), line, "left").withColumn("open", F.col("gone").isNull())
    apart = materialize(_differences(members, sets, percent))
    key = ["leader", "token"]
    sizes = apart.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max("first").alias("firsts"), F.max("later").alias("laters")).where("size > 1 and firsts and laters")
    lists = materialize(apart.join(sizes.select(*key, "size"), key))
    firsts, laters = (lists.where(x).select(*key, *row, "size") for x in ("first", "later"))
    few, many = (lambda rows: rows.where(f"size <= {SMALL}").drop("size")), (lambda rows: rows.where(f"size > {SMALL}").drop("size"))
    heads = many(firsts).groupBy(*key).agg(F.min(F.struct(*row)).alias("f")).select(*key, "f.*")
    pairs = _near(few(firsts), few(laters), key, percent).union(_near(heads, many(laters), key, percent)).distinct()
    more = materialize(_similar(materialize(pairs), sets, percent))
    left = many(laters).join(more, line, "left_anti")
    last = _similar(materialize(_near(many(firsts), left, key, percent).distinct()), sets, percent)
    return copies.union(found).union(more).union(last).distinct()


def dedup_lines(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later matches cut from the text; same rows and columns."""
    copy, own, above, lost = free_names(docs, "copy", "own_id", "above", "lost")
    rows = keyed(docs, copy, id_col, text_col)
    number = F.col("line_no").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    gone = later_matches(rows, percent, id_col, text_col, copy).groupBy(F.col("doc_id").alias(own), F.shiftright("line_no", 32).alias(above)).agg(F.collect_set(number).alias(lost))
    joined = rows.join(gone, (F.col(id_col).cast("long") == F.col(own)) & (F.col(copy) == F.col(above)), "left")
    lines = F.split(text_col, "\n")
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(lost, i), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def removed_lines(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, removed), one row per document with an id: line numbers cut, from 0, ascending."""
    (copy,) = free_names(docs, "copy")
    rows = keyed(docs, copy, id_col, text_col)
    own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(copy).alias("above"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    number = F.col("line_no").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    gone = later_matches(rows, percent, id_col, text_col, copy).groupBy("doc_id", F.shiftright("line_no", 32).alias("above")).agg(F.sort_array(F.collect_set(number)).alias("removed"))
    return own.join(gone, ["doc_id", "above"], "left").select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
