"""MinHash near-duplicates with tensored banding.

A document is the set of its five-word shingles. Instead of L independent tables, two
collections of ``side`` short minhash tuples are drawn; table (i, j) is keyed by the
pair (tuple i of the first, tuple j of the second). That gives side^2 tables from
2 * side tuples, so minhash work grows with the root of the number of tables.
Candidates are verified on full sets.

With tuples of two minhashes and side 8, a pair at similarity s meets in some table
with probability (1 - (1 - s^2)^8)^2: 0.997 at 0.75, 0.9994 at 0.8, 1.0000 at 0.9.

How groups are kept linear
* Equal sets are collapsed to one class before anything is banded.
* A bucket of up to ``SMALL`` classes yields the pairs whose sketches agree. They are
  verified in two steps: first each class against the bucket's smallest id, then,
  of what is left, only pairs whose components still differ.
* In a larger bucket every class is compared with ``PIVOTS`` pivots: the classes
  nearest to the bucket's consensus sketch (a family's original, its leader) and the smallest ids.
  The members of buckets with one leader form a list.
* A list of up to ``SMALL`` classes yields the pairs in different components. In a longer one all classes
  are compared with its smallest set L, and what they hold beyond L, rarest in the list first, is dealt
  into new lists, one for each shingle of an exact prefix; these are treated in the same way. The larger set of a pair
  looks up its prefix, the smaller is listed under a shorter one, so that what a list shares by and large, which comes last, lists nobody.
  A list under which at most ``SMALL`` classes stand, or that is not half as long as the one it comes from, yields its pairs. A list in one component ends.

Bounds, with i(x) the part of x in L and percent = 100 p: x and y match if |x ^ y| >= p (|x| + |y|) / (1 + p), which is at least p |x| for the larger and
2 p |y| / (1 + p) for the smaller. At most min(i(x), i(y)) of that lies in L, so p |x| - i(x) and 2 p |y| / (1 + p) - i(y) lie beyond it in both. If y and L do not match,
i(y) < p (|y| + |L|) / (1 + p), and as |L| <= |x| something lies beyond L in any case; if both match L, they are in one component.

The sketch holds two bits of each of the 32 minhashes. Pairs that agree in fewer than
``AGREE`` of them are dropped; at similarity 0.75 that happens to 1 pair in 10^5.

Defined cases
* null, empty or blank text: empty set, n_shingles 0, linked with nothing.
* fewer than five words: the whole sequence is the one shingle.
* null doc_id: a class of its own, component_id null, kept.
* rows that repeat a doc_id are one document: they share a component, each with the set size of its own text.
* very long texts are whole sets like others. Empty table: empty result. Extra columns pass through
  ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.broadcasts import small_side
from folioflow.llm.components import connected_components, joined_components
from folioflow.llm.hashing import column_bytes, mini_batches, mix, words_of
from folioflow.llm.names import free_names
from folioflow.store import materialize

SHINGLE = 5
SIDE = 8
TUPLE = 2
N_HASHES = 2 * SIDE * TUPLE
SMALL = 48
PIVOTS = 4
AGREE = 16
MAX_BROADCAST_IDS = 4_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_SEEDS = _RNG.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_TABLES = _RNG.integers(0, 1 << 63, (SIDE, SIDE), dtype=np.uint64)
_LOW = np.uint64(0x5555555555555555)


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several rows (repeats included), and each row's first one (n + 1 bounds)."""
    size = np.diff(bounds)
    with np.errstate(over="ignore"):
        whole = np.zeros(len(words), np.uint64)
        for k in range(SHINGLE):
            whole[: len(words) - k] += words[k:] * _PLACES[k]
        row = np.repeat(np.arange(len(size)), size)
        left = bounds[1:][row] - np.arange(len(words))  # words from here to the row's end
        keep = left >= SHINGLE
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        for r in short:
            lo, hi = bounds[r], bounds[r + 1]
            whole[lo] = (words[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            keep[lo] = True
        return mix(whole[keep]), np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(size)))))


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words, np.array([0, len(words)]))[0])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): set size, set fingerprint and minhashes; k1 is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            rows = batch.num_rows
            n, k1, k2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            sig = np.zeros((rows, N_HASHES), np.uint32)
            for i, j in mini_batches(offsets):
                found, bounds = shingles(*words_of(data, offsets[i : j + 1]))
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                at = bounds[:-1][full]
                with np.errstate(over="ignore"):
                    for k in range(N_HASHES):
                        sig[i + full, k] = np.minimum.reduceat((found ^ _SEEDS[k]) * _ODD[k], at) >> np.uint64(32)
                    for r in full:
                        own = np.unique(found[bounds[r] : bounds[r + 1]])
                        n[i + r], k1[i + r], k2[i + r] = len(own), own.sum(dtype=np.uint64), mix(own ^ _SEEDS[0]).sum(dtype=np.uint64)
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(k1.view(np.int64), mask=empty), pa.array(k2.view(np.int64), mask=empty), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(key, id, sketch) in every table (i, j)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), N_HASHES).astype(np.uint64)
            with np.errstate(over="ignore"):
                parts = [mix(sig[:, 2 * t] * np.uint64(0x9E3779B97F4A7C15) + sig[:, 2 * t + 1] + np.uint64(t)) for t in range(2 * SIDE)]
                sketch = np.zeros(len(ids), np.uint64)
                for k in range(N_HASHES):
                    sketch |= ((sig[:, k] >> np.uint64(9)) & np.uint64(3)) << np.uint64(2 * k)
                for i in range(SIDE):
                    keys = np.concatenate([mix(parts[i] * np.uint64(3) + parts[SIDE + j] + _TABLES[i, j]) for j in range(SIDE)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(ids, SIDE)), pa.array(np.tile(sketch, SIDE).view(np.int64))], names=["key", "id", "sketch"])

    return reps.select("doc_id", "sig").mapInArrow(work, "key long, id long, sketch long")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the two-bit fields two sketches agree."""
    differ = a ^ b
    return N_HASHES - np.bitwise_count((differ | (differ >> np.uint64(1))) & _LOW)


def _agreement_column(a: str, b: str):
    differ = F.col(a).bitwiseXOR(F.col(b))
    return F.lit(N_HASHES) - F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(int(_LOW))))


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(key, a, b, sketch, kind) from bucket rows dealt and sorted by key.

    kind 0: b against its bucket's smallest id a; kind 1: another pair; kind 2: row a of a
    bucket of more than ``SMALL`` (b null). A bucket's rows stream: only a small bucket or
    one Arrow batch is held.
    """

    def emit(key, ids, sketch):
        """Pairs of complete buckets."""
        first = np.empty(len(key), bool)
        first[0] = True
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(key)))
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        place = np.arange(len(key)) - start
        hot = np.flatnonzero(size > SMALL)
        out = [(key[hot], ids[hot], np.zeros(len(hot), np.int64), sketch[hot], np.full(len(hot), 2, np.int8))]
        alive = np.flatnonzero((size > 1) & (size <= SMALL))
        for d in range(1, SMALL):
            alive = alive[size[alive] - place[alive] > d]
            if not len(alive):
                break
            x, y = alive, alive + d
            good = (ids[x] != ids[y]) & (_agreement(sketch[x], sketch[y]) >= AGREE)
            x, y = x[good], y[good]
            out.append((key[x], ids[x], ids[y], np.zeros(len(x), np.uint64), (place[x] > 0).astype(np.int8)))
        return [np.concatenate(c) for c in zip(*out)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(key, a, b, sketch, kind):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b, mask=kind == 2), pa.array(sketch.view(np.int64)), pa.array(kind)], names=["key", "a", "b", "sketch", "kind"])

        held, hot_key = None, None
        for batch in batches:
            key, ids, sketch = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sketch = sketch.view(np.uint64)
            if hot_key is not None:  # the rest of a large bucket
                n = int(np.searchsorted(key, hot_key, side="right"))
                if n:
                    yield table(key[:n], ids[:n], ids[:n], sketch[:n], np.full(n, 2, np.int8))
                key, ids, sketch = key[n:], ids[n:], sketch[n:]
                if not len(key):
                    continue
                hot_key = None
            if held is not None:
                key, ids, sketch = (np.concatenate(c) for c in zip(held, (key, ids, sketch)))
                held = None
            last = int(np.searchsorted(key, key[-1], side="left"))
            if len(key) - last > SMALL:
                hot_key, last = key[-1], len(key)
            else:
                held = tuple(c[last:].copy() for c in (key, ids, sketch))
            if last:
                found = emit(key[:last], ids[:last], sketch[:last])
                if len(found[0]):
                    yield table(*found)
        if held is not None and len(held[0]) > 1:
            found = emit(*held)
            if len(found[0]):
                yield table(*found)

    return rows.mapInArrow(work, "key long, a long, b long, sketch long, kind byte")


def pivots_of(hot: DataFrame) -> DataFrame:
    """(key, pivot, pivot_sketch, leads): the pivots of each large bucket; the one nearest to the consensus leads.

    The consensus sketch comes from partial sums of bits, the pivots from ranked rows
    that Spark limits before the shuffle, so no task holds a bucket.
    """
    bit = lambda k: F.shiftrightunsigned(F.col("sketch"), k).bitwiseAND(F.lit(1))
    votes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(64)])
    consensus = votes.select("key", sum((F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(64)), F.lit(0).cast("long")).alias("consensus"))
    own = hot.select("key", F.col("a").alias("id"), "sketch")
    rated = own.join(consensus, "key").withColumn("near", _agreement_column("sketch", "consensus"))
    nearest = rated.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "id"))).where(f"r <= {PIVOTS // 2}").withColumn("leads", F.col("r") == 1)
    smallest = own.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(f"r <= {PIVOTS - PIVOTS // 2}").withColumn("leads", F.lit(False))
    return nearest.drop("near", "consensus").unionByName(smallest).groupBy("key", F.col("id").alias("pivot"), F.col("sketch").alias("pivot_sketch")).agg(F.max("leads").alias("leads"))


def pivot_pairs(hot: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b) between the classes of each large bucket and its pivots."""
    met = hot.select("key", F.col("a").alias("id"), "sketch").join(pivots, "key")
    met = met.where((F.col("id") != F.col("pivot")) & (_agreement_column("sketch", "pivot_sketch") >= AGREE))
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def beyond_leaders(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, token, id, component, n, d): what members (leader, id, component) hold beyond their leaders; n is a member's size, d that of its part beyond the leader."""
    schema = "leader long, token long, id long, component long, n long, d long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows):
            leader, own, component, n, d = (np.array(c, np.int64) for c in list(zip(*rows))[:5])
            each = np.repeat(np.arange(len(rows)), d)
            tokens = np.concatenate([r[5] for r in rows]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (leader[each], tokens, own[each], component[each], n[each], d[each])], names=["leader", "token", "id", "component", "n", "d"])

        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                x, lead = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (3, 4))
                beyond = np.setdiff1d(x, lead, True)
                rows.append((*(batch.column(c)[k].as_py() for c in range(3)), len(x), len(beyond), beyond))
                held += len(beyond) + 1
                if held > 1 << 17:
                    yield table(rows)
                    rows, held = [], 0
        if rows:
            yield table(rows)

    lead = sets.select(F.col("id").alias("leader"), F.col("set").alias("lead"))
    return members.join(sets, "id").join(lead, "leader").select("leader", "id", "component", "set", "lead").mapInArrow(work, schema)


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(leader, token, id, component, n, d, at, listed): rows whose token members of several components hold, cut to prefixes, the rarest of those tokens first.

    ``at`` counts the tokens that one component holds, which link nobody and come before the others, too.
    ``listed``: the row may stand for the smaller set of a pair. A token is counted where its rows meet, so no table of counts is joined to them.
    """
    key = ["leader", "token"]
    holders = Window.partitionBy(*key)
    held = rows.select("*", F.count(F.lit(1)).over(holders).alias("f"), (F.min("component").over(holders) < F.max("component").over(holders)).alias("several"))
    shared = held.where("several").drop("several")
    own = Window.partitionBy("leader", "id")
    at = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "token")) - 1
    cut = lambda least: F.expr(f"d + 1 - greatest(1, {least} - (n - d))")
    longer, shorter = cut(f"({percent} * n + 99) div 100"), cut(f"({2 * percent} * n + {99 + percent}) div {100 + percent}")
    return shared.withColumn("at", at).where(F.col("at") < longer).select(*key, "id", "component", "n", "d", "at", (F.col("at") < shorter).alias("listed"))


def _apart(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows that share (leader, token), in different components, as lengths and positions allow."""
    key = ["leader", "token"]
    side = lambda x, rows: rows.select(*key, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "d", "at", "component")])
    n, m = F.col("a_n"), F.col("b_n")
    common = F.least(F.col("a_d") - F.col("a_at"), F.col("b_d") - F.col("b_at")) + F.least(n - F.col("a_d"), m - F.col("b_d"))
    enough = common * (100 + percent) >= (n + m) * percent
    smaller = (m < n) | ((m == n) & (F.col("b_id") < F.col("a_id")))
    met = side("a", lists).join(side("b", lists.where("listed")), key)
    met = met.where(smaller & (m * 100 >= n * percent) & (F.col("a_component") != F.col("b_component")) & enough)
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _joined_in_lists(lists: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``found`` with the links between the components of each list (leader, token, id, component, n, d, at, listed), level by level as told above.

    Components meet members before these are dealt into lists, so that only one row a member and leader looks them up.
    """
    key = ["leader", "token"]
    whole = None
    while True:
        least = F.min(F.struct("n", "id"))["id"].alias("head")
        heads = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if("listed").alias("under"), F.min("component").alias("lo"), F.max("component").alias("hi"), least)
        heads = heads.where("lo < hi and under > 0")
        short = F.col("under") <= SMALL
        if whole is not None:
            heads = heads.join(whole, "leader")
            short = short | (F.col("size") * 2 > F.col("whole"))
        now = materialize(lists.join(heads.select(*key, "head", short.alias("short")), key))
        members = materialize(now.where("not short and id <> head").select(F.col("head").alias("leader"), "id").distinct())
        met = _apart(now.where("short"), percent).union(members.select("leader", "id"))
        found = joined_components(found, similar(materialize(met.distinct()), sets, percent))
        members = _several(_with_component(members, found))
        if members.isEmpty():
            return found
        whole = members.groupBy("leader").agg(F.count(F.lit(1)).alias("whole"))
        lists = materialize(_prefixes(materialize(beyond_leaders(members, sets)), percent))


def _several(members: DataFrame) -> DataFrame:
    """``members`` (leader, id, component) of leaders that have several components, as a table."""
    several = members.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leader")
    return materialize(members.join(several, "leader", "left_semi").select("leader", "id", "component"))


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def verified(pairs: DataFrame, docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Only documents named by a pair are read into sets. Their ids are broadcast up to
    ``MAX_BROADCAST_IDS`` (32 MB of ids); beyond, the semi join shuffles.
    """
    own = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, id_col, text_col)
    return similar(pairs, own, percent)


def sets_of(ids: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set): sorted shingle hashes, packed, of the documents whose ids are named."""
    named = materialize(ids.distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small_side(named, MAX_BROADCAST_IDS), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            packed = []
            for i, j in mini_batches(offsets):
                found, bounds = shingles(*words_of(data, offsets[i : j + 1]))
                packed += [np.unique(found[bounds[k] : bounds[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "set"])

    return materialize(texts.mapInArrow(sets, "id long, set binary"))


def similar(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small >= percent * large:
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    good[k] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    met = pairs.join(own.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(own.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    base = materialize(profiles(docs, id_col, text_col))
    usable = base.where("k1 is not null and doc_id is not null")
    classes = usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    member = materialize(usable.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "class_id").distinct())
    reps = usable.join(member.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")

    dealt = bucket_rows(reps).repartition("key").sortWithinPartitions("key", "id")
    raw = materialize(bucket_pairs(dealt).distinct())
    hot = raw.where("kind = 2").select("key", "a", "sketch")
    pivots = materialize(pivots_of(hot))
    first = raw.where("kind = 0").select("a", "b").union(pivot_pairs(hot, pivots)).distinct()
    links = materialize(verified(materialize(first), docs, percent, id_col, text_col))

    node_edges = member.where("doc_id <> class_id").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.count(F.lit(1)).alias("n"))
    split = node_edges.where("n > 1").select("a", "b").union(member.where("doc_id <> class_id").join(member.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    links = links.union(split)
    found = materialize(connected_components(links))

    # small buckets: pairs besides the smallest id's; large ones: members apart from their leader's component
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    others = raw.where("kind = 1").select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    others = others.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
    more = materialize(verified(materialize(others), docs, percent, id_col, text_col))
    found = joined_components(found, more)
    leaders = pivots.where("leads").select("key", F.col("pivot").alias("leader"))
    members = _several(_with_component(hot.select("key", F.col("a").alias("id")).join(leaders, "key").select("leader", "id").distinct(), found))
    if not members.isEmpty():
        sized = members.join(usable.groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n")), "id")
        lists = sized.select("leader", F.lit(0).cast("long").alias("token"), "id", "component", "n", F.col("n").alias("d"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("listed"))
        found = _joined_in_lists(lists, sets_of(members.select("id"), docs, id_col, text_col), found, percent)

    in_class = member.groupBy("doc_id").agg(F.min("class_id").alias("node"))
    labelled = in_class.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return base.select("doc_id", "n_shingles").join(labelled, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest id."""
    (own,) = free_names(docs, "gone_id")
    gone = materialize(near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(small_side(gone, max_broadcast_ids), F.col(id_col).cast("long") == F.col(own), "left_anti")
