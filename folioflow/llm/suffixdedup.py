"""Passages that occur more than once: suffix arrays by shard, common prefixes, and a merge across shards.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere. The steps:

1. **Anchors.** Every window of ``length`` bytes owns the place of the least hash among its strings of ``gram`` bytes, the leftmost
   such. Equal windows own equal anchors, and the windows that share one are neighbours, so each text falls into
   pieces (first start, last start) of about 85 windows. Counts of all anchors of the corpus, from partial aggregates, leave
   the pieces whose anchor is not alone.
2. **Equal pieces.** All windows of a piece that occurs twice in full are repeated. One of each
   such piece, and all others with its anchor, go on: their bytes are cut from the texts.
3. **Shards.** Pieces are dealt by anchor, sorted, and taken in shards of about ``shard_bytes``. Each shard builds its suffix array
   (Larsson and Sadakane) and common prefixes (Kasai); neighbours that share ``length`` bytes are repeated windows.
4. **Across shards.** Windows are equal only under one anchor. An anchor with more than ``part_pieces`` different pieces is
   split by their hashes over several shards; each gives one fingerprint of 128 bits for every different window. The sorted fingerprints are
   dealt by ranges and their equal ranges found by binary search; a window in two shards is repeated.
5. **Removal.** Spans of a text meet it by key, overlapping ones are merged.

Nothing is gathered but a text's own pieces and spans, and shards of bounded size; texts are cut into pieces by
stretches of ``STRETCH`` starts, so a long text costs no more memory at a time than its bytes. Texts travel packed.

Defined cases
* null texts count as empty; texts shorter than ``length`` bytes lose nothing.
* matches never cross texts; a text that overlaps itself counts. Rows that are equal in id and text lose all their bytes if long enough.
* removal is by bytes, so what is kept may end or begin within a character: ``kept`` is binary.
* input columns pass through; names added here get underscores if taken. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.hashing import _BASE, _INVERSE, _TABLE, _power, column_bytes, mix
from folioflow.llm.names import free_names
from folioflow.llm.suffixes import common_prefixes, suffix_array
from folioflow.store import materialize

STRETCH = 500_000
BATCH = 1_000_000
PLACE_BITS = 20


@dataclass(frozen=True)
class RepeatParams:
    """``length``: bytes that must repeat; ``gram``: bytes of an anchor; the others only shape the work, not the result."""

    length: int = 200
    gram: int = 32
    shard_bytes: int = 1 << 20
    part_pieces: int = 4096


def _stretches(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (row, first byte, past the last): texts of at least ``length`` bytes, long ones in stretches that overlap."""
    held, total = [], 0
    for row in np.flatnonzero(sizes >= length):
        for first in range(0, int(sizes[row]) - length + 1, STRETCH):
            end = min(first + STRETCH + length - 1, int(sizes[row]))
            if total + end - first > BATCH and held:
                yield held
                held, total = [], 0
            held.append((int(row), first, end))
            total += end - first
    if held:
        yield held


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, first start, last start, anchor hash, piece hash) of the pieces of some texts."""
    grams = length - gram + 1
    for batch in _stretches(np.diff(offsets), length):
        body = np.concatenate([data[offsets[r] + a : offsets[r] + b] for r, a, b in batch])
        sizes = np.array([b - a for _, a, b in batch])
        heads = np.concatenate([[0], np.cumsum(sizes)])
        n = len(body)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[body] * _power("up", _BASE, n), out=total[1:])
            down = _power("down", _INVERSE, n)
            hashes = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        # least hash of every window: hashes give way to places in the lowest bits, so that the leftmost of equals wins
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        counts = sizes - length + 1
        ends = np.cumsum(counts)
        which = np.repeat(np.arange(len(batch)), counts)
        starts = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + heads[which]
        owner = (least[starts] & low).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts)) - 1
        a, b, x, w = starts[at], starts[last], owner[at], which[at]
        with np.errstate(over="ignore"):
            whole = mix(mix((total[b + length] - total[a]) * down[a]) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B1) + (x - a).astype(np.uint64))
        rows, firsts = np.array([r for r, _, _ in batch]), np.array([f for _, f, _ in batch])
        shift = firsts[w] - heads[w]
        yield rows[w], a + shift, b + shift, hashes[x], whole


_PIECES = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("anchor", pa.int64()), ("whole", pa.int64())])
PIECES = "r1 long, r2 long, a int, b int, anchor long, whole long"


def _find_pieces(params: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = column_bytes(batch.column(2))
            for row, a, b, anchor, whole in pieces_of(data, offsets, params.length, params.gram):
                columns = (r1[row], r2[row], a, b, anchor.view(np.int64), whole.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return run


def _packed(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with the text as compressed bytes, for the way through a shuffle."""
    place = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            packed = []
            for value in batch.column(place):
                raw = (value.as_py() or "").encode()
                packed.append(len(raw).to_bytes(8, "big") + codec.compress(raw, asbytes=True))
            columns = list(batch.columns)
            columns[place] = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = texts.withColumn(text, F.col(f"`{text}`").cast("binary")).schema
    return texts.mapInArrow(run, schema)


def _unpack(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "big")
    return pa.Codec("zstd").decompress(packed[8:], n, asbytes=True) if n else b""


_CUT = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("split", pa.bool_()), ("open", pa.bool_()), ("r1", pa.int64()), ("r2", pa.int64()), ("a", pa.int32()), ("piece", pa.binary())])
CUT = "anchor long, part int, split boolean, open boolean, r1 long, r2 long, a int, piece binary"


def _cut_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r1, r2, packed, wanted = (c[k].as_py() for c in batch.columns)
                body = _unpack(packed)
                rows = [(w["anchor"], w["part"], w["split"], w["open"], r1, r2, w["a"], body[w["a"] : w["b"] + length]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)

    return run


_FOUND = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("mark", pa.binary()), ("open", pa.bool_())])
FOUND = "r1 long, r2 long, s int, e int, mark binary, open boolean"


def _shard(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Repeated spans of a shard's pieces, and a mark for every different window of split anchors."""
    data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])
    order = suffix_array(data, offsets)
    near = common_prefixes(data, offsets, order) >= length
    twice = np.zeros(len(data), bool)
    twice[order[near]] = True
    twice[order[np.flatnonzero(near) - 1]] = True
    piece = np.repeat(np.arange(len(rows)), np.diff(offsets))
    at = np.flatnonzero(twice & np.array([r[3] for r in rows])[piece])
    out = []
    if at.size:
        new = np.ones(at.size, bool)
        new[1:] = (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]])
        first = np.flatnonzero(new)
        for s, e in zip(at[first], at[np.append(first[1:], at.size) - 1]):
            row = rows[piece[s]]
            begin = row[6] - int(offsets[piece[s]])
            out.append((row[4], row[5], begin + int(s), begin + int(e) + length, None, True))
    if any(r[2] for r in rows):
        room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data)) >= length
        # one of each class of equal windows: the first of a run of neighbours that share the length
        for p in order[~near & room[order] & np.array([r[2] for r in rows])[piece[order]]]:
            row, body = rows[piece[p]], data[p : p + length].tobytes()
            s = row[6] + int(p - offsets[piece[p]])
            out.append((row[4], row[5], s, s + length, hashlib.blake2b(body, digest_size=16).digest(), bool(row[3] and not twice[p])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)] if out else [pa.array([], f.type) for f in _FOUND], schema=_FOUND)


def _search_shards(params: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key and size >= params.shard_bytes:
                    yield _shard(held, params.length)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[7])
        if held:
            yield _shard(held, params.length)

    return run


_SPANS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open windows whose mark comes from more than one shard; marks come sorted, and a run may go on in the next batch."""
    rest: pa.Table | None = None

    def found(table: pa.Table) -> pa.RecordBatch:
        marks = np.array(table.column("mark").to_pylist(), dtype="S16")
        several = np.searchsorted(marks, marks, "right") - np.searchsorted(marks, marks, "left") > 1
        kept = table.filter(pa.array(several & table.column("open").to_numpy(zero_copy_only=False).astype(bool))).select(_SPANS.names).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], schema=_SPANS)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        marks = np.array(table.column("mark").to_pylist(), dtype="S16")
        done = int(np.searchsorted(marks, marks[-1], "left"))
        if done:
            yield found(table.slice(0, done))
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield found(rest)


def _row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes of id and text, 128 bits together; equal rows share them."""
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)]


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: RepeatParams = RepeatParams()) -> DataFrame:
    """(r1, r2, spans) of rows that hold repeated passages; spans are (s, e) in bytes, in no order, and may overlap."""
    length = params.length
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    r1, r2 = _row_keys(F.col(f"`{doc_id}`"), body)
    texts = docs.select(r1.alias("r1"), r2.alias("r2"), body.alias("text"))
    pieces = texts.where(F.octet_length("text") >= length).mapInArrow(_find_pieces(params), PIECES)
    # written first, so that the join below deals both sides anew and a hot anchor's pieces can be split
    anchors = materialize(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").drop("n"))
    shared = materialize(pieces.join(anchors, "anchor"))
    span = [F.col("a").alias("s"), (F.col("b") + length).alias("e")]
    spans = shared.where("not mixed").select("r1", "r2", *span)

    mixed = shared.where("mixed").drop("mixed")
    kinds = materialize(mixed.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "a", "b")).alias("one")))
    spans = spans.union(mixed.join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("r1", "r2", *span))

    large = materialize(kinds.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / params.part_pieces).cast("int").alias("parts")).where("parts > 1"))
    dealt = kinds.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    wanted = dealt.select("one.r1", "one.r2", F.struct("anchor", F.pmod("whole", "parts").cast("int").alias("part"), (F.col("parts") > 1).alias("split"), (F.col("n") == 1).alias("open"), F.col("one.a").alias("a"), F.col("one.b").alias("b")).alias("w"))
    wanted = wanted.groupBy("r1", "r2").agg(F.collect_list("w").alias("wanted"))
    bodies = _packed(texts.where(F.octet_length("text") >= length), "text").join(wanted, ["r1", "r2"]).select("r1", "r2", "text", "wanted")
    cut = bodies.mapInArrow(_cut_pieces(length), CUT)
    found = materialize(cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_search_shards(params), FOUND))
    marks = found.where("mark is not null").select("mark", "r1", "r2", "s", "e", "open").repartitionByRange("mark").sortWithinPartitions("mark")
    spans = spans.union(found.where("mark is null").select("r1", "r2", "s", "e")).union(marks.mapInArrow(_merge_marks, "r1 long, r2 long, s int, e int"))
    return spans.groupBy("r1", "r2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that some span covers, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` without the text, with removed (array of (start, end) in bytes) and kept (the remaining bytes)."""
    k1, k2, removed, kept = free_names(docs, "r1", "r2", "removed", "kept")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = _row_keys(F.col(f"`{doc_id}`"), body)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(a.alias(k1), b.alias(k2), *others, body.alias(text))
    spans = repeated_spans(docs, text, doc_id, params).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("spans").alias(removed))
    joined = _packed(keyed, text).join(spans, [k1, k2], "left").select(*others, f"`{text}`", removed)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, rest = [], []
            for packed, found in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                raw = _unpack(packed.as_py())
                cuts = merged_spans([(x["s"], x["e"]) for x in found.as_py() or []])
                edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                runs.append([{"start": s, "end": e} for s, e in cuts])
                rest.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(runs, pair), pa.array(rest, pa.binary())], names=[*batch.schema.names[:-2], removed, kept])

    shape = docs.drop(text).withColumn(removed, F.array().cast("array<struct<start:long,end:long>>")).withColumn(kept, F.lit(b"")).schema
    return joined.mapInArrow(run, shape)
