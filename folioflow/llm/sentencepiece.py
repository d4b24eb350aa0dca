"""SentencePiece encoding and decoding through a relational lattice.

The vocabulary file gives pieces with scores. A unigram file's encoding is the path of pieces
with the largest sum of scores (Viterbi). The scores of a BPE file are merge ranks, whose sums
mean nothing; ``as_unigram`` gives such a file's pieces unigram scores that fall with the
logarithm of the rank, and the ids are then those of the library when it is given the same
pieces and scores as a unigram model. Read as it is, a BPE file is encoded by its merges in rank order, a
fold over the same lattice, which gives the library's ids for that file. Characters outside the
vocabulary become byte pieces.

1. Texts are cut into units between bytes that no piece holds side by side (before
   spaces, around line feeds, mostly between letters and marks), so no piece crosses a border and units
   can be encoded by themselves. Distinct units are counted.
2. Each distinct unit explodes into its substrings of up to the longest piece's length,
   which equi-join to the piece table (broadcast; its size is the vocabulary's). Edges are
   grouped by unit, where they already lie, and a higher-order aggregate folds the best
   path over end positions, or the merges.
3. Texts look up the most frequent units in a broadcast table (about 30 bytes each), at most ``top_units`` and at most
   half of all, so that the share of the rest does not jump where a corpus outgrows the table, and
   leave gaps for the rest; the rest meet the unit table in a shuffle join, one row per
   text and rare unit, and fill the gaps. Ids travel in two bytes, the more frequent the smaller, by planes and compressed.

Decoding joins the pieces' bytes again, so decode(encode(text)) = text for every text:
U+2581, which the format uses for the space, is encoded by its bytes where it stands in a text.

Defined cases
* null text: null ids; empty text: no ids.
* units longer than ``MAX_UNIT`` bytes (runs of one character, mostly) are encoded whole as well, in Python by a
  linear Viterbi or a heap of merges, as the fold's work grows with the square of a unit's length.
* ties between paths: the longer last piece wins; between merges: the leftmost.
* repeated rows are encoded alike; null ids of rows do not matter. Extra columns pass through, whatever their
  names; ``ids`` replaces a column of that name. Empty table: empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.binding import let
from folioflow.llm.hashing import column_bytes, mini_batches, mix, span_hashes
from folioflow.llm.names import free_names
from folioflow.store import materialize

MAX_UNIT = 192
UNITS_A_TASK = 1 << 15
FILL_ROWS = 512
SPACE = "▁"
OWN_SPACE = "\ufdd0"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces usable in a lattice, and the bytes of every id."""

    pieces: list = field(repr=False)  # (piece, id, score)
    surface: list = field(repr=False)  # bytes by id
    pairs: np.ndarray = field(repr=False)  # whether two bytes may be neighbours within a piece
    first_byte: int = 3
    unknown_score: float = 0.0
    kind: str = "unigram"  # or "bpe"
    longest: int = 16


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """Vocabulary of a SentencePiece model file; read on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path or default_model(), "rb") as file:
        model.ParseFromString(file.read())
    kinds = model.SentencePiece
    normal = [p.score for p in model.pieces if p.type == kinds.NORMAL]
    pieces, surface, bytes_at = [], [], {}
    pairs = np.zeros((256, 256), dtype=bool)
    pairs[:, 0x80:0xC0] = True  # never within a character
    for k, p in enumerate(model.pieces):
        surface.append(b"")
        if p.type == kinds.BYTE:
            bytes_at[int(p.piece[1:-1], 16)] = k
            surface[k] = bytes((int(p.piece[1:-1], 16),))
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            # a user-defined piece scores by its length, just below the best piece for every byte
            score = p.score if p.type == kinds.NORMAL else len(p.piece.encode()) * max(normal) - 0.1
            pieces.append((p.piece, k, float(score)))
            surface[k] = p.piece.replace(SPACE, " ").encode()
            if OWN_SPACE in p.piece:
                raise ValueError("the vocabulary holds the mark for a text's own U+2581")
            near = np.frombuffer(surface[k], np.uint8)
            pairs[near[:-1], near[1:]] = True
    first = bytes_at[0]
    if any(bytes_at.get(b) != first + b for b in range(256)):
        raise ValueError("the vocabulary lacks byte pieces")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models")
    kind = "unigram" if model.trainer_spec.model_type == 1 else "bpe"
    return Vocabulary(pieces, surface, pairs, first, min(normal) - 10.0, kind, max(len(p[0]) for p in pieces))


def as_unigram(vocabulary: Vocabulary) -> Vocabulary:
    """The vocabulary with unigram scores: -ln(rank + 2), ranks by falling score.

    Scores are whole sixteenths, so that sums are exact in the library's single precision too.
    """
    ranks = {k: rank for rank, (_, k, _) in enumerate(sorted(vocabulary.pieces, key=lambda p: (-p[2], p[1])))}
    pieces = [(piece, k, -round(16 * math.log(ranks[k] + 2)) / 16) for piece, k, _ in vocabulary.pieces]
    return replace(vocabulary, pieces=pieces, kind="unigram", unknown_score=min(p[2] for p in pieces) - 10.0)


def units_of(texts: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts with the leading space, unit starts and ends, and each text's first unit (n + 1 bounds)."""
    buffer = b"".join([b" " + t if t else t for t in texts])
    data = np.frombuffer(buffer, np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts])))
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(texts) + 1, np.int64)
    start = np.ones(len(data), dtype=bool)
    near = data[:-1].astype(np.uint16)
    near <<= 8
    near |= data[1:]
    np.logical_not(pairs.ravel().take(near), out=start[1:])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(start)
    return data, at, np.append(at[1:], len(data)), np.searchsorted(at, offsets)


def _text_batches(column) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = column_bytes(column)
    for i, j in mini_batches(offsets):
        yield i, j, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
    pa.default_memory_pool().release_unused()  # workers are kept for later stages


def count_units(docs: DataFrame, pairs: np.ndarray, text_col: str = "text") -> DataFrame:
    """(unit, n): distinct units and their counts; Python hands over one row per unit of some megabytes, and Spark combines them before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _text_batches(batch.column(0)):
                data, starts, ends, _ = units_of(texts, pairs)
                if len(starts):
                    _, first, n = np.unique(span_hashes(data, starts, ends, lower=False), return_index=True, return_counts=True)
                    # one buffer of all units' bytes instead of an object for each
                    sizes = ends[first] - starts[first]
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    units = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data[_spread(starts[first], sizes)]))
                    yield pa.RecordBatch.from_arrays([units, pa.array(n)], names=["unit", "n"])

    return docs.select(text_col).mapInArrow(work, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(hash, n, ids) by ``unit_table``; units of up to ``MAX_UNIT`` bytes by the lattice, longer ones by ``encode_long_units``.

    A task sorts all edges of its units, some hundred times a unit's own bytes, so tasks follow the count of units and not their size.
    """
    units = materialize(units)
    long = F.octet_length("unit") > MAX_UNIT
    tasks = units.count() // UNITS_A_TASK + 1
    return unit_table(lattice_ids(units.where(~long).repartition(tasks, "unit"), vocabulary)).unionByName(encode_long_units(units.where(long), vocabulary))


def _table_rows(units: pa.Array, n: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    data, offsets = column_bytes(units)
    hashes = span_hashes(data, offsets[:-1], offsets[1:], lower=False) if len(units) else np.zeros(0, np.uint64)
    ends = np.concatenate(([0], 2 * np.cumsum(ids.value_lengths().to_numpy()))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(ids.flatten().to_numpy().astype(np.uint16))])
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), n, packed], names=["hash", "n", "ids"])


def unit_table(encoded: DataFrame) -> DataFrame:
    """(hash, n, ids) of encoded units (unit, n, ids), ids in two bytes each. Only here a unit gets its hash, as hashes do not compress on their way."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table_rows(*batch.columns)

    return encoded.select("unit", "n", "ids").mapInArrow(work, "hash long, n long, ids binary")


def encode_long_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(hash, n, ids) as in ``unit_table``, each unit whole, in time that grows as n log n."""
    shared = units.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            v = shared.value
            table = table or {piece: (k, score) for piece, k, score in v.pieces}
            ids = [long_unit_ids(unit.as_py(), table, v) for unit in batch.column(0)]
            yield _table_rows(*batch.columns, pa.array(ids, pa.list_(pa.int32())))

    return units.select("unit", "n").mapInArrow(work, "hash long, n long, ids binary")


def long_unit_ids(unit: str, table: dict, v: Vocabulary) -> list[int]:
    shown = unit.replace(SPACE, OWN_SPACE).replace(" ", SPACE)
    cuts = (_best_cuts if v.kind == "unigram" else _merged_cuts)(shown, table, v)
    ids = []
    for at, upto in zip(cuts, cuts[1:]):
        own = table.get(shown[at:upto])
        ids += [own[0]] if own else [v.first_byte + b for b in unit[at:upto].encode()]
    return ids


def _merged_cuts(shown: str, table: dict, v: Vocabulary) -> list[int]:
    """As ``merged_path``: the cheapest, then leftmost merge first, from a heap."""
    n = len(shown)
    following, before = list(range(1, n + 1)), list(range(-1, n))  # by a part's start; n is the end
    heap = []

    def offer(at):
        middle = following[at]
        if middle < n:
            upto = following[middle]
            known = table.get(shown[at:upto]) if upto - at <= v.longest else None
            if known:
                heapq.heappush(heap, (-known[1], at, middle, upto))

    for at in range(n):
        offer(at)
    gone = bytearray(n)
    while heap:
        _, at, middle, upto = heapq.heappop(heap)
        if gone[at] or following[at] != middle or following[middle] != upto:
            continue
        gone[middle] = 1
        following[at] = upto
        if upto < n:
            before[upto] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [at for at in range(n) if not gone[at]] + [n]


def _best_cuts(shown: str, table: dict, v: Vocabulary) -> list[int]:
    """As ``best_path``: the least cost, then the longest last piece."""
    best, back = [0.0], [0]
    for upto in range(1, len(shown) + 1):
        ending = []
        for at in range(max(0, upto - v.longest), upto):
            known = table.get(shown[at:upto])
            if known or upto - at == 1:
                ending.append((best[at] - (known[1] if known else v.unknown_score), at))
        cost, at = min(ending)
        best.append(cost)
        back.append(at)
    cuts = [len(shown)]
    while cuts[-1] > 0:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def lattice_ids(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n, ids) by the lattice. ``units`` has one row per unit; the grouping keeps its partitioning."""
    v = vocabulary
    pieces = F.broadcast(units.sparkSession.createDataFrame(v.pieces, "piece string, id int, score double"))
    # a unit's own U+2581 is put out of reach of pieces, its spaces become U+2581
    shown = units.withColumn("shown", F.translate(F.translate("unit", SPACE, OWN_SPACE), " ", SPACE))
    ends = shown.select("unit", "n", "shown", F.explode(F.sequence(F.lit(2), F.length("shown") + 1)).alias("upto"))
    spans = ends.select("unit", "n", "shown", "upto", F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - v.longest), F.col("upto") - 1)).alias("at"))
    cut = spans.select("unit", "n", "at", "upto", F.substring("shown", F.col("at"), F.col("upto") - F.col("at")).alias("piece"))
    met = cut.join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("upto") - F.col("at") == 1))
    if v.kind == "unigram":
        # an edge is one number: end, start, and the id plus 1 (0 for a character without a piece)
        edge = F.shiftleft(F.col("upto").cast("long"), 48).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 32)).bitwiseOR((F.coalesce("id", F.lit(-1)) + 1).cast("long"))
    else:
        edge = F.struct((-F.coalesce("score", F.lit(v.unknown_score))).alias("cost"), "at", "upto", F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = met.groupBy("unit").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))

    def letters(character):
        code = F.hex(F.encode(character, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + v.first_byte)

    if v.kind == "unigram":
        # a character without a piece stands as minus its place in the path
        path = grouped.withColumn("path", best_path(v))
        spelt = F.flatten(F.transform("path", lambda k: F.when(k < 0, letters(F.substring(F.col("unit"), -k, F.lit(1)))).otherwise(F.array(k))))
        return path.select("unit", "n", F.when(F.exists("path", lambda k: k < 0), spelt).otherwise(F.col("path")).alias("ids"))

    cuts = grouped.withColumn("cuts", merged_path())

    def piece_ids(i):
        at, upto = F.get("cuts", i), F.get("cuts", i + 1)
        own = F.get(F.filter("edges", lambda e: (e["at"] == at) & (e["upto"] == upto) & (e["id"] >= 0)), F.lit(0))["id"]
        return F.when(own.isNotNull(), F.array(own)).otherwise(letters(F.substring(F.col("unit"), at, upto - at)))

    ids = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), piece_ids))
    return cuts.select("unit", "n", ids.alias("ids"))


def best_path(v: Vocabulary):
    """Ids of the path with the least cost, folded over edges by end and start; minus its place for a character without a piece.

    best[p] is the cost and the ids of the best path that ends before character p + 1. Every end has an
    edge, as each character has one, so an edge adds the next end or competes for the last.
    """
    costs = {k + 1: -score for _, k, score in v.pieces} | {0: -v.unknown_score}
    cost_of = F.split(F.lit(",".join(repr(float(costs.get(k, 0.0))) for k in range(len(v.surface) + 1))), ",").cast("array<double>")
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids")))

    def step(best, edge):
        at, upto = F.shiftright(edge, 32).bitwiseAND(F.lit(0xFFFF)).cast("int"), F.shiftright(edge, 48).cast("int")
        piece = edge.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        before = F.get(best, at - 1)
        cost = before["cost"] + F.get(cost_of, piece)
        reached = F.struct(cost.alias("cost"), F.array_append(before["ids"], F.when(piece == 0, -at).otherwise(piece - 1)).alias("ids"))
        return F.when(F.size(best) < upto, F.array_append(best, reached)).when(cost < F.get(best, upto - 1)["cost"], F.array_append(F.slice(best, F.lit(1), upto - 1), reached)).otherwise(best)

    return F.aggregate("edges", start, step, lambda best: F.element_at(best, -1)["ids"])


def merged_path():
    """Borders after BPE's merges: in each step of the fold, of all edges that join two neighbouring parts the cheapest, then leftmost, drops its middle border.

    Borders of units of up to 61 characters are bits of a long; a longer unit's are an array.
    """
    one = F.lit(1).cast("long")
    bit = lambda p: F.call_function("shiftleft", one, (p - 1).cast("int"))
    joining = F.filter("edges", lambda e: e["upto"] - e["at"] > 1)
    coded = F.transform(joining, lambda e: F.struct((bit(e["at"]) + bit(e["upto"])).alias("ends"), (bit(e["upto"]) - bit(e["at"] + 1)).alias("inner")))
    settled = F.lit(-(1 << 63))

    def merge_bits(edges):
        def step(borders, _):
            joins = lambda e: (borders.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(borders.bitwiseAND(e["inner"])) == 1)
            first = F.get(F.filter(edges, joins), F.lit(0))["inner"]
            return F.when(borders < 0, borders).otherwise(let(first, lambda inner: F.when(inner.isNull(), borders.bitwiseOR(settled)).otherwise(borders.bitwiseAND(F.bitwise_not(inner)))))

        return F.aggregate(F.sequence(F.lit(1), F.length("unit")), bit(F.length("unit") + 2) - 1, step)

    short = let(let(coded, merge_bits), lambda borders: F.filter(F.sequence(F.lit(1), F.length("unit") + 1), lambda p: borders.bitwiseAND(bit(p)) != 0))

    def merge_array(cuts, _):
        def joins(e):
            place = F.array_position(cuts, e["at"]).cast("int")
            return (place > 0) & (F.get(cuts, place + 1) == e["upto"])

        first = F.get(F.filter("edges", joins), F.lit(0))
        return F.when(first.isNull(), cuts).otherwise(F.array_remove(cuts, F.get(cuts, F.array_position(cuts, first["at"]).cast("int"))))

    long = F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.sequence(F.lit(1), F.length("unit") + 1), merge_array)
    return F.when(F.length("unit") <= 61, short).otherwise(long)


@dataclass
class UnitTable:
    """Ids of frequent units, found by unit hash in an open-addressing table."""

    hashes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    slots: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.slots = np.full(1 << max(4, int(2 * len(self.hashes)).bit_length()), -1, np.int32)
        left = np.arange(len(self.hashes), dtype=np.int32)
        at = self._home(self.hashes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of values in the arrays, and whether each is there."""
        if not len(self.hashes):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = self._home(values)
        place = self.slots.take(at)
        there = (place >= 0) & (self.hashes.take(place) == values)
        left = np.flatnonzero((place >= 0) & ~there)
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            slot = self.slots.take(at)
            same = (slot >= 0) & (self.hashes.take(slot) == values[left])
            place[left[same]] = slot[same]
            there[left[same]] = True
            on = (slot >= 0) & ~same
            left, at = left[on], at[on]
        return place, there


def frequent_units(table: DataFrame, most: int) -> tuple[UnitTable, int, np.ndarray]:
    """The most frequent units of up to ``MAX_UNIT`` ids, at most ``most`` and half of all, the count from which they are in, and all ids, those that stand most often in them first."""
    table = table.where(F.octet_length("ids") <= 2 * MAX_UNIT)
    steps = sorted(((r["step"], r["units"], r["least"]) for r in table.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("least")).collect()), reverse=True)
    most = min(most, sum(units for _, units, _ in steps) // 2)
    total, cut = 0, 1 << 62
    for _, units, least in steps:
        total += units
        if total > most:
            break
        cut = least

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            counts = (np.diff(offsets) // 2).astype(np.uint16)
            often = np.minimum(batch.column(2).to_numpy(), (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (batch.column(0).to_numpy(), counts, data[offsets[0] : offsets[-1]], often)], names=["hashes", "counts", "ids", "often"])

    parts = table.where(F.col("n") >= cut).select("hash", "ids", "n").mapInArrow(pack, "hashes binary, counts binary, ids binary, often binary").collect()
    hashes, counts, ids, often = (np.frombuffer(b"".join(r[c] for r in parts), kind) for c, kind in (("hashes", np.uint64), ("counts", np.uint16), ("ids", np.uint16), ("often", np.uint32)))
    counts = counts.astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64))).astype(np.int32) if len(counts) else np.zeros(0, np.int32)
    order = np.argsort(-np.bincount(ids, np.repeat(often, counts), 1 << 16), kind="stable").astype(np.uint16)
    return UnitTable(hashes, starts, counts, ids), cut, order


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all ranges in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", top_units: int = 800_000) -> DataFrame:
    """``docs`` with ids (array<int>)."""
    v = vocabulary or load_vocabulary()
    if len(v.surface) > 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    table = materialize(encode_units(count_units(docs, v.pairs, text_col), v))
    frequent, cut, order = frequent_units(table, top_units)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    pairs = v.pairs

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key of the text, hash of a rare unit in it)"""
        for batch in batches:
            for _, _, texts in _text_batches(batch.column(0)):
                data, starts, ends, bounds = units_of(texts, pairs)
                hashes = span_hashes(data, starts, ends, lower=False)
                gone = ~shared.value.find(hashes)[1]
                if gone.any():
                    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (_text_keys(hashes, bounds)[row[gone]], hashes[gone])], names=["key", "hash"])

    rare = docs.select(text_col).mapInArrow(tail, "key long, hash long")
    others = table.where((F.col("n") < cut) | (F.octet_length("ids") > 2 * MAX_UNIT)).select("hash", "ids")
    found = rare.join(others, "hash").groupBy("key").agg(F.collect_set(F.struct("hash", "ids")).alias("rare"))

    kept = [f for f in docs.schema.fields if f.name != "ids" and f.name != text_col]
    key, packed, rare_key, rare_units = free_names(docs, "key", "packed", "rare_key", "rare")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of frequent units, 0 for a gap, and the gaps' hashes, packed."""
        t, codec = shared.value, pa.Codec("zstd", 3)
        place = np.empty(1 << 16, np.uint16)
        place[order] = np.arange(1 << 16)
        for batch in batches:
            for i, j, texts in _text_batches(batch.column(text_col)):
                data, starts, ends, bounds = units_of(texts, pairs)
                hashes = span_hashes(data, starts, ends, lower=False)
                at, there = t.find(hashes)
                counts = np.where(there, t.counts[at], 1) if len(t.hashes) else np.ones(len(hashes), np.int64)
                ids = np.zeros(int(counts.sum()), np.uint16)
                where = np.repeat(there, counts)
                if where.any():
                    ids[where] = t.ids[_spread(t.starts[at[there]], t.counts[at[there]])]
                ids = place[ids]
                edges = np.concatenate(([0], np.cumsum(counts)))[bounds]
                gaps = hashes[~there]
                gap_at = np.concatenate(([0], np.cumsum(~there)))[bounds]
                rows = []
                for k in range(len(texts)):
                    lost = gaps[gap_at[k] : gap_at[k + 1]]
                    own = ids[edges[k] : edges[k + 1]]
                    planes = own.view(np.uint8).reshape(-1, 2).T.tobytes()
                    rows.append(np.array([len(lost), len(own)], np.uint32).tobytes() + lost.tobytes() + codec.compress(planes, asbytes=True))
                null = np.array(batch.column(text_col).slice(i, j - i).is_null())
                own = [batch.column(f.name).slice(i, j - i) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(_text_keys(hashes, bounds).view(np.int64)), pa.array(rows, pa.binary(), mask=null)], names=[*(f.name for f in kept), key, packed])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            for i in range(0, batch.num_rows, FILL_ROWS):
                part = batch.slice(i, FILL_ROWS)
                out = []
                for raw, rare in zip(part.column(packed), part.column(rare_units)):
                    if not raw.is_valid:
                        out.append(None)
                        continue
                    raw = raw.as_buffer()
                    n_lost, n_ids = np.frombuffer(raw, np.uint32, 2).tolist()
                    lost = np.frombuffer(raw, np.int64, n_lost, 8)
                    planes = np.frombuffer(codec.decompress(raw[8 + 8 * n_lost :], 2 * n_ids, asbytes=True), np.uint8)
                    ids = order[planes.reshape(2, -1).T.copy().view(np.uint16).ravel()].astype(np.int32)
                    if len(lost):
                        units = rare.values
                        known, (data, ends) = units.field(0).to_numpy(), column_bytes(units.field(1))
                        starts, values = ends // 2, data[: ends[-1]].view(np.uint16)
                        sort = np.argsort(known)
                        own = sort[np.searchsorted(known[sort], lost)]
                        sizes = (starts[1:] - starts[:-1])[own]
                        gaps = ids == 0
                        counts = np.ones(len(ids), np.int64)
                        counts[gaps] = sizes
                        filled = np.repeat(ids, counts)
                        filled[np.repeat(gaps, counts)] = values[_spread(starts[:-1][own], sizes)]
                        ids = filled
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(out, pa.list_(pa.int32()))], names=[*(f.name for f in kept), "ids"])

    columns = [F.col(f"`{f.name}`") for f in kept] + [F.col(f"`{text_col}`")]
    half = docs.select(*columns).mapInArrow(partial, T.StructType([*kept, T.StructField(key, T.LongType()), T.StructField(packed, T.BinaryType())]))
    joined = half.join(found.select(F.col("key").alias(rare_key), F.col("rare").alias(rare_units)), F.col(key) == F.col(rare_key), "left").drop(key, rare_key)
    return joined.mapInArrow(fill, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _text_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key for each text, from its units in order. Texts that share a key would only share a list of rare units."""
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ (place * np.uint64(0x9E3779B97F4A7C15))))))
        return mix(total[bounds[1:]] - total[bounds[:-1]])


def decode(docs: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ids; null ids give null. Bytes that are no UTF-8 (a path of foreign ids) become U+FFFD.

    The pieces, or for texts with byte pieces all pieces' bytes as hexadecimal text, are one constant of the vocabulary's size; no Python runs.
    """
    v = vocabulary or load_vocabulary()
    surface = F.split(F.lit(",".join(s.hex() for s in v.surface)), ",")
    bytes_of = F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get(surface, i)), ""))
    # ids above the byte pieces stand for whole characters
    whole = F.split(F.lit("\0".join("" if k < v.first_byte + 256 else s.decode() for k, s in enumerate(v.surface))), "\0")
    joined = F.when(F.array_min(ids_col) >= v.first_byte + 256, F.array_join(F.transform(ids_col, lambda i: F.get(whole, i)), "")).otherwise(F.make_valid_utf8(bytes_of.cast("string")))
    (own,) = free_names(docs, "joined")
    rows = docs.withColumn(own, joined)
    return rows.withColumn(text_col, F.when(F.col(own).startswith(" "), F.substring(own, 2, 1 << 30)).otherwise(F.col(own))).drop(own)
