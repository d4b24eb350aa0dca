"""Merkle manifest of a data set: a tree of hashes for each source, one over the sources, and proofs of rows.

Leaves are sorted once (``ordered.numbered``), so a node has the coordinate (tree, level, pos). Trees
are built a few levels at a time: a pass reads the nodes of one level in order, folds every block of
``FAN ** LEVELS`` consecutive ones and appends the levels above them to a store of Parquet files that is partitioned by
level. Proofs come from merge scans in the other direction: a pass reads the stored nodes of a block in the order of
their coordinates, next to the proof of the block's own node, and hands each node its siblings. Blocks are
the unit of work, so a source of any size is spread over tasks, and no task holds more than one block.

A proof is a list of (left, right): the digests, in hex and concatenated, of the siblings before and after the node.

Defined cases
* a null in any hashed column counts as ``-``; a null tree comes before all others; a null id before other ids.
* repeated ids are ordered by their leaves, so equal rows get neighbouring leaves and each its own proof.
* a tree of one leaf has that leaf as its root. An empty table has no root and gives no rows.
* texts of any length are hashed where they are read and never shuffled; other columns pass or are ignored by name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.ordered import null_key, numbered
from folioflow.store import materialize, shared_dir

FAN = 3
LEVELS = 6
BLOCK = FAN**LEVELS

NODE = "tree string, n long, level int, pos long, digest string, top boolean"
PATH = "path array<struct<left:string,right:string>>"


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 in hex over columns, each as its size in bytes, a colon and its value, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first two values, one at a time."""
    key, held = None, []
    for row in rows:
        if row[:2] != key:
            if held:
                yield key, held
            key, held = row[:2], []
        held.append(row)
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STRUCT = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())])
_PATHS = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("path", _STRUCT), ("subroot", pa.string()), ("root", pa.string())])
_PROOFS = pa.schema([("row", pa.string()), ("digest", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", _STRUCT)])


def width(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n // FAN**level)


def _raise(base: int):
    """Nodes of a level, sorted, to those of the next ``LEVELS`` levels."""

    def made(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, block), held in _blocks(rows):
            n, now = held[0][3], [row[4] for row in held]
            for step in range(1, LEVELS + 1):
                level = base + step
                if width(n, level - 1) == 1:
                    break
                now = [_joined(now[k : k + FAN]) for k in range(0, len(now), FAN)]
                first = block * FAN ** (LEVELS - step)
                for k, digest in enumerate(now):
                    yield tree, n, level, first + k, digest, width(n, level) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(made(_rows(batches)), _NODES)

    return run


@dataclass
class Store:
    """Nodes by pass: ``passes[k]`` has levels k * LEVELS + 1 to (k + 1) * LEVELS, ``leaves`` level 0."""

    leaves: DataFrame
    passes: list[DataFrame]

    def level(self, level: int) -> DataFrame:
        if level == 0:
            return self.leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "digest", (F.col("n") == 1).alias("top"))
        return self.passes[(level - 1) // LEVELS].where(F.col("level") == level)

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        found = self.level(0).where("top").select("tree", "digest")
        for made in self.passes:
            found = found.union(made.where("top").select("tree", "digest"))
        return found


def build(leaves: DataFrame) -> Store:
    """Store over ``leaves`` (tree, n, pos, digest); n is the number of leaves of the tree, pos counts from 0."""
    spark = leaves.sparkSession
    store = Store(leaves, [])
    path = f"{shared_dir(spark)}/folioflow-nodes-{uuid.uuid4().hex}"
    most = leaves.agg(F.max("n")).first()[0] or 0
    while width(most, base := len(store.passes) * LEVELS) > 1:
        block = F.floor(F.col("pos") / BLOCK).cast("long")
        ready = store.level(base).where(~F.col("top")).select("tree", block.alias("block"), "pos", "n", "digest").repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", "pos")
        to = f"{path}/pass={len(store.passes)}"
        ready.mapInArrow(_raise(base), NODE).write.partitionBy("level").parquet(to)
        store.passes.append(spark.read.schema(NODE).parquet(to))
    return store


def _descend(base: int, payload: bool):
    """The proof of a block's node, and the block's nodes by level and place, to proofs of the nodes of its lowest level."""

    def made(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, held in _blocks(rows):
            above, nodes = None, {}
            for _, _, level, pos, n, digest, row, path, subroot, root in held:
                if level < 0:
                    above = ([(p["left"], p["right"]) for p in path], subroot, root)
                else:
                    nodes.setdefault(level, {})[pos] = (digest, row, n)
            tail, subroot, root = above
            for pos, (digest, row, n) in nodes[base].items():
                own, at = [], pos
                for level in range(base, base + LEVELS):
                    if width(n, level) == 1:
                        break
                    first = at - at % FAN
                    run = nodes[level]
                    side = [run[k][0] if k in run and k != at else "" for k in range(first, first + FAN)]
                    own.append(("".join(side[: at - first]), "".join(side[at - first :])))
                    at //= FAN
                whole = [{"left": a, "right": b} for a, b in own + tail]
                yield (row, digest, subroot, root, whole) if payload else (held[0][0], n, pos, whole, subroot, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(made(_rows(batches)), _PROOFS if payload else _PATHS, 1024)

    return run


def proofs(store: Store, above: DataFrame, row: Column) -> DataFrame:
    """(row, digest, subroot, root, path) of every leaf; ``row`` is a text over the leaves' columns that goes along.

    ``above`` has (tree, subroot, root, path): what follows the root of each tree, an empty path where nothing does.
    """
    n_at = lambda level: F.ceil(F.col("n") / float(FAN**level))
    lower: DataFrame | None = None
    for base in range(max(len(store.passes) - 1, 0) * LEVELS, -1, -LEVELS):
        inside = store.leaves if base == 0 else store.level(base).where(~F.col("top"))
        # a tree that ends within this pass goes on with what lies above it, the others with the proofs of the pass before
        ending = inside.where((F.col("pos") == 0) & (n_at(base + LEVELS) <= 1)).select("tree").join(above, "tree")
        none = F.lit(None).cast("string")
        head = ending.select("tree", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), none.alias("digest"), none.alias("row"), "path", "subroot", "root")
        if lower is not None:
            head = head.union(lower.select("tree", F.col("pos").alias("block"), F.lit(-1), F.lit(0).cast("long"), "n", none, none, "path", "subroot", "root"))
        no_path = F.lit(None).cast(PATH.split(" ", 1)[1])
        for level in range(base, base + LEVELS):
            if level > 0 and (level - 1) // LEVELS >= len(store.passes):
                break
            nodes = store.leaves.withColumn("row", row) if level == 0 else store.level(level).withColumn("row", none)
            block = F.floor(F.col("pos") / FAN ** (LEVELS - (level - base))).cast("long")
            kept = nodes if level == 0 else nodes.where(n_at(base) > 1)
            head = head.union(kept.select("tree", block, F.lit(level), "pos", "n", "digest", "row", no_path, none, none))
        ready = head.repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", "level", "pos")
        if base == 0:
            return ready.mapInArrow(_descend(0, True), f"row string, digest string, subroot string, root string, {PATH}")
        lower = materialize(ready.mapInArrow(_descend(base, False), f"tree string, n long, pos long, {PATH}, subroot string, root string"))
    raise AssertionError("the last pass returns")


def verify(proved: DataFrame, leaf: Column) -> DataFrame:
    """``proved`` with proof_sha256, folded_root (from ``leaf`` and the siblings) and verified (whether that is the root)."""
    up = lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = proved.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", F.aggregate("path", leaf, up))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def dataset_proofs(docs: DataFrame, columns: list[str], row_id: str, source: str, claimed: Column | None = None) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) of every row: leaves over ``columns``, trees by ``source`` in order of ``row_id``.

    ``claimed`` is a second digest that goes along, as of rows that someone presents later; the row's own if not given.
    """
    leaf = digest_of([F.col(f"`{c}`") for c in columns])
    made = docs.select(F.col(f"`{row_id}`").alias("id"), null_key(F.col(f"`{source}`")).alias("tree"), leaf.alias("digest"), (claimed if claimed is not None else leaf).alias("claimed"))
    kind = made.schema["id"].dataType
    # hashed once: sorting reads its input twice
    sources = build(materialize(numbered(materialize(made), "tree", [F.col("id"), F.col("digest")])))
    roots = sources.roots().select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "digest")
    top = build(numbered(roots, "tree", [F.col("source")]))
    whole = F.array().cast(PATH.split(" ", 1)[1])
    nothing = top.roots().select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), whole.alias("path"))
    over = proofs(top, nothing, F.col("source")).select(F.col("row").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    found = proofs(sources, over, F.concat_ws(" ", F.col("claimed"), F.col("id").cast("string")))
    parts = F.split("row", " ", 2)
    return found.select(F.get(parts, F.lit(1)).cast(kind).alias("id"), F.col("digest").alias("leaf"), F.get(parts, F.lit(0)).alias("claimed"), "subroot", "root", "path")
