"""Repair of conversation structure as a cheapest path through a composition of three weighted machines.

* The input acceptor has a state for each turn and reads the turn's symbol: its role's initial and its fault.
* The edit transducer has one state. It keeps, reroles or deletes a turn, or inserts one (costs in ``COSTS``).
* The grammar acceptor reads the initials written: a system turn at most at the head, then pairs of
  user and assistant, ``(s?(ua)+)?``.

Weights are (cost, label string), compared in that order, and a path's weight is the sum of costs and the
concatenation of labels (D, I, K, R). The composition is made lazily: only arcs of states that a symbol
reaches are drawn, and a step backwards over a symbol is looked up by the costs still to go, which take few values. Shortest
distances go in reverse topological order, so that labels are put in front: among arcs of one state the
labels differ, so the least string among the cheapest follows from the first label alone, and no strings are compared.

Rows are sorted in runs over all tasks (``ordered.sorted_runs``); repeats are found by the first place of each
(role, text). What a conversation sends to one task is a letter a turn, no more than the audit that it gets back.
Its texts are joined in pieces of ``PIECE`` turns; only the digest of the repaired text, a chain by its nature,
reads one conversation's pieces in turn, a batch at a time.

Defined cases
* a null role or text counts as one space; a null turn sorts first; a null conversation is one of its own.
* turns with one number are ordered by role, then text; repeated rows follow each other, the later ones being duplicates.
* roles with another initial than s, u, a can be reroled or deleted only; an empty role likewise.
* an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.ordered import null_key, sorted_runs
from folioflow.store import materialize

PIECE = 256
# the contract's fixed values
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED_COST = 5
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
WRITTEN = {"u": "user", "a": "assistant"}
BLANK = r"[^\x20\x09-\x0D]"

FINE, EMPTY, REPEATED, CUT = range(4)
INITIALS = "sua?"
SYMBOLS = "0123456789ABCDEF"
NEVER = 1 << 40


def arcs(state: int, symbol: str | None) -> Iterator[tuple[str, int, bool, int, str]]:
    """Arcs of the composition, least label first: (label, cost, whether the turn is read, grammar state, what the turn becomes).

    ``symbol`` None is the end of the input, where only insertions are left. What a turn becomes is coded as D, K,
    u or a (reroled), U or A (inserted).
    """
    moves = GRAMMAR[state]
    if symbol is not None:
        initial, fault = INITIALS[SYMBOLS.index(symbol) // 4], SYMBOLS.index(symbol) % 4
        yield "D", COSTS["D"], True, state, "D"
    for letter in sorted(set(moves) & set(WRITTEN)):
        yield "I", COSTS["I"], False, moves[letter], letter.upper()
    if symbol is not None and fault not in (EMPTY, REPEATED):
        more = TRUNCATED_COST if fault == CUT else 0
        if initial in moves:
            yield "K", COSTS["K"] + more, True, moves[initial], "K"
        for letter in sorted(set(moves) & set(WRITTEN)):
            yield "R", COSTS["R"] + more, True, moves[letter], letter


@lru_cache(maxsize=65536)
def backwards(after: tuple[int, ...], symbol: str | None) -> tuple[tuple[int, ...], int, tuple]:
    """Costs to go before a symbol from those after it: (costs less their least, that least, best arc of each state).

    An insertion leads to another state of the same place, so distances within the place are settled
    first; every insertion costs something, and two of them lead back, so three rounds are enough.
    """
    here = [NEVER] * len(GRAMMAR)
    for _ in range(3):
        for state in GRAMMAR:
            ends = [after[state]] if symbol is None else []
            here[state] = min([here[state], *ends, *(cost + (after[to] if read else here[to]) for _, cost, read, to, _ in arcs(state, symbol))])
    best = []
    for state in GRAMMAR:
        cheapest = [(label, read, to, made) for label, cost, read, to, made in arcs(state, symbol) if cost + (after[to] if read else here[to]) == here[state]]
        # at the end of the input an accepting state may stop, and the empty string is the least
        best.append(None if symbol is None and after[state] == here[state] else min(cheapest))
    least = min(here)
    return tuple(c - least for c in here), least, tuple(best)


def repair_path(symbols: str) -> tuple[int, str, str]:
    """(cost, audit, codes) of the least path over a conversation's symbols."""
    togo, cost, steps = *backwards(tuple(0 if q in FINAL else NEVER for q in GRAMMAR), None)[:2], []
    end = backwards(tuple(0 if q in FINAL else NEVER for q in GRAMMAR), None)[2]
    for symbol in reversed(symbols):
        togo, least, best = backwards(togo, symbol)
        cost += least
        steps.append(best)
    state, audit, codes, total = 0, [], [], cost + togo[0]
    for best in reversed(steps):
        read = False
        while not read:
            label, read, state, made = best[state]
            audit.append(label)
            codes.append(made)
    while end[state] is not None:
        label, _, state, made = end[state]
        audit.append(label)
        codes.append(made)
    return total, "".join(audit), "".join(codes)


_PIECES = pa.list_(pa.struct([("run", pa.int32()), ("piece", pa.int64()), ("codes", pa.string())]))
_PLAN = pa.schema([("conv", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("pieces", _PIECES)])
PLAN = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<run:int,piece:long,codes:string>>"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, parts in zip(*(c.to_pylist() for c in batch.columns)):
            symbols = "".join(p["symbols"] for p in parts)
            cost, audit, codes = repair_path(symbols)
            count = lambda fault: sum(symbols.count(s) for s in SYMBOLS[fault::4])
            initials = "".join(INITIALS[SYMBOLS.index(s) // 4] for s in symbols)
            illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
            # each piece takes the codes of its turns and of what is inserted before them
            shares, at = [], 0
            for part in parts:
                begin, left = at, len(part["symbols"])
                while left:
                    left -= codes[at] not in "UA"
                    at += 1
                shares.append({"run": part["run"], "piece": part["piece"], "codes": codes[begin:at]})
            shares[-1]["codes"] += codes[at:]
            rows.append((conv, count(EMPTY), count(REPEATED), count(CUT), illegal, cost, audit, shares))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLAN)], schema=_PLAN)


def _symbol(initial: Column, fault: Column) -> Column:
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.substring(F.lit(SYMBOLS), place * 4 + fault + 1, F.lit(1))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) in sorted runs, as a table in the shared folder: with conv (a key without nulls), run and at."""
    filled = turns.select(null_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    # ranges are cut by a bounded part of the text, as their borders go through the driver
    return sorted_runs(filled, [F.col("conv"), F.col("turn"), F.left("role", F.lit(40)), F.left("text", F.lit(40))], [F.col("role"), F.col("text")])


def _piece() -> Column:
    return F.floor(F.col("at") / PIECE).cast("long").alias("piece")


def plan_repairs(ordered: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, pieces) of every conversation of ``ordered_turns``.

    ``pieces`` holds, for every piece of the conversation's rows, what becomes of each turn.
    """
    text = F.col("text")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    light = ordered.select("conv", "run", "at", F.left("role", F.lit(1)).alias("initial"), text.rlike(BLANK).alias("filled"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"), same.alias("same"))
    first = light.where("filled").groupBy("conv", "same").agg(F.min(F.struct("run", "at")).alias("f")).select("f.run", "f.at", F.lit(True).alias("first"))
    fault = F.when(~F.col("filled"), EMPTY).when(F.col("first").isNull(), REPEATED).when(~F.col("ended"), CUT).otherwise(FINE)
    marked = light.join(first, ["run", "at"], "left").select("conv", "run", "at", _piece(), _symbol(F.col("initial"), fault).alias("symbol"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "")
    pieces = marked.groupBy("conv", "run", "piece").agg(letters.alias("symbols"))
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "piece", "symbols"))).alias("parts"))
    return whole.mapInArrow(_planned, PLAN)


_TURNS = pa.schema([("conv", pa.string()), ("run", pa.int32()), ("piece", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that stay, by piece; inserted ones have no number."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _TURNS)], schema=_TURNS)

    for batch in batches:
        held: list[tuple] = []
        for conv, run, piece, codes, rows in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
            at = 0
            for place, code in enumerate(codes):
                if code in "UA":
                    held.append((conv, run, piece, place, "I", None, WRITTEN[code.lower()], ""))
                    continue
                row, at = rows[at], at + 1
                if code != "D":
                    held.append((conv, run, piece, place, "K" if code == "K" else "R", row["turn"], row["role"] if code == "K" else WRITTEN[code], row["text"]))
            if len(held) >= PIECE:
                yield made(held)
                held = []
        if held:
            yield made(held)


def repaired_turns(ordered: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns of the repaired conversations: (conv, run, piece, place, edit, turn, role, text), in order of run, piece and place."""
    texts = ordered.select("conv", "run", _piece(), "at", F.col("turn").cast("long").alias("turn"), "role", "text")
    grouped = texts.groupBy("conv", "run", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("rows"))
    codes = plan.select("conv", F.explode("pieces").alias("p")).select("conv", "p.run", "p.piece", "p.codes")
    ready = grouped.join(codes, ["conv", "run", "piece"]).select("conv", "run", "piece", "codes", "rows")
    return ready.mapInArrow(_applied, "conv string, run int, piece long, place long, edit string, turn long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's pieces, which come in order."""
    now, state, done = None, None, []
    for batch in batches:
        for conv, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(lines.encode())
    if state is not None:
        done.append((now, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "sha256"])


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) over ``role:text`` of the repaired turns, joined by line ends; conversations without turns have no row."""
    line = F.concat("role", F.lit(":"), "text")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    pieces = repaired.groupBy("conv", "run", "piece").agg(lines.alias("lines"))
    return pieces.repartition("conv").sortWithinPartitions("conv", "run", "piece").select("conv", "lines").mapInArrow(_digests, "conv string, sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of turns (conv_id, turn, role, text): a row for each conversation, and the turns that it ends up with."""
    ordered = ordered_turns(turns)
    plan = materialize(plan_repairs(ordered))
    repaired = repaired_turns(ordered, plan)
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    gaps = ordered.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), span.alias("gaps"))
    nothing = hashlib.sha256(b"").hexdigest()
    report = gaps.join(plan.drop("pieces"), "conv").join(repaired_digests(repaired), "conv", "left")
    return report.select("conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256")), repaired
