"""Suffix-array dedup, conversation repair and Merkle manifests against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import convrepair, manifest, queries, suffixdedup, suffixes

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def shards():
    r = random.Random(3)
    yield [b""]
    yield [b"a" * 40, b"", b"a" * 40, b"aab", b"\0\0\0", b"\0\0"]
    yield [bytes(r.choice(b"ab") for _ in range(r.randrange(60))) for _ in range(25)]
    base = bytes(r.choice(b"abcdefgh") for _ in range(300))
    yield [base[k : k + 200] for k in range(0, 100, 7)] + [base, base[:150] + b"x" + base[150:], base]


@pytest.mark.parametrize("texts", list(shards()))
def test_suffix_array_and_common_prefixes(texts):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tails = sorted((t[k:], o + k) for t, o in zip(texts, offsets.tolist()) for k in range(len(t)))
    order = suffixes.suffix_array(data, offsets)
    assert order.tolist() == [p for _, p in tails]

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert suffixes.common_prefixes(data, offsets, order).tolist() == [0, *(common(a, b) for (a, _), (b, _) in itertools.pairwise(tails))][: len(tails)]


def plain_repeats(texts, length):
    """(removed, spans, kept) by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((int(gone.sum()), edges, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def repeat_fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeghiéöß") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short, licence = prose(60), prose(20), prose(34)
    texts = [prose(120) for _ in range(20)]
    texts += [prose(10 + k) + passage + prose(k) for k in range(5)]
    texts += [texts[3]] * 3 + [texts[4][:300] + "X" + texts[4][300:], texts[5][7:]]
    texts += [f"{prose(15)} {short} {prose(12)}" for _ in range(30)] + [f"{prose(9)} {licence} {prose(9)}" for _ in range(40)]
    return texts + [None, "", "kurz", "a" * 500, "ab" * 300, passage, "q" * 199, "z" * 200, prose(40) * 3, passage[:201]]


@pytest.mark.parametrize("params", [suffixdedup.RepeatParams(), suffixdedup.RepeatParams(part_pieces=2, shard_bytes=2000), suffixdedup.RepeatParams(length=50, gram=16, part_pieces=3)])
def test_repeats_equal_every_window_counted(spark, params):
    texts = repeat_fixture()
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, r1 string, kept int").repartition(5)
    found = {r["kept"]: r for r in suffixdedup.remove_repeats(docs, params=params).collect()}
    assert set(found[0].asDict()) == {"doc_id", "r1", "kept", "removed", "kept_"} and found[1]["r1"] == "x"
    for k, (gone, spans, kept) in enumerate(plain_repeats(texts, params.length)):
        assert (sum(x["end"] - x["start"] for x in found[k]["removed"]), len(found[k]["removed"]), bytes(found[k]["kept_"])) == (gone, spans, kept), k


def test_repeats_of_long_rows_repeated_rows_and_empty_tables(spark, monkeypatch):
    r = random.Random(8)
    long = "".join(r.choice("abcdefghij") for _ in range(1_300_000))
    rows = [(1, long), (2, long[600_000:600_900]), (3, "w" * 210), (4, long[100:400]), (7, long[2000:2300]), (7, long[2000:2300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], [tuple(x) for x in r["removed"]]) for r in suffixdedup.remove_repeats(docs).collect())
    assert found == [(1, [(100, 400), (2000, 2300), (600_000, 600_900)]), (2, [(0, 900)]), (3, [(0, 210)]), (4, [(0, 300)]), (7, [(0, 300)]), (7, [(0, 300)])]
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_op11_columns(spark, tmp_path):
    texts = repeat_fixture()
    found = {r["doc_id"]: r for r in queries.op11_suffixdedup(spark, write(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, (gone, spans, kept) in enumerate(plain_repeats(texts, 200)):
        assert tuple(found[k]) == (k, len((texts[k] or "").encode()), gone, spans, sha(kept))


def plain_repair(rows):
    """Least (cost, audit) and lines by trying edits turn by turn; a state keeps its best prefix of every (cost, audit)."""
    moves = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    full = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(2):
            for q, best in list(states.items()):
                for c in moves[q]:
                    if c in full:
                        new = (best[0] + 5, best[1] + "I", (*best[2], full[c] + ":"))
                        states[to[c]] = min(states.get(to[c], new), new)
        return states

    states = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, lines) in states.items():
            options = [(q, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[:1] in moves[q]:
                    options.append((to[role[0]], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                options += [(to[c], (cost + 1 + more, audit + "R", (*lines, f"{full[c]}:{text}"))) for c in moves[q] if c in full]
            for p, option in options:
                after[p] = min(after.get(p, option), option)
        states = inserted(after)
    return min(s for q, s in states.items() if q in (0, 3))


def plain_conversations(rows):
    fill = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        held = convs.setdefault(conv, [])
        role, text = ("user" if kind == 4 else fill(role)), fill(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        if kind:
            held += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    space = " \t\n\x0b\x0c\r"
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in held:
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = {t for has, t, *_ in held if has}
        cost, audit, lines = plain_repair(judged)
        initials = [r[:1] for r, *_ in judged]
        count = lambda f: sum(x[2] == f for x in judged)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count("blank"), count("duplicate"), count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha("\n".join(lines)))
    return out


def conversations():
    r = random.Random(11)
    rows = []
    for conv in [None, *range(160)]:
        for turn in range(r.choice([1, 2, 3, 6, 9])):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]) if conv is None or conv % 3 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 2]), role, r.choice(["Yes.", "No!  ", "and then", "  ", "", None, "Why?\n", f"Turn {turn}.", "end.\x85", "é… ."])))
    return rows + [(500, 0, "user", "x."), (500, 0, "user", "x."), (500, 0, "assistant", "y."), (501, None, None, None)] + [(502, t, ("user", "assistant")[t % 2], f"t{t // 3}.") for t in range(900)]


def test_op12_equals_plain_search(spark, tmp_path):
    rows = conversations()
    found = queries.op12_convrepair(spark, write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")).collect()
    expected = plain_conversations(rows)
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r["conv_id"]], r["conv_id"]
    # faults that only insertions or costly turns mend
    assert convrepair.repair_path("4") == (2, "D", "D") and convrepair.repair_path("") == (0, "", "")
    for symbols in map("".join, itertools.product("0148BC3", repeat=4)):
        rows = [("sua?"[int(s, 16) // 4], f"{k}", ["", "blank", "duplicate", "truncated"][int(s, 16) % 4]) for k, s in enumerate(symbols)]
        assert convrepair.repair_path(symbols)[:2] == plain_repair(rows)[:2], symbols


def test_repaired_turns_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi.", "a"), (1, 1, "user", "Hi.", "b"), (1, 2, "tool", "Fine.", "c"), (2, 5, "system", "Be kind.", "d")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string")
    report, repaired = convrepair.repair(turns)
    assert [(r["turn"], r["role"], r["text"], r["edit"]) for r in repaired.orderBy("conv", "place").collect()] == [(0, "user", "Hi.", "K"), (2, "assistant", "Fine.", "R")]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: (3, "KDR"), 2: (2, "D")}
    assert convrepair.repair(turns.limit(0))[0].count() == 0


def fold(nodes):
    """Levels of a tree over digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at - at % 3
        run = level[first : first + 3]
        yield "".join(run[: at - first]), "".join(run[at - first + 1 :])
        at //= 3


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = fold([leaf(r) for r in by[source]])
    top = fold([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for at, r in enumerate(by[source]):
            path = [*siblings(trees[source], at), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[source][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [6, 2])
def test_op13_equals_plain_trees(spark, tmp_path, monkeypatch, levels):
    # two levels a pass make many passes of small trees; six is what the query uses
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    sizes = {None: 1, "": 2, "ä": 3, "z": 4, "b": 28, "hot": 140}
    rows = [(None if k % 11 == 5 else 1000 * s + k, source, None if k % 7 == 0 else "tr", k if k % 5 else None, None if k % 6 == 1 else "line\n" * (k % 4)) for s, (source, n) in enumerate(sizes.items()) for k in range(n)]
    rows += [(7, "hot", "en", 1, "same\n")] * 3
    found = queries.op13_manifest(spark, write(spark, tmp_path, "documents", rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)
    assert len({r["verified"] for r in found}) == 2


def test_manifest_of_other_tables(spark):
    docs = spark.createDataFrame([("k 1", None, 3, "x"), (None, "s", None, "y")], "name string, tree string, path int, pos string")
    found = manifest.verify(manifest.dataset_proofs(docs, docs.columns, "name", "tree"), F.col("leaf")).collect()
    assert {r["id"] for r in found} == {"k 1", None} and all(r["verified"] and r["leaf"] == r["claimed"] for r in found)
    assert manifest.dataset_proofs(docs.limit(0), docs.columns, "name", "tree").count() == 0
