"""Conversation repair against a best-first search over edits, and the parser against the full chart."""

import heapq
import random
import re
from collections import Counter
from hashlib import md5, sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm import cyk_repair as cyk

COLUMNS = "conv_id long, turn long, role string, text string, audit string, N int, place string"


def search(turns):
    """Least (cost, audit) for (initial, must go, truncated) turns, by best-first search over (cost, audit)."""
    heap, found = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, place = heapq.heappop(heap)
        if i == len(turns) and place in (0, 3):
            return cost, audit
        if (i, place) in found:
            continue
        found.add((i, place))
        after = 3 if place == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", i, after))
        if i < len(turns):
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, place))
            if not gone:
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, after))
                if initial == "s" and place == 0:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, 1))
                if initial == {2: "u", 3: "a"}[after]:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, after))


def expected(rows, damage=True):
    """conv_id -> result columns and repaired turns, from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = ":".join(" " if x is None else str(x) for x in (c, turn))
            rule = crc32(key.encode()) % 20 if damage else 19
            if rule == 4:
                role = "user"
            text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
            turns += [(turn, role, text)] * {0: 0, 3: 2}.get(rule, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], md5(t[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            words = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen
                          else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = search([(t[1][:1], f in ("blank", "duplicate"), f == "truncated") for t, f in zip(turns, faults, strict=True)])
        numbers = [t[0] for t in turns if t[0] is not None]
        repaired, left = [], iter(turns)
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                after = "assistant" if repaired and repaired[-1][0][0] == "u" else "user"
                repaired.append((role if edit == "K" else after, text, edit))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _, _ in repaired))
        pairs = Counter(a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False))
        count = Counter(faults)
        out[conv] = ((max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0), count["blank"], count["duplicate"],
                     count["truncated"], sum(n for p, n in pairs.items() if p not in ("su", "ua", "au")), cost, audit,
                     sha256("\n".join(f"{r}:{t}" for r, t, _ in repaired).encode()).hexdigest()), repaired
    return out


def random_rows(seed, conversations=60, longest=12):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randrange(1, longest)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool"]),
                         draw.choice(["Yes.", "No!", "so", " \t", "", "Well. \n", f"t{turn}?"])))
    return rows


ODD = [
    (None, 1, "user", "A."), (None, 2, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 5, "", "x."), (2, 9, "User", "y."),
    (3, 1, "system", "S."), (4, 2, "assistant", None), (5, -4, "umbrella", "Q?\r\n"), (5, -3, "agent", "R…"), (6, 1, "user", "w " * 50_000),
    (7, 3, "user", "same."), (7, 3, "assistant", "same."), (7, 3, "user", "other."), (8, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], COLUMNS)


def held(found):
    return {r["conv_id"]: tuple(r[c] for c in (*cyk.COUNT_NAMES, "repaired_sha256")) for r in found}


@pytest.mark.parametrize("rows", [ODD, random_rows(1), random_rows(2, 8, 60)], ids=["odd", "short", "long"])
def test_repair(spark, rows):
    turns = frame(spark, rows).repartition(3)
    want = expected(rows)
    found = cyk.repair_conversations(cyk.damaged(turns)).collect()
    assert len(found) == len(want) and held(found) == {c: x for c, (x, _) in want.items()}
    plain = expected(rows, damage=False)
    assert held(cyk.repair_conversations(turns).collect()) == {c: x for c, (x, _) in plain.items()}
    texts = cyk.repaired_turns(turns).orderBy("conv_id", "place").collect()
    for conv, (_, repaired) in plain.items():
        assert [(r["role"], r["text"], r["edit"]) for r in texts if r["conv_id"] == conv] == repaired


def test_one_conversation_over_many_tasks(spark):
    """A conversation that range partitioning deals to several tasks, between short ones; and many identical turns."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c} {t % 400}.") for c, n in ((1, 3), (2, 3_000), (3, 2)) for t in range(n)]
    rows += [(4, 1, "user", "again."), (4, 1, "user", "again.")] * 500
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        spans = cyk.parse_conversations(frame(spark, rows)).collect()
        found = cyk.repair_conversations(frame(spark, rows)).collect()
    finally:
        spark.conf.unset(conf)
    want = {c: x for c, (x, _) in expected(rows, damage=False).items()}
    assert held(found) == want
    assert {r["conv_id"]: tuple(r)[1:] for r in spans} == {c: x[:-1] for c, x in want.items()}
    assert want[2][2] == 2_600 and want[4][2] == 999


def test_empty(spark):
    none = frame(spark, ODD).limit(0)
    assert cyk.repair_conversations(cyk.damaged(none)).count() == cyk.repaired_turns(none).count() == 0
    dropped = cyk.damaged(frame(spark, ODD[:3])).withColumn("copies", F.lit(0))
    assert held(cyk.repair_conversations(dropped).collect()) == {
        c: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c in (None, 1)}


def full_chart(codes):
    """CYK over all spans and all splits."""
    cells = {(i, i): cyk.CLOSURE for i in range(len(codes) + 1)}
    for size in range(1, len(codes) + 1):
        for i in range(len(codes) - size + 1):
            found = [cyk.LEAF[codes[i]]] if size == 1 else [
                cyk.combine(cells[i, k], cells[k, i + size]) for k in range(i, i + size + 1) if k not in (i, i + size)]
            cells[i, i + size] = tuple(min((c for c in column if c), default=None) for column in zip(*found, strict=True))
    return cells[0, len(codes)]


def test_one_split_gives_the_full_chart():
    draw = random.Random(3)
    for n in [0, 1, 2, 3, 5, 8, 13, 17] * 12:
        codes = "".join(draw.choice("suuaaoSUAOx") for _ in range(n))
        cell = cyk.parse_leaves(codes)
        assert cell == full_chart(codes)
        assert cyk.parsed(cell) == search([(c.lower(), c == "x", c.isupper()) for c in codes])
        assert cyk.combine(cyk.CLOSURE, cell) == cyk.combine(cell, cyk.CLOSURE) == cell
        spans = cyk.Spans()
        for c in codes:
            spans.add(cyk.LEAF[c])
        assert spans.whole() == cell
