"""Conversation repair: the solver against all edits, whole conversations against plain Python, odd tables."""

import heapq
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm.repair import damage, repair_conversations, repaired_digest, solve

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(signature):
    """(cost, audit) by looking at whole audits in order of (cost, audit)."""
    heap, n = [(0, "", 0, "")], len(signature)
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if not re.fullmatch(r"s?(ua)*u?", out) or len(out) > n + 3:
            continue
        if i == n and re.fullmatch(r"(s?(ua)+)?", out):
            ends = [(cost, audit), *((c, a) for c, a, j, o in heap if c == cost and j == n and re.fullmatch(r"(s?(ua)+)?", o))]
            later = [h for h in heap if h[0] == cost]
            while later:  # what costs no more may still end, and in a lesser audit
                c, a, j, o = later.pop()
                if j < n and signature[j] in "sua" and re.fullmatch(r"s?(ua)*u?", o + signature[j]):
                    later.append((c, a + "K", j + 1, o + signature[j]))
                elif j == n and re.fullmatch(r"(s?(ua)+)?", o):
                    ends.append((c, a))
            return min(ends)
        if i < n:
            letter = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if letter != "x":
                more = 3 if letter.isupper() else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + letter.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, out + role))
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + role))
    raise AssertionError


def test_solver_against_all_edits():
    draw = random.Random(3)
    for _ in range(400):
        signature = "".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(0, 5)))
        assert solve(signature)[:2] == cheapest(signature), signature


def test_long_signatures_don_t_recurse_deeply():
    assert solve("ua" * 20000)[0] == 0 and solve("x" * 3000)[:2] == (12000, "D" * 3000)
    cost, audit, steps = solve("u" * 3001)
    assert len(audit) >= 3001 and cost > 0 and len(steps) == audit.count("K") + audit.count("R") + audit.count("I")


def plain(rows):
    """One conversation's (turn, role, text) after damage: the row that is wanted."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    letters = [(r[1][:1] if r[1][:1] in ("s", "u", "a") else "o") for r in rows]
    signature = "".join("x" if f in ("blank", "duplicate") else x.upper() if f else x for x, f in zip(letters, faults, strict=True))
    cost, audit = cheapest(signature)
    out, i = [], 0
    for e in audit:
        state = sum(1 for role, _ in out if role[:1] != "s") % 2
        put = ("user", "assistant")[state]
        out += {"K": [rows[i][1:] if i < len(rows) else None], "R": [(put, rows[i][2] if i < len(rows) else "")], "I": [(put, "")], "D": []}[e]
        i += e != "I"
    n = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, out)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        held += [] if rule == 0 else [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return out


def test_whole_conversations(spark):
    draw = random.Random(4)
    texts = ["Yes.", "no", "Why?", "", " \t", "Yes.", "é!\n", "a.b", None]
    rows = [
        (conv, turn if draw.random() < 0.9 else draw.choice([None, 0, 40]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), draw.choice(texts))
        for conv in [*range(60), None]
        for turn in range(draw.randint(1, 5))
    ]
    rows += [(100 + i, 0, "user", "x") for i in range(30)]  # some of one row are dropped
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"gone": F.lit(True), "rule": F.lit("own"), "copy": F.lit(1), "cost": F.lit(7)}).repartition(5)
    got = repair_conversations(damage(df), gone_col="gone").collect()
    want = {conv: plain(held) for conv, held in damaged(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [tuple(t) for t in r.repaired]) == want[r.conv_id], r
    assert any(not held for held in damaged(rows).values())


def test_empty_and_digest(spark):
    none = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"] and none.count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "Yes.")], SCHEMA)
    (r,) = repair_conversations(df).select("cost", "audit", F.sha2(F.lit("user:\nassistant:Yes."), 256).alias("want"), repaired_digest(F.col("repaired")).alias("got")).collect()
    assert (r.cost, r.audit) == (3, "IK") and r.want == r.got
