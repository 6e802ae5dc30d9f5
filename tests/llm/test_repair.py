"""Repair against a search over all edits, and over odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
FULL = {"u": "user", "a": "assistant"}


def searched(rows):
    """The cheapest and then least edits, by a search over states of the text itself; repaired rows."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        tail = initials[-2:] if len(initials) > 1 else initials
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, list(out)
        ways = [("I", 5, i, (FULL[x], "")) for x in "ua"]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append(("D", 2, i + 1, None))
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                ways += [("K", stays, i + 1, (role, text))] + [("R", stays + 1, i + 1, (FULL[x], text)) for x in "ua"]
        for letter, c, j, row in ways:
            now = initials + (row[0][:1] if row else "")
            if (not row or row[0]) and any(LEGAL.fullmatch(now + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, audit + letter, j, now, out + ((row,) if row else ())))
    raise AssertionError


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(c, t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = [], []
        for _, role, text in own:
            black = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
            seen.append((role, text))
        cost, audit, fixed = searched([(role, text, f) for (_, role, text), f in zip(own, faults)])
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def found(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = repair.repair_conversations(repair.damage(df)).withColumn("h", F.sha2(F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), 256)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["h"]) for r in got}


@pytest.mark.parametrize("seed", range(5))
def test_cheapest_edits(seed):
    r = random.Random(seed)
    for _ in range(400):
        roles = r.choice([["user", "assistant"], ["system", "user", "assistant", "tool", " ", ""], ["assistant", "system"]])
        rows = [(r.choice(roles), f"t{i}", r.choice(["", "", "", "blank", "duplicate", "truncated"][: r.choice([1, 4, 6])])) for i in range(r.randrange(0, 9))]
        assert repair.cheapest_repair(rows) == searched(rows), rows


def test_long_conversation():
    r = random.Random(3)
    rows = [(r.choice(["user", "assistant", "system"]), "", r.choice(["", "", "truncated", "blank"])) for _ in range(50_000)]
    cost, audit, fixed = repair.cheapest_repair(rows)
    assert sum(map(audit.count, "KRD")) == len(rows) and LEGAL.fullmatch("".join(x[0][0] for x in fixed)) and cost <= 2 * len(rows)


def test_odd_tables(spark):
    r = random.Random(5)
    texts = ["Yes.", "no", " ", "", None, "Why? \t", " ", "long " * 5000, "Done!\n", "\U0001f600."]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "user", "assistant", None, "bot", ""]), r.choice(texts)) for _ in range(400)]
    rows += rows[:40] + [(1000 + i, 0, "user", "Only one.") for i in range(60)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == {}


def test_given_rows(spark):
    rows = defaultdict(list)
    for conv in range(120):
        for turn in range(random.Random(conv).randrange(1, 9)):
            rows[conv].append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"Text {turn} of {conv}."))
    rows = [x for own in rows.values() for x in own]
    assert found(spark, rows) == plain(rows)
