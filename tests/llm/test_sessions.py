"""Sessions against a plain loop: ordinary clients, clients dealt by time, small chunks, odd rows."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sessions

MINUTE = 60_000_000
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, us long, slice string, path int"


def plain(rows):
    clicks = defaultdict(list)
    for r in {r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None}.values():
        clicks[r[3]].append(r)
    out = {}
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for client, own in clicks.items():
        late = [r for r in own if r[2] is not None and us(r[2]) - us(r[1]) > 360 * MINUTE]
        timely = sorted((us(r[1]), r[0], r[4] == "error" and (r[5] or 0) >= 60, int(np.floor(100 * (r[5] or 0) + 0.5))) for r in own if r not in late)
        made = []
        for t, i, final, cents in timely:
            why = None
            if made:
                s = made[-1]
                why = "end" if s["final"] else "gap" if t - s["end"] >= 10 * MINUTE else "length" if t - s["start"] > 40 * MINUTE else None
                if why:
                    s["closed"] = why
            if not made or why:
                made.append({"id": i, "start": t, "n": 0, "late": 0, "cents": 0, "path": []})
            s = made[-1]
            s.update(end=t, final=final, n=s["n"] + 1, cents=s["cents"] + cents, path=[*s["path"], str(i)])
        for r in late:
            before = [s for s in made if s["start"] <= us(r[1])]
            if before:
                before[-1]["late"] += 1
        for s in made:
            out[client, s["id"]] = (s["start"], s["end"], s["n"], s["late"], s["cents"], s.get("closed") or ("end" if s["final"] else "none"), ",".join(s["path"]))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = sessions.sessionise(df, (F.col("value") >= 60) & (F.col("kind") == "error"), F.floor(100 * F.col("value") + 0.5), **kw).collect()
    assert len({(r["client_id"], r["session_id"]) for r in got}) == len(got)
    return {(r["client_id"], r["session_id"]): (r["start_us"], r["end_us"], r["n_clicks"], r["n_late"], r["value_cents"], r["closed_by"], r["path"]) for r in got}


def made(seed, n, busy, pace, final=0.02):
    r, rows = random.Random(seed), []
    clock = defaultdict(lambda: dt.datetime(2024, 1, 1))
    for i in range(n):
        client = 0 if r.random() < busy else r.randrange(1, 9)
        clock[client] += dt.timedelta(microseconds=0 if r.random() < 0.15 else r.randrange(int(pace * MINUTE)))
        if r.random() < 0.03:
            clock[client] += dt.timedelta(minutes=r.choice([10, 9, 11, 40, 300]))
        ts = clock[client]
        late = dt.timedelta(minutes=r.choice([1, 359, 360, 361, 900]) if r.random() < 0.3 else 0)
        rows.append((i * 7 % 100_003, ts, None if r.random() < 0.02 else ts + late, client, r.choice(["error", "view", None]), r.choice([None, 1.005, 59.99, -3.3]) if r.random() > final else 60.0))
    return rows + rows[: n // 50] + [(None, rows[0][1], None, 1, "view", 1.0), (200_001, None, None, 1, "error", 80.0), (200_002, rows[0][1], None, None, "error", 80.0)]


@pytest.mark.parametrize(("seed", "pace", "final"), [(1, 4, 0.02), (2, 0.4, 0.002), (3, 11, 0.2), (4, 0.05, 0.0)])
def test_sessions(spark, seed, pace, final):
    rows = made(seed, 900, 0.6, pace, final)
    want = plain(rows)
    assert len(want) > 3
    assert found(spark, rows) == want
    assert found(spark, rows, groups=4, slice_rows=40, chunk=25) == want


def test_sessions_in_chunks(spark):
    rows = made(7, 1500, 0.8, 0.2, 0.003)
    assert found(spark, rows, chunk=50) == plain(rows)
    assert found(spark, rows, groups=16, slice_rows=10) == plain(rows)


def test_no_clicks(spark):
    assert found(spark, []) == {}
    late = [(i, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 5, "error", 70.0) for i in range(4)]
    assert found(spark, late) == {}
    assert found(spark, [*late, (9, dt.datetime(2023, 12, 31), None, 5, None, None)]) == plain([*late, (9, dt.datetime(2023, 12, 31), None, 5, None, None)])


@pytest.mark.parametrize("seed", range(6))
def test_steps_compose(seed):
    """A stretch's step function, in one and in parts, against the loop over its clicks."""
    r = np.random.default_rng(seed)
    gap, length = 10, 40
    for _ in range(200):
        n = int(r.integers(1, 40))
        t, click, final = np.sort(r.integers(100, 100 + n * int(r.integers(1, 9)), n)), np.arange(n) + 500, r.random(n) < 0.03
        whole = sessions.Steps.of(t, click, final, gap, length)
        at = sorted(r.integers(0, n + 1, 2))
        parts = [sessions.Steps.of(t[a:b], click[a:b], final[a:b], gap, length) for a, b in zip([0, *at], [*at, n], strict=True) if a < b]
        joined = parts[0]
        for p in parts[1:]:
            joined = joined.then(p, gap)
        for start in range(int(t[0]) - 45, int(t[0]) + 1):
            state = (start, 7)
            for i in range(n):
                if t[i] - state[0] > length or (i and (final[i - 1] or t[i] - t[i - 1] >= gap)):
                    state = (int(t[i]), int(click[i]))
            for s in (whole, joined):
                us, c = s.apply(np.array([start]), np.array([7]))
                assert (int(us[0]), int(c[0])) == state
        state = None
        for i in range(n):
            if state is None or t[i] - state[0] > length or final[i - 1] or t[i] - t[i - 1] >= gap:
                state = (int(t[i]), int(click[i]))
        assert whole.fresh == joined.fresh == state
