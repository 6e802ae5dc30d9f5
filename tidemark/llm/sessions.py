"""Gap sessionisation: clicks into sessions that end at final clicks, pauses and a length.

Clients are hashed into groups; a worker reads its groups in order as Arrow batches and
hands them to an embedded DuckDB, whose windows find the hard breaks, whose recursive
query cuts what is too long between two of them, and whose ASOF join puts late clicks
where they belong.

A client with very many clicks is dealt out by slices of time.  What a slice does to the
session that is open when it begins is a step function of that session's start, worked
out for all slices side by side; one pass over a client's slices then tells with what
each begins.  A worker never holds more than ``CHUNK`` rows (and those of one client and
microsecond): it goes on from one part of a slice to the next as from slice to slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, scratch

#: Groups that clients are hashed into.  A group is dealt by time if it has more than four
#: times the mean rows of a group, so that there are at most a quarter of them.
GROUPS = 65_536
#: Rows up to which a group is never cut, and slices that one is cut into at most.
SLICE_ROWS, MOST_SLICES = 4096, 4096
#: Rows that a worker takes up at a time.
CHUNK = 200_000
MINUTE = 60_000_000
NEVER = np.iinfo(np.int64).max


def microseconds(ts: Column, kind: str) -> Column:
    """Microseconds since 1970: of a time with a zone in UTC, of one without as it stands."""
    if kind == "timestamp":
        return F.unix_micros(ts)
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * (1440 * MINUTE) + F.hour(ts).cast("long") * (60 * MINUTE) + F.minute(ts).cast("long") * MINUTE + second


# ---------------------------------------------------------------- slices of busy clients


@dataclass
class Steps:
    """What a stretch of a client's timely clicks does to the session open before it.

    A start under ``bound[i]`` (the first such) becomes ``us[i], click[i]``; others stay.
    ``fresh`` is the last session's start if the first click begins one.
    """

    first: int
    last: int
    last_final: bool
    bound: np.ndarray
    us: np.ndarray
    click: np.ndarray
    fresh: tuple[int, int]

    @classmethod
    def of(cls, t: np.ndarray, click: np.ndarray, final: np.ndarray, gap: int, length: int) -> Steps:
        """Of clicks in order."""
        n = len(t)
        broken = np.flatnonzero(final[:-1] | (np.diff(t) >= gap))
        after = np.searchsorted(t, t + length, "right")  # where the next session begins if one begins here
        last = np.where(after < n, after, np.arange(n))
        while not np.array_equal(last, further := last[last]):
            last = further
        if len(broken):
            e = last[broken[-1] + 1]
            at, bound = np.array([e]), np.array([NEVER])
            fresh = e
        else:
            most = min(n, int(np.searchsorted(t, t[0] + length, "right")) + 1)
            ends = last[:most]
            at = np.append(np.flatnonzero(np.diff(ends)), most - 1)
            bound, at, fresh = t[at] - length, ends[at], last[0]
        return cls(int(t[0]), int(t[-1]), bool(final[-1]), bound, t[at], click[at], (int(t[fresh]), int(click[fresh])))

    def apply(self, us: np.ndarray, click: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What becomes of session starts that are open before the first click."""
        i = np.searchsorted(self.bound, us, "right")
        moved = i < len(self.bound)
        j = np.minimum(i, len(self.bound) - 1)
        return np.where(moved, self.us[j], us), np.where(moved, self.click[j], click)

    def breaks(self, last: int, last_final: bool, gap: int) -> bool:
        """Whether the first click begins a session whatever is open, coming after ``last``."""
        return last_final or self.first - last >= gap

    def then(self, other: Steps, gap: int) -> Steps:
        """This stretch and the next as one."""
        if other.breaks(self.last, self.last_final, gap):
            us, click = other.fresh
            return Steps(self.first, other.last, other.last_final, np.array([NEVER]), np.array([us]), np.array([click]), other.fresh)
        us, click = other.apply(np.append(self.us, self.fresh[0]), np.append(self.click, self.fresh[1]))
        rest = other.bound > (self.bound[-1] if len(self.bound) else -NEVER)
        return Steps(
            self.first, other.last, other.last_final, np.append(self.bound, other.bound[rest]), np.append(us[:-1], other.us[rest]), np.append(click[:-1], other.click[rest]), (int(us[-1]), int(click[-1]))
        )


_SLICE = "client_id long, slice long, first long, last long, last_final boolean, bound array<long>, us array<long>, click array<long>, fresh_us long, fresh_click long"
_ENTRY = "client_id long, slice long, kind int, us long, click_id long, late boolean, final boolean, cents long"


def _slices(rows: DataFrame, gap: int, length: int) -> DataFrame:
    """A row for each client and slice: its ``Steps``, nulls where all clicks are late."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, steps, done = None, None, []

        def row() -> tuple:
            if steps is None:
                return (*unit, *[None] * 8)
            return (*unit, steps.first, steps.last, steps.last_final, steps.bound, steps.us, steps.click, *steps.fresh)

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("client_id", "slice", "us", "click_id", "late", "final")}
            edge = np.flatnonzero((np.diff(col["client_id"]) != 0) | (np.diff(col["slice"]) != 0)) + 1
            for lo, hi in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                this = (int(col["client_id"][lo]), int(col["slice"][lo]))
                if this != unit:
                    if unit is not None:
                        done.append(row())
                    unit, steps = this, None
                timely = np.flatnonzero(~col["late"][lo:hi].astype(bool)) + lo
                if len(timely):
                    more = Steps.of(col["us"][timely], col["click_id"][timely], col["final"][timely].astype(bool), gap, length)
                    steps = more if steps is None else steps.then(more, gap)
            if len(done) >= 1000:
                yield _batch(done, _SLICE_ARROW)
                done = []
        if unit is not None:
            done.append(row())
        if done:
            yield _batch(done, _SLICE_ARROW)

    return rows.repartition("client_id", "slice").sortWithinPartitions("client_id", "slice", "us", "click_id").mapInArrow(step, _SLICE)


_LONGS = pa.list_(pa.int64())
_SLICE_ARROW = pa.schema([("client_id", pa.int64()), ("slice", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("last_final", pa.bool_()), ("bound", _LONGS), ("us", _LONGS), ("click", _LONGS), ("fresh_us", pa.int64()), ("fresh_click", pa.int64())])
_ENTRY_ARROW = pa.schema([("client_id", pa.int64()), ("slice", pa.int64()), ("kind", pa.int32()), ("us", pa.int64()), ("click_id", pa.int64()), ("late", pa.bool_()), ("final", pa.bool_()), ("cents", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _entries(slices: DataFrame, gap: int) -> DataFrame:
    """With what each slice but a client's first begins: a row as of a click of ``kind`` 0.

    ``us, click_id`` are the open session's start, ``cents`` and ``final`` the time of the
    last timely click and whether it is final.  One pass over at most ``MOST_SLICES`` rows
    a client.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["client_id"] != client:
                    client, state = r["client_id"], None
                if state is not None:
                    out.append((client, r["slice"], 0, state[0], state[1], False, state[3], state[2]))
                if r["first"] is None:
                    continue
                steps = Steps(r["first"], r["last"], r["last_final"], np.array(r["bound"], np.int64), np.array(r["us"], np.int64), np.array(r["click"], np.int64), (r["fresh_us"], r["fresh_click"]))
                if state is None or steps.breaks(state[2], state[3], gap):
                    start = steps.fresh
                else:
                    us, click = steps.apply(np.array([state[0]]), np.array([state[1]]))
                    start = int(us[0]), int(click[0])
                state = (*start, steps.last, steps.last_final)
            if out:
                yield _batch(out, _ENTRY_ARROW)

    return slices.repartition("client_id").sortWithinPartitions("client_id", "slice").mapInArrow(fold, _ENTRY)


# ---------------------------------------------------------------- sessions of a chunk

#: Over ``c``, rows of whole or continued slices; ``kind`` 0 is what a slice begins with.
_SQL = """
WITH RECURSIVE
e AS (SELECT client_id, slice, us, click_id, cents AS l_us, final AS l_final FROM c WHERE kind = 0),
t AS (SELECT c.client_id, c.slice, c.us, c.click_id, c.final, c.cents, coalesce(lag(c.us) OVER w, e.l_us) AS p_us, coalesce(lag(c.final) OVER w, e.l_final) AS p_final
      FROM c LEFT JOIN e ON e.client_id = c.client_id AND e.slice = c.slice WHERE c.kind = 1 AND NOT c.late
      WINDOW w AS (PARTITION BY c.client_id, c.slice ORDER BY c.us, c.click_id)),
h AS (SELECT *, CASE WHEN p_us IS NULL THEN 'first' WHEN p_final THEN 'end' WHEN us - p_us >= {gap} THEN 'gap' END AS why FROM t),
r AS MATERIALIZED (SELECT *, count(why) OVER (PARTITION BY client_id, slice ORDER BY us, click_id) AS run FROM h),
b AS MATERIALIZED (
  SELECT client_id, slice, run, us, min(click_id) AS click_id
  FROM (SELECT client_id, slice, run, us, click_id FROM r UNION ALL SELECT client_id, slice, 0, us, click_id FROM e) GROUP BY ALL),
l AS (SELECT client_id, slice, run FROM b GROUP BY ALL HAVING max(us) - min(us) > {length}),
m AS MATERIALIZED (SELECT b.* FROM b SEMI JOIN l ON b.client_id = l.client_id AND b.slice = l.slice AND b.run = l.run),
n AS MATERIALIZED (
  SELECT a.client_id, a.slice, a.run, a.us, m.us AS n_us, m.click_id AS n_click
  FROM (SELECT *, us + {length} AS until FROM m) a ASOF JOIN m ON a.client_id = m.client_id AND a.slice = m.slice AND a.run = m.run AND a.until < m.us),
s(client_id, slice, run, us, click_id) AS (
  SELECT client_id, slice, run, min(us), arg_min(click_id, us) FROM b GROUP BY client_id, slice, run
  UNION ALL
  SELECT s.client_id, s.slice, s.run, n.n_us, n.n_click FROM s JOIN n ON n.client_id = s.client_id AND n.slice = s.slice AND n.run = s.run AND n.us = s.us),
x AS (SELECT r.*, s.click_id AS session_id FROM r ASOF JOIN s ON r.client_id = s.client_id AND r.slice = s.slice AND r.run = s.run AND r.us >= s.us),
g AS (SELECT client_id, slice, session_id, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents, max(us) AS end_us, arg_max(final, (us, click_id)) AS last_final,
             min(us) AS first_us, arg_min(click_id, (us, click_id)) AS first_click, string_agg(click_id::VARCHAR, ',' ORDER BY us, click_id) AS path
      FROM x GROUP BY client_id, slice, session_id),
k AS (SELECT y.client_id, y.slice, y.click_id AS session_id, count(*) AS n_late
      FROM (SELECT client_id, slice, us FROM c WHERE kind = 1 AND late) c
      ASOF JOIN (SELECT client_id, slice, us, arg_max(click_id, run) AS click_id FROM s GROUP BY client_id, slice, us) y ON c.client_id = y.client_id AND c.slice = y.slice AND c.us >= y.us
      GROUP BY ALL),
o AS (SELECT DISTINCT client_id, slice FROM c WHERE open),
z AS (SELECT s.client_id, s.slice, s.click_id AS session_id, s.us AS start_us, f.click_id IS NULL AS entered,
             lead(coalesce(f.why, 'length')) OVER (PARTITION BY s.client_id, s.slice ORDER BY s.run, s.us) AS next_why
      FROM s LEFT JOIN r f ON f.client_id = s.client_id AND f.slice = s.slice AND f.click_id = s.click_id)
SELECT z.client_id, z.slice, z.session_id, z.start_us, g.end_us, coalesce(g.n_clicks, 0) AS n_clicks, coalesce(k.n_late, 0) AS n_late, coalesce(g.value_cents, 0) AS value_cents, z.next_why, g.last_final,
       g.first_us, g.first_click, g.path, NOT z.entered AND (z.next_why IS NOT NULL OR o.client_id IS NULL) AS whole
FROM z LEFT JOIN g ON g.client_id = z.client_id AND g.slice = z.slice AND g.session_id = z.session_id
       LEFT JOIN k ON k.client_id = z.client_id AND k.slice = z.slice AND k.session_id = z.session_id
       LEFT JOIN o ON o.client_id = z.client_id AND o.slice = z.slice
"""
_PART = (
    "client_id long, slice long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, next_why string, last_final boolean, first_us long, first_click long, path string, whole boolean"
)
_PART_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _PART.split(", "))])


def _cut(table: pa.Table) -> tuple[int, bool]:
    """Where to part a chunk: before its last client and slice; if it is all one, before its last microsecond (then true); at 0 if that is one too."""
    client, part, us = (table.column(c).to_numpy() for c in ("client_id", "slice", "us"))
    edge = np.flatnonzero((np.diff(client) != 0) | (np.diff(part) != 0))
    if len(edge):
        return int(edge[-1]) + 1, False
    clicks = table.column("kind").to_numpy() == 1
    edge = np.flatnonzero((np.diff(us) != 0) & clicks[:-1])
    return (int(edge[-1]) + 1, True) if len(edge) else (0, False)


def _parts(rows: DataFrame, gap: int, length: int, chunk: int) -> DataFrame:
    """Sessions, and parts of those that lie in several slices or chunks."""
    sql = _SQL.format(gap=gap, length=length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": "false"})

        def sessions(table: pa.Table) -> pa.Table:
            db.register("c", table)
            got = db.sql(sql).to_arrow_table().cast(_PART_ARROW)
            db.unregister("c")
            return got

        def carried(head: pa.Table, got: pa.Table) -> list[pa.RecordBatch]:
            """What the rest of the slice begins with, as a row of ``kind`` 0: the last session's start and the last timely click."""
            if not got.num_rows:
                return []  # none but late clicks so far, before any session
            start = max(zip(got.column("start_us").to_pylist(), got.column("session_id").to_pylist(), strict=True))
            timely = head.filter(pa.compute.and_(pa.compute.equal(head.column("kind"), 1), pa.compute.invert(head.column("late"))))
            if timely.num_rows:
                last, final = timely.column("us")[-1].as_py(), timely.column("final")[-1].as_py()
            else:
                last, final = head.column("cents")[0].as_py(), head.column("final")[0].as_py()
            row = {"client_id": head.column("client_id")[0].as_py(), "slice": head.column("slice")[0].as_py(), "kind": 0, "us": start[0], "click_id": start[1], "late": False, "final": final, "cents": last, "open": head.column("open")[0].as_py()}
            return [pa.RecordBatch.from_pylist([row], schema=head.schema)]

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < chunk:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at, within = _cut(table)
            if not at:
                continue
            head, tail = table.slice(0, at), table.slice(at)
            if within:  # the rest of the slice comes after it
                head = head.set_column(head.schema.get_field_index("open"), head.schema.field("open"), pa.array([True] * at))
            got = sessions(head)
            yield from got.to_batches()
            held = (carried(head, got) if within else []) + tail.to_batches()
            n = sum(b.num_rows for b in held)
        if held:
            yield from sessions(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, _PART)


def sessionise(
    clicks: DataFrame, final: Column, value: Column, gap_minutes: int = 10, length_minutes: int = 40, late_minutes: int = 360,
    id_col: str = "click_id", client_col: str = "client_id", ts_col: str = "ts", arrived_col: str = "arrived_at",
    groups: int = GROUPS, slice_rows: int = SLICE_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """Sessions of ``clicks``: ``client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path``.

    ``final`` says which clicks end their session, ``value`` what each adds to
    ``value_cents`` (nulls: not, 0).  A client's clicks go on with the session, in the
    order of time and id, unless the one before was final (``end``), lies ``gap_minutes``
    or more back (``gap``), or the session began more than ``length_minutes`` ago
    (``length``); ``closed_by`` is the first of these that holds, ``end`` or ``none`` for
    a client's last.  Clicks that arrive more than ``late_minutes`` after their time are
    late: each counts in ``n_late`` of the client's last session that began before or with
    it; those before a client's first session count nowhere.  ``path`` has the ids of the
    session's clicks, comma-joined.

    Rows without a client, a time or an id are left out; of rows that repeat an id one
    counts, with the least client, time and other values.  A click without an arrival
    is timely.  Only the named columns and those of the two expressions are read,
    so that others may have any name.  An empty table has no sessions.

    A session's path needs its clicks in one task; it has those of ``length_minutes``.
    A slice's row holds one start for each way in which its first ``length_minutes`` can
    be cut, at most as many as these have clicks and mostly a few.
    """
    gap, length = gap_minutes * MINUTE, length_minutes * MINUTE
    kinds = dict(clicks.dtypes)
    with scratch(clicks.sparkSession):
        us, came = (microseconds(F.col(c), kinds[c]) for c in (ts_col, arrived_col))
        late = F.coalesce(came - us > late_minutes * MINUTE, F.lit(False))
        named = clicks.select(
            F.col(id_col).cast("long").alias("click_id"), F.col(client_col).cast("long").alias("client_id"), us.alias("us"), late.alias("late"), F.coalesce(final, F.lit(False)).alias("final"), F.coalesce(value.cast("long"), F.lit(0)).alias("cents")
        ).where("click_id is not null and client_id is not null and us is not null")
        group = F.pmod(F.xxhash64("client_id"), F.lit(groups))
        # at most a quarter of the groups can be over four times the mean
        most = max(slice_rows, 4 * named.count() // groups)
        tally = named.groupBy(group.alias("__group")).agg(F.count("*").alias("__n"), F.min("us").alias("__low"), F.max("us").alias("__high")).where(F.col("__n") > most)
        width = F.greatest(F.lit(1.0), (F.col("__high") - F.col("__low")) / F.least(F.lit(MOST_SLICES - 1), F.ceil(F.col("__n") / most)))
        busy = tally.select("__group", "__low", width.alias("__width"))
        one = named.groupBy("click_id").agg(F.min(F.struct("client_id", "us", "late", "final", "cents")).alias("__r")).select("click_id", "__r.*")
        dealt = one.withColumn("__group", group).join(F.broadcast(busy), "__group", "left")
        rows = materialize(dealt.select("client_id", F.coalesce(F.floor((F.col("us") - F.col("__low")) / F.col("__width")), F.lit(0)).alias("slice"), F.lit(1).alias("kind"), "us", "click_id", "late", "final", "cents", F.col("__low").isNotNull().alias("open")), "clicks")
        entries = _entries(_slices(rows.where("open"), gap, length), gap).withColumn("open", F.lit(True))
        all_rows = rows.unionByName(entries).withColumn("__group", group)
        order = all_rows.repartition("__group", "slice").drop("__group").sortWithinPartitions("client_id", "slice", "kind", "us", "click_id")
        parts = materialize(_parts(order, gap, length, chunk), "session-parts", keep=True)
    last = F.max(F.when(F.col("n_clicks") > 0, F.struct("end_us", "first_us", "first_click", "last_final")))["last_final"]
    pieces = F.array_sort(F.collect_list(F.when(F.col("n_clicks") > 0, F.struct("first_us", "first_click", "path"))))
    merged = parts.where(~F.col("whole")).groupBy("client_id", "session_id", "start_us").agg(
        F.max("end_us").alias("end_us"), F.sum("n_clicks").alias("n_clicks"), F.sum("n_late").alias("n_late"), F.sum("value_cents").alias("value_cents"),
        F.max("next_why").alias("next_why"), last.alias("last_final"), F.array_join(F.transform(pieces, lambda p: p["path"]), ",").alias("path"),
    )
    closed = F.coalesce("next_why", F.when(F.col("last_final"), F.lit("end")).otherwise(F.lit("none")))
    names = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", closed.alias("closed_by"), "path"]
    return parts.where("whole").select(*names).unionByName(merged.select(*names))
