"""Conversation structure repair: the cheapest edits after which a conversation alternates as it should.

A repaired conversation is empty, or an optional system row and then pairs of a user's
and an assistant's row.  Four states tell how far a row has got in that.  Seen from the
end, each turn has cost layers: layer k holds, as four bits, the states from which all
that follows can be made right at a cost of k.  A turn's layers come from those of the
next by shifts and masks, one for each edit, on all layers and states at once.  The first
layer of the first turn with the starting state is the cost; following the bits from
there, always by the first edit in the order of the alphabet, gives the least audit.

States differ by some inserted rows at most, so that 16 layers from a turn's first are
enough, and a conversation takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs: another role, a row taken out, a row put in, a cut-off row left in.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: 0 at the start, 1 after the system row, 2 after a user's row, 3 after an assistant's.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
_ROLE = {"u": "user", "a": "assistant"}
LAYERS = 16
_ALL, _ONES = (1 << 4 * LAYERS) - 1, int("1" * LAYERS, 16)
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def _before(layers: int, initial: str) -> int:
    """The states from which a row of this initial leads into the given ones, in every layer."""
    if initial == "u":
        return (layers >> 2 & _ONES) * 0b1011
    if initial == "a":
        return (layers >> 3 & _ONES) << 2
    return layers >> 1 & _ONES if initial == "s" else 0


def _inserted(layers: int) -> int:
    """With what inserted rows reach besides; after two there is no state left to gain."""
    for _ in range(2):
        layers |= (_before(layers, "u") | _before(layers, "a")) << 4 * INSERT
    return layers


def _layered(rows: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """For each row, and behind the last: the cost of its first layer, and the layers.  ``rows`` have role and fault."""
    out = [(0, _inserted(0b1001) & _ALL)]
    for role, fault in reversed(rows):
        base, after = out[-1]
        layers = after << 4 * DELETE
        if fault not in ("blank", "duplicate"):
            more = CUT_OFF if fault == "truncated" else 0
            layers |= _before(after, role[:1]) << 4 * more
            layers |= (_before(after, "u") | _before(after, "a")) << 4 * (more + REROLE)
        layers = _inserted(layers)
        empty = ((layers & -layers).bit_length() - 1) // 4
        out.append((base + empty, layers >> 4 * empty & _ALL))
    return out[::-1]


def cheapest_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """The cost, the edits' initials and the repaired rows of ``role, text, fault`` in order."""
    layers = _layered([(role, fault) for role, _, fault in rows])

    def within(i: int, state: int | None, cost: int) -> bool:
        base, bits = layers[i]
        return state is not None and 0 <= cost - base < LAYERS and bool(bits >> 4 * (cost - base) + state & 1)

    total = next(layers[0][0] + k for k in range(LAYERS) if layers[0][1] >> 4 * k & 1)
    i, state, cost, audit, repaired = 0, 0, total, [], []
    while i < len(rows) or cost:
        due = _NEXT[state, _DUE[state]]
        if i < len(rows):
            role, text, fault = rows[i]
            more = CUT_OFF if fault == "truncated" else 0
            kept = _NEXT.get((state, role[:1])) if fault not in ("blank", "duplicate") else None
        if i < len(rows) and within(i + 1, state, cost - DELETE):
            audit.append("D")
            i, cost = i + 1, cost - DELETE
        elif within(i, due, cost - INSERT):
            audit.append("I")
            repaired.append((_ROLE[_DUE[state]], ""))
            state, cost = due, cost - INSERT
        elif within(i + 1, kept, cost - more):
            audit.append("K")
            repaired.append((role, text))
            i, state, cost = i + 1, kept, cost - more
        else:
            audit.append("R")
            repaired.append((_ROLE[_DUE[state]], text))
            i, state, cost = i + 1, due, cost - more - REROLE
    return total, "".join(audit), repaired


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row of ``role, text``: ``blank``, ``duplicate``, ``truncated`` or none."""
    seen, out = set(), []
    for row in rows:
        bare = row[1].strip(WHITE)
        out.append("blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add(row)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows damaged by a checksum of conversation and turn, as a test of repair.

    Of twenty rows about one each is dropped (marked, so that its conversation is still
    known), emptied, freed of its full stops, repeated, or made a user's.  Nulls count as
    one space in every column; ``conv_id`` and ``turn`` keep theirs.  Other columns go.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("__how"))
    how = F.col("__how")
    rows = rows.withColumn("text", F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn("role", F.when(how == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("__copy", F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", "role", "text", (how == 0).alias("dropped"))


_REPAIR = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
])


def _repair(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> dict:
    found = faults([r[1:] for r in rows])
    cost, audit, repaired = cheapest_repair([(role, text, fault) for (_, role, text), fault in zip(rows, found, strict=True)])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    return {
        "conv_id": conv_id, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in repaired],
    }


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    ``rows`` have ``conv_id, turn, role, text`` and ``dropped`` (rows that are not there
    and only name their conversation).  They are taken by turn, nulls first; rows of one
    turn by role and text.  Rows that are equal follow one another and the later are
    duplicates.  A null conversation is one as any other; a null role or text is one space,
    an empty role is none that could be kept.  ``gaps`` counts missing turns between the
    first and the last, ``illegal`` neighbours that may not follow each other.  Blank and
    duplicate rows must go; a row that ends without a full stop costs 5 if it stays.
    ``repaired`` has the roles and whole texts afterwards.  No rows, no conversations.

    A conversation is dealt with in one task, in a time that grows with its length: audit
    and repaired text are one row of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, done, size = (), [], [], 0
        for batch in batches:
            for conv, turn, role, text, dropped in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")], strict=True):
                if (conv,) != of:
                    if of:
                        done.append(_repair(of[0], held))
                    of, held = (conv,), []
                    if size > 1 << 22 or len(done) >= 1000:
                        yield pa.RecordBatch.from_pylist(done, schema=_REPAIR)
                        done, size = [], 0
                if not dropped:
                    held.append((turn, role, text))
                    size += len(text)
        if of:
            done.append(_repair(of[0], held))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_REPAIR)

    space = F.lit(" ")
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, space).alias(c) for c in ("role", "text")], F.coalesce("dropped", F.lit(False)).alias("dropped"))
    order = named.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return order.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>")
