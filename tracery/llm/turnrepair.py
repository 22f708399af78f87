"""Repair of conversations by the cheapest edits that give ``(system? (user assistant)+)?``.

The edits of a conversation are ways through a graph: a node is a gap between turns and
what the turns kept so far ended with, an arc keeps, re-roles or deletes the next turn
or inserts an empty one.  Minimum costs from the start and to the end tell which arcs
lie on a cheapest way (the tight ones); from the start, the least letter among the
tight arcs of all nodes reached so far is taken, step by step.

A long conversation is cut: turns are dealt by their order over all conversations, a
part of a conversation of at most ``block`` different turns is a block.  Blocks are summed up
as costs from state to state, the sums of a conversation are folded from both ends, and
each block then finds its own tight arcs.  Only the last pass reads a conversation from
end to end, turn by turn, since its hash and audit are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = 1 << 14
SPACE = " \t\n\x0b\x0c\r"
#: Edits in the order of ties, and what they cost; an undeleted truncated turn costs ``TRUNCATED`` more.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS, COSTS, TRUNCATED = "DIKR", (2, 5, 0, 1), 5
#: States: nothing kept so far, system, user, assistant; what an inserted or re-roled turn makes of each.
FILLED = (2, 2, 3, 2)
ROLES = ("", "system", "user", "assistant")
FINE, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 60


def _kept(state: int, initial: str) -> int:
    """The state after a turn with this initial is kept, -1 if it cannot be."""
    if initial == "s":
        return 1 if state == 0 else -1
    return {"u": 2, "a": 3}.get(initial, -1) if {"u": state != 2, "a": state == 2}.get(initial) else -1


def _arcs(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(letter, from, to, cost) of a turn's arcs."""
    out = [(DELETE, q, q, COSTS[DELETE]) for q in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    out += [(KEEP, q, _kept(q, initial), COSTS[KEEP] + more) for q in range(4) if _kept(q, initial) >= 0]
    return out + [(REROLE, q, FILLED[q], COSTS[REROLE] + more) for q in range(4)]


def _matrix(arcs: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = np.full((4, 4), NEVER)
    for _, a, b, cost in arcs:
        out[a, b] = min(out[a, b], cost)
    return out


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of one step after the other."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


_STAY = np.where(np.eye(4, dtype=bool), 0, NEVER)
_ONE = np.minimum(_STAY, _matrix([(INSERT, q, FILLED[q], COSTS[INSERT]) for q in range(4)]))
#: Costs of insertions in one gap; a third would come back to a state.
GAP = _then(_ONE, _ONE)
END = GAP[:, [0, 3]].min(1)
_KINDS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in (FINE, BLANK, CUT)}
_STEPS = {key: _then(GAP, _matrix(arcs)) for key, arcs in _KINDS.items()}


def _kind(initial: str, fault: int) -> tuple[str, int]:
    return initial if initial in ("s", "u", "a") else "", BLANK if fault == DUPLICATE else fault


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ordered turns with the number of their block; behind each block a row with its costs from state to state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number, conv, count, cost, part = None, 0, None, 0, None, 0

        def closing() -> dict:
            return {"conv_id": conv, "block": part << 32 | number, "at": count, "cost": cost.reshape(-1).tolist()}

        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                part = row.pop("part")
                if cost is not None and (row["conv_id"] != conv or count == size):
                    out.append(closing())
                    number, cost = number + 1, None
                if cost is None:
                    conv, count, cost = row["conv_id"], 0, _STAY
                out.append(row | {"block": part << 32 | number, "at": count, "cost": None})
                cost = np.minimum(_then(cost, _STEPS[_kind(row["role"][:1], row["fault"])]) + COSTS[DELETE] * (row["n"] - 1), NEVER)
                count += 1
            yield _batch(out, schema)
        if cost is not None:
            yield _batch([closing()], schema)

    return run


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    kept = [schema.field(c) for c in schema.names if c != "part"]
    return pa.RecordBatch.from_pylist(rows, pa.schema([*kept, ("block", pa.int64()), ("at", pa.int64()), ("cost", pa.list_(pa.int64()))]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a conversation the least costs from its start to the block and from the block to its end."""
    names, kind = ["conv_id", "block", "before", "after"], None

    def folded(conv, blocks: list[tuple[int, list[int]]]) -> list[tuple]:
        matrices = [np.array(c).reshape(4, 4) for _, c in blocks]
        before, after = [np.where(np.arange(4) == 0, 0, NEVER)], [END]
        for m in matrices[:-1]:
            before.append(np.minimum((before[-1][:, None] + m).min(0), NEVER))
        for m in matrices[:0:-1]:
            after.append(np.minimum((m + after[-1][None]).min(1), NEVER))
        return [(conv, b[0], x.tolist(), y.tolist()) for b, x, y in zip(blocks, before, after[::-1], strict=True)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    conv, blocks = None, []
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for c, block, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if blocks and c != conv:
                out += folded(conv, blocks)
                blocks = []
            conv = c
            blocks.append((block, cost))
        yield table(out)
    if blocks:
        yield table(folded(conv, blocks))


def _tight(rows: list[dict], before: np.ndarray, after: np.ndarray) -> list[int]:
    """For each turn of a block its tight arcs: bit 4 * state + letter."""
    kinds = [_kind(r["role"][:1], r["fault"]) for r in rows]
    copies = [COSTS[DELETE] * (r["n"] - 1) for r in rows]
    ahead = [after]
    for kind, more in zip(kinds[::-1], copies[::-1], strict=True):
        ahead.append((_STEPS[kind] + ahead[-1][None]).min(1) + more)
    ahead.reverse()
    here = (before[:, None] + GAP).min(0)
    total = int((here + ahead[0]).min())
    out = []
    for i, (kind, more) in enumerate(zip(kinds, copies, strict=True)):
        bits, nxt = 0, np.full(4, NEVER)
        for q in range(4):
            if here[q] + COSTS[INSERT] + ahead[i][FILLED[q]] == total:
                bits |= 1 << (4 * q + INSERT)
        for letter, a, b, cost in _KINDS[kind]:
            if here[a] + cost + more + ahead[i + 1][b] == total:
                bits |= 1 << (4 * a + letter)
            nxt[b] = min(nxt[b], here[a] + cost + more)
        here = (nxt[:, None] + GAP).min(0)
        out.append(bits)
    return out


def _arcs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of each block behind a row with its ends; turns with their tight arcs come out."""
    block, ends, rows, schema = None, None, [], None

    def table(out: list[dict]) -> pa.RecordBatch:
        fields = [schema.field(c) for c in ("conv_id", "turn", "role", "hash", "fault", "n")]
        return pa.RecordBatch.from_pylist(out, pa.schema([*fields, ("arcs", pa.int32())]))

    def closed() -> list[dict]:
        return [r | {"arcs": bits} for r, bits in zip(rows, _tight(rows, *ends), strict=True)]

    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            if row["before"] is not None:
                if rows:
                    out += closed()
                block, ends, rows = row["block"], (np.array(row["before"]), np.array(row["after"])), []
            else:
                assert row["block"] == block
                rows.append({c: row[c] for c in ("conv_id", "turn", "role", "hash", "fault", "n")})
        yield table(out)
    if rows:
        yield table(closed())


class _Walk:
    """The way through one conversation, and what is counted on it."""

    def __init__(self) -> None:
        self.states, self.audit, self.cost, self.last = {0}, bytearray(), 0, None
        self.faults, self.illegal, self.turns, self.first, self.latest = [0, 0, 0, 0], 0, 0, None, None

    def _edit(self, letter: int) -> None:
        self.audit += LETTERS[letter].encode()
        self.cost += COSTS[letter]

    def turn(self, row: dict) -> tuple[list[str], str | None]:
        """(roles inserted before, role of the turn itself or None) by the least tight letters."""
        initial, fault, n = row["role"][:1], row["fault"], row["n"]
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += n - 1
        self.illegal += (self.last is not None and (self.last, initial) not in {("s", "u"), ("u", "a"), ("a", "u")}) + n - 1
        self.last = initial
        if row["turn"] is not None and row["turn"] != self.latest:
            self.first, self.latest, self.turns = row["turn"] if self.first is None else self.first, row["turn"], self.turns + 1
        inserted, role = [], None
        while True:
            letter = next((x for x in range(4) if any(row["arcs"] >> (4 * q + x) & 1 for q in self.states)), None)
            if letter is None:
                raise RuntimeError("no cheapest edit leads on from here")
            on = {q for q in self.states if row["arcs"] >> (4 * q + letter) & 1}
            self._edit(letter)
            if letter == INSERT:
                self.states = {FILLED[q] for q in on}
                inserted.append(ROLES[min(self.states)])
                continue
            if letter == KEEP:
                self.states, role = {_kept(q, initial) for q in on}, row["role"]
            elif letter == REROLE:
                self.states = {FILLED[q] for q in on}
                role = ROLES[min(self.states)]
            else:
                self.states = on
            if letter != DELETE and fault == CUT:
                self.cost += TRUNCATED
            break
        self.audit += LETTERS[DELETE].encode() * (n - 1)
        self.cost += COSTS[DELETE] * (n - 1)
        return inserted, role

    def end(self) -> list[str]:
        """Roles inserted after the last turn."""
        out = []
        while not self.states & {0, 3}:
            self._edit(INSERT)
            self.states = {FILLED[q] for q in self.states}
            out.append(ROLES[min(self.states)])
        return out

    @property
    def gaps(self) -> int:
        return self.latest - self.first + 1 - self.turns if self.turns else 0


DIGEST = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
TURN = [("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _reader(turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Conversations turn by turn: their repaired turns, or one row each with counts, audit and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, digest, place, wanted, kind = None, None, None, 0, None, None
        out: list[list] = []

        def say(role: str, text: str, turn: int | None) -> None:
            nonlocal place
            if turns:
                out.append([conv, place, turn, role, text])
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
            place += 1

        def close() -> None:
            for role in walk.end():
                say(role, "", None)
            if not turns:
                out.append([conv, walk.gaps, *walk.faults[1:], walk.illegal, walk.cost, walk.audit.decode(), digest.hexdigest()])

        def table() -> pa.RecordBatch:
            fields = [("conv_id", kind), *(TURN if turns else DIGEST)]
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
            out.clear()
            return done

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if walk is None or row["conv_id"] != conv:
                    if walk is not None:
                        close()
                    conv, walk, digest, place, wanted = row["conv_id"], _Walk(), hashlib.sha256(), 0, None
                if row["what"] == 1:
                    inserted, role = walk.turn(row)
                    for x in inserted:
                        say(x, "", None)
                    wanted = None if role is None else (role, row["turn"])
                elif row["what"] == 2 and wanted is not None:
                    say(wanted[0], row["text"], wanted[1])
                    wanted = None
            yield table()
        if walk is not None:
            close()
            yield table()

    return run


def _order(*last: str) -> list:
    return ["conv_id", F.asc_nulls_first("turn"), "role", "hash", *last]


def _solid(text: Column) -> Column:
    """The text without white space at its end: empty if it is blank."""
    return F.rtrim(text, F.lit(SPACE))


def _edits(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, turn, role, hash, fault, n, arcs): each different turn of a conversation, how often it comes, its first fault and its tight arcs."""
    turns = rows.groupBy("conv_id", "turn", "role", "hash").agg(F.sum("n").alias("n"), F.max("fault").alias("fault"))
    turns = written(turns, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = turns.groupBy("conv_id", "role", "hash").agg(F.min(when).alias("first")).withColumnsRenamed({"conv_id": "c", "role": "r", "hash": "h"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    late = turns.join(first, same).withColumn("fault", F.when((F.col("fault") != BLANK) & ~F.col("first").eqNullSafe(when), F.lit(DUPLICATE)).otherwise(F.col("fault")))
    late = written(late.select("conv_id", "turn", "role", "hash", "fault", "n"), "faults")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = late.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).withColumn("part", F.spark_partition_id().cast("long"))
    conv = late.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, turn bigint, role string, hash string, fault int, n bigint, block bigint, at bigint, cost array<bigint>"
    cut = written(ranged.mapInArrow(_blocks(block), schema), "blocks")
    sums = cut.where("cost is not null").select("conv_id", "block", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    ends = sums.mapInArrow(_ends, f"conv_id {conv}, block bigint, before array<bigint>, after array<bigint>")
    both = cut.where("cost is null").drop("cost").unionByName(ends.withColumn("at", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    found = both.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_arcs_of_blocks, f"conv_id {conv}, turn bigint, role string, hash string, fault int, n bigint, arcs int")
    return written(found, "arcs")


def _read(convs: DataFrame, id_col: str, turns: bool, ids: DataFrame | None, block: int) -> DataFrame:
    rows = convs.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    bare = _solid(F.col("text"))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    edits = _edits(rows.select("conv_id", "turn", "role", "hash", F.lit(1).cast("long").alias("n"), fault.cast("int").alias("fault")), block)
    every = (convs if ids is None else ids).select(F.col(id_col).alias("conv_id")).distinct().withColumn("what", F.lit(0))
    stream = edits.withColumn("what", F.lit(1)).unionByName(rows.withColumn("what", F.lit(2)), allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    ordered = stream.repartition("conv_id").sortWithinPartitions(*_order("what"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    result = "place bigint, turn bigint, role string, text string" if turns else "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return ordered.mapInArrow(_reader(turns), f"conv_id {conv}, {result}").withColumnRenamed("conv_id", id_col)


def repaired_turns(convs: DataFrame, id_col: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """Return (conv_id, place, turn, role, text): the turns of every repaired conversation in order, inserted ones without a turn number and with an empty text."""
    return _read(convs, id_col, True, None, block)


def repair_audit(convs: DataFrame, id_col: str = "conv_id", ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Return (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation.

    Turns are taken by ``turn`` (null first), those of one turn by role, then by the
    SHA-256 of their text.  A turn's first fault counts: blank, duplicate (its role and
    text came before), truncated (its last character that is no white space is not one
    of ``.!?``).  ``illegal`` counts neighbours whose roles may not follow each other,
    ``gaps`` the turn numbers that are missing between the least and the greatest.
    ``audit`` has a letter for each edit: K keep, R re-role, D delete, I insert; the
    cheapest, and of these the first in the order of letters.

    A null role or text is one space; null turns come first and are in no gap; a null id
    is a conversation.  Repeated rows are duplicates of each other.  ``ids`` names
    conversations that may have no turns; those have zeros, an empty audit and the hash
    of an empty text.  Other columns are ignored; an empty table gives an empty table.
    """
    return _read(convs, id_col, False, ids, block)


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``convs`` with known damage by a checksum of conversation and turn: turns dropped, emptied, without end marks, repeated, or given to the user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = convs.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
