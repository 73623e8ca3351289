"""Repair of conversation structure at least cost, by the auction algorithm for shortest paths.

A conversation's rows are the layers of a lattice with four states: nothing yet, after the system row,
after a user row, after an assistant row. Arcs keep, rerole or delete the row, or insert an empty one;
their whole costs and the states say what a legal conversation is. An auction finds the cheapest way:
a path grows from its start along the cheapest arc, and where no arc holds the price of its last node,
the price is raised and the path shortened. At the end no arc is cheaper than the difference of its
prices, so every cheapest way consists of tight arcs; they are followed in the order of their letters,
and nodes that the auction has not settled are settled by another one started there.

Rows are sorted by range and cut into blocks of ``BLOCK`` rows, whatever their conversation's length.
Whole conversations inside a block are solved at once. Others are chained: the cost from every state
at a block's start to every state at its end (16 numbers) is found block by block, added up backwards,
and blocks then learn their first state forwards. Within a block, pieces of ``PIECE`` rows are chained
alike. Only the hash of a repaired conversation runs over it in one go, row after row.

Defined results: null ids, turns, roles and texts are handled; a null role or text is one space; null
turns come first; rows of a turn are ordered by role, then by the SHA-256 of the text; equal rows are
counted once and written as often as they occur. Roles are compared by their first character, an empty
role has none. Conversations that lose all rows, and an empty table, give the values of no rows. Only
the four named columns are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

BLOCK, PIECE = 8192, 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the row a state asks for
ENDING, END_COST = ("", "II", "I", ""), (0, 2 * INSERT, INSERT, 0)  # what completes a conversation
INITIALS = "sua"
FREE, GONE, CUT = range(3)  # a row's demands: none, must be deleted, costs more if it stays
NEVER = 1 << 60
SPACE = r"\x20\x09-\x0D"


# ---- the lattice of a piece of rows -------------------------------------------------------------


def arcs_of(codes: str) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, target) of every node, by letter; node 4 i + state stands before row i."""
    arcs: list[list[tuple[str, int, int]]] = []
    for i, code in enumerate(codes):
        kind, demand = divmod(ord(code) - 65, 3)
        for state in range(4):
            out = [("D", DELETE, 4 * (i + 1) + state), ("I", INSERT, 4 * i + NEXT[state])]
            if demand != GONE:
                extra = TRUNCATED if demand == CUT else 0
                if (kind == 0 and state == START) or (kind and kind < 3 and kind + 1 == NEXT[state]):
                    out.append(("K", extra, 4 * (i + 1) + kind + 1))
                out.append(("R", REROLE + extra, 4 * (i + 1) + NEXT[state]))
            arcs.append(out)
    return arcs


class Auction:
    """Prices of a piece's nodes towards its end, where leaving from state s costs ends[s]."""

    def __init__(self, arcs: list[list[tuple[str, int, int]]], ends: list[int]):
        layers = len(arcs) // 4
        alive = [e < NEVER for e in ends]
        self.arcs: list = [()] * len(arcs) + [()] * 4
        self.price = [NEVER] * len(arcs) + list(ends)
        self.settled = [False] * len(arcs) + alive
        floor = min(ends)  # prices start as a lower bound that no arc undercuts: every row's cheapest arc
        for i in range(layers - 1, -1, -1):
            here = arcs[4 * i : 4 * i + 4]
            rows_on = [[a for a in out if a[0] != "I" and alive[a[2] % 4]] for out in here]
            now = [bool(out) for out in rows_on]
            for _ in range(2):  # an insertion may lead to a state that reaches the end
                now = [now[s] or now[NEXT[s]] for s in range(4)]
            floor += min((a[1] for out in rows_on for a in out), default=0)
            for s in range(4):
                if now[s]:
                    self.price[4 * i + s] = floor
                    self.arcs[4 * i + s] = [a for a in here[s] if (now if a[0] == "I" else alive)[a[2] % 4]]
            alive = now

    def settle(self, origin: int) -> int:
        """Cost from a node to the end: extend the path, or raise the price of its last node and contract it."""
        arcs, price, settled = self.arcs, self.price, self.settled
        if not settled[origin] and not arcs[origin]:
            return NEVER
        path = [origin]
        while not settled[path[-1]]:
            last = path[-1]
            best, target = min((cost + price[t], t) for _, cost, t in arcs[last])
            if price[last] < best:
                price[last] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)
        for node in path:
            settled[node] = True
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """Letters of the least cheapest way and the state it leaves from: tight arcs by letter."""
        self.settle(origin)
        letters, node = [], origin
        while self.arcs[node]:
            for letter, cost, target in self.arcs[node]:
                if self.price[node] == cost + self.price[target] and self.price[node] == cost + self.settle(target):
                    break
            letters.append(letter)
            node = target
        return "".join(letters), node % 4


def pieces(codes: str, piece: int) -> list[str]:
    return [codes[a : a + piece] for a in range(0, len(codes), piece)]


def costs_through(codes: str, piece: int = PIECE) -> list[list[int]]:
    """Least cost from every state at the start to every state at the end of some rows."""
    total = [[0 if a == b else NEVER for b in range(4)] for a in range(4)]
    for part in pieces(codes, piece):
        arcs = arcs_of(part)
        auctions = [Auction(arcs, [0 if a == b else NEVER for a in range(4)]) for b in range(4)]
        through = [[auctions[b].settle(a) for b in range(4)] for a in range(4)]
        total = [[min(NEVER, *(total[a][k] + through[k][b] for k in range(4))) for b in range(4)] for a in range(4)]
    return total


def best_way(codes: str, first: int, ends: list[int], piece: int = PIECE) -> tuple[str, int, int]:
    """Audit, cost within these rows and last state of the least cheapest way from a state."""
    parts, after = pieces(codes, piece), [list(ends)]
    for part in parts[:0:-1]:
        through = costs_through(part)
        after.append([min(min(NEVER, through[a][b] + after[-1][b]) for b in range(4)) for a in range(4)])
    audit, cost, state = "", 0, first
    for part in parts:
        auction = Auction(arcs_of(part), goal := after.pop())
        letters, left = auction.trace(state)
        audit, cost, state = audit + letters, cost + auction.settle(state) - goal[left], left
    return audit, cost, state


def illegal_pairs(codes: str) -> int:
    """Adjacent rows whose initials are none of su, ua, au."""
    kinds = [(ord(c) - 65) // 3 for c in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:]))


# ---- tables ------------------------------------------------------------------------------------


def damaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as the contract of the query damages them, by crc32 of ``conv:turn`` modulo 20; 3 leaves the row twice (copies)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    return turns.filter(lot != 0).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(space(role)).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias("text"),
        F.when(lot == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    right = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(F.col(f"_r_{k}"))
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: key, copies, blank, truncated, first (no equal role and text in an earlier turn)."""
    small = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "copies",
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"),
    )
    distinct = small.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    earliest = distinct.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place"))
    joined = _same(distinct, earliest, ["conv_id", "role", "digest"])
    return joined.withColumn("first", place.eqNullSafe(F.col("place"))).drop("place")


def _code(kind: Column, demand: Column) -> Column:
    return F.chr(F.lit(65) + kind * 3 + demand)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of consecutive rows of a conversation; ``whole`` if they are all its rows."""
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    demand = F.when(F.col("blank") | ~F.col("first"), GONE).when(F.col("cut"), CUT).otherwise(FREE)
    coded = rows.select("conv_id", "turn", "role", "digest", _code(initial, demand).alias("code"), _code(initial, F.lit(GONE)).alias("again"), "copies")
    keys = ["conv_id", "turn", "role", "digest"]
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema.fields}
    schema = f"block long, conv_id {kinds['conv_id']}, whole boolean, codes string, turns array<{kinds['turn']}>, roles array<string>, digests array<string>"
    types = _arrow(T.StructType(coded.select(*keys).schema.fields))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40

        def emit(rows: list, whole: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            columns = [
                pa.array([number], pa.int64()), pa.array([rows[0][0]], types[0]), pa.array([whole]), pa.array(["".join(r[4] for r in rows)]),
                pa.array([[r[1] for r in rows]], pa.list_(types[1])), pa.array([[r[2] for r in rows]]), pa.array([[r[3] for r in rows]]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "conv_id", "whole", "codes", "turns", "roles", "digests"])

        held: list = []
        inside = False  # the conversation's first row is known to be in this task, and in the rows held
        for batch in batches:
            for conv, turn, role, digest, code, again, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != conv:
                    yield emit(held, inside)
                    held, inside = [], True
                for copy in range(copies):
                    if len(held) == size:
                        yield emit(held, False)
                        held, inside = [], False
                    held.append((conv, turn, role, digest, again if copy else code))
        if held:
            yield emit(held, False)

    ordered = coded.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(cut_up, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _rows(df: DataFrame, apply, schema: str) -> DataFrame:
    """A function from the stream of rows (dicts) of a task to a stream of rows."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    types = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for a in range(0, batch.num_rows, 64) for row in batch.slice(a, 64).to_pylist())
        held: list[dict] = []
        for row in apply(stream):
            held.append(row)
            if len(held) == 256:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], t) for f, t in zip(fields.fields, types)], names=fields.fieldNames())

    return df.mapInArrow(run, schema)


def _chained(parts: DataFrame, kind: str, piece: int) -> DataFrame:
    """block, ends, first, broken: what blocks of conversations over several blocks must know of their neighbours."""

    def through(rows):
        for r in rows:
            ends = [(ord(c) - 65) // 3 for c in (r["codes"][0], r["codes"][-1])]
            yield {"block": r["block"], "conv_id": r["conv_id"], "through": costs_through(r["codes"], piece), "edge": ends}

    def backwards(rows):
        conv, ends, started = None, None, False
        for r in rows:
            if not started or r["conv_id"] != conv:
                conv, ends, started = r["conv_id"], list(END_COST), True
            yield {**r, "ends": ends}
            ends = [min(min(NEVER, r["through"][a][b] + ends[b]) for b in range(4)) for a in range(4)]

    def leads(rows):
        for r in rows:
            yield {**r, "leads": [best_way(r["codes"], a, r["ends"], piece)[2] if any(r["through"][a][b] + r["ends"][b] < NEVER for b in range(4)) else a for a in range(4)]}

    def forwards(rows):
        conv, state, last, started = None, START, None, False
        for r in rows:
            if not started or r["conv_id"] != conv:
                conv, state, last, started = r["conv_id"], START, None, True
            broken = last is not None and (last, r["edge"][0]) not in ((0, 1), (1, 2), (2, 1))
            yield {**r, "first": state, "broken": int(broken)}
            state, last = r["leads"][state], r["edge"][1]

    base = f"block long, conv_id {kind}, through array<array<long>>, edge array<long>"
    costs = stored(_rows(parts.select("block", "conv_id", "codes"), through, base))
    back = stored(_rows(costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")), backwards, base + ", ends array<long>"))
    led = _rows(back.join(parts.select("block", "codes"), "block"), leads, f"block long, conv_id {kind}, edge array<long>, ends array<long>, leads array<long>")
    ahead = led.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return stored(_rows(ahead, forwards, "block long, ends array<long>, first long, broken long"))


def _solved(blocks: DataFrame, piece: int) -> DataFrame:
    """conv_id, block, audit, cost, illegal and edits: the rows that stay, and what is inserted before rows."""
    kind, turn = blocks.schema["conv_id"].dataType.simpleString(), blocks.schema["turns"].dataType.elementType.simpleString()
    whole = blocks.filter("whole").withColumns({"ends": F.array(*map(F.lit, END_COST)).cast("array<long>"), "first": F.lit(START).cast("long"), "broken": F.lit(0).cast("long")})
    parts = blocks.filter("NOT whole")
    known = whole.unionByName(parts.join(_chained(parts, kind, piece), "block"))

    def solve(rows):
        for r in rows:
            audit, cost, state = best_way(r["codes"], r["first"], r["ends"], piece)
            edits, row, at = [], 0, r["first"]
            before = ""
            for letter in audit:
                if letter == "D":
                    if before:
                        edits.append((row, before, ""))
                    row, before = row + 1, ""
                    continue
                at = (ord(r["codes"][row]) - 65) // 3 + 1 if letter == "K" else NEXT[at]
                if letter == "I":
                    before += INITIALS[at - 1]
                else:
                    edits.append((row, before, r["roles"][row] if letter == "K" else "user" if at == USER else "assistant"))
                    row, before = row + 1, ""
            listed = [{"turn": r["turns"][i], "role": r["roles"][i], "digest": r["digests"][i], "before": b, "stays": s} for i, b, s in edits]
            yield {"conv_id": r["conv_id"], "block": r["block"], "audit": audit, "cost": cost, "state": state, "illegal": illegal_pairs(r["codes"]) + r["broken"], "edits": listed}

    schema = f"conv_id {kind}, block long, audit string, cost long, state long, illegal long, edits array<struct<turn:{turn},role:string,digest:string,before:string,stays:string>>"
    return _rows(known, solve, schema)


def _hashes(solved: DataFrame, endings: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: rows stream by in order, edits before their texts, the ending last."""
    edit = solved.select("conv_id", F.explode("edits").alias("e")).select("conv_id", F.lit(False).alias("last"), "e.turn", "e.role", "e.digest", F.lit(0).alias("sort"), "e.before", "e.stays", F.lit("").alias("text"))
    texts = rows.select("conv_id", F.lit(False).alias("last"), "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(1).alias("sort"), F.lit("").alias("before"), F.lit("").alias("stays"), "text")
    empty = F.lit(None)
    last = endings.select("conv_id", F.lit(True).alias("last"), empty.cast(rows.schema["turn"].dataType).alias("turn"), empty.cast("string").alias("role"), empty.cast("string").alias("digest"), F.lit(0).alias("sort"), "before", F.lit("").alias("stays"), F.lit("").alias("text"))

    def run(stream):
        conv, digest, edit, any_line, started = None, hashlib.sha256(), None, False, False

        def line(text: str) -> None:
            nonlocal any_line
            digest.update((("\n" if any_line else "") + text).encode("utf-8", "surrogatepass"))
            any_line = True

        for r in stream:
            if not started or r["conv_id"] != conv:
                if started:
                    yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
                conv, digest, edit, any_line, started = r["conv_id"], hashlib.sha256(), None, False, True
            for initial in r["before"]:
                line("user:" if initial == "u" else "assistant:")
            key = (r["turn"], r["role"], r["digest"])
            if r["sort"] == 0:
                edit = (key, r["stays"]) if r["stays"] else None
            elif edit and edit[0] == key:
                line(f"{edit[1]}:{r['text']}")
                edit = None
        if started:
            yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

    order = ["conv_id", "last", "turn", "role", "digest", "sort"]
    stream = edit.unionByName(texts).unionByName(last).repartition("conv_id").sortWithinPartitions(*order)
    kind = solved.schema["conv_id"].dataType.simpleString()
    return _rows(stream, run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=undamaged, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damage(turns, conv, turn, role, text)
    faulty = stored(faults(rows))
    n = F.col("copies")
    again = F.when(F.col("blank"), 0).otherwise(F.when(F.col("first"), n - 1).otherwise(n))
    per_turn = faulty.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("first") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    counts = per_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    solved = stored(_solved(stored(_blocks(faulty, block)), piece))
    totals = solved.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.max_by("state", "block").cast("int").alias("state"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    tail, tail_cost = F.array(*map(F.lit, ENDING)), F.array(*map(F.lit, END_COST))
    totals = totals.withColumns({"cost": F.col("cost") + F.get(tail_cost, F.col("state")), "audit": F.concat("audit", F.get(tail, F.col("state")))})
    inserted = F.array(F.lit(""), F.lit("ua"), F.lit("a"), F.lit(""))
    hashes = _hashes(solved, totals.select("conv_id", F.get(inserted, F.col("state")).alias("before")), rows)
    known = _same(_same(counts, totals.drop("state"), ["conv_id"]), hashes, ["conv_id"])
    out = _same(turns.select(F.col(conv).alias("conv_id")).distinct(), known, ["conv_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
