"""Greedy packing in input order, spread over tasks.

A pack that starts at a row takes as many rows as the limits allow, so where the next one starts is a
search in prefix sums, for all rows at once. Rows are sorted by range and cut into blocks. Within a
block, jumping from start to start (by doubling) tells for every possible first start how many packs
start there and how full the last one is; a short scan over blocks then finds each block's real first
start, and the blocks number their packs independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sizing import cut

BLOCK = 16_384


def next_starts(tokens: np.ndarray, most: int, budget: int) -> np.ndarray:
    """For every row, where the pack after the one that starts there begins (their number if it may go on)."""
    n = len(tokens)
    if (tokens < 0).any():  # sums do not grow: row by row
        out = np.full(n, n)
        for i in range(n):
            used, j = tokens[i], i + 1
            while j < n and j - i < most and used + tokens[j] <= budget:
                used, j = used + tokens[j], j + 1
            out[i] = j
        return out
    upto = np.concatenate(([0], np.cumsum(tokens)))
    return np.maximum(np.minimum(np.searchsorted(upto, upto[:-1] + budget, side="right") - 1, np.arange(n) + most), np.arange(n) + 1)


def packs_from(tokens: np.ndarray, most: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per first start (one of the first rows): packs that start, rows and tokens of the last one."""
    n = len(tokens)
    jump = np.append(np.minimum(next_starts(tokens, most, budget), n), n)
    count, last = np.append(np.ones(n, np.int64), 0), np.append(np.arange(n), -1)
    while (jump < n).any():  # doubling: from start to start, two, four, ... packs at a time
        count = count + count[jump]
        last = np.where(last[jump] >= 0, last[jump], last)
        jump = jump[jump]
    upto = np.concatenate(([0], np.cumsum(tokens)))
    firsts = min(n, most) + 1
    rows, used = n - last, upto[-1] - upto[last]
    return count[:firsts], np.where(last < 0, 0, rows)[:firsts], np.where(last < 0, 0, used)[:firsts]


def taken(tokens: np.ndarray, rows: int, used: int, most: int, budget: int) -> int:
    """How many of the next rows an open pack still takes."""
    k = 0
    while k < len(tokens) and rows + k < most and used + int(tokens[k]) <= budget:
        used, k = used + int(tokens[k]), k + 1
    return k


def greedy_packs(docs: DataFrame, most: int, budget: int, block: int = BLOCK) -> DataFrame:
    """request_id, position, tokens (longs) with the number of the pack; no row is over the budget."""
    kind = docs.schema["request_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    most = max(1, most)
    order = ["request_id", "position", "tokens"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: tuple[list, list] = ([], [])
        request, started = None, False

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            number += 1
            lists = [pa.array([x], pa.list_(pa.int64())) for x in held]
            held = ([], [])
            return pa.RecordBatch.from_arrays([pa.array([request], arrow), pa.array([number], pa.int64()), *lists], names=["request_id", "block", "positions", "tokens"])

        for batch in batches:
            for who, position, tokens in zip(*[c.to_pylist() for c in batch.columns]):
                if held[0] and (who != request or len(held[0]) == block):
                    yield emit()
                if not started or who != request:
                    request, started = who, True
                held[0].append(position)
                held[1].append(tokens or 0)
        if held[0]:
            yield emit()

    ordered = docs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = cut(ordered.mapInArrow(cut_up, f"request_id {name}, block long, positions array<long>, tokens array<long>"))

    def each(df: DataFrame, apply, schema: str) -> DataFrame:
        """One row in, one batch out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from apply(batch.slice(k, 1))

        return df.mapInArrow(run, schema)

    def ways(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = row.column(2).flatten().to_numpy()
        lists = [tokens[: min(len(tokens), most)], *packs_from(tokens, most, budget)]
        columns = [row.column(0), row.column(1), pa.array([len(tokens)], pa.int64()), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists]]
        yield pa.RecordBatch.from_arrays(columns, names=["request_id", "block", "n", "head", "packs", "rows", "used"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request, started, base, rows, used = None, False, 0, 0, 0
        for batch in batches:
            out = []
            for r in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                fresh = not started or r["request_id"] != request
                if fresh:
                    request, started, base, first = r["request_id"], True, 0, 0
                else:
                    first = taken(np.asarray(r["head"]), rows, used, most, budget)
                out.append((r["block"], first, base))
                if first == r["n"]:  # the open pack takes the whole block
                    rows, used = rows + first, used + sum(r["head"])
                else:
                    base, rows, used = base + r["packs"][first], r["rows"][first], r["used"][first]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["block", "first", "base"])

    small = each(blocks.select("request_id", "block", "tokens"), ways, f"request_id {name}, block long, n long, head array<long>, packs array<long>, rows array<long>, used array<long>")
    begun = small.repartition("request_id").sortWithinPartitions("request_id", "block").mapInArrow(chain, "block long, first long, base long")

    def number_rows(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = row.column(2).flatten().to_numpy()
        first, base = row.column(3)[0].as_py(), row.column(4)[0].as_py()
        starts, after, at = np.zeros(len(tokens), np.int64), next_starts(tokens, most, budget), first
        while at < len(tokens):
            starts[at], at = 1, int(after[at])
        columns = [pa.nulls(len(tokens), arrow) if row.column(0)[0].as_py() is None else pa.repeat(row.column(0)[0], len(tokens)), row.column(1).flatten(), pa.array(tokens), pa.array((base - 1 + np.cumsum(starts)).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[*order, "pack"])

    rows = blocks.join(begun, "block").select("request_id", "positions", "tokens", "first", "base")
    return each(rows, number_rows, f"request_id {name}, position long, tokens long, pack int")
