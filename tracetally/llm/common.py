"""Shared helpers: input columns, cut points in the shared folder, row-wise Arrow passes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import cut

SLICE_ROWS = 64  # rows turned into Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null becomes empty), under fixed names; other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


stored = cut  # write a table to the shared folder and read it back: later steps restart from durable files


kept_by_worker: dict[str, object] = {}  # what tasks of an operator leave in their Python worker for its next tasks


def fresh_worker() -> None:
    """Python workers go on to tasks of other operators: gives back what is kept in this one, and what Arrow holds unused."""
    kept_by_worker.clear()
    pa.default_memory_pool().release_unused()


def per_row(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a function to every row (as positional arguments); it returns a list of output tuples.

    ``make`` builds the function once per task. Rows are handled in small slices, so memory
    is bounded by the longest texts of a slice, not by a partition.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    types = _arrow_types(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of the worker's tasks before
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                out = [r for args in zip(*[c.to_pylist() for c in part.columns]) for r in apply(*args)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def keep_rows(df: DataFrame, text_col: str, wanted: Callable[[str], bool]) -> DataFrame:
    """The rows, with all columns, whose text (null: empty) is wanted; few texts at a time are turned into strings."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                mask = pa.array([wanted(t or "") for t in part.column(at).to_pylist()], pa.bool_())
                yield part.filter(mask)

    return df.mapInArrow(run, df.schema)


def _arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in spark.createDataFrame([], schema).schema.fields]


def overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether a span shares a character with any of some spans, by bisection."""
    ordered = sorted(spans)
    starts, reach = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def test(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return test


def span_digest(spans, base_only: bool, kinds: list[str]):
    """``kind:start:end`` of the spans by start, then kind as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    kept = F.filter(spans, lambda s: s["base"]) if base_only else spans
    keyed = F.transform(kept, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["a"], s["c"])), ",")
