"""Whole groups from the sorted batches of a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..workers import with_workers

#: Rows that a task packs at a time.
PACKED = 500_000


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every run of equal keys."""
    if not table.num_rows:
        return np.empty(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end with their last group complete; the open group waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def by_groups(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table | Iterable[pa.Table]], schema: str, *, prepare: Callable[[DataFrame], DataFrame] | None = None, together: bool = False) -> DataFrame:
    """Apply ``kernel(table, starts of groups)`` to many whole groups at a time.

    One shuffle by the keys, one sort within partitions; a kernel sees sorted, complete groups and may
    work on all of them at once; it returns a table, or several.  ``prepare`` adds the columns to sort by or to
    work on after the shuffle.  ``together``: groups are in one partition each already, there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, keys):
            out = kernel(table, group_starts(table, keys))
            for part in [out] if isinstance(out, pa.Table) else out:
                yield from part.to_batches()

    with_workers(df.sparkSession)
    rows = df if together else df.repartition(*keys)
    return (prepare(rows) if prepare else rows).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def part_names(n: int) -> np.ndarray:
    """For each of ``n`` partitions the smallest number that Spark's hash partitioning puts there."""
    many = 16 * n
    while True:
        x = np.arange(many, dtype=np.uint32)  # Spark's hash of an int: Murmur3 with seed 42
        x *= np.uint32(0xCC9E2D51)
        x = ((x << np.uint32(15)) | (x >> np.uint32(17))) * np.uint32(0x1B873593) ^ np.uint32(42)
        x = ((x << np.uint32(13)) | (x >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        at, first = np.unique((x ^ (x >> np.uint32(16))).view(np.int32) % n, return_index=True)
        if len(at) == n:
            return first.astype(np.int32)
        many *= 2


def packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, names: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(part, block): all that ``PACKED`` rows have of a part, as a message of compressed columns; ``names``: of the parts."""
    held: list[pa.RecordBatch] = []
    many = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            many += batch.num_rows
        if not many or (batch is not None and many < PACKED):
            continue
        table = pa.Table.from_batches(held)
        held, many = [], 0
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = table.select(schema.names).cast(schema).take(pa.array(order)).combine_chunks().to_batches()[0]
        sink, ends = pa.BufferOutputStream(), []
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows.slice(0, 0))  # after the schema, which no block repeats
            ends.append(sink.tell())
            for start, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
                writer.write_batch(rows.slice(start, end - start))
                ends.append(sink.tell())
        whole = sink.getvalue()
        blocks = [whole[a:b].to_pybytes() for a, b in zip(ends, ends[1:], strict=False)]
        found = part[order][starts]
        yield pa.record_batch([pa.array(found if names is None else names[found], pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def unpacked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, first = batch.column("block"), 0
        while first < len(blocks):
            rows, many = [], 0
            while first < len(blocks) and many < 10_000:
                rows.append(pa.ipc.read_record_batch(pa.ipc.read_message(blocks[first].as_buffer()), schema))
                many, first = many + rows[-1].num_rows, first + 1
            yield from pa.Table.from_batches(rows, schema).combine_chunks().to_batches()


def dealt(df: DataFrame, key: Column) -> DataFrame:
    """The rows of ``df``, those of equal keys in one partition, shuffled as compressed columns and not one by one.

    Keys are dealt to parts, one a partition and named so that it gets there: what ``PACKED`` rows of a task have of
    a part is one row of the shuffle, and blocks of a few rows take several times their bytes.  The planner can't tell
    rows from packed sizes, so partitions are not merged.
    """
    spark = with_workers(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in df.schema])
    names = part_names(n)
    blocks = df.withColumn("part", F.pmod(F.hash(key), F.lit(n))).mapInArrow(lambda b: packed(b, schema, names), "part int, block binary")
    return blocks.repartition(n, "part").mapInArrow(lambda b: unpacked(b, schema), df.schema)
