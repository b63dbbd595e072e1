"""Checks of order and contiguity, and block layouts of modules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.batches import by_groups


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def contiguous_on(df: DataFrame, group: str | list[str], order: str, value: str) -> DataFrame:
    """Whether equal values stand together: as many runs as different values."""
    by = Window.partitionBy(*_keys(group)).orderBy(order)
    before = F.lag(value).over(by)
    runs = df.select(*_keys(group), F.col(value).alias("v"), F.when(before.isNull() | (before != F.col(value)), 1).otherwise(0).alias("new"))
    out = runs.groupBy(*_keys(group)).agg(F.sum("new").cast("long").alias("n_runs"), F.countDistinct("v").alias("n_values"))
    return out.withColumn("contiguous", F.col("n_runs") == F.col("n_values"))


def ordered_on(df: DataFrame, group: str | list[str], order: str, key: Column) -> DataFrame:
    """Whether ``key`` never falls along ``order``."""
    by = Window.partitionBy(*_keys(group)).orderBy(order)
    marked = df.select(*_keys(group), key.alias("k"), F.lag(key).over(by).alias("before"))
    out = marked.groupBy(*_keys(group)).agg(F.count("*").alias("n_rows"), F.count_if(F.col("before") > F.col("k")).alias("n_descents"))
    return out.withColumn("ordered", F.col("n_descents") == 0)


def adjacent_unique(df: DataFrame, group: str | list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*_keys(group)).orderBy(order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def module_blocks(cells: DataFrame, target: int) -> DataFrame:
    """Modules of an event laid out in blocks of about ``target`` cells, a module never cut."""
    sized = cells.groupBy("event_id", "module_index").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("event_id").orderBy("module_index")) - F.col("n")
    placed = sized.withColumn("block", F.floor(before / F.lit(float(target))).cast("long"))
    return placed.groupBy("event_id", "block").agg(F.count("*").alias("n_modules"), F.sum("n").cast("long").alias("n_cells"), F.max("n").alias("largest"))


def packed_modules(cells: DataFrame, target: int) -> DataFrame:
    """(event_id, bin, n_modules, n_cells): modules in order, a bin closed once it holds ``target`` cells or more.

    Packing is sequential within an event; a kernel packs many events at once.
    """
    sized = cells.groupBy("event_id", "module_index").agg(F.count("*").alias("n"))

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        event, n = table.column("event_id").to_numpy(), table.column("n").to_numpy()
        rows = []
        for a, b in zip(starts, [*starts[1:], len(n)], strict=True):
            total, at, nth = np.cumsum(n[a:b]), 0, 0
            while at < b - a:
                before = total[at - 1] if at else 0
                end = min(int(np.searchsorted(total, before + target)) + 1, b - a)
                rows.append((event[a], nth, end - at, total[end - 1] - before))
                at, nth = end, nth + 1
        names = ("event_id", "bin", "n_modules", "n_cells")
        return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(names)})

    return by_groups(sized, ["event_id"], ["module_index"], kernel, "event_id long, bin long, n_modules long, n_cells long")


def packing_statistics(bins: DataFrame) -> DataFrame:
    """Per event: modules, cells, bins, the smallest and largest bin, and bins times the largest over cells."""
    out = bins.groupBy("event_id").agg(
        F.sum("n_modules").alias("n_modules"), F.sum("n_cells").alias("n_cells"), F.count("*").alias("n_bins"),
        F.min("n_cells").alias("smallest"), F.max("n_cells").alias("largest"),
    )
    return out.withColumn("inefficiency", F.col("n_bins") * F.col("largest") / F.col("n_cells"))
