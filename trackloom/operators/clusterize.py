"""Cells to clusters to measurements.

Cells are (event_id, module_index, channel0, channel1, activation) with a ``cell_id``.  All steps are
partitioned by (event_id, module_index): a module of one event is small, their number grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.batches import by_groups
from ..kernels.union import components

MODULE = ["event_id", "module_index"]
CELL_ORDER = ["event_id", "module_index", "channel1", "channel0"]


def dedup_cells(raw: DataFrame, order: str = "line_no") -> DataFrame:
    """One row per (event, module, channels): activations summed, other fields of the first row kept."""
    return raw.groupBy(*MODULE, "channel0", "channel1").agg(F.sum("activation").cast("long").alias("activation"), F.min_by("time_ticks", order).alias("time_ticks"), F.min(order).alias("cell_id"), F.count("*").alias("n_merged"))


def resolve_modules(cells: DataFrame, modules: DataFrame, key: str = "module_index") -> DataFrame:
    """Cells with their module's row; a cell of an unknown module is an error, as in a geometry lookup."""
    found = cells.join(modules, key, "left")
    known = F.assert_true(F.col("geometry_id").isNotNull(), F.concat(F.lit("unknown module "), F.col(key).cast("string")))
    return found.where(known.isNull())


def adjacency(cells: DataFrame) -> DataFrame:
    """(event, module, a, b): touching cells, a before b in (channel0, channel1).

    Each cell looks up its four following neighbours by an equi-join, so nothing is compared that
    cannot touch.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("d0"), F.lit(j).alias("d1")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = cells.select(*MODULE, F.col("cell_id").alias("a"), "channel0", "channel1", F.explode(steps).alias("s"))
    ahead = ahead.select(*MODULE, "a", (F.col("channel0") + F.col("s.d0")).alias("channel0"), (F.col("channel1") + F.col("s.d1")).alias("channel1"))
    there = cells.select(*MODULE, F.col("cell_id").alias("b"), "channel0", "channel1")
    return ahead.join(there, [*MODULE, "channel0", "channel1"]).select(*MODULE, "a", "b")


def clusters(cells: DataFrame) -> DataFrame:
    """Cells with ``cluster_id``: the smallest cell_id of the 8-connected component within the module."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        group = np.zeros(n, np.int64)
        group[starts[1:]] = 1
        first = components(np.cumsum(group), table.column("channel0").to_numpy(), table.column("channel1").to_numpy())
        ids = table.column("cell_id").to_numpy()
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, first, ids)
        return table.append_column("cluster_id", pa.array(low[first]))

    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema]
    return by_groups(cells, MODULE, ["channel1", "channel0"], kernel, ", ".join([*cols, "cluster_id long"]))


def numbered_clusters(labelled: DataFrame) -> DataFrame:
    """``cluster_index``: clusters of a module counted in the order in which a scan over its sorted cells meets them."""
    first = Window.partitionBy(*MODULE, "cluster_id")
    met = labelled.withColumn("met", F.min(F.struct("channel1", "channel0")).over(first))
    return met.withColumn("cluster_index", F.dense_rank().over(Window.partitionBy(*MODULE).orderBy("met")) - 1).drop("met")


def cluster_lists(labelled: DataFrame) -> DataFrame:
    """One row per cluster with its cells in order."""
    return labelled.groupBy(*MODULE, "cluster_id").agg(F.sort_array(F.collect_list("cell_id")).alias("cell_ids"))


def cell_position(channel: str, pitch: str, low: str) -> Column:
    """The middle between the edges of a cell's bin on an equidistant axis."""
    edge = lambda i: F.col(low) + i * F.col(pitch)
    return (edge(F.col(channel)) + edge(F.col(channel) + 1)) / 2


def edge_position(channel: str, edges: str) -> Column:
    """The same for explicit bin edges (an array column)."""
    return (F.element_at(edges, F.col(channel) + 1) + F.element_at(edges, F.col(channel) + 2)) / 2


def _diameter(strategy: str) -> Column:
    d0, d1 = F.col("width0"), F.col("width1")
    ways = {"channel0": d0, "channel1": d1, "maximum": F.greatest(d0, d1), "diagonal": F.sqrt(d0 * d0 + d1 * d1)}
    return ways[strategy]


def measurements(labelled: DataFrame, modules: DataFrame, designs: DataFrame, *, diameter: str = "channel1") -> DataFrame:
    """Activation-weighted position and variance per cluster, with the module's shift.

    The variance is the weighted second moment plus that of a uniform bin, pitch^2 / 12.  Module and
    design rows are dimension tables: the planner broadcasts them below its size threshold.
    """
    located = labelled.join(modules, "module_index").join(designs, "design_id")
    located = located.withColumns({"x0": cell_position("channel0", "pitch0", "min0"), "x1": cell_position("channel1", "pitch1", "min1"), "w": F.col("activation").cast("double")})
    sums = {"w": F.sum("w")}
    for i in (0, 1):
        sums[f"s{i}"] = F.sum(F.col("w") * F.col(f"x{i}"))
        sums[f"q{i}"] = F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{i}"))
        sums[f"width{i}"] = (F.max(f"channel{i}") - F.min(f"channel{i}") + 1) * F.max(f"pitch{i}")
        sums[f"pitch{i}"] = F.max(f"pitch{i}")
        sums[f"shift{i}"] = F.max(f"shift{i}")
    rows = located.groupBy(*MODULE, "cluster_id").agg(F.max("geometry_id").alias("surface_link"), F.count("*").alias("n_cells"), *(c.alias(n) for n, c in sums.items())).where("w > 0")
    mean = lambda i: F.col(f"s{i}") / F.col("w")
    var = lambda i: F.col(f"q{i}") / F.col("w") - mean(i) * mean(i) + F.col(f"pitch{i}") * F.col(f"pitch{i}") / 12
    return rows.select(*MODULE, "cluster_id", "surface_link", "n_cells", (mean(0) + F.col("shift0")).alias("loc0"), (mean(1) + F.col("shift1")).alias("loc1"), var(0).alias("var0"), var(1).alias("var1"), _diameter(diameter).alias("diameter"))


def measurement_order(found: DataFrame) -> DataFrame:
    """``measurement_id``: the place in the order by surface, local position and variance within the event."""
    by = Window.partitionBy("event_id").orderBy("surface_link", "loc0", "loc1", "var0", "var1", "cluster_id")
    return found.withColumn("measurement_id", (F.row_number().over(by) - 1).cast("long"))


def clusterization(raw: DataFrame, modules: DataFrame, designs: DataFrame) -> DataFrame:
    """Raw cells to measurements."""
    return measurements(clusters(dedup_cells(raw)), modules, designs)
