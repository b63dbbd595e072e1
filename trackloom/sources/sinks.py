"""Writers: event CSV, Parquet tables, OBJ geometry, JSON configurations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """A columnar table partitioned by event where it has one; Parquet stands for every binary format."""
    (df.write.partitionBy("event_id") if "event_id" in df.columns else df.write).mode("overwrite").parquet(path)


def cells_csv(cells: DataFrame) -> DataFrame:
    """Cells in the column order of the files; the measurement id is written as 0."""
    return cells.select("event_id", "geometry_id", F.lit(0).cast("long").alias("measurement_id"), "channel0", "channel1", "timestamp", "value")


def write_cells(cells: DataFrame, path: str) -> None:
    cells_csv(cells).write.partitionBy("event_id").option("header", True).mode("overwrite").csv(path)


def spacepoint_lines(spacepoints: DataFrame) -> DataFrame:
    """One OBJ vertex per space point, in the order of ids."""
    line = F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz"))
    return spacepoints.select("event_id", "spacepoint_id", line.alias("line"))


def _uses(seeds: DataFrame) -> DataFrame:
    """event_id, n (of the seed in its event), k (0 to 2), spacepoint_id, vertex: three rows a seed.

    Seeds are shuffled once, by event; every step keeps that partitioning.
    """
    order = Window.partitionBy("event_id").orderBy("bottom_id", "middle_id", "top_id")
    numbered = seeds.select("event_id", "bottom_id", "middle_id", "top_id").repartition("event_id").withColumn("n", F.row_number().over(order))
    used = numbered.select("event_id", "n", F.posexplode(F.array("bottom_id", "middle_id", "top_id")).alias("k", "spacepoint_id"))
    met = F.min(F.col("n").cast("long") * 3 + F.col("k")).over(Window.partitionBy("event_id", "spacepoint_id"))
    return used.withColumn("met", met).select("event_id", "n", "k", "spacepoint_id", F.dense_rank().over(Window.partitionBy("event_id").orderBy("met")).cast("long").alias("vertex"))


def seed_vertices(seeds: DataFrame) -> DataFrame:
    """Vertex numbers of a seed file: space points in the order of first use, from 1, each once."""
    return _uses(seeds).select("event_id", "spacepoint_id", "vertex").distinct()


def seed_lines(seeds: DataFrame) -> DataFrame:
    """``l b m t`` lines over the vertex numbers."""
    sides = ("bottom", "middle", "top")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    rows = _uses(seeds).groupBy("event_id", "n").agg(*(of(k, "spacepoint_id").alias(f"{s}_id") for k, s in enumerate(sides)), *(of(k, "vertex").alias(s) for k, s in enumerate(sides)))
    return rows.select("event_id", "bottom_id", "middle_id", "top_id", F.concat_ws(" ", F.lit("l"), *sides).alias("line"))


def track_lines(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """One polyline per track; vertices are numbered through all tracks of an event and not shared."""
    rows = links.join(tracks.select("event_id", "track_id"), "track_id")
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("track_id", "pos"))
    numbered = rows.select("event_id", "track_id", "pos", n.alias("vertex"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vertex"))), lambda s: s["vertex"].cast("string")), " ")
    return numbered.groupBy("event_id", "track_id").agg(F.concat(F.lit("l "), line).alias("line"))


def digitization_json(config: DataFrame) -> DataFrame:
    """The configuration as one JSON text (a dimension table: its size is that of the detector)."""
    axis = lambda e: F.struct((F.size(e) - 1).alias("bins"), F.lit("arbitrary").alias("type"), F.get(e, F.lit(0)).alias("min"), F.element_at(e, -1).alias("max"), F.col(e).alias("edges"))
    data = F.when(F.col("edges1").isNull(), F.array(axis("edges0"))).otherwise(F.array(axis("edges0"), axis("edges1")))
    value = F.struct(F.struct(F.struct(data.alias("binningdata")).alias("segmentation")).alias("geometric"))
    entry = F.struct("volume", "layer", "sensitive", value.alias("value"))
    return config.select(entry.alias("e")).agg(F.to_json(F.struct(F.collect_list("e").alias("entries"))).alias("json"))


def seed_report(matched: DataFrame) -> DataFrame:
    """seed_id, length, particle_id; -1 without a match."""
    return matched.select("seed_id", "length", F.coalesce("particle_id", F.lit(-1).cast("long")).alias("particle_id"))


def append_throughput(path: str, directory: str, threads: int, loaded: int, cold: int, processed: int, warm_up_s: float, processing_s: float) -> None:
    """One line of a throughput log on the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"{directory},{threads},{loaded},{cold},{processed},{warm_up_s},{processing_s}\n")
