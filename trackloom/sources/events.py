"""Readers of event files: CSV bound by column name, JSON configurations, tables in Parquet.

A file belongs to the event whose nine-digit number its name holds.  Unsigned 64-bit ids are read as
decimals and kept as their signed bit pattern.  Row numbers within a file are made at reading, in
the file's order; they are keys of hits and measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSIGNED = "unsigned"
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "cells": [("geometry_id", UNSIGNED), ("measurement_id", UNSIGNED), ("channel0", "int"), ("channel1", "int"), ("timestamp", "float"), ("value", "float")],
    "hits": [("particle_id", UNSIGNED), ("geometry_id", UNSIGNED), *((c, "float") for c in ("tx", "ty", "tz", "tt", "tpx", "tpy", "tpz", "te", "deltapx", "deltapy", "deltapz", "deltae")), ("index", UNSIGNED)],
    "measurements": [("measurement_id", UNSIGNED), ("geometry_id", UNSIGNED), ("local_key", "smallint"), *((c, "float") for c in ("local0", "local1", "phi", "theta", "time", "var_local0", "var_local1", "var_phi", "var_theta", "var_time"))],
    "measurement-simhit-map": [("measurement_id", UNSIGNED), ("hit_id", UNSIGNED)],
    "particles_initial": [("particle_id", UNSIGNED), ("particle_type", "int"), ("process", "int"), *((c, "float") for c in ("vx", "vy", "vz", "vt", "px", "py", "pz", "m", "q"))],
    "surfaces": [("geometry_id", UNSIGNED), *((c, "float") for c in ("cx", "cy", "cz", "rot_xu", "rot_xv", "rot_xw", "rot_yu", "rot_yv", "rot_yw", "rot_zu", "rot_zv", "rot_zw"))],
}


def bit_pattern(x: Column) -> Column:
    """An unsigned 64-bit number as the signed one of the same bits."""
    big = x.cast("decimal(20,0)")
    return F.when(big >= F.lit("9223372036854775808").cast("decimal(20,0)"), big - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(big).cast("long")


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``event_id``, ``row`` and the named columns of all files of a kind; further columns are allowed, an empty value is null.

    ``path`` is a folder with files event<9 digits>-<kind>.csv, or surfaces.csv.
    """
    name = "surfaces.csv" if kind == "surfaces" else f"event*-{kind}.csv"
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(f"{path}/{name}")
    cols = []
    for c, t in SCHEMAS[kind]:
        if c not in raw.columns:
            raise ValueError(f"{kind} files have no column {c}")
        cols.append((bit_pattern(F.col(c)) if t == UNSIGNED else F.col(c).cast(t)).alias(c))
    file = F.col("_metadata.file_path")
    event = F.coalesce(F.regexp_extract(file, r"event(\d{9})-", 1).try_cast("long"), F.lit(0).cast("long"))
    rows = raw.select(event.alias("event_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), *cols)
    # within a file, blocks and the order inside them give the line order
    return rows.withColumn("row", (F.row_number().over(Window.partitionBy("event_id").orderBy("block", "seq")) - 1).cast("long")).drop("block", "seq")


def read_cells(spark: SparkSession, path: str, *, dedup: bool = True) -> DataFrame:
    """Cells; with ``dedup`` one row per (event, geometry, channels) with summed values and the first row's rest."""
    rows = read_csv(spark, path, "cells")
    if not dedup:
        return rows.sortWithinPartitions("event_id", "geometry_id", "channel1", "channel0")
    first = F.min_by(F.struct("measurement_id", "timestamp", "row"), "row")
    out = rows.groupBy("event_id", "geometry_id", "channel1", "channel0").agg(F.sum("value").cast("float").alias("value"), first.alias("f"), F.count("*").alias("n_merged"))
    return out.select("event_id", "geometry_id", "f.measurement_id", "channel0", "channel1", "f.timestamp", "value", "f.row", "n_merged")


def read_measurements(spark: SparkSession, path: str, *, sort: bool = False) -> DataFrame:
    """Measurements with ``dimensions`` and ``subspace`` from the bits 1 and 2 of local_key (empty: 0).

    With ``sort`` they are numbered by surface and position; ``row`` keeps the old number.
    """
    rows = read_csv(spark, path, "measurements")
    key = F.coalesce("local_key", F.lit(0)).cast("int")
    has0, has1 = key.bitwiseAND(2) != 0, key.bitwiseAND(4) != 0
    rows = rows.withColumns({"dimensions": has0.cast("int") + has1.cast("int"), "subspace": F.when(has1 & ~has0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))})
    if sort:
        by = Window.partitionBy("event_id").orderBy("geometry_id", "local0", "local1", "var_local0", "var_local1", "row")
        rows = rows.withColumn("new_row", (F.row_number().over(by) - 1).cast("long"))
    return rows


def read_spacepoints(spark: SparkSession, path: str) -> DataFrame:
    """Hits as space points, with the measurement that the map names for their row number (else null)."""
    hits = read_csv(spark, path, "hits")
    known = read_csv(spark, path, "measurement-simhit-map").select("event_id", F.col("hit_id").alias("row"), F.col("measurement_id").alias("measurement_1"))
    return hits.join(known, ["event_id", "row"], "left").select("event_id", F.col("row").alias("spacepoint_id"), F.col("tx").cast("double").alias("x"), F.col("ty").cast("double").alias("y"), F.col("tz").cast("double").alias("z"), "particle_id", "geometry_id", "measurement_1")


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "particles_initial").drop("row")


def read_particle_measurements(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, particle_id, meas_ids); a hit without particle or measurement is an error."""
    hits, known = read_csv(spark, path, "hits"), read_csv(spark, path, "measurement-simhit-map")
    particles = read_particles(spark, path).select("event_id", "particle_id", F.lit(True).alias("known"))
    rows = hits.select("event_id", F.col("row").alias("hit_id"), "particle_id").join(particles, ["event_id", "particle_id"], "left")
    rows = rows.where(F.assert_true(F.coalesce("known", F.lit(False)), F.lit("hit without particle")).isNull())
    rows = rows.join(known.select("event_id", "hit_id", "measurement_id"), ["event_id", "hit_id"], "left")
    rows = rows.where(F.assert_true(F.col("measurement_id").isNotNull(), F.lit("hit without measurement")).isNull())
    return rows.groupBy("event_id", "particle_id").agg(F.sort_array(F.collect_list("measurement_id")).alias("meas_ids"))


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "surfaces").drop("event_id", "row").withColumnRenamed("geometry_id", "surface_link")


_AXIS = T.StructType([T.StructField("bins", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("edges", T.ArrayType(T.DoubleType()))])
_ENTRY = T.StructType([
    T.StructField("volume", T.LongType()), T.StructField("layer", T.LongType()), T.StructField("sensitive", T.LongType()),
    T.StructField("value", T.StructType([T.StructField("geometric", T.StructType([T.StructField("segmentation", T.StructType([T.StructField("binningdata", T.ArrayType(_AXIS))]))])), T.StructField("shift", T.ArrayType(T.DoubleType()))])),
])
_CONFIG = T.StructType([T.StructField("entries", T.ArrayType(_ENTRY))])


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CONFIG).option("multiLine", True).json(path).select(F.explode("entries").alias("e"))


def bin_edges(axis: Column) -> Column:
    """Explicit edges, or bins + 1 equidistant ones."""
    step = (axis["max"] - axis["min"]) / axis["bins"]
    return F.coalesce(axis["edges"], F.transform(F.sequence(F.lit(0), axis["bins"]), lambda i: axis["min"] + i * step))


def read_digitization(spark: SparkSession, path: str) -> DataFrame:
    """volume, layer, sensitive (0: any), edges0, edges1, dimensions (one with a single bin on an axis)."""
    axes = F.col("e.value.geometric.segmentation.binningdata")
    rows = _entries(spark, path).select("e.volume", "e.layer", "e.sensitive", F.get(axes, F.lit(0)).alias("a0"), F.get(axes, F.lit(1)).alias("a1"))
    one = F.coalesce(F.col("a0.bins") == 1, F.lit(True)) | F.coalesce(F.col("a1.bins") == 1, F.lit(True))
    ids = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("volume", "layer", "sensitive")]
    return rows.select(*ids, bin_edges(F.col("a0")).alias("edges0"), F.when(F.col("a1").isNotNull(), bin_edges(F.col("a1"))).alias("edges1"), F.when(one, 1).otherwise(2).alias("dimensions"))


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    """volume, layer, sensitive, shift0, shift1 (zero where not given)."""
    shift = F.col("e.value.shift")
    ids = [F.coalesce(F.col(f"e.{c}"), F.lit(0).cast("long")).alias(c) for c in ("volume", "layer", "sensitive")]
    return _entries(spark, path).select(*ids, F.coalesce(F.get(shift, F.lit(0)), F.lit(0.0)).alias("shift0"), F.coalesce(F.get(shift, F.lit(1)), F.lit(0.0)).alias("shift1"))


def most_specific(modules: DataFrame, config: DataFrame, key: str = "geometry_id") -> DataFrame:
    """Each module with its most specific entry; 0 in an entry stands for any layer or sensitive.

    A module without an entry is an error.  Three equi-joins, from specific to general.
    """
    values = [c for c in config.columns if c not in ("volume", "layer", "sensitive")]
    out = modules
    packed = config.select("volume", "layer", "sensitive", F.struct(*values).alias("v"))
    for i, (layer, sensitive) in enumerate(((True, True), (True, False), (False, False))):
        part = packed if layer and sensitive else packed.where("sensitive = 0") if layer else packed.where("layer = 0 AND sensitive = 0")
        on = ["volume", *(["layer"] if layer else []), *(["sensitive"] if sensitive else [])]
        out = out.join(part.select(*on, F.col("v").alias(f"v{i}")), on, "left")
    out = out.withColumn("v", F.coalesce("v0", "v1", "v2")).drop("v0", "v1", "v2")
    out = out.where(F.assert_true(F.col("v").isNotNull(), F.concat(F.lit("no entry for module "), F.col(key).cast("string"))).isNull())
    return out.select(*modules.columns, "v.*")


def detector_description(surfaces: DataFrame, digitization: DataFrame, conditions: DataFrame) -> DataFrame:
    """Surfaces (with volume, layer, sensitive and optionally is_annulus) with edges, shifts and subspace."""
    out = most_specific(most_specific(surfaces, digitization, "surface_link"), conditions, "surface_link")
    annulus = F.col("is_annulus") if "is_annulus" in surfaces.columns else F.lit(False)
    return out.withColumn("subspace", F.when(annulus, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))


def constant_field(points: DataFrame, field: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({f"b{c}": F.lit(v) for c, v in zip("xyz", field, strict=True)})


def grid_field(points: DataFrame, grid: DataFrame, *, origin: tuple[float, float, float], step: tuple[float, float, float], size: tuple[int, int, int], key: str = "spacepoint_id") -> DataFrame:
    """Trilinear interpolation in a grid (i, j, k, bx, by, bz); points outside are clamped to its edge.

    Each point looks up its eight corners by an equi-join.
    """
    at = {c: F.least(F.greatest((F.col(c) - o) / s, F.lit(0.0)), F.lit(float(n - 1))) for c, o, s, n in zip("xyz", origin, step, size, strict=True)}
    low = {c: F.least(F.floor(at[c]).cast("int"), F.lit(max(n - 2, 0))) for c, n in zip("xyz", size, strict=True)}
    rows = points.withColumns({f"f{c}": at[c] - low[c] for c in "xyz"} | {f"l{c}": low[c] for c in "xyz"})
    corners = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("di", "dj", "dk"), d, strict=True))) for d in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]])
    each = rows.withColumn("c", F.explode(corners))
    each = each.withColumns({g: F.least(F.col(f"l{c}") + F.col(f"c.d{g}"), F.lit(n - 1)) for g, c, n in zip("ijk", "xyz", size, strict=True)})
    weight = F.lit(1.0)
    for g, c in zip("ijk", "xyz", strict=True):
        weight = weight * F.when(F.col(f"c.d{g}") == 1, F.col(f"f{c}")).otherwise(1 - F.col(f"f{c}"))
    found = each.withColumn("w", weight).join(grid, ["i", "j", "k"])
    return found.groupBy(key).agg(*(F.sum(F.col("w") * F.col(f"b{c}")).alias(f"b{c}") for c in "xyz"))


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """A field map in CSV (x, y, z, Bx, By, Bz, one point of a regular grid a line) as the grid ``grid_field`` reads.

    Returns x, y, z, bx, by, bz and i, j, k: the places of the coordinates among the different ones of their
    axis (dimension tables of a grid's size).
    """
    names = ("x", "y", "z", "bx", "by", "bz")
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).option("header", True).option("enforceSchema", True).csv(path)
    for axis, number in zip("xyz", "ijk", strict=True):
        places = rows.select(axis).distinct().select(axis, (F.row_number().over(Window.orderBy(axis)) - 1).alias(number))
        rows = rows.join(F.broadcast(places), axis)  # one row per plane of the grid
    return rows.select(*names, *"ijk")


def constant_grid(spark: SparkSession, field: tuple[float, float, float], *, origin: tuple[float, float, float], step: tuple[float, float, float], size: tuple[int, int, int]) -> DataFrame:
    """A grid map of one field vector, made in parallel."""
    ni, nj, nk = size
    ids = spark.range(ni * nj * nk)
    place = {"i": F.floor(F.col("id") / (nj * nk)), "j": F.floor(F.col("id") / nk) % nj, "k": F.col("id") % nk}
    out = ids.select(*(c.cast("int").alias(n) for n, c in place.items()))
    at = {a: F.lit(o) + F.col(n) * F.lit(s) for a, n, o, s in zip("xyz", "ijk", origin, step, strict=True)}
    return out.select(*(c.alias(a) for a, c in at.items()), *(F.lit(b).alias(f"b{a}") for a, b in zip("xyz", field, strict=True)), "i", "j", "k")
