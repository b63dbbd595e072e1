"""Truth matching: contributing particles, efficiency, duplicates, fakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_join(measurements: DataFrame, hit_map: DataFrame, hits: DataFrame, particles: DataFrame) -> DataFrame:
    """Measurements with their hits and particles."""
    return measurements.join(hit_map, "meas_id").join(hits, "hit_id").join(particles, "particle_id")


def particle_measurements(hits: DataFrame, hit_map: DataFrame, particles: DataFrame) -> DataFrame:
    """Particle to its measurements; a repeated hit, or a hit without particle or measurement, is an error."""
    counted = hits.groupBy("hit_id").agg(F.count("*").alias("n"), F.first("particle_id").alias("particle_id"))
    counted = counted.where(F.assert_true(F.col("n") == 1, F.lit("duplicate hit id")).isNull())
    rows = counted.join(particles.select("particle_id", F.lit(True).alias("known")), "particle_id", "left").where(F.assert_true(F.col("known"), F.lit("hit without particle")).isNull())
    rows = rows.join(hit_map, "hit_id", "left").where(F.assert_true(F.col("meas_id").isNotNull(), F.lit("hit without measurement")).isNull())
    return rows.groupBy("particle_id").agg(F.sort_array(F.collect_list("meas_id")).alias("meas_ids"))


def contributions(links: DataFrame, meas_particle: DataFrame, track: str = "track_id") -> DataFrame:
    """(track, particle, n_hits, rank): particles of a track's measurements, most hits first, then smaller id.

    A link counts once per particle of its measurement.
    """
    n = links.join(meas_particle, "meas_id").groupBy(track, "particle_id").agg(F.count("*").alias("n_hits"))
    by = Window.partitionBy(track).orderBy(F.desc("n_hits"), "particle_id")
    return n.withColumn("rank", F.row_number().over(by).cast("long"))


def eta(px: str, py: str, pz: str) -> Column:
    pt2 = F.col(px) * F.col(px) + F.col(py) * F.col(py)
    return F.asinh(F.col(pz) / F.sqrt(pt2))


def accepted_particles(particles: DataFrame, meas_particle: DataFrame, *, pt_min: float = 0.5, z_max: float = 500.0, r_max: float = 200.0, eta_max: float = 3.0, process: int = -1, min_meas: int = 3) -> DataFrame:
    """Charged particles within the cuts (the vertex within z_max and, across the beam, r_max) with ``min_meas`` measurements or more."""
    size = meas_particle.groupBy("particle_id").agg(F.count("*").alias("n_meas"))
    rows = particles.join(size, "particle_id")
    pt2 = F.col("px") * F.col("px") + F.col("py") * F.col("py")
    # |eta| <= eta_max, as |pz| <= pt sinh(eta_max), without a logarithm
    import math

    steep = F.col("pz") * F.col("pz") <= pt2 * (math.sinh(eta_max) ** 2)
    near = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") <= r_max * r_max
    keep = near & (F.col("charge") != 0) & (pt2 >= pt_min**2) & (F.abs(F.col("vz")) <= z_max) & steep & (F.col("n_meas") >= min_meas)
    return rows.where(keep if process < 0 else keep & (F.col("process") == process))


def matched_tracks(links: DataFrame, meas_particle: DataFrame, *, ratio: float = 0.5, double_matching: bool = True, strict: bool = False) -> DataFrame:
    """Per track with a contributing particle: the main one, purity, completeness, and whether it matches."""
    best = contributions(links, meas_particle).where("rank = 1")
    size = links.groupBy("track_id").agg(F.count("*").alias("n_meas"))
    truth = meas_particle.groupBy("particle_id").agg(F.count("*").alias("n_truth"))
    rows = best.join(size, "track_id").join(truth, "particle_id").select("track_id", "particle_id", "n_hits", "n_meas", "n_truth")
    rows = rows.withColumns({"purity": F.col("n_hits") / F.col("n_meas"), "completeness": F.col("n_hits") / F.col("n_truth")})
    ok = F.col("purity") > ratio if strict else F.col("purity") >= ratio
    if double_matching:
        ok = ok & (F.col("completeness") >= ratio)
    return rows.withColumn("matched", ok)


def per_particle(accepted: DataFrame, found: DataFrame, links: DataFrame, meas_particle: DataFrame) -> DataFrame:
    """Accepted particles with their numbers of matched tracks, duplicates and fakes."""
    good = found.where("matched").groupBy("particle_id").agg(F.count("*").alias("n_matched"))
    bad = found.where("NOT matched").select("track_id")
    fakes = contributions(links, meas_particle).join(bad, "track_id").groupBy("particle_id").agg(F.count("*").alias("n_fake"))
    rows = accepted.select("particle_id", "n_meas").join(good, "particle_id", "left").join(fakes, "particle_id", "left").fillna(0, ["n_matched", "n_fake"])
    return rows.withColumn("n_duplicate", F.greatest(F.col("n_matched") - 1, F.lit(0)))


def rates(accepted: DataFrame, found: DataFrame, links: DataFrame, meas_particle: DataFrame) -> DataFrame:
    """Totals and rates over all events, in one row."""
    rows = per_particle(accepted, found, links, meas_particle)
    truth = rows.agg(F.count("*").alias("n_truth"), F.count_if(F.col("n_matched") > 0).alias("n_found"), F.coalesce(F.sum("n_duplicate"), F.lit(0)).cast("long").alias("n_duplicate"), F.lit(1).alias("k"))
    reco = found.agg(F.count_if(~F.col("matched")).alias("n_fake"), F.lit(1).alias("k"))
    both = truth.join(reco, "k").join(links.agg(F.countDistinct("track_id").alias("n_tracks"), F.lit(1).alias("k")), "k").drop("k")
    return both.withColumns({"efficiency": F.col("n_found") / F.col("n_truth"), "duplicate_rate": F.col("n_duplicate") / F.col("n_found"), "fake_rate": F.col("n_fake") / F.col("n_tracks")})


def nseed_report(accepted: DataFrame, found: DataFrame) -> DataFrame:
    """Seeds that match a particle and that don't, accepted particles with a matched seed and without, and their rates."""
    seeds = found.agg(F.count_if("matched").alias("n_true"), F.count_if(~F.col("matched")).alias("n_false"), F.lit(1).alias("k"))
    hit = found.where("matched").select("particle_id").distinct().withColumn("hit", F.lit(True))
    tracks = accepted.join(hit, "particle_id", "left").agg(F.count("hit").alias("n_matched"), F.count_if(F.col("hit").isNull()).alias("n_unmatched"), F.lit(1).alias("k"))
    total, truth = F.nullif(F.col("n_true") + F.col("n_false"), F.lit(0)), F.nullif(F.col("n_matched") + F.col("n_unmatched"), F.lit(0))
    rates_ = {"precision_": F.col("n_true") / total, "fake_rate": F.col("n_false") / total, "recall": F.col("n_matched") / truth}
    return seeds.join(tracks, "k").drop("k").withColumns(rates_)


def exact_matcher(links: DataFrame, meas_particle: DataFrame) -> DataFrame:
    """Smallest particle that contributes as often as the track has links."""
    size = links.groupBy("track_id").agg(F.count("*").alias("n"))
    rows = contributions(links, meas_particle).join(size, "track_id").where("n_hits = n")
    return rows.groupBy("track_id").agg(F.min("particle_id").alias("particle_id"))


def stepped_matcher(links: DataFrame, meas_particle: DataFrame, ratio: float) -> DataFrame:
    """Particle with the most hits, if more than ``ratio`` of the track's links; ties to the smaller id."""
    size = links.groupBy("track_id").agg(F.count("*").alias("n"))
    rows = contributions(links, meas_particle).join(size, "track_id").where((F.col("n_hits") > F.lit(ratio) * F.col("n")) & (F.col("n_hits") <= F.col("n")))
    return rows.groupBy("track_id").agg(F.min(F.struct((-F.col("n_hits")).alias("less"), "particle_id")).alias("b")).select("track_id", F.col("b.particle_id").alias("particle_id"))


def dominant_measurement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Clusters against truth cells on (event, module, channels): shared cells, and the main particle of each cluster."""
    n = found.join(truth, ["event_id", "module_index", "channel0", "channel1"]).groupBy("cluster_id", "particle_id").agg(F.count("*").alias("n_cells"))
    by = Window.partitionBy("cluster_id").orderBy(F.desc("n_cells"), "particle_id")
    return n.withColumn("rank", F.row_number().over(by).cast("long"))


def time_ordered(hits: DataFrame) -> DataFrame:
    """Hits of every particle in the order of time."""
    by = Window.partitionBy("event_id", "particle_id").orderBy("time_ns", "hit_id")
    return hits.withColumn("place", (F.row_number().over(by) - 1).cast("long"))


def trim_events(tables: dict[str, DataFrame], particle_ids: DataFrame) -> dict[str, DataFrame]:
    """Rows of the given particles in all tables, with measurements numbered densely anew.

    ``tables``: particles, hits, hit_map, measurements, cells (the last two with meas_id).
    """
    keep = particle_ids.select("particle_id").distinct()
    particles = tables["particles"].join(keep, "particle_id", "left_semi")
    hits = tables["hits"].join(keep, "particle_id", "left_semi")
    hit_map = tables["hit_map"].join(hits.select("hit_id"), "hit_id", "left_semi")
    kept = tables["measurements"].join(hit_map.select("meas_id").distinct(), "meas_id", "left_semi")
    new = kept.select("event_id", "meas_id").distinct().withColumn("new_id", (F.row_number().over(Window.partitionBy("event_id").orderBy("meas_id")) - 1).cast("long")).drop("event_id")
    out = {"particles": particles, "hits": hits}
    for name, df in (("hit_map", hit_map), ("measurements", kept), *((n, tables[n]) for n in tables if n not in ("particles", "hits", "hit_map", "measurements"))):
        out[name] = df.join(new, "meas_id").drop("meas_id").withColumnRenamed("new_id", "meas_id")
    return out
