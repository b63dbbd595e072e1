"""Sharing of measurements between tracks, voting, and greedy ambiguity resolution."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inverse_index(links: DataFrame) -> DataFrame:
    """meas_id to its different tracks."""
    return links.groupBy("meas_id").agg(F.sort_array(F.collect_set("track_id")).alias("track_ids"))


def unique_measurements(links: DataFrame) -> DataFrame:
    return links.select("meas_id").distinct()


def deduplicated(links: DataFrame) -> DataFrame:
    """One link per track and measurement, at its first position."""
    return links.groupBy("track_id", "meas_id").agg(F.min("pos").alias("pos"))


def accepted_counts(links: DataFrame) -> DataFrame:
    """Per measurement: how many links and how many different tracks."""
    return links.groupBy("meas_id").agg(F.count("*").alias("n_links"), F.countDistinct("track_id").alias("n_tracks"))


def sharing(links: DataFrame) -> DataFrame:
    """Per track: links, links to measurements of several tracks (repeats count), and their share."""
    owners = links.groupBy("meas_id").agg(F.countDistinct("track_id").alias("n_tracks"))
    per_track = links.join(owners, "meas_id").groupBy("track_id").agg(F.count("*").alias("n_meas"), F.count_if(F.col("n_tracks") > 1).alias("n_shared"))
    return per_track.withColumn("rel_shared", F.col("n_shared") / F.col("n_meas"))


def inverted_ids(tracks: DataFrame) -> DataFrame:
    """Place of every track in the order from best to worst within its event."""
    by = Window.partitionBy("event_id").orderBy(F.desc("pval"), "track_id")
    return tracks.select("event_id", "track_id", (F.row_number().over(by) - 1).cast("long").alias("place"))


def votes(tracks: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(meas_id, track_id) of the ``k`` best tracks by p-value of every measurement."""
    known = deduplicated(links).join(tracks.select("track_id", "pval"), "track_id")
    by = Window.partitionBy("meas_id").orderBy(F.desc("pval"), "track_id")
    return known.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("meas_id", "track_id", "rank")


def voted(tracks: DataFrame, links: DataFrame, k: int, fraction: float = 0.5) -> DataFrame:
    """Tracks that at least ``fraction`` of their measurements vote for."""
    count = votes(tracks, links, k).groupBy("track_id").agg(F.count("*").alias("n_votes"))
    size = links.groupBy("track_id").agg(F.countDistinct("meas_id").alias("n_meas"))
    return size.join(count, "track_id").where(F.col("n_votes") >= fraction * F.col("n_meas"))


def resolve_event(track_ids: list[int], pvals: list[float], meas: list[list[int]], *, min_meas: int = 3, max_shared: int = 1, max_iterations: int | None = None) -> list[int]:
    """Positions of the tracks that stay.

    Tracks with fewer than ``min_meas`` links go first.  Then, while any track shares ``max_shared``
    links or more, the worst goes: largest share, then smallest p-value, then the larger id.  A measurement
    left with one owner is no longer shared; the owner's count falls by its links to it.
    """
    alive = {i for i, m in enumerate(meas) if len(m) >= min_meas}
    owners: dict[int, set[int]] = defaultdict(set)
    for i in alive:
        for m in meas[i]:
            owners[m].add(i)
    times = {i: Counter(meas[i]) for i in alive}
    shared = {i: sum(n for m, n in times[i].items() if len(owners[m]) > 1) for i in alive}
    key = lambda i: (-shared[i] / len(meas[i]), pvals[i], -track_ids[i], i)
    heap = [key(i) for i in alive]
    heapq.heapify(heap)
    crowded = sum(s >= max_shared for s in shared.values())
    done = 0
    while crowded and alive and (max_iterations is None or done < max_iterations):
        top = heapq.heappop(heap)
        worst = top[3]
        if worst not in alive or top != key(worst):
            continue  # an entry from before its count fell
        done += 1
        alive.remove(worst)
        crowded -= shared[worst] >= max_shared
        for m in times[worst]:
            left = owners[m]
            left.discard(worst)
            if len(left) == 1:
                (other,) = left
                was = shared[other]
                shared[other] -= times[other][m]
                crowded -= was >= max_shared > shared[other]
                heapq.heappush(heap, key(other))
    return sorted(alive)


def greedy_resolution(tracks: DataFrame, links: DataFrame, *, min_meas: int = 3, max_shared: int = 1) -> DataFrame:
    """event_id and track_id of the tracks that the greedy resolution of each event keeps.

    The eviction order within an event is sequential by definition, so an event is one group; its size
    doesn't grow with the number of events.
    """
    lists = links.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "meas_id"))), lambda s: s["meas_id"]).alias("meas"))
    rows = tracks.select("event_id", "track_id", "pval").join(lists, "track_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("track_id")
        ids = table.column("track_id").to_pylist()
        keep = resolve_event(ids, table.column("pval").to_pylist(), table.column("meas").to_pylist(), min_meas=min_meas, max_shared=max_shared)
        return table.take(pa.array(np.array(keep, np.int64))).select(["event_id", "track_id"])

    return rows.groupBy("event_id").applyInArrow(run, "event_id long, track_id long")


def parallel_resolution(tracks: DataFrame, links: DataFrame, keep, *, min_meas: int = 3) -> DataFrame:
    """``greedy_resolution`` with ``max_shared`` = 1, many evictions at a time.

    Tracks that are not connected by shared measurements don't affect each other, and with this limit
    the worst track of the event always belongs to a component that still shares: so components are
    resolved independently, and a large event is no longer one group.
    """
    from .components import connected_components

    known = tracks.select("event_id", "track_id", "pval")
    enough = links.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_meas).select("track_id")
    rows = keep(links.join(enough, "track_id").join(known, "track_id").select("event_id", "track_id", "meas_id", "pos", "pval"))
    first = rows.groupBy("event_id", "meas_id").agg(F.min("track_id").alias("a"))
    shared = rows.join(first, ["event_id", "meas_id"]).select("a", F.col("track_id").alias("b")).where("a <> b")
    root = connected_components(shared, keep).withColumnRenamed("id", "track_id")
    alone = rows.select("event_id", "track_id").distinct().join(root, "track_id", "left_anti")
    tied = rows.join(root, "track_id")
    lists = tied.groupBy("event_id", "root", "track_id", "pval").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "meas_id"))), lambda s: s["meas_id"]).alias("meas"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("track_id")
        kept = resolve_event(table.column("track_id").to_pylist(), table.column("pval").to_pylist(), table.column("meas").to_pylist(), min_meas=min_meas)
        return table.take(pa.array(np.array(kept, np.int64))).select(["event_id", "track_id"])

    return lists.groupBy("root").applyInArrow(run, "event_id long, track_id long").unionByName(alone)
