"""Queries of track sharing, voting and ambiguity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ambiguity as A
from .bridge import duck, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


_OWNED = "WITH owners AS (SELECT meas_id, COUNT(DISTINCT track_id) AS n_tracks FROM track_links GROUP BY meas_id)"


@query("ag6_shared_measurements", _OWNED + """
    SELECT track_id, COUNT(*) AS n_meas, CAST(SUM(CASE WHEN n_tracks > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_shared,
           CAST(SUM(CASE WHEN n_tracks > 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS rel_shared
    FROM track_links JOIN owners USING (meas_id) GROUP BY track_id""")
def ag6(spark, d):
    return A.sharing(table(spark, d, "track_links"))


@query("ag7_accepted_counts", "SELECT meas_id, COUNT(*) AS n_links, COUNT(DISTINCT track_id) AS n_tracks FROM track_links GROUP BY meas_id")
def ag7(spark, d):
    return A.accepted_counts(table(spark, d, "track_links"))


@query("jo15_inverse_index", "SELECT meas_id, STRING_AGG(CAST(track_id AS VARCHAR), ',' ORDER BY track_id) AS track_ids FROM (SELECT DISTINCT meas_id, track_id FROM track_links) AS t GROUP BY meas_id")
def jo15(spark, d):
    return A.inverse_index(table(spark, d, "track_links")).select("meas_id", F.array_join("track_ids", ",").alias("track_ids"))


@query("se1_unique_measurements", "SELECT DISTINCT meas_id FROM track_links")
def se1(spark, d):
    return A.unique_measurements(table(spark, d, "track_links"))


@query("se2_track_dedup", "SELECT track_id, meas_id, MIN(pos) AS pos FROM track_links GROUP BY track_id, meas_id")
def se2(spark, d):
    return A.deduplicated(table(spark, d, "track_links"))


_VOTES = """WITH known AS (SELECT DISTINCT l.track_id, l.meas_id, t.pval FROM track_links l JOIN tracks t USING (track_id)),
    ranked AS (SELECT meas_id, track_id, CAST(ROW_NUMBER() OVER (PARTITION BY meas_id ORDER BY pval DESC, track_id) AS BIGINT) AS rank FROM known),
    votes AS (SELECT * FROM ranked WHERE rank <= 2)"""


@query("so6_best_tips", _VOTES + "SELECT meas_id, track_id, rank FROM votes")
def so6(spark, d):
    return A.votes(table(spark, d, "tracks"), table(spark, d, "track_links"), 2)


@query("al19_measurement_voting", _VOTES + """, counted AS (SELECT track_id, COUNT(*) AS n_votes FROM votes GROUP BY track_id),
    sized AS (SELECT track_id, COUNT(DISTINCT meas_id) AS n_meas FROM track_links GROUP BY track_id)
    SELECT track_id, n_meas, n_votes FROM sized JOIN counted USING (track_id) WHERE n_votes >= 0.5e0 * n_meas""")
def al19(spark, d):
    return A.voted(table(spark, d, "tracks"), table(spark, d, "track_links"), 2)


@query("wi6_inverted_ids", "SELECT event_id, track_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY pval DESC, track_id) - 1 AS BIGINT) AS place FROM tracks")
def wi6(spark, d):
    return A.inverted_ids(table(spark, d, "tracks"))


@query("al28_greedy_resolution")
def al28(spark, d):
    return A.greedy_resolution(table(spark, d, "tracks"), table(spark, d, "track_links"), min_meas=3, max_shared=2)
