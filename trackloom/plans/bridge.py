"""Bridge views: the provided tables seen as detector data, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.batches import by_groups, dealt

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS: dict[str, str] = {
    # duplicates of (event, module, channels) stay: what a cell reader sees
    "raw_cells": """
        SELECT CAST(FLOOR(l_orderkey / 1000.0e0) AS BIGINT) AS event_id, CAST(l_suppkey % 50 AS INT) AS module_index,
               CAST(l_partkey % 48 AS INT) AS channel0, CAST(l_orderkey % 48 AS INT) AS channel1,
               CAST(l_quantity AS BIGINT) AS activation, CAST(l_linenumber AS BIGINT) AS time_ticks,
               l_orderkey * 100 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_no
        FROM lineitem""",
    "cells": """
        SELECT event_id, module_index, channel0, channel1, CAST(SUM(activation) AS BIGINT) AS activation,
               ((event_id * 50 + module_index) * 48 + channel1) * 48 + channel0 AS cell_id
        FROM raw_cells GROUP BY event_id, module_index, channel0, channel1""",
    "modules": """
        SELECT DISTINCT CAST(s_suppkey % 50 AS INT) AS module_index, CAST(s_suppkey % 50 * 1048576 + 7 AS BIGINT) AS geometry_id,
               CAST(s_suppkey % 50 % 5 AS INT) AS design_id, (s_suppkey % 50) * 0.125e0 AS shift0, 0.0e0 AS shift1
        FROM supplier""",
    "designs": """
        SELECT DISTINCT design_id, 0.0625e0 * (1 + design_id) AS pitch0, 0.125e0 * (1 + design_id) AS pitch1, -1.5e0 AS min0, -3.0e0 AS min1
        FROM modules""",
    # each order is one curved track, each line one layer; only + - * / sqrt, so both engines agree bit by bit
    "spacepoints": """
        SELECT ev AS event_id, base * 100 + ROW_NUMBER() OVER (PARTITION BY base ORDER BY l_suppkey, l_extendedprice) AS spacepoint_id, x, y, z FROM (
          SELECT ev, base, l_suppkey, l_extendedprice, (a * r - b * s) / NULLIF(l, 0e0) AS x, (b * r + a * s) / NULLIF(l, 0e0) AS y, z FROM (
            SELECT ev, base, l_suppkey, l_extendedprice, a, b, SQRT(CAST(a * a + b * b AS DOUBLE)) AS l, CAST(r AS DOUBLE) AS r, CAST(r * r AS DOUBLE) * kap AS s, z0 + cot * r AS z FROM (
              SELECT CAST(FLOOR(l_orderkey / 100.0e0) AS BIGINT) AS ev, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS base, l_suppkey, l_extendedprice,
                     ((l_orderkey * 7919) % 401) - 200 AS a, ((l_orderkey * 104729) % 397) - 198 AS b,
                     32 + 24 * (l_linenumber - 1) + (l_partkey % 3) AS r, ((l_orderkey % 11) - 5) * 4.0e-5 AS kap,
                     CAST((l_orderkey % 41) * 5 - 100 AS DOUBLE) AS z0, ((l_orderkey % 23) - 11) * 0.1e0 AS cot
              FROM lineitem) AS shaped WHERE a <> 0 AND b <> 0) AS rotated) AS placed""",
    "tracks": """
        SELECT CAST(FLOOR(o_orderkey / 400.0e0) AS BIGINT) AS event_id, o_orderkey AS track_id, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 AS pval,
               CAST(2 * (1 + o_orderkey % 9) AS BIGINT) AS ndf, CAST((o_orderkey * 31) % 4001 AS DOUBLE) / 128e0 AS chi2,
               CAST(o_orderkey % 9 AS BIGINT) AS fit_outcome
        FROM orders""",
    "track_links": """
        SELECT l_orderkey AS track_id, l_partkey AS meas_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos
        FROM lineitem""",
    "particles": """
        SELECT c_custkey AS particle_id, CAST(c_custkey % 3 - 1 AS BIGINT) AS charge, CAST(c_custkey % 4 AS BIGINT) AS process,
               CAST((c_custkey * 37) % 401 - 200 AS DOUBLE) / 64e0 AS px, CAST((c_custkey * 53) % 397 - 198 AS DOUBLE) / 64e0 AS py,
               CAST((c_custkey * 71) % 801 - 400 AS DOUBLE) / 64e0 AS pz, CAST((c_custkey * 13) % 301 - 150 AS DOUBLE) AS vz,
               CAST((c_custkey * 29) % 401 - 200 AS DOUBLE) AS vx, CAST((c_custkey * 43) % 307 - 153 AS DOUBLE) AS vy
        FROM customer""",
    "particle_count": "SELECT COUNT(*) AS n FROM customer",
    # every measurement comes from one particle, every seventh from a second one as well
    "meas_particle": """
        SELECT p_partkey AS meas_id, 1 + (p_partkey * 31) % n AS particle_id FROM part, particle_count
        UNION ALL
        SELECT p_partkey AS meas_id, 1 + (p_partkey * 31 + 1) % n AS particle_id FROM part, particle_count WHERE p_partkey % 7 = 0""",
    "candidate_links": """
        SELECT o_custkey AS seed_id, o_orderkey AS link_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS step,
               LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_id,
               CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_hole, CAST(o_orderkey % 97 AS BIGINT) AS chi2
        FROM orders""",
    "hits": """
        SELECT CAST(FLOOR(l_orderkey / 100.0e0) AS BIGINT) AS event_id, l_orderkey * 1000 + l_linenumber AS hit_id, 1 + l_orderkey % 150 AS particle_id,
               CAST(l_suppkey % 50 AS INT) AS module_index, CAST(l_quantity AS DOUBLE) AS time_ns, l_extendedprice AS tx
        FROM lineitem""",
}

_WORD = re.compile(r"\b(FROM|JOIN)\s+((?:\w+\s*,\s*)*\w+)", re.IGNORECASE)


def needs(sql: str) -> list[str]:
    """The views that a statement names after FROM or JOIN, in the order in which they must exist."""
    found: list[str] = []
    for m in _WORD.finditer(sql):
        for name in re.split(r"\s*,\s*", m[2]):
            if name in VIEWS and name not in found:
                found += [x for x in needs(VIEWS[name]) if x not in found]
                found.append(name)
    return found


def duck(sql: str, recursive: bool = False) -> str:
    """``sql`` for DuckDB, with the bridge views it names put before it."""
    body = sql.strip()
    own = body[5:] if body[:5].upper() == "WITH " else None
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needs(sql))
    head = "WITH RECURSIVE " if recursive else "WITH "
    if own is not None:
        return f"{head}{views},\n{own}" if views else f"{head}{own}"
    return f"{head}{views}\n{body}" if views else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table or a bridge view."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {m for found in _WORD.finditer(sql) for m in re.split(r"\s*,\s*", found[2]) if m in VIEWS or m in BASE}
    text = _WORD.sub(lambda m: f"{m[1]} " + ", ".join(f"{{{x}}} AS {x}" if x in used else x for x in re.split(r"\s*,\s*", m[2])), sql)
    return spark.sql(text, **{x: table(spark, sf_dir, x) for x in used})


#: Of the view ``spacepoints``: what numbers the points of one base, the base, the event, and the lines that make points.
_NUMBER = "ROW_NUMBER() OVER (PARTITION BY base ORDER BY l_suppkey, l_extendedprice)"
_BASE = "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey"
_EVENT = "CAST(FLOOR(l_orderkey / 100.0e0) AS BIGINT)"
_MADE = "((l_orderkey * 7919) % 401) - 200 <> 0 AND ((l_orderkey * 104729) % 397) - 198 <> 0 AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL"


def _numbered(table: pa.Table, starts: np.ndarray) -> pa.Table:
    number = np.arange(table.num_rows) - np.repeat(starts, np.diff(starts, append=table.num_rows)) + 1
    return table.select(["l_orderkey", "l_linenumber", "l_partkey"]).append_column("l_suppkey", pa.array(number, pa.int64()))


def points_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``spacepoints`` that have a place, those of an event in one partition.

    A place follows from three numbers of the line.  Only those are shuffled, packed, and by event after the points
    are numbered: lines of one base can lie in several events.  The view's statement is then put on them, with the
    number where it was counted.
    """
    lines = table(spark, sf_dir, "lineitem").where(_MADE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("l_orderkey", "l_linenumber", "l_partkey")) + ", l_suppkey bigint"
    whole = dealt(lines, F.expr(_BASE)).withColumn("base", F.expr(_BASE))
    numbered = by_groups(whole, ["base"], ["l_suppkey", "l_extendedprice"], _numbered, schema, together=True)
    counted = dealt(numbered, F.expr(_EVENT)).withColumn("l_extendedprice", F.lit(0.0))
    sql = VIEWS["spacepoints"].replace(_NUMBER, "l_suppkey").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(sql, lineitem=counted)
