"""Approximate nearest neighbours by inner product: a robust-pruned graph per shard, beam search.

Equal vectors are one point of an index; a point carries its smallest ids, as many as a result can
use.  Points are dealt by hash to shards of about ``shard_size``; each shard is built once and stored
as one row.  A shard cuts its points into slices of like norm with a pruned graph each, and ranks the
beam by inner product, see ``Shard``.  Queries travel in blocks to every shard; what is found is scored
in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphindex import GraphIndex
from .shared import Scratch, with_workers


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: rows with finite, not all-zero vectors of the table's most frequent length; floats stay floats."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    return rows.join(F.broadcast(most.select("dim")), F.size("vec") == F.col("dim")).drop("dim")  # one row


#: Norms within a slice differ by this factor at most.
RATIO = 1.12


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows (not all zero), without overflow."""
    top = np.abs(x).max(1).astype(np.float64)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


class Shard:
    """Points in slices of like norm, from the largest down, with a graph for each.

    Within a slice norms differ by a factor of ``RATIO`` at most, so what is near by inner product is near
    by distance too.  Graphs are built on the vectors divided by the slice's largest norm.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, slices: list[tuple[int, int, int, float]], links: np.ndarray, degree: int):
        self.x, self.order, self.slices, self.links, self.degree = x, order, slices, links, degree

    @classmethod
    def build(cls, x: np.ndarray, *, degree: int, beam: int, alpha: float) -> Shard:
        norm = norms(x)
        order = np.argsort(-norm, kind="stable")
        links, slices, at = [], [], 0
        while at < len(x):
            top = float(norm[order[at]])
            end = int(np.searchsorted(-norm[order], -top / RATIO, side="right"))
            graph = GraphIndex(x[order[at:end]] / top, degree=degree, beam=beam, alpha=alpha)
            links.append(graph.links)
            slices.append((at, end, graph.entry, top))
            at = end
        return cls(x, order, slices, np.concatenate(links), degree)

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Points (-1: none) and inner products in double precision of the ``k`` nearest found per row.

        Nearest first, ties to the smaller point.
        """
        q64, q_norm = q.astype(np.float64), norms(q)
        ids, score = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        for at, end, entry, top in self.slices:
            # a slice whose largest product can't reach the k-th best found is left out: nothing is lost
            rows = np.flatnonzero(q_norm * top >= score[:, -1] * (1 - 1e-9))
            if not len(rows):
                continue
            graph = GraphIndex(self.x[self.order[at:end]] / top, links=self.links[at:end], entry=entry)
            got, _ = graph.search(q[rows] / q_norm[rows, None], min(max(beam, k), end - at), product=True)
            there = got >= 0
            got = np.where(there, self.order[at:end][got], -1)
            value = np.where(there, np.einsum("id,ijd->ij", q64[rows], self.x[got].astype(np.float64)), -np.inf)
            both_i, both_s = np.concatenate((ids[rows], got), 1), np.concatenate((score[rows], value), 1)
            by = np.lexsort((both_i, -both_s), axis=1)[:, :k]
            ids[rows], score[rows] = np.take_along_axis(both_i, by, 1), np.take_along_axis(both_s, by, 1)
        return ids, score


_SHARD = "shard int, points binary, vectors binary, norm_order binary, links binary, slices array<struct<a:int,b:int,entry:int,top:double>>"


def _build(degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        x = _matrix(table.column("vec"))
        made = Shard.build(x, degree=degree, beam=beam, alpha=alpha)
        raw = {"points": table.column("point").to_numpy(), "vectors": x, "norm_order": made.order, "links": made.links}
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("entry", pa.int32()), ("top", pa.float64())]))
        slices = [dict(zip("ab", s[:2], strict=True)) | {"entry": s[2], "top": s[3]} for s in made.slices]
        columns = {name: pa.array([value.tobytes()], pa.binary()) for name, value in raw.items()}
        return pa.table({"shard": table.column("shard").slice(0, 1), **columns, "slices": pa.array([slices], kind)})

    return run


def _search(k: int, beam: int, degree: int, dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                points = np.frombuffer(raw["points"], np.int64)
                x, q = (np.frombuffer(raw[n], kind).reshape(-1, dim) for n in ("vectors", "q_vectors"))
                slices = [(s["a"], s["b"], s["entry"], s["top"]) for s in raw["slices"]]
                shard = Shard(x, np.frombuffer(raw["norm_order"], np.int64), slices, np.frombuffer(raw["links"], np.int32).reshape(-1, degree), degree)
                q_ids = np.frombuffer(raw["q_points"], np.int64)
                step = max(64, min(1024, (1 << 24) // max(1, len(x))))
                for at in range(0, len(q), step):
                    ids, score = shard.search(q[at : at + step], k, beam)
                    r, c = np.nonzero(ids >= 0)
                    columns = [pa.array(q_ids[at + r]), pa.array(points[ids[r, c]]), pa.array(score[r, c])]
                    yield pa.RecordBatch.from_arrays(columns, ["q_point", "point", "score"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    x = _matrix(table.column("vec"))
    ids = table.column("point").to_numpy()
    return pa.table({"block": table.column("block").slice(0, 1), "q_points": pa.array([ids.tobytes()], pa.binary()), "q_vectors": pa.array([x.tobytes()], pa.binary())})


def nearest(
    vectors: DataFrame, *, every: int = 100, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    shard_size: int = 16384, degree: int = 32, beam: int = 64, search_beam: int = 160, alpha: float = 1.2, block: int = 2048,
) -> DataFrame:
    """The ``k`` rows of largest inner product for every query (rows whose id is divisible by ``every``).

    Returns ``query_id, rank, vec_id, score``: nearest first, ties to the smaller id; the score is the
    inner product in double precision.  A query never finds itself but does find its copies.  Vectors
    that are null, empty, all zero, or hold null or non-finite components, and vectors of another
    length than most, take no part.  Floats and doubles are scored as they are, other numbers as doubles.
    Ids are unique; rows with a null id take no part.  An empty table gives an empty result.
    """
    spark = with_workers(vectors.sparkSession)
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(usable(vectors, id_col, vec_col), "rows")
    # the k + 1 smallest ids of every vector; the group limit runs before the shuffle
    by_vec = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(by_vec)).where(F.col("nth") <= k + 1)
    points = few.groupBy("vec").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = scratch.keep(points, "points")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    info = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not info["n"]:
        return empty
    kind = "f4" if points.schema["vec"].dataType.simpleString() == "array<float>" else "f8"
    shards = max(1, round(info["n"] / shard_size))
    dealt = points.select(F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"), "point", "vec")
    index = scratch.keep(dealt.groupBy("shard").applyInArrow(_build(degree, beam, alpha), _SHARD), "index")

    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    queries = scratch.keep(asked.join(points.select("vec", "point"), "vec").select(F.col("id").alias("query_id"), "point"), "queries")
    q_points = queries.select("point").distinct().join(points.select("point", "vec"), "point")
    blocks = max(1, -(-info["n"] // (every * block)))
    packed = q_points.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_pack, "block int, q_points binary, q_vectors binary")
    visits = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(F.col("shard"), F.col("block"))
    found = visits.join(index.hint("shuffle_hash"), "shard").drop("shard", "block").mapInArrow(_search(k + 1, search_beam, degree, info["dim"], kind), "q_point long, point long, score double")
    # k + 1 points of a query, from all shards, before their copies are told apart
    best = Window.partitionBy("q_point").orderBy(F.desc("score"), "point")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    top = top.join(points.select("point", "ids"), "point").select("q_point", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("q_point").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("q_point").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    # one list serves all copies of a query; each leaves itself out
    own = queries.join(lists, queries["point"] == lists["q_point"])
    own = own.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """20 nearest of every row whose vec_id is divisible by 20, against all other rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)
