"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components
from .. import workers

__all__ = ["Scratch", "connected_components", "delete", "shared_dir", "smallest_by_hash", "with_workers", "work_folder"]

#: Bytes of a batch that goes to a Python worker: the default lets texts of hundreds of megabytes meet in one.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASES: dict[str, str] = {}
_FOLDER: ContextVar[str | None] = ContextVar("work folder", default=None)


def with_workers(spark: SparkSession) -> SparkSession:
    """Python workers of the session can import this package and get batches of ``BATCH_BYTES`` at most."""
    limit = spark.conf.get(_BATCH_LIMIT).rstrip("bB")
    if limit.isdigit() and int(limit) > BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return workers.with_workers(spark)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when the driver ends.

    A session on this machine alone may do without that setting and gets a temporary folder; on a
    cluster executors wouldn't find each other's files there, so the setting is required.
    """
    key = spark.sparkContext.applicationId
    if key not in _BASES:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="trackloom-")
            atexit.register(_remove_local, base)
        _BASES[key] = f"{base.rstrip('/')}/trackloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _BASES[key])
    return _BASES[key]


def _remove_local(base: str) -> None:
    import shutil

    shutil.rmtree(base, ignore_errors=True)


def _remove(spark: SparkSession, base: str) -> None:
    with suppress(Exception):  # a session that has ended can't remove its folder any more
        delete(spark, base)


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[None]:
    """Work tables that operators write within go when it ends: their results must have been written by then."""
    base = f"{shared_dir(spark)}/work-{uuid.uuid4().hex[:8]}"
    before = _FOLDER.set(base)
    try:
        yield
    finally:
        _FOLDER.reset(before)
        delete(spark, base)


class Scratch:
    """Written tables of one operator call; ``drop`` frees those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self._made: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the files: the lineage ends here."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._made.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df, path in list(self._made):
            if any(df is x for x in frames):
                self._made.remove((df, path))
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def smallest_by_hash(rows: DataFrame, total: int, many: int) -> DataFrame:
    """The ``many`` rows with the smallest hash of doc_id; ``total`` is the number of rows.

    A bound on the hash that leaves a few more than ``many`` comes first, so that what meets in one task
    to be ordered doesn't grow with the number of partitions.
    """
    at = F.xxhash64("doc_id")
    share = (many + 8 * many**0.5 + 64) / max(total, 1)
    if share < 1:
        rows = rows.where(at < int(share * 2**64) - 2**63)
    return rows.orderBy(at, "doc_id").limit(many)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges to (id, root): root is the smallest id reachable."""
    return components.connected_components(edges, lambda df: scratch.keep(df, "cc"), scratch.drop)
