"""Shared pieces: scratch tables in the cluster's shared folder, connected components, code shipping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}


#: Rows of whole texts that are sent to a Python worker at once.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(module_name: str) -> None:
    """Pickle functions of this module by value, so executors need no copy of the package.

    Every operator that runs Python calls this: it also lowers the rows of an Arrow batch where the session
    has Spark's default, because batches of whole texts are held several times on either side.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        if spark.sparkContext.master.split("[")[0] == "local":
            _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="ctxspark-")
        else:
            _OWN_ROOT[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _OWN_ROOT[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; `drop` and leaving the block delete them.

    `result` writes a table that outlives the block, because a lazy DataFrame is handed to the caller.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for path in self._paths:
            self._delete(path)
        self._paths.clear()
        free_shuffles(self.spark)

    def _delete(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _path(self, tag: str) -> str:
        return f"{scratch_root(self.spark)}/{tag}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
        df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
        path = self._path(tag)
        self._paths.add(path)  # also deleted if the write fails
        out = self._write(df, path, codec)
        out._scratch_path = path
        return out

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        return self._write(df, self._path(tag))

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "__dict__", {}).get("_scratch_path")
            if path in self._paths:
                self._paths.remove(path)
                self._delete(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced, and the driver give memory back."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Have executors collect garbage now: a JVM gives heap back to the system only then, and Python workers beside it need the memory."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


#: Up to so many edges (16 bytes each) have their components found on the driver; beyond it, in rounds of joins.
FEW_EDGES = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while (low[x] != low[y]).any():
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))  # a root moves to a smaller one
        while (low != low[low]).any():
            low = low[low]
    return nodes, nodes[low]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components: of FEW_EDGES on the driver, else by alternating large-star and small-star rounds over DataFrames.

    edges: a long, b long. Returns node long, comp long (the smallest node reachable); nodes that no
    edge mentions are absent. Self-loops and repeated edges are allowed; an empty table gives an empty one.
    Minima are found with partial aggregation and joined back, so a node with very many neighbours is
    neither collected nor expanded.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.keep(e.distinct(), "edges")
    if e.count() <= FEW_EDGES:
        few = e.toArrow()
        nodes, comps = roots(*[few.column(c).to_numpy() for c in ("u", "v")])
        scratch.drop(e)
        return scratch.spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array(comps, pa.int64())}))
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        small = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        new = scratch.keep(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        scratch.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(nodes.select(F.col("comp").alias("node"), "comp").distinct())


@contextlib.contextmanager
def conf(spark: SparkSession, **settings):
    """Set SQL settings (with _ for .) within a block and put the old values back."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim() -> None:
    """Give a worker's freed memory back to the system: workers outlive their tasks, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch, column: int, rows: int = 1024, size: int = 2_000_000):
    """Parts of an Arrow batch, bounded in rows and in bytes of one text column (one row at least): bounds a worker's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows], dtype=np.int64), size)))
        yield batch.slice(at, n)
        at += n
    trim()


def pruning(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """Keys of a join, to be broadcast if there are at most so many rows (of a few bytes each); above, it is a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys
