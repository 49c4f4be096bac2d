"""Vector search: exact top-k by inner product in blocks of queries, with filters; optional k-means cells."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.ingest import fresh_folder

#: Queries that are sent to the executors at once.
BLOCK = 2048
#: Blocks whose searches are one plan.
BLOCKS = 16
#: Vectors that a task scores at once.
ROWS = 1024
INDEX_TYPES = ("flat", "hnsw", "ivf")


def check_index_type(kind: str) -> str:
    if kind not in INDEX_TYPES:
        raise ValueError(f"unknown index type {kind!r}; known: {', '.join(INDEX_TYPES)}")
    return kind


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The same rows; fails on a vector of another size."""
    wrong = F.size(column) != dimension
    return vectors.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, got "), F.size(column)))).otherwise(F.col(column)))


def dot(a, b):
    """Inner product of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(score):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _best(ids: list, matrix: np.ndarray, k: int):
    """The k best (largest score, then smallest id) of each query over all batches of a task; scores of ROWS vectors are held at once."""
    rows_at_once = ROWS  # executors have no copy of this module

    def merged(held, found):
        query, score, own = (np.concatenate(x) for x in zip(held, found, strict=True))
        order = np.lexsort((own, -score, query))
        query, score, own = query[order], score[order], own[order]
        first = np.searchsorted(query, query)  # where the query's rows begin
        keep = np.arange(len(query)) - first < k
        return query[keep], score[keep], own[keep]

    def run(batches):
        held = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(matrix @ flat.reshape(part.num_rows, -1).T, 6)
                if part.num_rows > k and not np.isfinite(floor).all():
                    floor = np.fmax(floor, np.partition(scores, part.num_rows - k, axis=1)[:, part.num_rows - k])
                rows, cols = np.nonzero(scores >= floor[:, None])  # ties at the edge all stay
                held = merged(held, (rows, scores[rows, cols], part.column(0).to_numpy(zero_copy_only=False)[cols]))
                full = np.bincount(held[0], minlength=len(ids)) == k
                ends = np.searchsorted(held[0], np.arange(len(ids)), side="right")
                floor[full] = held[1][ends[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[held[0]]), pa.array(held[2]), pa.array(held[1])], names=["query_id", "id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, score of the k largest inner products per query; ties by id.

    vectors: id long, embedding; queries: query_id long, embedding. Each task keeps its own k best per
    query before anything is shuffled. Null embeddings match nothing. The results of every BLOCKS blocks of
    queries are written, so that a plan holds no more matrices than these.
    """
    spark = vectors.sparkSession
    own = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    folder, written, planned, block = f"{fresh_folder(spark)}/knn", 0, [], []

    def ranked() -> DataFrame:
        parts = functools.reduce(DataFrame.union, planned)
        rows = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
        return rows.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def plan() -> None:
        found = _best([q for q, _ in block], np.array([v for _, v in block], np.float64), k)
        planned.append(own.mapInArrow(found, "query_id long, id long, score double"))
        block.clear()

    for row in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        if len(planned) == BLOCKS:
            ranked().write.parquet(f"{folder}/{written}")
            written += 1
            planned.clear()
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            plan()
    if block:
        plan()
    out = [spark.read.parquet(*[f"{folder}/{i}" for i in range(written)])] if written else []
    out += [ranked()] if planned else []
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    return functools.reduce(DataFrame.union, out)


def topk(vectors: DataFrame, query: list[float], k: int = 10, where=None) -> DataFrame:
    """rank, id, score (clamped to 0..1) for one query vector; `where` filters before the search, so k rows come."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select("id", F.round(clamp(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")


def overfetch(vectors: DataFrame, query: list[float], k: int, where, factor: int = 5) -> DataFrame:
    """The filter after a search for factor * k: may return fewer than k."""
    found = topk(vectors, query, k * factor).join(vectors.where(where).select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(k)


def cells(vectors: DataFrame, n_cells: int, sample: int = 10_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(vectors with cell, centres) by MLlib k-means fitted on about `sample` vectors: an approximate index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    share = min(1.0, sample / max(1, vectors.count()))
    model = KMeans(k=n_cells, seed=seed, featuresCol="v", predictionCol="cell").fit(rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(rows).drop("v"), centres.select("cell", vector_to_array(array_to_vector("centre")).alias("centre"))


def probe(indexed: DataFrame, centres: DataFrame, query: list[float], k: int, n_probe: int) -> DataFrame:
    """Approximate topk: only the n_probe cells whose centres are nearest."""
    near = sorted(centres.collect(), key=lambda r: -float(np.dot(r["centre"], query)))[:n_probe]
    return topk(indexed.where(F.col("cell").isin([r["cell"] for r in near])), query, k)
