"""Hybrid ranking: vector, BM25, symbol and graph scores merged by weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import like_any_case


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.5
    bm25: float = 0.2
    symbol: float = 0.2
    graph: float = 0.1

    def __post_init__(self):
        total = self.semantic + self.bm25 + self.symbol + self.graph
        if not 0.99 <= total <= 1.01:
            raise ValueError(f"weights sum to {total}, not 1")


def candidates(limit: int, max_limit: int = 50, multiplier: int = 5) -> int:
    """Rows that each leg contributes."""
    return min(limit, max_limit) * multiplier


def symbol_leg(queries: DataFrame, symbols: DataFrame, chunks: DataFrame, first: int = 10) -> DataFrame:
    """query_id, id, score: half a point for each of the first matching symbols (by name, id) of a chunk's file, 1 at most.

    queries: query_id, text; symbols: symbol_id, name, file; chunks: id, file. A symbol matches if its
    name holds the whole query text, in any case.
    """
    hits = symbols.join(F.broadcast(queries.select("query_id", "text")), like_any_case(F.col("name"), F.col("text")))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("name", "symbol_id"))).where(F.col("n") <= first)
    per_file = hits.groupBy("query_id", "file").agg(F.least(F.lit(1.0), 0.5 * F.count(F.lit(1))).alias("score"))
    return chunks.select("id", "file").join(per_file, "file").select("query_id", "id", "score")


def fuse(legs: dict[str, DataFrame], weights: Weights = Weights(), limit: int = 10, min_score: float = 0.05) -> DataFrame:
    """query_id, rank, id, score, semantic, bm25, symbol, graph from legs (query_id, id, score).

    One aggregation over the union of the legs stands for the outer joins; a missing score is 0. Scores are
    rounded to 6 digits before ties are broken by id.
    """
    names = ("semantic", "bm25", "symbol", "graph")
    rows = None
    for name, leg in legs.items():
        part = leg.select("query_id", "id", *[(F.col("score") if n == name else F.lit(None).cast("double")).cast("double").alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy("query_id", "id").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
    score = sum((F.col(n) * getattr(weights, n) for n in names), F.lit(0.0))
    scored = each.withColumn("score", F.round(score, 6)).where(F.col("score") >= min_score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "id", "score", *names)
