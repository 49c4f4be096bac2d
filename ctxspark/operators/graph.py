"""Symbol graph as two tables: name resolution, traversal by frontier joins, shortest paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNRESOLVED = "unresolved::"
MAX_DEPTH = 5


def name_index(symbols: DataFrame, last: bool = False) -> DataFrame:
    """name, symbol_id: the first (or last) symbol by (file_path, line_start, id) under each short or qualified name."""
    names = symbols.select("id", "file_path", "line_start", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    order = F.struct("file_path", "line_start", "id")
    pick = F.max(order) if last else F.min(order)
    return names.groupBy("name").agg(pick.alias("at")).select("name", F.col("at.id").alias("symbol_id"))


def resolve(relationships: DataFrame, index: DataFrame) -> DataFrame:
    """relationships with target_symbol_id by name where it is missing, else `unresolved::<name>`."""
    found = relationships.join(index.select(F.col("name").alias("target_name"), F.col("symbol_id").alias("by_name")), "target_name", "left")
    return found.withColumn("target_symbol_id", F.coalesce("target_symbol_id", "by_name", F.concat(F.lit(UNRESOLVED), "target_name"))).drop("by_name")


def edges_of(resolved: DataFrame) -> DataFrame:
    """src, dst, type, confidence: of several relationships of one pair the last (by seq) counts."""
    at = F.max_by(F.struct("relationship_type", "confidence"), "seq").alias("at")
    return resolved.groupBy(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")).agg(at).select("src", "dst", F.col("at.relationship_type").alias("type"), F.col("at.confidence").alias("confidence"))


def lookup(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """Edges from or to a node, of one type if given."""
    found = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return found if kind is None else found.where(F.col("type") == kind)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence")


def _written(spark: SparkSession, scratch: list[str], df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that the plan of a step doesn't grow with the number of steps."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/_graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(spark: SparkSession, scratch: list[str]) -> None:
    for path in scratch:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def reach(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, node, depth, type, confidence: nodes within `depth` steps, each once, by the edge that finds it first.

    Of edges that find a node in the same step the one from the smallest node counts. The start itself and
    placeholders (`unresolved::...`) are not returned, placeholders not passed. starts: column node.
    Each step is a join of the frontier with the edges and an anti join with what is known; edges are
    written once where several steps read them, and every frontier is, so plans stay as small as one step.
    The result's table outlives the call.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    spark = edges.sparkSession
    frontier = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    if depth == 0:
        return frontier.select("start", "node", F.lit(0).alias("depth"), F.lit("").alias("type"), F.lit(0.0).alias("confidence")).limit(0)
    scratch: list[str] = []
    try:
        edges = edges.where(~F.col("dst").startswith(UNRESOLVED)).select("src", "dst", "type", "confidence")
        edges = _written(spark, scratch, edges) if depth > 1 else edges
        seen = frontier = _written(spark, scratch, frontier)
        parts = []
        for step in range(1, depth + 1):
            found = frontier.join(edges, frontier["node"] == edges["src"])
            found = found.groupBy("start", F.col("dst").alias("node")).agg(F.min(F.struct("src", "type", "confidence")).alias("by"))
            found = found.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(step).alias("depth"), "by.type", "by.confidence")
            kept: list[str] = []
            parts.append(_written(spark, kept, found))
            frontier = parts[-1].select("start", "node")
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
    finally:
        _dropped(spark, scratch)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def dependencies(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    return reach(edges, starts, depth)


def references(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    return reach(reverse(edges), starts, depth)


def callees(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return dependencies(edges, starts, 3).where("type = 'calls'")


def callers(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return references(edges, starts, 3).where("type = 'calls'")


def shortest_path(edges: DataFrame, start: str, target: str) -> DataFrame:
    """step, node of one shortest directed path of any length; empty if there is none. Of equal paths that by the smallest predecessors.

    Breadth first: every step writes the new nodes with their predecessor, so plans don't grow; the path
    is followed back from the target, a node a step.
    """
    spark = edges.sparkSession
    if start == target:
        known = edges.where((F.col("src") == start) | (F.col("dst") == start)).limit(1).count()
        return spark.createDataFrame([(0, start)] if known else [], "step int, node string")
    scratch: list[str] = []
    try:
        edges = _written(spark, scratch, edges.select("src", "dst").distinct())
        levels = [_written(spark, scratch, spark.createDataFrame([(start, None)], "node string, by string"))]
        paths = [scratch[-1]]
        while True:
            seen = spark.read.schema("node string, by string").parquet(*paths)
            step = levels[-1].join(edges, levels[-1]["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("by"))
            levels.append(_written(spark, scratch, step.join(seen.select("node"), "node", "left_anti")))
            paths.append(scratch[-1])
            if levels[-1].where(F.col("node") == target).limit(1).count():
                break
            if levels[-1].isEmpty():
                return spark.createDataFrame([], "step int, node string")
        path = [target]
        for level in reversed(levels[1:]):
            path.append(level.where(F.col("node") == path[-1]).first()["by"])
        return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")
    finally:
        _dropped(spark, scratch)


def counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges: nodes include placeholders and unknown sources."""
    every = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
    return every.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that with the largest order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
