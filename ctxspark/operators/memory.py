"""Agent memory: an append-only log of events and the views over it."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import like_any_case

# Categories; others become general.
CATEGORIES = ("architecture", "convention", "decision", "bug", "api", "domain", "tooling", "general")
MAX_PER_CATEGORY, STALE_DAYS, KEEP_ACCESSED = 100, 90, 3
LOG = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("op", T.StringType()), ("category", T.StringType()), ("content", T.StringType()), ("tags", T.ArrayType(T.StringType())), ("at", T.TimestampType()), ("version", T.LongType()))])


def retrieve(memories: DataFrame, query: str, category: str | None = None, tags: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Memories that hold the query, of the category and with any of the tags if given, latest first."""
    found = memories.where(like_any_case(F.col("content"), F.lit(query)))
    if category is not None:
        found = found.where(F.col("category") == category)
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return found.orderBy(F.desc("updated_at"), "id").limit(limit)


def evicted(memories: DataFrame, per_category: int = MAX_PER_CATEGORY) -> DataFrame:
    """Memories beyond the cap of their category: least accessed first, then longest not updated."""
    size = memories.groupBy("category").agg((F.count(F.lit(1)) - per_category).alias("_over")).where("_over > 0")
    ranked = memories.join(F.broadcast(size), "category")  # only the few categories beyond the cap are ranked at all
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("access_count", "updated_at", "id")))
    return ranked.where(F.col("_n") <= F.col("_over")).select(*memories.columns)


def stale(memories: DataFrame, now, days: float = STALE_DAYS, keep_accessed: int = KEEP_ACCESSED) -> DataFrame:
    return memories.where((F.col("updated_at") < now - F.expr(f"interval {round(days * 86400)} seconds")) & (F.col("access_count") < keep_accessed))


def listed(memories: DataFrame, category: str | None = None, limit: int = 50) -> DataFrame:
    rows = memories if category is None else memories.where(F.col("category") == category)
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def stats(memories: DataFrame) -> DataFrame:
    """category, total; the row `all` has the sum."""
    per = memories.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return per.union(memories.agg(F.lit("all"), F.count(F.lit(1))))


class MemoryStore:
    """Memories in a folder of Parquet events (save, touch, update, forget); the current state is a query over them."""

    def __init__(self, spark: SparkSession, path: str, per_category: int = MAX_PER_CATEGORY):
        self.spark, self.path, self.per_category = spark, path, per_category
        self._append([])

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def _event(self, id_: str, op: str, category=None, content=None, tags=None) -> tuple:
        now = datetime.now(timezone.utc)
        return (id_, op, category, content, tags, now, uuid.uuid1().time)

    def current(self) -> DataFrame:
        log = self.log()
        last = F.max_by("content", F.when(F.col("content").isNotNull(), F.col("version")))
        rows = log.groupBy("id").agg(
            F.max(F.when(F.col("op") == "forget", 1).otherwise(0)).alias("gone"),
            F.max("category").alias("category"),
            last.alias("content"),
            F.max_by("tags", F.when(F.col("op") == "save", F.col("version"))).alias("tags"),
            F.min("at").alias("created_at"),
            F.max(F.when(F.col("op").isin("save", "update"), F.col("at"))).alias("updated_at"),
            F.count_if(F.col("op") == "touch").alias("access_count"),
        )
        return rows.where("gone = 0 and category is not null").drop("gone")

    def save(self, content: str, category: str = "general", tags: list[str] | None = None) -> str:
        id_ = str(uuid.uuid4())
        self._append([self._event(id_, "save", category if category in CATEGORIES else "general", content, tags or [])])
        self._forget([r["id"] for r in evicted(self.current(), self.per_category).select("id").toLocalIterator()])
        return id_

    def _forget(self, ids: list[str]) -> int:
        if ids:
            self._append([self._event(i, "forget") for i in ids])
        return len(ids)

    def retrieve(self, query: str, category: str | None = None, tags: list[str] | None = None, limit: int = 10) -> list[dict]:
        rows = [r.asDict() for r in retrieve(self.current(), query, category if category in CATEGORIES else None, tags, limit).collect()]
        if rows:
            self._append([self._event(r["id"], "touch") for r in rows])
        return rows

    def update(self, id_: str, content: str) -> bool:
        found = not self.current().where(F.col("id") == id_).isEmpty()
        if found:
            self._append([self._event(id_, "update", content=content)])
        return found

    def forget(self, id_: str) -> bool:
        return bool(self._forget([r[0] for r in self.current().where(F.col("id") == id_).select("id").collect()]))

    def forget_stale(self, now: datetime | None = None) -> int:
        now = now or datetime.now(timezone.utc)
        old = self.current().where((F.col("updated_at") < F.lit(now - timedelta(days=STALE_DAYS))) & (F.col("access_count") < KEEP_ACCESSED))
        return self._forget([r[0] for r in old.select("id").toLocalIterator()])

    def list_all(self, category: str | None = None, limit: int = 50) -> DataFrame:
        return listed(self.current(), category, limit)

    def stats(self) -> DataFrame:
        return stats(self.current())
