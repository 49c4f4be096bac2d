"""BM25 ranking over a table of texts by an inverted index, stored or not; queries are a table, too, so a
batch of searches is one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Up to so many asked terms are pushed down to the scans of a stored index.
FEW_TERMS = 200
#: Up to so many words of all queries are broadcast.
ASKED = 500_000
#: Pairs of a query and a text that a task scores, about.
PAIRS = 2_000_000
#: Size of the parts of a stored index that a reader can skip.
GROUP_BYTES = 16 << 20


def corpus(docs: DataFrame, id_col: str, text_col: str, max_docs: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """id, tokens of every text; the first max_docs by id and max_tokens of a text if set."""
    if max_docs is not None:
        docs = docs.orderBy(id_col).limit(max_docs)
    return docs.select(F.col(id_col).alias("id"), tokenize(F.coalesce(F.col(text_col), F.lit("")), max_tokens).alias("tokens"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """term, df, cf over a corpus. A text's tokens are counted as they are and once each, in one pass that shuffles only sums by term."""
    each = tokens.select(F.posexplode(F.array("tokens", F.array_distinct("tokens"))).alias("once", "tokens")).select("once", F.explode("tokens").alias("term"))
    return each.groupBy("term").agg(F.sum(F.col("once").cast("long")).alias("df"), F.sum(1 - F.col("once").cast("long")).alias("cf"))


def raw_idf(n: int):
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def with_idf(counts: DataFrame, n: int) -> DataFrame:
    """term, df, cf, idf of counts (term, df, cf) over n texts: a negative idf becomes a quarter of the mean over all terms before that."""
    mean = F.broadcast(counts.agg(F.avg(F.when(F.col("cf") > 0, raw_idf(n))).alias("mean")))  # one row; with cf (always above 0), so that the counts' exchange is reused
    return counts.join(mean).select("term", "df", "cf", F.when(raw_idf(n) < 0, FLOOR * F.col("mean")).otherwise(raw_idf(n)).alias("idf"))


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, dl), terms (term, df, cf, idf), number of texts and their mean length."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean_length: float


def postings_of(tokens: DataFrame) -> DataFrame:
    """term, id, tf, dl and the other columns of tokens (id, tokens, ...)."""
    keep = [c for c in tokens.columns if c not in ("id", "tokens")]
    each = tokens.select("id", *keep, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("term", "id", "dl", *keep).agg(F.count(F.lit(1)).alias("tf"))


def terms_of(postings: DataFrame, n: int) -> DataFrame:
    """term, df, cf, idf of postings of n texts."""
    return with_idf(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), n)


def index_of(tokens: DataFrame) -> Index:
    """An index that is computed where it is read; `write_index` stores it."""
    n, total = tokens.agg(F.count(F.lit(1)), F.sum(F.size("tokens"))).first()
    postings = postings_of(tokens)
    return Index(postings, terms_of(postings, n), n, (total / n if n and total else 0.0) or 1.0)


def by_term(rows: DataFrame, *more: str) -> DataFrame:
    """Rows laid out by term, so that a reader skips the parts of other terms; a frequent term is spread by the further columns."""
    return rows.repartitionByRange("term", *more).sortWithinPartitions("term", *more)


def write_index(tokens: DataFrame, path: str) -> None:
    """Postings are written where they are counted, by term within each file, so that they're shuffled once and texts are read once."""
    spark, n = tokens.sparkSession, tokens.count()
    postings_of(tokens).sortWithinPartitions("term").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    by_term(terms_of(spark.read.parquet(f"{path}/postings"), n)).write.mode("overwrite").parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/terms").agg(F.sum("cf")).first()[0]
    spark.createDataFrame([(n, (total / n if n and total else 0.0) or 1.0)], "n long, mean_length double").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str) -> Index:
    n, mean_length = spark.read.parquet(f"{path}/size").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n, mean_length)


def search_index(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, score (best of a query is 1) of the k best per query; ties by id.

    queries: query_id, text. A repeated word of a query counts once; rows without a positive score are
    left out. Up to FEW_TERMS asked terms are a filter of the scans, more a join. Postings of asked terms are
    shuffled once, by id, and up to ASKED asked words are broadcast to them; so a text's scores are summed
    where its postings are, and of the pairs of a query and a text only each task's k best are shuffled.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    few = [r[0] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    terms = asked.select("term").distinct()
    n_asked, n_queries = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    small = F.broadcast if n_asked <= ASKED else lambda df: df
    held = lambda df: df.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else df.join(small(terms), "term", "left_semi")
    asked = small(asked.join(held(index.terms.select("term", "idf")), "term"))
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.n * n_queries // PAIRS)
    found = held(index.postings.select("term", "id", "tf", "dl")).repartition(parts, "id").join(asked, "term")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.mean_length))
    scored = found.select("query_id", "id", weight.alias("w")).groupBy("query_id", "id").agg(F.sum("w").alias("raw"))
    best = small(scored.groupBy("query_id").agg(F.max("raw").alias("best")).where("best > 0"))
    scored = scored.join(best, "query_id").where("raw > 0").select("query_id", "id", F.round(F.col("raw") / F.col("best"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(tokens: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search_index over an index of tokens (id, tokens) that isn't stored."""
    return search_index(index_of(tokens), queries, k)
