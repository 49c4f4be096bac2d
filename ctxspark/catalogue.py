"""Named queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures
from .functions import masking, paths, text
from .operators import bm25, chunking, graph, hybrid, memory, parsing, vectors
from .streaming import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored indexes by application, folder, and size and time of the documents' files.
_INDEXES: dict[tuple, str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The inverted index of documents, written at the first search and again after the table has changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.getContentSummary(path)
    key = spark.sparkContext.applicationId, sf_dir, status.getLength(), files.getFileStatus(path).getModificationTime()
    if key not in _INDEXES:
        folder = f"{ingest.fresh_folder(spark)}/bm25"
        bm25.write_index(bm25.corpus(table(spark, sf_dir, "documents"), "doc_id", "text"), folder)
        _INDEXES[key] = folder
    return bm25.read_index(spark, _INDEXES[key])


# ---------------------------------------------------------------- ranking

SEARCH_TEXT = "the then erthhand para que oulyan einander nicht"

TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-zA-Z0-9_$]+'), lambda x: x <> '')"

BM25_CTES = f"""
d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS tokens FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM d) GROUP BY term),
raw AS (SELECT term, df, ln(s.n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM q),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY id, dl, term),
sc AS (SELECT query_id, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM s)))) AS raw FROM tf JOIN idf USING (term) JOIN asked USING (term) GROUP BY query_id, id),
nm AS (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, raw, max(raw) OVER (PARTITION BY query_id) AS best FROM sc),
bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM nm WHERE best > 0 AND raw > 0)"""


@query(f"WITH q AS (SELECT 0::BIGINT AS query_id, '{SEARCH_TEXT}' AS text), {BM25_CTES} SELECT query_id, rank::INT AS rank, id, score FROM bm WHERE rank <= 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_index(stored_index(spark, sf_dir), spark.createDataFrame([(0, SEARCH_TEXT)], "query_id long, text string"), 20)


@query(f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {BM25_CTES} SELECT query_id, rank::INT AS rank, id, score FROM bm WHERE rank <= 10")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_index(stored_index(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query(f"""WITH q AS (SELECT 0 AS query_id, 'x' AS text), {BM25_CTES},
cf AS (SELECT term, count(*) AS cf FROM (SELECT unnest(tokens) AS term FROM d) GROUP BY term)
SELECT term, df, cf, round(idf, 6) AS idf FROM idf JOIN cf USING (term)""")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = bm25.corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return bm25.with_idf(bm25.term_stats(corpus), corpus.count()).select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _vectors(spark, sf_dir).where("id = 7").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


DOT = "list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id)::INT AS rank, id, score FROM (SELECT vec_id AS id, round(least(1, greatest(0, {DOT})), 6) AS score FROM embeddings e) ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10)


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id)::INT AS rank, id, score FROM (SELECT vec_id AS id, round(least(1, greatest(0, {DOT})), 6) AS score FROM embeddings e WHERE label = 3) ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, F.col("label") == 3)


@query(f"""WITH t AS (SELECT vec_id AS id, label, round(least(1, greatest(0, {DOT})), 6) AS score FROM embeddings e ORDER BY score DESC, id LIMIT 50)
SELECT id, score FROM t WHERE label = 3 ORDER BY score DESC, id LIMIT 10""")
def vector_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.overfetch(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, F.col("label") == 3).select("id", "score")


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 10""")
def vector_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    return vectors.knn(own, own.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


@query("SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id = 42")
def vector_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id = 42").select("id", F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"""WITH q AS (SELECT 0::BIGINT AS query_id, '{SEARCH_TEXT}' AS text), {BM25_CTES},
sem AS (SELECT vec_id AS id, round(least(1, greatest(0, {DOT})), 6) AS score FROM embeddings e ORDER BY score DESC, id LIMIT 50),
sy AS (SELECT doc_id AS id, least(1.0, 0.5 * count(*)) AS score FROM documents JOIN (SELECT DISTINCT source FROM documents WHERE source ILIKE '%src1%' ORDER BY source LIMIT 10) USING (source) GROUP BY doc_id),
u AS (SELECT id, score AS semantic, NULL::DOUBLE AS bm25, NULL::DOUBLE AS symbol FROM sem UNION ALL SELECT id, NULL, score, NULL FROM bm WHERE rank <= 50 UNION ALL SELECT id, NULL, NULL, score FROM sy),
g AS (SELECT id, coalesce(max(semantic), 0) AS semantic, coalesce(max(bm25), 0) AS bm25, coalesce(max(symbol), 0)::DOUBLE AS symbol FROM u GROUP BY id),
f AS (SELECT *, round(semantic * 0.5 + bm25 * 0.2 + symbol * 0.2, 6) AS score FROM g)
SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, id, score, semantic, bm25, symbol, 0.0::DOUBLE AS graph FROM f WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = hybrid.candidates(10)
    sem = vectors.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), n).select(F.lit(0).cast("long").alias("query_id"), "id", "score")
    bm = bm25.search_index(stored_index(spark, sf_dir), spark.createDataFrame([(0, SEARCH_TEXT)], "query_id long, text string"), n)
    symbols = docs.select(F.col("source").alias("symbol_id"), F.col("source").alias("name"), F.col("source").alias("file")).distinct()
    sy = hybrid.symbol_leg(spark.createDataFrame([(0, "src1")], "query_id long, text string"), symbols, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file")))
    return hybrid.fuse({"semantic": sem, "bm25": bm, "symbol": sy})


# ---------------------------------------------------------------- text functions

def _sql_mask(upto: int | None = None) -> str:
    out = "text"
    for _, pattern, placeholder in masking.enabled_rules()[:upto]:
        out = f"regexp_replace({out}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{placeholder}', 'g')"
    return out


def _sql_count(i: int) -> str:
    pattern = masking.enabled_rules()[i][1].replace("'", "''")
    return f"len(regexp_extract_all({_sql_mask(i) if i else 'text'}, '(?i){pattern}'))"


_RULES = [r[0] for r in masking.enabled_rules()]


@query(f"SELECT doc_id, {_sql_mask()} AS masked FROM documents")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask(F.col("text")).alias("masked"))


@query("SELECT doc_id, " + ", ".join(f"{_sql_count(i)}::BIGINT AS {name}" for i, name in enumerate(_RULES)) + ", 0::BIGINT AS ips, (" + " + ".join(_sql_count(i) for i in range(len(_RULES))) + ")::BIGINT AS total FROM documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = masking.mask_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


@query("SELECT " + ", ".join(f"sum({_sql_count(i)})::BIGINT AS {name}" for i, name in enumerate(_RULES)) + " FROM documents")
def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = masking.mask_counts(F.col("text"))
    return table(spark, sf_dir, "documents").agg(*[F.sum(counts[n]).cast("long").alias(n) for n in _RULES])


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '(?i){r[1].replace(chr(39), chr(39) * 2)}')" for r in masking.enabled_rules()))
def pii_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(masking.contains_pii(F.col("text"))).select("doc_id")


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS token_count, (len(string_split(text, chr(10))))::INT AS line_count, md5(text) AS hash FROM documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(t).alias("token_count"), text.line_count(t).alias("line_count"), text.content_hash(t).alias("hash"))


UUID5 = "concat_ws('-', d[1:8], d[9:12], '5' || d[14:16], substr('89ab', (('0x' || d[17:17])::INT % 4) + 1, 1) || d[18:20], d[21:32])"


@query(f"SELECT page_id, {UUID5} AS id FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS d FROM pages)")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.uuid5(F.col("url")).alias("id"))


@query("""SELECT doc_id, md5(m) AS hash, greatest(1, length(c) // 4)::INT AS token_count FROM (SELECT doc_id, c, """ + _sql_mask().replace("text", "c", 1).replace("(text,", "(c,") + """ AS m FROM
(SELECT doc_id, '// File: ' || source || chr(10) || '// Symbol: ' || lang || chr(10) || chr(10) || text AS c FROM documents))""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.context_header(F.col("text"), F.col("source"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(masking.mask(made)).alias("hash"), text.token_count(made).alias("token_count"))


#: Endings that page paths are given in turn, and their languages.
ENDINGS = [(".py", "python"), (".TS", "typescript"), (".tsx", "tsx"), (".js", "javascript"), (".jsx", "jsx"), (".php", "php"), (".cs", "csharp"), (".sql", "sql"), (".vue", "unknown"), (".json", "json"), (".yaml", "yaml"), (".md", "markdown"), (".css", "css"), (".html", "html"), (".sh", "shell"), (".none", "unknown"), ("", "unknown")]


@query("SELECT page_id, CASE page_id % " + str(len(ENDINGS)) + " " + " ".join(f"WHEN {i} THEN '{lang}'" for i, (_, lang) in enumerate(ENDINGS)) + " END AS language FROM pages")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e, _ in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", paths.language_of(F.concat(F.lit("dir.x/page"), ending)).alias("language"))


@query("SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '^en/(.*/)?[^/]*[0-9]\\.html(/.*)?$')")
def path_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").where(paths.glob_match(path, "en/**/*[0-9].html")).select("page_id")


# ---------------------------------------------------------------- state and counts

@query("SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM pages) AS symbols, (SELECT count(*) FROM conversations) AS memories, (SELECT count(*) FROM embeddings) AS vectors, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) AS languages")
def architecture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, alias: table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(alias))
    per = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x.lang, F.lit("="), x.n)), ",").alias("languages"))
    return one("documents", "files").join(one("pages", "symbols")).join(one("conversations", "memories")).join(one("embeddings", "vectors")).join(languages)


CHANGED = """k AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 1000000000, md5(text) FROM documents WHERE doc_id % 13 = 0)"""


@query(f"""WITH {CHANGED} SELECT coalesce(d.doc_id, k.doc_id) AS doc_id, CASE WHEN k.hash IS NULL THEN 'new' WHEN d.text IS NULL THEN 'deleted' WHEN k.hash = md5(d.text) THEN 'unchanged' ELSE 'modified' END AS status FROM documents d FULL JOIN k ON k.doc_id = d.doc_id""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against known hashes: a tenth is unknown, a seventh has another text, some are gone."""
    from .sources.store import changes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    known = docs.where("doc_id % 10 <> 0").select("doc_id", text.content_hash(old).alias("hash")).union(docs.where("doc_id % 13 = 0").select(F.col("doc_id") + 1_000_000_000, text.content_hash(F.col("text"))))
    return changes(docs.select("doc_id", text.content_hash(F.col("text")).alias("hash")), known, "doc_id")


@query("SELECT md5(text) AS id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.content_hash(F.col("text")).alias("id"), "doc_id", "source")
    return graph.last_wins(rows, "id", "doc_id")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%re%' AND p_size <= 10 ORDER BY p_name, p_partkey LIMIT 20")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").where(text.like_any_case(F.col("p_name"), F.lit("RE"))).where("p_size <= 10")
    return found.orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS changed_at FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderdate is not null").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("changed_at"))


@query("SELECT c.doc_id, c.doc_id IN (SELECT vec_id FROM embeddings) AS is_embedded FROM documents c")
def embedded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("is_embedded")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").withColumn("is_embedded", F.coalesce("is_embedded", F.lit(False)))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "source")


# ---------------------------------------------------------------- graph

EDGES_SQL = """e AS (
SELECT DISTINCT 'l' || l_orderkey AS src, 'p' || l_partkey AS dst, 'calls' AS type FROM lineitem
UNION SELECT 'l' || l_orderkey, 's' || l_suppkey, 'uses' FROM lineitem
UNION SELECT 'l' || o_orderkey, 'c' || o_custkey, 'injects' FROM orders
UNION SELECT 'c' || c_custkey, 'n' || c_nationkey, 'extends' FROM customer
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'extends' FROM supplier
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'extends' FROM nation)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed edges: orders (l) to parts, suppliers, customers; these to nations, regions."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"))
    parts = [
        edge(t("lineitem"), "l", "l_orderkey", "p", "l_partkey", "calls"),
        edge(t("lineitem"), "l", "l_orderkey", "s", "l_suppkey", "uses"),
        edge(t("orders"), "l", "o_orderkey", "c", "o_custkey", "injects"),
        edge(t("customer"), "c", "c_custkey", "n", "c_nationkey", "extends"),
        edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "extends"),
        edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "extends"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _reach_sql(edges: str, starts: str, depth: int) -> str:
    levels = [f"WITH {EDGES_SQL}, g AS ({edges}), f0 AS ({starts}), v0 AS (SELECT node AS start, node FROM f0), l0 AS (SELECT * FROM v0)"]
    for i in range(1, depth + 1):
        levels.append(f"""l{i} AS (SELECT start, dst AS node, min(struct_pack(src := src, type := type)) AS via FROM l{i - 1} JOIN g ON g.src = l{i - 1}.node WHERE (start, dst) NOT IN (SELECT start, node FROM v{i - 1}) GROUP BY start, dst),
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT start, node FROM l{i})""")
    return ", ".join(levels) + " " + " UNION ALL ".join(f"SELECT start, node, {i} AS depth, via.type AS type, 1.0::DOUBLE AS confidence FROM l{i}" for i in range(1, depth + 1))


@query(_reach_sql("SELECT src, dst, type FROM e", "SELECT 'l' || o_orderkey AS node FROM orders WHERE o_orderkey % 20 = 0", 3))
def graph_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("l"), "o_orderkey").alias("node"))
    return graph.dependencies(_edges(spark, sf_dir), starts, 3)


@query(_reach_sql("SELECT dst AS src, src AS dst, type FROM e", "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 20 = 0", 2))
def graph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.references(_edges(spark, sf_dir), starts, 2)


@query("SELECT * FROM (" + _reach_sql("SELECT dst AS src, src AS dst, type FROM e", "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 20 = 0", 3) + ") WHERE type = 'calls'")
def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.callers(_edges(spark, sf_dir), starts)


@query(f"""WITH {EDGES_SQL}, a AS (SELECT min(dst) AS n1 FROM (SELECT e1.dst FROM e e1 JOIN e e2 ON e1.dst = e2.src JOIN e e3 ON e2.dst = e3.src WHERE e1.src = 'l1' AND e3.dst = 'r1')),
p AS (SELECT [e1.src, e1.dst, e2.dst, e3.dst] AS path FROM e e1 JOIN e e2 ON e1.dst = e2.src JOIN e e3 ON e2.dst = e3.src WHERE e1.src = 'l1' AND e3.dst = 'r1'), m AS (SELECT min(path) AS path FROM p)
SELECT (i - 1)::INT AS step, path[i] AS node FROM m, unnest(range(1, 5)) AS t(i) WHERE path IS NOT NULL""")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(_edges(spark, sf_dir), "l1", "r1")


@query("WITH RECURSIVE e AS (SELECT event_id AS a, event_id + 1 AS b FROM events WHERE event_id <= 40), p AS (SELECT 0 AS step, 1::BIGINT AS here UNION ALL SELECT step + 1, b FROM p JOIN e ON a = here) SELECT step::INT AS step, 'e' || here AS node FROM p")
def graph_long_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of 40 steps with a shorter dead end and a cycle beside it."""
    own = table(spark, sf_dir, "events").where("event_id between 1 and 40").select("event_id")
    edge = lambda a, b: own.select(F.concat(F.lit("e"), a).alias("src"), F.concat(F.lit("e"), b).alias("dst"))
    chain = edge(F.col("event_id"), F.col("event_id") + 1)
    edges = chain.union(edge(F.col("event_id"), F.greatest(F.col("event_id") - 3, F.lit(1)))).union(edge(F.col("event_id"), F.col("event_id") + 5000000))
    return graph.shortest_path(edges, "e1", "e41")


@query(f"WITH {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e) SELECT (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g UNION SELECT 'p' || p_partkey FROM part)) AS nodes, (SELECT count(*) FROM g) AS edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.counts(_edges(spark, sf_dir).select("src", "dst").distinct(), nodes)


@query("""WITH r AS (SELECT l_orderkey::VARCHAR AS src, CASE WHEN p_size > 5 THEN p_name ELSE '?' || p_name END AS target_name, l_returnflag AS type, l_linenumber * 1000 + ascii(l_returnflag) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
i AS (SELECT p_name AS name, min(p_partkey)::VARCHAR AS id FROM part GROUP BY p_name),
n AS (SELECT src, coalesce(i.id, 'unresolved::' || target_name) AS dst, type, seq FROM r LEFT JOIN i ON i.name = r.target_name)
SELECT src, dst, arg_max(type, seq) AS type, count(*) AS n_relationships FROM n GROUP BY src, dst""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships by part name resolved to the first part of that name (names of parts of size 5 and less are unknown); of several on one pair the last counts."""
    parts = table(spark, sf_dir, "part")
    rel = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rel = rel.select(F.col("l_orderkey").cast("string").alias("source_symbol_id"), F.lit(None).cast("string").alias("target_symbol_id"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(F.concat(F.lit("?"), "p_name")).alias("target_name"), F.col("l_returnflag").alias("relationship_type"), F.lit(1.0).alias("confidence"), (F.col("l_linenumber") * 1000 + F.ascii("l_returnflag")).alias("seq"))
    symbols = parts.select(F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("file_path"), F.col("p_partkey").alias("line_start"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"))
    resolved = graph.resolve(rel, graph.name_index(symbols))
    count = resolved.groupBy(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")).agg(F.count(F.lit(1)).alias("n_relationships"))
    return graph.edges_of(resolved).select("src", "dst", "type").join(count, ["src", "dst"])


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY target""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


# ---------------------------------------------------------------- memory

MEMORIES = """m AS (SELECT conv_id || '-' || turn AS id, role AS category, text AS content, TIMESTAMP '2024-01-01' + to_seconds((conv_id * 600 + turn * 60)::BIGINT) AS updated_at, ((conv_id * 7 + turn) % 5)::BIGINT AS access_count FROM conversations)"""


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + F.col("conv_id") * 600 + F.col("turn") * 60).cast("timestamp")
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("category"), F.col("text").alias("content"), at.alias("updated_at"), ((F.col("conv_id") * 7 + F.col("turn")) % 5).alias("access_count"))


@query(f"WITH {MEMORIES} SELECT id, category FROM m WHERE lower(content) LIKE '%the%' AND category = 'user' ORDER BY updated_at DESC, id LIMIT 10")
def memory_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.retrieve(_memories(spark, sf_dir), "the", "user").select("id", "category")


@query(f"WITH {MEMORIES} SELECT id, category, access_count FROM m ORDER BY updated_at DESC, id LIMIT 50")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.listed(_memories(spark, sf_dir)).select("id", "category", "access_count")


@query(f"WITH {MEMORIES} SELECT category, count(*) AS total FROM m GROUP BY category UNION ALL SELECT 'all', count(*) FROM m")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.stats(_memories(spark, sf_dir))


@query(f"WITH {MEMORIES}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY access_count, updated_at, id) AS n, count(*) OVER (PARTITION BY category) AS c FROM m) SELECT id, category FROM r WHERE n <= c - 100")
def memory_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.evicted(_memories(spark, sf_dir)).select("id", "category")


@query(f"WITH {MEMORIES} SELECT id, category FROM m WHERE updated_at < (SELECT max(updated_at) FROM m) - INTERVAL 6 HOUR AND access_count < 3")
def memory_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir)
    now = rows.agg(F.max("updated_at")).first()[0]
    return memory.stale(rows, F.lit(now), days=0.25).select("id", "category")


# ---------------------------------------------------------------- order-dependent operators

@query("""WITH w AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, event_id, (epoch_us(nxt) - epoch_us(ts))::BIGINT AS gap_us FROM w WHERE nxt IS NOT NULL AND epoch_us(nxt) - epoch_us(ts) > 3600000000""")
def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("nxt").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap_us")
    return table(spark, sf_dir, "events").withColumn("nxt", after).where("nxt is not null").select("user_id", "event_id", gap).where("gap_us > 3600000000")


@query("""SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM events""")
def asof_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest preceding event of the first kind, per user."""
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("event_id", F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(w).alias("parent_id"))


# ---------------------------------------------------------------- parsing, chunking, streaming

def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL::VARCHAR" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _fixture(spark: SparkSession, languages: tuple[str, ...] | None = None) -> DataFrame:
    rows = [(p, lang, s) for p, (lang, s) in fixtures.FILES.items() if languages is None or lang in languages]
    return spark.createDataFrame(rows, "path string, language string, source string")


def _register_parsers() -> None:
    for name, languages in (("parse_sql", ("sql",)), ("parse_csharp", ("csharp",)), ("parse_dotnet", ("dotnet",)), ("parse_asp", ("aspnet",)), ("parse_python", ("python",)), ("parse_php", ("php",)), ("parse_typescript", ("tsx",))):
        paths_ = [p for p, (lang, _) in fixtures.FILES.items() if lang in languages]

        def run(spark: SparkSession, sf_dir: str, languages=languages) -> DataFrame:
            files = _fixture(spark, languages)
            found = parsing.symbols_of(parsing.parse_files(files), files)
            return found.select("name", F.col("symbol_type").alias("kind"), "line_start", "line_end", "parent_name")

        QUERIES[name] = run
        ORACLE[name] = _values([r for p in paths_ for r in fixtures.EXPECTED[p]], "name, kind, line_start, line_end, parent_name")


_register_parsers()


@query(_values([(p, *r) for p, rows in fixtures.EXPECTED_RELATIONSHIPS.items() for r in dict.fromkeys(rows)] + [("web/Cart.tsx", "useQuery", "queries")], "path, target_name, relationship_type"))
def parse_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.relationships_of(parsing.parse_files(_fixture(spark)))
    return rows.select(F.col("source_file_path").alias("path"), "target_name", "relationship_type")


@query()
def chunk_fixture_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _fixture(spark)
    return chunking.chunk_files(files, parsing.parse_files(files), chunking.Sizes(5, 20, 60, 5)).select("id", "file_path", "symbol_name", "symbol_type", "line_start", "line_end", "hash", "token_count", "chunk_index")


SPLIT_SQL = """WITH RECURSIVE t AS (SELECT doc_id, text, greatest(1, length(text) // 4) AS size, string_split(text, chr(10)) AS x FROM documents),
d AS (SELECT doc_id, l, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda y: greatest(1, length(y) // 4))), 0)) AS cs, len(l) AS n
  FROM (SELECT doc_id, list_concat(list_transform(x[1:len(x) - 1], lambda y: y || chr(10)), CASE WHEN x[len(x)] <> '' THEN [x[len(x)]] ELSE [] END) AS l FROM t WHERE size > 120)),
r AS (
  SELECT doc_id, 0 AS segment, 0::BIGINT AS b, coalesce(list_min(list_filter(range(1, n), lambda i: cs[i + 2] > 120)), n) AS e FROM d
  UNION ALL
  SELECT s.doc_id, segment + 1, nb, coalesce(list_min(list_filter(range(e + 1, n), lambda i: cs[i + 2] - cs[nb + 1] > 120)), n)
  FROM (SELECT r.*, d.n, d.cs, list_min(list_filter(range(r.b, r.e + 1), lambda j: d.cs[r.e + 1] - d.cs[j + 1] <= 20)) AS nb FROM r JOIN d USING (doc_id) WHERE r.e < d.n) s),
o AS (SELECT doc_id, segment, b AS first_line, array_to_string(l[b + 1:e], '') AS part FROM r JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, 0, text FROM t WHERE size <= 120)
SELECT doc_id, segment::INT AS segment, first_line::INT AS first_line, greatest(1, length(part) // 4)::INT AS token_count, md5(part) AS hash FROM o"""


def _segments(batches):
    for batch in batches:
        rows = [(d, n, first, part) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, (first, part) in enumerate(chunking.split_lines(text or "", 120, 20))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "segment", "first_line", "part"])


@query(SPLIT_SQL)
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut at line ends into segments of at most 120 tokens with an overlap of 20."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = docs.mapInArrow(_segments, "doc_id long, segment int, first_line int, part string")
    return parts.select("doc_id", "segment", "first_line", text.token_count(F.col("part")).alias("token_count"), text.content_hash(F.col("part")).alias("hash"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = ingest.fresh_folder(spark)
    stream = ingest.file_stream(spark, f"{sf_dir}/events.parque[t]", ingest.EVENTS)
    return ingest.ingest_counts(stream, "event_type", f"{folder}/parts", f"{folder}/checkpoint")


# ---------------------------------------------------------------- paths, texts and filters on made-up values of the tables' rows

def _cases(table_id: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(table_id) % len(values) + 1).cast("int"))


def _case_sql(table_id: str, results: list) -> str:
    said = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return f"CASE {table_id} % {len(results)} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(results)) + " END"


#: Paths and whether they may be read (1,000 bytes each where no size is given).
READABLE = [("src/app.py", True), ("a/.env", False), (".env.local", False), ("keys/server.pem", False), ("x/vendor/lib.php", False), ("x/vendors/lib.php", True), ("node_modules/a/b.js", False), ("img/logo.PNG", False), ("doc/readme.md", True), (".ssh/config", False), ("a/secrets/x.json", False), ("a/secretsx/x.json", True), ("lib/a.so", False), ("service-account-7.json", False), ("a.db-wal", False), ("deep/a/b/c/d.ts", True)]


@query(f"SELECT doc_id, {_case_sql('doc_id', [ok for _, ok in READABLE])} AND doc_id % 5 <> 0 AS allowed FROM documents")
def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes, patterns and sizes that are never read; every fifth file is one byte too long."""
    path = _cases("doc_id", [p for p, _ in READABLE])
    size = F.when(F.col("doc_id") % 5 == 0, 1001).otherwise(1000)
    return table(spark, sf_dir, "documents").select("doc_id", paths.Blocklist(max_bytes=1000).allowed_column(path, size).alias("allowed"))


#: Patterns, and paths that they match and don't match.
GLOBS = [("*.log", ["a.log", "x/y/b.log"], ["a.logs", "log"]), ("/build", ["build", "build/x"], ["x/build"]), ("doc/*.md", ["doc/a.md"], ["doc/x/a.md", "x/doc/a.md"]), ("a/**/z", ["a/z", "a/b/c/z"], ["b/a/z"]), ("tmp/", ["tmp/x", "q/tmp/y"], ["tmp"]), ("f[0-3]?.c", ["f1x.c", "s/f3y.c"], ["f4x.c", "f1.c"])]


@query("SELECT page_id, " + ", ".join(f"{_case_sql('page_id', [True] * len(yes) + [False] * len(no))} AS g{i}" for i, (_, yes, no) in enumerate(GLOBS)) + " FROM pages")
def glob_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[paths.glob_match(_cases("page_id", yes + no), p).alias(f"g{i}") for i, (p, yes, no) in enumerate(GLOBS)])


@query("SELECT 'laravel' AS a, 'nextjs' AS b, 'dotnet' AS c, NULL::VARCHAR AS d FROM region WHERE r_regionkey = 0")
def framework_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = {"a": ["src/x.py", "artisan", "App.sln"], "b": ["pages/_app.tsx", "src/App.tsx"], "c": ["App.sln", "x.cs"], "d": ["main.go"]}
    found = [F.lit(paths.framework_of(spark.createDataFrame([(p,) for p in files], "path string"))).cast("string").alias(n) for n, files in trees.items()]
    return table(spark, sf_dir, "region").where("r_regionkey = 0").select(*found)


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def normalized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with other line ends and bytes are the texts again."""
    docs = table(spark, sf_dir, "documents")
    other = F.regexp_replace("text", "\n", "\r\n")
    return docs.select("doc_id", text.content_hash(text.normalize_source(other.cast("binary"))).alias("hash"))


@query("SELECT doc_id, substr(text, 1, 40) AS snippet, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS body, regexp_extract('a/b.c::' || source, '[^/.:]*$') AS last FROM documents")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(t, 40).alias("snippet"), text.body_of(t, F.lit(2), F.lit(3)).alias("body"), text.last_segment(F.concat(F.lit("a/b.c::"), "source"), "/.:").alias("last"))


_IP = "'host ' || (doc_id % 300) || '.0.2.' || (doc_id % 256) || ' port ' || doc_id"


@query(f"SELECT doc_id, regexp_replace({_IP}, '{dict((n, p) for n, p, _ in masking.RULES)['ips']}', '[REDACTED_IP]', 'g') AS masked, len(regexp_extract_all({_IP}, '{dict((n, p) for n, p, _ in masking.RULES)['ips']}'))::BIGINT AS ips FROM documents")
def pii_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that is off by default."""
    host = F.expr(_IP)
    others = {n for n, _, _ in masking.RULES if n != "ips"}
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask(host, others).alias("masked"), masking.mask_counts(host, others)["ips"].cast("long").alias("ips"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' AND p_type = (SELECT min(p_type) FROM part) AND p_brand = (SELECT max(p_brand) FROM part WHERE p_type = (SELECT min(p_type) FROM part)) ORDER BY p_name, p_partkey LIMIT 20")
def symbol_search_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name search with equal type and language."""
    parts = table(spark, sf_dir, "part")
    kind = parts.agg(F.min("p_type")).first()[0]
    brand = parts.where(F.col("p_type") == kind).agg(F.max("p_brand")).first()[0]
    found = parts.where(text.like_any_case(F.col("p_name"), F.lit("A"))).where((F.col("p_type") == kind) & (F.col("p_brand") == brand))
    return found.orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query(f"WITH {MEMORIES} SELECT id, category FROM m WHERE lower(content) LIKE '%e%' AND (access_count = 1 OR category = 'system') ORDER BY updated_at DESC, id LIMIT 25")
def memory_retrieve_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with any of two tags."""
    tagged = _memories(spark, sf_dir).withColumn("tags", F.array(F.concat(F.lit("n"), "access_count"), F.col("category")))
    return memory.retrieve(tagged, "E", tags=["n1", "system"], limit=25).select("id", "category")


@query(f"WITH {EDGES_SQL} SELECT src, dst, type FROM e WHERE type = 'extends' AND (dst = 'n1' OR src = 'n1')")
def relationship_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(_edges(spark, sf_dir), "n1", "extends").select("src", "dst", "type")


@query("SELECT p_brand AS file_path, p_name AS name, p_size AS line_start, p_partkey AS id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size, p_partkey LIMIT 100")
def symbols_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbols of one file by line."""
    parts = table(spark, sf_dir, "part")
    rows = parts.where(F.col("p_brand") == parts.agg(F.min("p_brand")).first()[0])
    return rows.select(F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.col("p_size").alias("line_start"), F.col("p_partkey").alias("id")).orderBy("line_start", "id").limit(100)
