"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .decontaminate import contamination
from .fingerprint import fingerprints
from .jaccard_join import jaccard_components
from .license_scan import document_licenses
from .license_scan import oracle_sql as license_sql
from .line_dedup import dedup_lines
from .masked_lm import fit as fit_masked
from .masked_lm import score as score_masked
from .quality import fit as fit_quality
from .quality import score_quality
from .sentencepiece_sa import encode as sp_encode
from .sentencepiece_sa import load as sp_load
from .toxicity import fit as fit_toxicity
from .toxicity import score_toxicity
from .url_rules import host_of, judge, path_of, written_rule

#: Written URL rules of op5: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: SentencePiece model that op7 and the pipeline encode with, unless they are given another.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    score = F.col("quality")
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op2_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    score = F.col("toxicity")
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        return score_masked(docs, fit_masked(docs, scratch))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls are labelled by the written rule that fits, else by the document whose number ends the path; rules mined from these judge the others."""
    pages = _table(spark, sf_dir, "pages")
    bad = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract("url", r"(?s)^.*?://[^?#]*/([0-9]{1,18})(?:/|\.html)?(?:[?#]|$)", 1)
    shown = pages.select("url", number.alias("number")).select("url", F.expr("try_cast(number as bigint)").alias("doc_id"))
    written = written_rule(host_of(F.col("url")), path_of(F.col("url")), URL_RULES)[1]
    said = pages.select("url", (written == "block").alias("bad")).where("bad is not null")
    rest = shown.join(bad, "doc_id").where(written.isNull()).select("url", "bad")
    return judge(pages, said.union(rest), URL_RULES)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    out = sp_encode(_table(spark, sf_dir, "documents"), sp_load(model_file))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_near_items")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_crf,
        op2_toxicity_segments,
        op3_masked_lm,
        op4_line_dedup,
        op5_url_rules,
        op6_document_fingerprints,
        op7_sentencepiece,
        op8_license_scan,
        op9_ngram_jaccard_join,
        op10_benchmark_decontamination,
        pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) r USING (doc_id)
""",
    "op10_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), m AS (SELECT dw.doc_id, dw.i, bw.size, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.size = bw.size
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
ORACLE["op8_license_scan"] = license_sql()
