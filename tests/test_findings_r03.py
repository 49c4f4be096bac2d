"""Cases of FINDINGS_r03.md, each of which the code before got wrong."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxspark.catalogue import QUERIES
from ctxspark.functions import masking
from ctxspark.operators import bm25, vectors

PIECES = """api_key='|ACCESS_TOKEN: |client-secret=|"|abcdefghij0123456789XYZ|https://a.b/c?sig=|&sv=|eyJab.|cd-e.|f|me@|x.org|@| |\n|[|]|+1 |(12)|555|-|.|1234|12-3456789|123-45-6789
AB12345678|123456789V|123456789012|4111111111111111|1234567890|key|Token|=|'|\u00e9|\u0130|K""".split("|")


def test_texts_without_hints_run_no_rule(spark):
    """A long word costs the rule for addresses the square of its length, unless the text holds an @."""
    def run(x: str):
        counts = masking.mask_counts(F.col("x"))
        begun = time.time()
        row = spark.createDataFrame([(x,)], "x string").select((masking.mask(F.col("x")) == F.col("x")).alias("same"), counts["total"].alias("n"), masking.contains_pii(F.col("x")).alias("any")).first()
        return tuple(row), time.time() - begun

    run("a")
    row, seconds = run("a" * 300_000)
    assert row == (True, 0, False) and seconds < 10


def test_hints_change_no_result(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choices(PIECES, k=rng.randint(1, 14))),) for _ in range(3000)] + [("",), (None,)]
    df = spark.createDataFrame(texts, "x string").repartition(4)
    for disabled in (set(), masking.OFF_BY_DEFAULT):
        text, want = F.col("x"), {name: F.lit(0) for name, _, _ in masking.RULES}
        found = F.lit(False)
        for name, pattern, placeholder in masking.enabled_rules(disabled):
            df = df.withColumn("t", text).withColumn(f"w_{name}", F.regexp_count("t", F.lit("(?i)" + pattern)))
            df = df.withColumn("t", F.regexp_replace("t", F.lit("(?i)" + pattern), F.lit(placeholder))).localCheckpoint()
            text, want[name], found = F.col("t"), F.col(f"w_{name}"), found | F.col("x").rlike("(?i)" + pattern)
        got = masking.mask_counts(F.col("x"), disabled)
        wrong = [~masking.mask(F.col("x"), disabled).eqNullSafe(F.col("t")), ~got["total"].eqNullSafe(sum(want.values(), F.lit(0))), ~masking.contains_pii(F.col("x"), disabled).eqNullSafe(found)]
        wrong += [~got[n].eqNullSafe(want[n]) for n in want]
        assert df.select(*[F.count_if(w).alias(f"c{i}") for i, w in enumerate(wrong)]).first() == (0,) * len(wrong)
        assert df.where(got["total"] > 0).count() > 500


@pytest.mark.parametrize("k", [1, 3, 700])
def test_a_task_keeps_k_rows_of_a_query(monkeypatch, k):
    monkeypatch.setattr(vectors, "ROWS", 50, raising=False)
    rng = np.random.default_rng(3)
    own, asked = rng.integers(-2, 3, (400, 3)).astype(float), rng.integers(-2, 3, (20, 3)).astype(float)  # many ties
    ids = rng.permutation(400)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + n]), pa.array(own[i : i + n].tolist(), pa.list_(pa.float64()))], names=["id", "embedding"]) for i, n in ((0, 130), (130, 0), (130, 270))]
    got = [tuple(r.values()) for b in vectors._best(list(range(100, 120)), asked, k)(iter(batches)) for r in b.to_pylist()]
    want = [(100 + q, int(i), float(s)) for q in range(20) for s, i in sorted(zip(own @ asked[q], ids, strict=True), key=lambda x: (-x[0], x[1]))[:k]]
    assert sorted(got) == sorted(want)


def test_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "BLOCKS", 2, raising=False)
    rng = np.random.default_rng(4)
    own = rng.integers(-3, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)] + [(60, None)], "id long, embedding array<float>")
    got = vectors.knn(df, df.where("id % 3 = 0").withColumnRenamed("id", "query_id"), 4)
    want = [(q, r + 1, i, s) for q in range(0, 60, 3) for r, (s, i) in enumerate(sorted(((float(own[q] @ own[i]), i) for i in range(60)), key=lambda x: (-x[0], x[1]))[:4])]
    assert sorted(map(tuple, got.collect())) == want


def shuffles(df) -> list[str]:
    """What the plan's exchanges deal rows out by, those it reuses left out."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for line in text.splitlines() if "Reused" not in line for x in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", re.sub(r"#\d+L?", "", line))]


def test_term_stats_count_in_one_pass(spark, sf_dir):
    assert shuffles(QUERIES["bm25_term_stats"](spark, sf_dir)) == ["term"]


def test_rows_that_share_an_id_count_each(spark):
    """As the SQL counts them."""
    df = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, ""), (3, None)], "id long, text string")
    assert sorted(map(tuple, bm25.term_stats(bm25.corpus(df, "id", "text")).collect())) == [("a", 2, 3), ("b", 1, 1)]


@pytest.mark.parametrize("few, asked", [(200, 500_000), (0, 500_000), (0, 0)])
def test_scores_are_summed_where_the_postings_are(spark, sf_dir, monkeypatch, few, asked):
    """Before, every pair of a query and a text was shuffled. Beyond the bounds the rows are the same."""
    want = sorted(map(tuple, QUERIES["bm25_batch"](spark, sf_dir).collect()))
    monkeypatch.setattr(bm25, "FEW_TERMS", few)
    monkeypatch.setattr(bm25, "ASKED", asked, raising=False)
    monkeypatch.setattr(bm25, "PAIRS", 500, raising=False)
    got = QUERIES["bm25_batch"](spark, sf_dir)
    if asked:
        assert not [x for x in shuffles(got) if x.startswith("query_id, id")]
    assert sorted(map(tuple, got.collect())) == want
