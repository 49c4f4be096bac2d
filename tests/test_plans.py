"""Plans that must hold at any size: pruned scans, pushed filters, bounded top-k, no Python where none is needed."""

import re

import pytest

from ctxspark.catalogue import QUERIES


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_point_lookup_is_pushed_down(spark, sf_dir):
    text = plan(QUERIES["vector_get"](spark, sf_dir))
    assert "EqualTo(vec_id,42)" in text and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


@pytest.mark.parametrize("name, columns", [("language_counts", "lang:string"), ("pii_mask", "doc_id:bigint,text:string"), ("page_links", "page_id:bigint,html:string"), ("recent_changes", "o_orderkey:bigint,o_orderdate:timestamp")])
def test_columns_are_pruned(spark, sf_dir, name, columns):
    found = set(re.findall(r"ReadSchema: struct<(.*)>", plan(QUERIES[name](spark, sf_dir))))
    assert {re.sub("timestamp(_ntz)?", "timestamp", f) for f in found} == {columns}


@pytest.mark.parametrize("name", ["vector_topk", "recent_changes", "memory_list", "symbol_search"])
def test_top_k_is_no_global_sort(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["bm25_search", "memory_evict", "hybrid_search"])
def test_ranks_are_cut_before_the_window(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert name == "memory_evict" or "WindowGroupLimit" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"vector_knn_batch", "split_lines", "chunk_fixture_repo", "parse_relationships", "stream_ingest_counts"} - {q for q in QUERIES if q.startswith("parse_")}))
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("MapIn|EvalPython|FlatMapGroups|CartesianProduct", text)
