import os

import pytest
from pyspark.sql import functions as F

from ctxspark import config, fixtures
from ctxspark.operators import bm25, chunking, graph, hybrid, memory, vectors
from ctxspark.operators.parsing import parse
from ctxspark.plans.engine import Engine
from ctxspark.streaming import ingest


@pytest.mark.parametrize("path", sorted(fixtures.FILES))
def test_parser_fixture(path):
    language, source = fixtures.FILES[path]
    got = parse(source, language, path)
    assert sorted((s["name"], s["symbol_type"], s["line_start"], s["line_end"], s["parent_name"] or "") for s in got.symbols) == sorted((*r[:4], r[4] or "") for r in fixtures.EXPECTED[path])
    assert sorted((r["target_name"], r["relationship_type"]) for r in got.relationships) == sorted(fixtures.EXPECTED_RELATIONSHIPS[path])


def test_parsers_never_raise():
    assert parse("x", "cobol", "a").errors
    broken = parse("class A:\n  def f(:\n", "python", "a.py")
    assert broken.errors and [s["name"] for s in broken.symbols] == ["A", "f"]
    for language in ("php", "tsx", "csharp", "sql", "dotnet", "asp"):
        assert not parse("", language, "a").symbols
        parse("class A { function f( { ' \" /* ", language, "a")


def test_split_lines():
    assert chunking.split_lines("", 10) == [(0, "")]
    text = "".join(f"line number {i:03d}\n" for i in range(50))
    parts = chunking.split_lines(text, 20, 0)
    assert "".join(p for _, p in parts) == text and all(chunking.tokens(p) <= 30 for _, p in parts)
    over = chunking.split_lines(text, 20, 5)
    assert all(b[1].startswith(a[1].split("\n")[-2]) for a, b in zip(over, over[1:]))
    long = "x" * 1000
    assert chunking.split_lines(long + "\nshort\n", 20) == [(0, long + "\n"), (1, "short\n")]


def test_chunk_plan():
    source = "import a\n" * 60 + "def f():\n    return 1\n" + "# tail\n" * 40
    symbol = {"name": "f", "symbol_type": "function", "line_start": 61, "line_end": 62, "parent_name": None}
    got = chunking.plan(source, [symbol], chunking.Sizes(5, 20, 60, 0))
    assert got[0]["symbol"] == 0 and (got[0]["line_start"], got[0]["line_end"]) == (61, 62)
    assert all(chunking.tokens(c["content"]) <= 75 for c in got) and {c["symbol"] for c in got[1:]} == {None}
    assert chunking.plan("", [], chunking.Sizes()) == []
    methods = [{"name": f"m{i}", "symbol_type": "method", "line_start": 2 + 10 * i, "line_end": 11 + 10 * i, "parent_name": "C"} for i in range(6)]
    body = "class C:\n" + "".join(f"    statement number {i}\n" for i in range(60))
    split = chunking.plan(body, [{"name": "C", "symbol_type": "class", "line_start": 1, "line_end": 61, "parent_name": None}, *methods], chunking.Sizes(5, 20, 130, 0))
    assert len(split) == 3 and split[-1]["line_end"] == 61


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "banana pie"), (3, None), (4, "")], "id long, t string")
    corpus = bm25.corpus(docs, "id", "t")
    got = bm25.search(corpus, spark.createDataFrame([(7, "apple apple"), (8, "nothing")], "query_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(7, 1, 1, 1.0)]
    empty = bm25.corpus(docs.limit(0), "id", "t")
    assert bm25.search(empty, spark.createDataFrame([(7, "apple")], "query_id long, text string")).count() == 0
    assert bm25.corpus(docs, "id", "t", max_docs=2, max_tokens=2).agg(F.sum(F.size("tokens"))).first()[0] == 4


def test_vectors(spark):
    rows = [(i, [float(i == j) for j in range(4)]) for i in range(4)] + [(9, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert [r["id"] for r in vectors.topk(v, [0.0, 1.0, 0.5, 0.0], 2).collect()] == [1, 2]
    got = vectors.knn(v, v.select(F.col("id").alias("query_id"), "embedding"), 1)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(i, i) for i in range(4)}
    with pytest.raises(ValueError):
        vectors.check_index_type("annoy")
    with pytest.raises(Exception, match="expected 3"):
        vectors.check_dimension(v, 3).collect()
    indexed, centres = vectors.cells(v.where("embedding is not null"), 2)
    assert vectors.probe(indexed, centres, [1.0, 0.0, 0.0, 0.0], 1, 2).first()["id"] == 0


def test_weights():
    with pytest.raises(ValueError):
        hybrid.Weights(0.9, 0.9, 0, 0)
    assert hybrid.candidates(100) == 250


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0.9), ("b", "c", "uses", 1.0), ("c", "a", "calls", 1.0), ("a", "c", "extends", 1.0), ("b", "unresolved::x", "calls", 1.0)], "src string, dst string, type string, confidence double")
    starts = spark.createDataFrame([("a",)], "node string")
    assert sorted((r["node"], r["depth"], r["type"]) for r in graph.dependencies(edges, starts, 5).collect()) == [("b", 1, "calls"), ("c", 1, "extends")]
    assert sorted((r["node"], r["depth"]) for r in graph.references(edges, starts, 2).collect()) == [("b", 2), ("c", 1)]
    assert [r["node"] for r in graph.shortest_path(edges, "b", "a").collect()] == ["b", "c", "a"]
    assert graph.shortest_path(edges, "c", "nowhere").count() == 0
    assert graph.dependencies(edges, starts, 0).count() == 0
    names = spark.createDataFrame([("1", "f", 2, "n", "m.n"), ("2", "e", 9, "n", "n")], "id string, file_path string, line_start int, name string, qualified_name string")
    rel = spark.createDataFrame([("a", None, "n", "calls", 1.0, 1), ("a", None, "gone", "calls", 1.0, 2), ("a", "2", "n", "uses", 0.5, 3)], "source_symbol_id string, target_symbol_id string, target_name string, relationship_type string, confidence double, seq long")
    got = graph.edges_of(graph.resolve(rel, graph.name_index(names)))
    assert sorted((r["dst"], r["type"]) for r in got.collect()) == [("2", "uses"), ("unresolved::gone", "calls")]
    assert {r["symbol_id"] for r in graph.name_index(names, last=True).where("name = 'n'").collect()} == {"1"}


def test_memory(spark, tmp_path):
    store = memory.MemoryStore(spark, str(tmp_path / "memory"), per_category=2)
    assert store.stats().collect()[0]["total"] == 0
    first = store.save("Use Tabs", "convention", ["style"])
    assert [r["id"] for r in store.retrieve("tabs", tags=["style"])] == [first]
    assert store.retrieve("tabs", category="bug") == []
    assert store.retrieve("TABS")[0]["access_count"] == 1
    assert store.update(first, "Use spaces") and not store.update("none", "x")
    for i in range(3):
        store.save(f"note {i}", "convention")
    kept = [r["content"] for r in store.list_all("convention").collect()]
    assert len(kept) == 2 and "Use spaces" in kept  # it was accessed, so the others went first
    assert store.forget(first) and not store.forget(first)
    assert store.save("x", "no such category") and store.list_all("general").count() == 1
    assert store.forget_stale() == 0


def test_engine(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, (_, source) in fixtures.FILES.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(source)
    for path in (".env", "vendor/x.php", "app/node_modules/y.js", "a.png", "trace.log"):
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text("class Hidden {}")
    (tree / ".gitignore").write_text("*.log\n")
    (tree / "web/login.ts").write_text("export const useLogin = () => {\n  return useMutation({ mutationFn: loginApi });\n};\nexport function loginApi() { return fetch('/api/login'); }\n")
    engine = Engine(spark, str(tmp_path / "state"), config.load(chunking={"min_tokens": 5}))
    first = engine.index(str(tree))
    assert first["new"] == first["scanned"] == len(fixtures.FILES) + 2 and first["symbols"] > 30
    assert engine.symbols().where("name = 'Hidden'").isEmpty()
    assert engine.chunks().where("token_count > 1250").isEmpty()
    assert engine.find_references("loginApi").select("name").first()[0] == "useLogin"
    assert [r["name"] for r in engine.trace_flow("useLogin", "loginApi").collect()] == ["useLogin", "loginApi"]
    assert engine.search_codebase("login mutation", 3).first()["file_path"] == "web/login.ts"
    assert engine.search_codebase("login", 5, path_filter="*.py").count() == 0
    again = engine.index(str(tree))
    assert again["unchanged"] == first["scanned"] and again["indexed"] == 0
    os.remove(tree / "web/login.ts")
    (tree / "tool/run.py").write_text("def fresh():\n    return 1\n")
    third = engine.index(str(tree))
    assert (third["modified"], third["deleted"], third["new"]) == (1, 1, 0)
    assert engine.symbols().where("name in ('loginApi', 'Runner')").isEmpty() and engine.search_symbol("fresh").count() == 1
    assert engine.vectors().join(engine.chunks(), "id", "left_anti").isEmpty() and engine.chunks().join(engine.vectors(), "id", "left_anti").isEmpty()
    row = engine.explain_architecture().first()
    assert row["files"] == third["scanned"] and row["vectors"] == row["chunks"]
    assert engine.recent_changes(1).count() == 1
    chunk = engine.chunks().select("id").first()[0]
    assert engine.read_chunk(chunk).count() == 1


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("chunking: {max_tokens: 900}\nsecurity: {never_index: [a, b]}\n")
    c = config.load([str(path), "missing.yaml"], {"CONTEXT_CHUNKING_MIN_TOKENS": "40", "CONTEXT_UNKNOWN": "1"}, security={"never_index": ["c"]})
    assert (c.chunking.max_tokens, c.chunking.min_tokens, c.security.never_index) == (900, 40, ["c"])
    with pytest.raises(ValueError):
        config.load(environ={}, chunking={"typo": 1})


def test_stream_windows(spark, sf_dir, tmp_path):
    stream = ingest.windowed(ingest.file_stream(spark, f"{sf_dir}/events.parque[t]", ingest.EVENTS))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    total = spark.table("windows").agg(F.sum("events")).first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()
