"""Cache, locks, memory limits, store commits and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ctxspark import cli, instance
from ctxspark.cache import Cache
from ctxspark.operators import inference, vectors
from ctxspark.operators.tokens import Tokens
from ctxspark.plans.engine import Engine
from ctxspark.sources.store import SnapshotStore


def test_cache():
    now = [0.0]
    cache = Cache(2, 10, lambda: now[0])
    cache.put("a", 1)
    cache.put("b", 2)
    assert cache.get("a") == 1
    cache.put("c", 3)  # b is the least recently used
    assert cache.get("b") is None and cache.get("a") == 1 and len(cache) == 2
    now[0] = 10.0
    assert cache.get("a", "gone") == "gone" and cache.hits == 2 and cache.misses == 2
    none = Cache(0)
    none.put("x", 1)
    assert none.get("x") is None


def test_lock(tmp_path):
    with instance.lock(str(tmp_path)):
        with pytest.raises(instance.Busy):
            with instance.lock(str(tmp_path)):
                pass
    (tmp_path / "index.lock").write_text(json.dumps({"pid": 2**22 + 1}))  # no such process
    with instance.lock(str(tmp_path)):
        assert json.loads((tmp_path / "index.lock").read_text())["pid"] == os.getpid()
    assert not (tmp_path / "index.lock").exists()


def test_register_and_limits(tmp_path):
    (tmp_path / "running").mkdir()
    (tmp_path / "running" / "1.json").write_text("broken")
    with instance.registered(str(tmp_path), "index"):
        assert [e["what"] for e in instance.running(str(tmp_path))] == ["index"]
    assert instance.running(str(tmp_path)) == []
    used = [150.0]
    watch = instance.Watch(100, 200, lambda: used.__setitem__(0, used[0] - 60), lambda: used[0])
    assert watch.check() == 90
    used[0] = 300.0
    with pytest.raises(MemoryError):
        watch.check()
    said = []
    progress = instance.Progress(3, said.append, lambda: 0.0)
    for _ in range(3):
        progress.step()
    assert said == ["3/3 in 0.0 s"]


def test_store(spark, tmp_path):
    store, other = (SnapshotStore(spark, f"{tmp_path}/s") for _ in range(2))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert store.read("t", "k int, v string").isEmpty()
    assert store.commit({"t": rows}) == 1 and other.commit({"u": rows}) == 2
    assert set(store.current()) == {"t", "u"}  # the second commit keeps the first one's table
    store.upsert("t", "k int, v string", spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "k")
    assert sorted(map(tuple, store.read("t", "k int, v string").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert store.delete_rows("t", "k int, v string", rows, "k") == 2 and store.delete_rows("t", "k int, v string", rows, "k") == 0
    assert store.vacuum(1) == 2
    assert [tuple(r) for r in store.read("t", "k int, v string").collect()] == [(3, "c")] and store.read("u", "k int, v string").count() == 2
    (tmp_path / "s" / "_log" / f"{9:012d}.json").write_text("{broken")
    assert set(store.current()) == {"t", "u"}


def test_facts():
    got = {f[:2] for f in inference.script_facts("const C = () => { useContext(UserContext); const q = useQuery({ queryFn: load }); get('/api/a/1'); x.skip(1); return <Row a={1}><B.C/><UserContext.Provider/></Row> }")}
    assert {("consumes", "UserContext"), ("calls", "load"), ("calls", "get"), ("queries", "/api/a/1"), ("renders", "Row"), ("provides", "UserContext")} <= got
    assert ("calls", "skip") not in got
    php = "class A { public function __construct(private \\\\X\\\\Repo $r, ?int $n) {} }\nRoute::get('/a', [UserController::class, 'show']);\nRoute::post('/b', 'App\\\\B@save');".replace("\\\\", "\\")
    assert {f[:2] for f in inference.php_facts(php)} == {("injects", "Repo"), ("injects", "int"), ("route_to", "UserController"), ("route_to", "B")}


def test_tokens():
    t = Tokens("a /* x */ 'it\\'s' // y\n  b { ( ] }")
    assert [(x.text, x.line, x.leads) for x in t][:3] == [("a", 1, True), ("'it\\'s'", 1, False), ("b", 2, True)]
    assert t.text(t.partner[3]) == "}" and Tokens("") == []


def test_cells_recall(spark, sf_dir):
    """The nearest ten are found in a quarter of the cells, but for a tenth."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    indexed, centres = vectors.cells(rows, 8)
    asked = [[float(x) for x in r[0]] for r in rows.where("id % 50 = 0").select("embedding").collect()]
    found = total = 0
    for q in asked:
        want = {r["id"] for r in vectors.topk(rows, q, 10).collect()}
        found += len(want & {r["id"] for r in vectors.probe(indexed, centres, q, 10, 4).collect()})
        total += len(want)
    assert total and found / total >= 0.8


def test_command_line(spark, tmp_path, capsys):
    tree, state = tmp_path / "tree", f"{tmp_path}/state"
    tree.mkdir()
    (tree / "a.py").write_text("import b\n\nclass Loader(Base):\n    def load_config(self):\n        return helper()\n\ndef helper():\n    return 1\n")
    (tree / "b.tsx").write_text("export function Cart() {\n  return <Row />;\n}\nexport function Row() { return 1; }\n")

    def run(*args):
        assert cli.main(["--state", state, *args]) == 0
        return json.loads(capsys.readouterr().out)

    assert run("index", str(tree))["new"] == 2
    assert run("reindex", str(tree))["unchanged"] == 2
    assert run("search", "helper", "--limit", "3")[0]["file_path"] == "a.py"
    assert run("stats")["files"] == 2
    assert [s["name"] for s in run("inspect", "a.py")][:2] == ["Loader", "load_config"]
    assert {r["name"] for r in run("graph", "Cart")} == {"Row"}
    assert {r["name"] for r in run("graph", "Row", "--direction", "references")} == {"Cart"}
    assert "id" in run("memory", "save", "use tabs", "--category", "convention", "--tag", "style")
    assert [m["content"] for m in run("memory", "list")] == ["use tabs"]
    assert run("doctor")["ok"] and run("ps") == []
    assert run("benchmark")["mean_ms"] > 0
    said = []
    cli.serve(Engine(spark, state), ['{"id": 1, "method": "tools/list"}', '{"id": 2, "method": "tools/call", "params": {"name": "search_symbol", "arguments": {"name": "helper"}}}', '{"id": 3, "method": "none"}', "broken"], said.append)
    said = [json.loads(x) for x in said]
    assert len(said[0]["result"]["tools"]) == 12 and "helper" in said[1]["result"]["content"][0]["text"] and "error" in said[2] and "error" in said[3]
