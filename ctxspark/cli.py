"""Command line: python -m ctxspark.cli --state FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import instance
from .plans.engine import Engine
from .session import get_session

#: Queries of `benchmark`.
QUERIES = ["where is the configuration loaded", "function that parses a file", "database query", "user authentication", "error handling"]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _say(value) -> None:
    print(json.dumps(value, default=str, indent=1, ensure_ascii=False))


def _index(e: Engine, a) -> dict:
    return e.index(a.tree, full=a.full)


def _search(e: Engine, a) -> list[dict]:
    return _rows(e.search_codebase(a.text, a.limit, a.language, a.path))


def _inspect(e: Engine, a) -> list[dict]:
    return _rows(e.symbols_of_file(a.path))


def _graph(e: Engine, a) -> list[dict]:
    find = {"dependencies": e.find_dependencies, "references": e.find_references, "callers": lambda n, _: e.find_callers(n), "callees": lambda n, _: e.find_callees(n)}[a.direction]
    return _rows(find(a.name, a.depth))


def _memory(e: Engine, a):
    if a.action == "save":
        return {"id": e.save_memory(a.text or "", a.category or "general", a.tag)}
    return _rows(e.memory.list_all(a.category, a.limit))


def _doctor(e: Engine, a) -> dict:
    """What is there: versions, tables of the last commit, whether their rows agree."""
    chunks, vectors = e.chunks(), e.vectors()
    lost = chunks.join(vectors, "id", "left_anti").count()
    return {"spark": e.spark.version, "tables": sorted(e.store.current()), "chunks": chunks.count(), "chunks_without_vector": lost, "embedder": e.embedder.model_name, "ok": lost == 0}


def _benchmark(e: Engine, a) -> dict:
    """Milliseconds of each query after a warm-up, and their mean."""
    _rows(e.search_codebase(QUERIES[0], 10))
    took = {}
    for q in QUERIES:
        began = time.perf_counter()
        _rows(e.search_codebase(q, 10))
        took[q] = round((time.perf_counter() - began) * 1000, 1)
    return {"ms": took, "mean_ms": round(statistics.mean(took.values()), 1)}


def tools(e: Engine) -> dict[str, Callable]:
    """What `mcp` offers, by name."""
    names = ("search_codebase", "search_symbol", "read_chunk", "find_references", "find_dependencies", "trace_flow", "explain_architecture", "find_similar_code", "recent_changes", "save_memory", "retrieve_memory", "get_stats")
    return {n: getattr(e, n) for n in names}


def serve(e: Engine, lines, say: Callable[[str], None]) -> None:
    """Answer JSON-RPC requests, one a line: initialize, tools/list, tools/call."""
    offered = tools(e)
    for line in lines:
        if not line.strip():
            continue
        request = {}
        try:
            request = json.loads(line)
            method, params = request.get("method"), request.get("params") or {}
            if method == "initialize":
                result = {"serverInfo": {"name": "ctxspark"}, "capabilities": {"tools": {}}}
            elif method == "tools/list":
                result = {"tools": [{"name": n, "description": (f.__doc__ or n).strip().split("\n")[0]} for n, f in offered.items()]}
            elif method == "tools/call" and params.get("name") in offered:
                got = offered[params["name"]](**(params.get("arguments") or {}))
                got = _rows(got) if isinstance(got, DataFrame) else got
                result = {"content": [{"type": "text", "text": json.dumps(got, default=str)}]}
            else:
                raise LookupError(f"no method {method}")
            answer = {"result": result}
        except Exception as error:  # a bad request must not end the server
            answer = {"error": {"code": -32000, "message": f"{type(error).__name__}: {error}"}}
        if "id" in request or "error" in answer:
            say(json.dumps({"jsonrpc": "2.0", "id": request.get("id"), **answer}))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ctxspark", description=__doc__)
    top.add_argument("--state", default=".context", help="folder of the index")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring the index up to date with a tree")
    index.add_argument("tree")
    index.add_argument("--full", action="store_true")
    again = sub.add_parser("reindex", help="index a tree anew")
    again.add_argument("tree")
    search = sub.add_parser("search", help="ranked chunks")
    search.add_argument("text")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("--language")
    search.add_argument("--path", help="glob of paths")
    sub.add_parser("stats", help="counts of the tables")
    sub.add_parser("inspect", help="symbols of a file").add_argument("path")
    graph = sub.add_parser("graph", help="what a symbol leads to, or what leads to it")
    graph.add_argument("name")
    graph.add_argument("--direction", choices=["dependencies", "references", "callers", "callees"], default="dependencies")
    graph.add_argument("--depth", type=int, default=2)
    memory = sub.add_parser("memory", help="list or save memories")
    memory.add_argument("action", choices=["list", "save"])
    memory.add_argument("text", nargs="?")
    memory.add_argument("--category")
    memory.add_argument("--tag", action="append")
    memory.add_argument("--limit", type=int, default=50)
    sub.add_parser("ps", help="processes that use the index")
    sub.add_parser("doctor", help="check the index")
    sub.add_parser("benchmark", help="time some searches")
    sub.add_parser("mcp", help="answer JSON-RPC requests on standard input")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "ps":
        _say(instance.running(a.state))
        return 0
    with instance.registered(a.state, a.command):
        e = Engine(get_session(), a.state)
        if a.command in ("index", "reindex"):
            a.full = a.command == "reindex" or a.full
            try:
                with instance.lock(a.state):
                    _say(_index(e, a))
            except instance.Busy as error:
                print(error, file=sys.stderr)
                return 1
        elif a.command == "stats":
            _say(_rows(e.get_stats())[0])
        elif a.command == "mcp":
            serve(e, sys.stdin, lambda line: print(line, flush=True))
        else:
            _say({"search": _search, "inspect": _inspect, "graph": _graph, "memory": _memory, "doctor": _doctor, "benchmark": _benchmark}[a.command](e, a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
