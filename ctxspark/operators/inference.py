"""Relationships inferred from conventions of web frameworks.

One Arrow pass walks the tokens of every file and writes down what it calls, renders, consumes, provides,
requests, injects and routes to, with lines; the rest is joins: a fact belongs to the symbols whose lines
hold it. Names are resolved to the last symbol of that short name by (file path, line, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import last_wins
from .tokens import Tokens

# Names that are never taken for calls of indexed functions.
IGNORED_CALLS = ["Array", "Boolean", "Date", "Error", "Number", "Object", "Promise", "String", "fetch", "if", "map", "parseInt", "setTimeout", "switch"]
CALLERS = ("function", "react_component", "hook", "arrow_function")
VIEWS = ("react_component", "hook")
SEQ = {"calls": 1, "renders": 2, "consumes": 3, "queries": 4, "provides": 5, "injects": 6, "depends_on": 7, "route_to": 8}
# Calls that declare a route.
ROUTE_VERBS = {"get", "post", "put", "patch", "delete", "any", "match", "resource", "apiResource"}
URL_CHARS = set("abcdefghijklmnopqrstuvwxyz0123456789/_-")

Fact = tuple[str, str, int, str]  # kind, target name, line, source text


def script_facts(source: str) -> Iterator[Fact]:
    """Calls, rendered elements, contexts and requested urls of a JavaScript or TypeScript source."""
    t = Tokens(source)
    for i, x in enumerate(t):
        after = t.text(i + 1)
        if x.kind == "word" and not x.text.startswith("$"):
            if after == "(" and t.text(i - 1) != ".":
                yield "calls", x.text, x.line, ""
                if x.text == "useContext" and t.is_word(i + 2) and t.text(i + 2).endswith("Context") and t.text(i + 3) == ")":
                    yield "consumes", t.text(i + 2), x.line, ""
            elif x.text in ("queryFn", "mutationFn") and after == ":" and t.is_word(i + 2):
                yield "calls", t.text(i + 2), x.line, ""
        elif x.text == "<" and t.is_word(i + 1) and t[i + 1].start == x.end:
            if t.text(i + 2) == "." and t.text(i + 3) == "Provider" and after.endswith("Context"):
                yield "provides", after, x.line, ""
            elif after[0].isupper() and (t.text(i + 2) in ("/", ">") or (i + 2 < len(t) and t[i + 2].start > t[i + 1].end)):
                yield "renders", after, x.line, ""
        elif x.kind == "string" and x.value.lower().startswith("/api/") and len(x.value) > 5 and set(x.value.lower()) <= URL_CHARS:
            yield "queries", x.value, x.line, ""


def php_facts(source: str) -> Iterator[Fact]:
    """Types of constructor parameters, and what routes lead to, of a PHP source."""
    t = Tokens(source, "php")
    short = lambda name: name.rsplit("\\", 1)[-1]
    for i, x in enumerate(t):
        if x.text == "function" and t.text(i + 1) == "__construct" and t.text(i + 2) == "(":
            for j in range(i + 3, t.partner[i + 2]):
                if t.text(j).startswith("$") and t.is_word(j - 1) and not t.text(j - 1).startswith("$"):
                    yield "injects", short(t.text(j - 1)), x.line, ""
        elif x.text == "Route" and t.text(i + 1) == "::" and t.text(i + 2) in ROUTE_VERBS and t.text(i + 3) == "(" and t.is_string(i + 4) and t.text(i + 5) == ",":
            at = i + 6
            if t.text(at) == "[" and t.is_word(at + 1) and t.text(at + 2) == "::" and t.is_string(at + 5):
                yield "route_to", short(t.text(at + 1)), x.line, source[x.start : t[t.partner[at]].end]
            elif t.is_string(at):
                yield "route_to", short(t[at].value).split("@")[0], x.line, source[x.start : t[at].end]


def facts(files: DataFrame) -> DataFrame:
    """file_path, kind, target_name, line, said of files (path, source); languages are told by suffix."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                suffix = (path or "").rsplit(".", 1)[-1].lower()
                read = php_facts if suffix == "php" else script_facts if suffix in ("js", "jsx", "ts", "tsx", "mjs", "cjs") else None
                rows += [(path, *f) for f in read(source or "")] if read else []
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.string()) for c, n in zip(cols, names, strict=True)], names=names)

    names = ["file_path", "kind", "target_name", "line", "said"]
    return files.select("path", "source").mapInArrow(run, "file_path string, kind string, target_name string, line int, said string")


def _last_by_name(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.col("name").alias("target_name")).agg(F.max(F.struct("file_path", "line_start", "id")).alias("at")).select("target_name", F.col("at.id").alias("target_symbol_id"))


def _edge(rows: DataFrame, kind: str, confidence: float, origin: str) -> DataFrame:
    """rows: source_symbol_id, source_file_path, target_name, target_symbol_id."""
    return rows.select("source_symbol_id", "source_file_path", "target_symbol_id", "target_name", F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"), F.lit(origin).alias("origin"), F.lit(1_000_000 + SEQ[kind]).cast("long").alias("seq"))


def infer(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The inferred relationships of symbols (id, name, symbol_type, file_path, line_start, line_end) in files (path, source)."""
    names = _last_by_name(symbols)
    said = facts(files).distinct()
    inside = symbols.select("id", "name", "symbol_type", "file_path", "line_start", "line_end").join(said, "file_path").where("line between line_start and line_end")
    inside = inside.select(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("source_file_path"), "name", "symbol_type", "kind", "target_name").distinct()

    def found(kind: str, types: tuple[str, ...], confidence: float, origin: str) -> DataFrame:
        rows = inside.where((F.col("kind") == kind) & F.col("symbol_type").isin(*types)).where("target_name <> name")
        return _edge(rows.join(names, "target_name"), kind, confidence, origin)

    def own(kind: str, id_of, confidence: float, origin: str, rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("kind") == kind).join(names, "target_name")
        return _edge(rows.withColumns({"source_symbol_id": X.uuid5(id_of), "source_file_path": F.col("file_path")}), kind, confidence, origin)

    urls = inside.where("kind = 'queries' and symbol_type = 'hook'").withColumn("target_symbol_id", F.lit(None).cast("string"))
    routes = said.where(F.col("file_path").contains("routes/"))
    out = [
        found("calls", CALLERS, 0.9, "react").where(~F.col("target_name").isin(*IGNORED_CALLS)),
        found("renders", VIEWS, 0.9, "react"),
        found("consumes", VIEWS, 1.0, "react"),
        _edge(urls, "queries", 0.8, "react"),
        own("provides", F.concat(F.col("file_path"), F.lit("::provider::"), F.col("target_name")), 0.95, "react", said),
        found("injects", ("controller", "service"), 0.95, "laravel"),
        own("route_to", F.concat_ws("::", "file_path", "said"), 1.0, "laravel", routes),
    ]
    for suffix, role, confidence in (("Repository", "repository", 0.9), ("Policy", "policy", 0.85)):
        served = symbols.where((F.col("symbol_type") == role) & F.col("name").endswith(suffix))
        served = served.select(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("source_file_path"), F.regexp_replace("name", suffix, "").alias("target_name"))
        out.append(_edge(served.join(names, "target_name"), "depends_on", confidence, "laravel"))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    every = every.withColumn("id", X.relationship_id(F.col("source_symbol_id"), F.col("target_name"), F.col("relationship_type")))
    return last_wins(every, "id", "seq")
