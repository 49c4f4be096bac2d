"""Chunks of source files: symbols, split large ones, gaps between them, whole files without any.

Boundaries come from a sequential fold over a file's lines in one Arrow pass (`plan`); headers, masking,
counts, hashes and ids are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions import text as X

# Symbols that are chunks of their own.
TOP_LEVEL = frozenset(
    "class abstract_class interface trait enum function react_component hook controller service repository model policy event listener job command migration provider middleware".split()
)
METHODS = frozenset(("method", "constructor", "arrow_function"))


@dataclass(frozen=True)
class Sizes:
    min_tokens: int = 50
    target_tokens: int = 500
    max_tokens: int = 1200
    overlap_tokens: int = 50

    def __post_init__(self):
        if not self.min_tokens < self.target_tokens < self.max_tokens:
            raise ValueError("min_tokens < target_tokens < max_tokens must hold")


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def split_lines(text: str, max_tokens: int, overlap_tokens: int = 0) -> list[tuple[int, str]]:
    """(first line, from 0; text) of greedy segments of whole lines; a too long line stays whole.

    Lines at the end of a segment that fit in overlap_tokens begin the next one.
    """
    if tokens(text) <= max_tokens:
        return [(0, text)]
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    sizes = [tokens(x) for x in lines]
    out, begin, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total + size > max_tokens and i > begin:
            out.append((begin, "".join(lines[begin:i])))
            begin, total = i, 0
            while begin > out[-1][0] and total + sizes[begin - 1] <= overlap_tokens:
                begin -= 1
                total += sizes[begin]
        total += size
    out.append((begin, "".join(lines[begin:])))
    return out


def plan(source: str, symbols: list[dict], sizes: Sizes = Sizes()) -> list[dict]:
    """Chunks (symbol index or None, line_start, line_end, content) of one file in emission order."""
    lines = source.split("\n")
    part = lambda a, b: "\n".join(lines[a - 1 : b])
    out: list[dict] = []

    def add(content: str, first: int, last: int, symbol: int | None) -> None:
        out.append({"symbol": symbol, "line_start": first, "line_end": last, "content": content})

    def add_split(content: str, first: int, symbol: int | None) -> None:
        for at, text in split_lines(content, sizes.max_tokens, sizes.overlap_tokens):
            n = len(text.rstrip("\n").split("\n"))
            add(text.rstrip("\n"), first + at, first + at + n - 1, symbol)

    top = [(i, s) for i, s in enumerate(symbols) if s["symbol_type"] in TOP_LEVEL]
    top.sort(key=lambda x: (x[1]["line_start"], x[0]))
    for i, s in top:
        first, last = s["line_start"], min(s["line_end"], len(lines))
        whole = part(first, last)
        if tokens(whole) <= sizes.max_tokens:
            add(whole, first, last, i)
            continue
        methods = sorted((m["line_start"], min(m["line_end"], last), j) for j, m in enumerate(symbols) if m["symbol_type"] in METHODS and m["parent_name"] == s["name"] and first <= m["line_start"] <= last)
        if not methods:
            add_split(whole, first, i)
            continue
        if methods[0][0] > first and tokens(part(first, methods[0][0] - 1)) >= sizes.min_tokens:
            add(part(first, methods[0][0] - 1), first, methods[0][0] - 1, i)
        pending: list[tuple[int, int, int]] = []

        def flush(pending=pending, i=i) -> None:
            if pending:
                body = "\n".join(part(a, b) for a, b, _ in pending)
                if tokens(body) >= sizes.min_tokens:
                    add(body, pending[0][0], pending[-1][1], pending[0][2] if len(pending) == 1 else i)
                pending.clear()

        for a, b, j in methods:
            body = part(a, b)
            if tokens(body) > sizes.max_tokens:
                flush()
                add_split(body, a, j)
                continue
            if pending and tokens("\n".join(part(x, y) for x, y, _ in pending) + "\n" + body) > sizes.max_tokens:
                flush()
            pending.append((a, b, j))
        flush()
    at = 1
    for first, last in [(s["line_start"], min(s["line_end"], len(lines))) for _, s in top] + ([(len(lines) + 1, 0)] if top else []):
        if first > at:
            gap = part(at, first - 1).strip("\n")
            if gap.strip() and tokens(gap.strip()) >= sizes.min_tokens:
                if tokens(gap) > sizes.max_tokens:
                    add_split(gap, at, None)
                else:
                    add(gap, at, first - 1, None)
        at = max(at, last + 1)
    if not out and source.strip():
        add_split(source, 1, None)
    return out


_PLANNED = "path string, chunk_index int, symbol int, line_start int, line_end int, content string"


def chunk_files(files: DataFrame, parsed: DataFrame, sizes: Sizes = Sizes(), mask: bool = True) -> DataFrame:
    """The chunks table of files (path, language, source) and what parse_files gave for them."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, source, symbols in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "symbols")), strict=True):
                rows += [(path, n, c["symbol"], c["line_start"], c["line_end"], c["content"]) for n, c in enumerate(plan(source or "", symbols or [], sizes))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "chunk_index", "symbol", "line_start", "line_end", "content"])

    both = files.join(parsed.select("path", "symbols"), "path")
    rows = both.select("path", "source", "symbols").mapInArrow(run, _PLANNED)
    rows = rows.join(both.select("path", "language", "symbols"), "path")
    own = F.when(F.col("symbol").isNotNull(), F.try_element_at("symbols", F.col("symbol") + 1))
    rows = rows.withColumns({"symbol_name": own["name"], "symbol_type": own["symbol_type"], "file_id": X.file_id(F.col("path"))})
    rows = rows.withColumn("symbol_id", F.when(F.col("symbol").isNotNull(), X.symbol_id(F.col("file_id"), own["qualified_name"], own["line_start"])))
    rows = rows.withColumn("content", X.context_header(F.col("content"), F.col("path"), F.col("symbol_name")))
    masked = masking.mask(F.col("content")) if mask else F.col("content")
    return rows.select(
        X.chunk_id(F.col("file_id"), F.col("line_start"), F.col("chunk_index")).alias("id"),
        "file_id", F.col("path").alias("file_path"), "symbol_id", "content", masked.alias("content_masked"), "language", "symbol_name", "symbol_type",
        "line_start", "line_end", X.content_hash(F.col("content")).alias("hash"), X.token_count(F.col("content")).alias("token_count"), "chunk_index",
    )
