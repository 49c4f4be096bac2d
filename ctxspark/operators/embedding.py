"""Embedders: a contract, a model-free default by feature hashing, and an Arrow pass over a table."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# What known models want before a query and before a document.
PREFIXES = {
    "BAAI/bge-small-en-v1.5": ("Represent this sentence for searching relevant passages: ", ""),
    "BAAI/bge-base-en-v1.5": ("Represent this sentence for searching relevant passages: ", ""),
    "BAAI/bge-large-en-v1.5": ("Represent this sentence for searching relevant passages: ", ""),
    "nomic-ai/nomic-embed-text-v1.5": ("search_query: ", "search_document: "),
}


class Embedder(Protocol):
    model_name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, unit length; the same everywhere and without a model."""

    model_name = "hashing"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9_$]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[row, h % self.dimension] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def prefixed(text: str, model: str, query: bool) -> str:
    return PREFIXES.get(model, ("", ""))[0 if query else 1] + text


def embed_table(rows: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, batch: int = 32) -> DataFrame:
    """id, embedding of rows (id, text): the embedder is made once per task."""

    def run(batches):
        embedder = make()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                got = embedder.embed([prefixed(t or "", embedder.model_name, False) for t in own.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(got), pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")


def embed_query(text: str, embedder: Embedder) -> list[float]:
    return [float(x) for x in embedder.embed([prefixed(text, embedder.model_name, True)])[0]]
