"""Layered settings: defaults, then YAML files, then CONTEXT_* variables, then arguments."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any

from .operators.chunking import Sizes
from .operators.hybrid import Weights


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing"
    dimension: int = 384
    batch_size: int = 32


@dataclass(frozen=True)
class Chunking:
    min_tokens: int = 50
    target_tokens: int = 500
    max_tokens: int = 1200
    overlap_tokens: int = 50

    def sizes(self) -> Sizes:
        return Sizes(self.min_tokens, self.target_tokens, self.max_tokens, self.overlap_tokens)


@dataclass(frozen=True)
class Security:
    enable_pii_masking: bool = True
    max_file_bytes: int = 2 * 1024 * 1024
    never_index: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Retrieval:
    default_limit: int = 10
    max_limit: int = 50
    semantic: float = 0.5
    bm25: float = 0.2
    symbol: float = 0.2
    graph: float = 0.1
    min_score: float = 0.05
    multiplier: int = 5

    def weights(self) -> Weights:
        return Weights(self.semantic, self.bm25, self.symbol, self.graph)


@dataclass(frozen=True)
class Memory:
    stale_days: int = 90
    max_per_category: int = 100


@dataclass(frozen=True)
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    security: Security = field(default_factory=Security)
    retrieval: Retrieval = field(default_factory=Retrieval)
    memory: Memory = field(default_factory=Memory)


def merge(base: dict, over: dict) -> dict:
    """Dictionaries merge, everything else (lists, too) replaces."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def _build(kind, values: dict[str, Any]):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(sorted(unknown))}")
    return kind(**{k: _build(type(getattr(kind(), k)), v) if isinstance(v, dict) else v for k, v in values.items()})


def load(files: list[str] = (), environ: dict[str, str] | None = None, **override) -> Config:
    """CONTEXT_<SECTION>_<FIELD>=value sets a field; missing files are skipped."""
    import yaml

    values: dict = {}
    for path in files:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                values = merge(values, yaml.safe_load(f) or {})
    sections = {f.name: getattr(Config(), f.name) for f in dataclasses.fields(Config)}
    for key, text in (os.environ if environ is None else environ).items():
        for name, section in sections.items():
            if key.startswith(prefix := f"CONTEXT_{name.upper()}_"):
                own = key.removeprefix(prefix).lower()
                if own in {f.name for f in dataclasses.fields(section)}:
                    values = merge(values, {name: {own: yaml.safe_load(text)}})
    return _build(Config, merge(values, override))
