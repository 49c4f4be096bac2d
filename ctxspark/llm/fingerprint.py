"""Homomorphic multiset fingerprints of documents.

Every paragraph (line) hashes to a wide vector: STRICT lanes modulo 2^64 from the whole paragraph, and
LANES lanes modulo 2^16 in which each of its word 3-shingles adds +1 or -1. A document's fingerprint is
the sum over its paragraphs, so it does not depend on their order, equal multisets of paragraphs give
equal fingerprints, and inserting or deleting a paragraph adds or subtracts its vector. The second kind
of lanes is a tug-of-war sketch: inner products of two fingerprints estimate those of the shingle
multisets, which gives the likeness of two documents.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

STRICT = 4
LANES = 256
SHINGLE = 3
#: Rows of a range of doc_id; ranges are sorted and read one after the other.
RANGE_ROWS = 4096
MAX_RANGES = 100_000
SLICE_ROWS = 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class WordHashes(dict):
    """Hash of each word, remembered; emptied when it grows beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Fingerprint:
    """The vector sum of paragraphs; + and - combine fingerprints, str() gives the text form."""

    __slots__ = ("lanes", "strict")

    def __init__(self, strict: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.strict = np.zeros(STRICT, np.uint64) if strict is None else strict
        self.lanes = np.zeros(LANES, np.int16) if lanes is None else lanes

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strict + other.strict, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strict - other.strict, self.lanes - other.lanes)

    def __eq__(self, other) -> bool:
        return bool((self.strict == other.strict).all() and (self.lanes == other.lanes).all())

    def __hash__(self) -> int:
        return hash(str(self))

    def __str__(self) -> str:
        return base64.b64encode(self.strict.tobytes() + self.lanes.tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        """Estimated cosine of the shingle multisets, 0 to 1; 1 for equal fingerprints, 0 against an empty one."""
        if self == other:
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def of_paragraphs(paragraphs: list[str], hashes: WordHashes) -> Fingerprint:
    if not paragraphs:
        return Fingerprint()
    strict = np.zeros(STRICT, np.uint64)
    got, ends = [], []
    for p in paragraphs:
        digest = xxhash.xxh3_128_digest(p) + xxhash.xxh3_128_digest(p, 1)
        strict += np.frombuffer(digest, np.uint64)
        found = p.split()
        got += found
        ends.append(len(found))
    if not got:
        return Fingerprint(strict)
    w = np.fromiter(map(hashes.__getitem__, got), np.uint64, len(got))
    # place of each word in its paragraph from the end: shingles must not cross paragraphs
    sizes = np.array([e for e in ends if e])
    last = np.repeat(np.cumsum(sizes), sizes)
    pos = np.arange(len(w))
    h = w * _ODD[0]
    for i in range(1, SHINGLE):
        there = pos + i < last
        h = np.where(there, h * _ODD[1] + np.concatenate((w[i:], w[:i]))[: len(w)], h)
    # a paragraph has one shingle for each start but its last SHINGLE - 1 words (one at least)
    begin = last - np.repeat(sizes, sizes)
    h = h[(pos + SHINGLE <= last) | (pos == begin)]
    lanes = np.empty((len(h), LANES // 64), np.uint64)
    for i in range(LANES // 64):
        x = h * _ODD[i]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        lanes[:, i] = x ^ (x >> np.uint64(32))
    bits = np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return Fingerprint(strict, (2 * bits - len(h)).astype(np.int16))


def of_text(text: str | None, hashes: WordHashes | None = None) -> Fingerprint:
    """A null text counts as empty; an empty text has one empty paragraph."""
    return of_paragraphs((text or "").split("\n"), WordHashes() if hashes is None else hashes)


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _chain(batches):
    """Rows in the order of documents within a range; the row after the last one of a range comes as a copy."""
    hashes = WordHashes()
    before = None  # of the current range: pid, doc_id, text, fingerprint
    out: list[tuple] = []

    def finish(doc_id, text, own, following, next_own):
        edited = edit(text, following)
        old, new = text.split("\n"), edited.split("\n")
        same = 0
        while same < min(len(old), len(new)) and old[same] == new[same]:
            same += 1
        own_edited = own - of_paragraphs(old[same:], hashes) + of_paragraphs(new[same:], hashes)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(own_edited), own.likeness(own_edited), own.likeness(next_own)))

    def flush():
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for pid, copy, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if before is not None and before[0] != pid:
                    before = None  # its successor came as a copy
                if copy and before is None:
                    continue  # a further copy
                own = of_text(text, hashes)
                if before is not None:
                    finish(before[1], before[2], before[3], text, own)
                before = None if copy else (pid, doc_id, text, own)
            if out:
                yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next doc_id (after the last: the first; nulls come first, rows
    with one doc_id are ordered by text). Null texts count as empty; repeated rows stay repeated. Texts of
    more than 32,767 equal shingles keep exact equality but may misjudge likeness. Other columns are not read.
    """
    ship(__name__)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds = rows.agg(F.percentile_approx("ord", [i / ranges for i in range(1, ranges)] or [0.5], 100_000)).first()[0] or []
    cuts = np.unique(np.array(bounds if ranges > 1 else [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="left"))

    firsts = sorted((r[0], r[1]) for r in rows.groupBy(range_of("ord").alias("pid")).agg(F.min("ord")).collect())  # one row per range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("int")
    def range_before(ids: pd.Series) -> pd.Series:
        return ids.map(before).fillna(-1).astype("int32")

    placed = rows.withColumns({"pid": range_of("ord"), "prev": range_before("ord")})
    own = F.struct(F.col("pid"), F.lit(0).alias("copy"))
    both = F.when(F.col("prev") >= 0, F.array(own, F.struct(F.col("prev").alias("pid"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    placed = placed.select("doc_id", "ord", "text", F.explode(both).alias("at")).select("at.pid", "at.copy", "doc_id", "ord", "text")
    ordered = placed.repartition("pid").sortWithinPartitions("pid", "copy", "ord", "text")
    return ordered.select("pid", "copy", "doc_id", "text").mapInArrow(_chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
