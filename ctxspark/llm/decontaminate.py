"""Benchmark decontamination by a positional inverted index of the training documents.

1. The benchmark's vocabulary is numbered and its terms are counted over all documents.
2. Every window of 10 consecutive item words gets its rarest and second rarest term. Occurrences of
   rarest terms form the stored index: term, document, position and the term numbers around it.
3. Windows meet postings on their rarest term. Lists are intersected with offsets adjusted: the second
   rarest term must stand at its own offset, then the whole phrase; a window whose terms stand near
   each other in another order is a proximity match.

A benchmark with more words than BLOCK_WORDS is handled in blocks of items, each against all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, slices

WINDOW = 10
#: Words of a block of items: bounds the vocabulary that is sent to every executor.
BLOCK_WORDS = 200_000
#: Share of a window's distinct terms that must stand around its rarest term for a proximity match.
NEAR = 0.8
#: ASCII bytes that are not in [0-9A-Za-z] become blanks, A-Z become a-z; other bytes stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _texts(part, column: int):
    return part.column(column).cast(pa.binary()).to_pylist()


def _vocabulary(batches):
    for batch in batches:
        found = {w for t in _texts(batch, 0) for w in words_of(t)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["word"])


def _numbers(text: bytes | None, ids: dict[bytes, int]) -> np.ndarray:
    found = words_of(text)
    return np.fromiter((ids.get(w, 0) for w in found), np.int32, len(found)) if found else np.zeros(0, np.int32)


def _frequencies(ids: dict[bytes, int]):
    def run(batches):
        counts = np.zeros(len(ids) + 1, np.int64)
        get = ids.get
        for batch in batches:
            for part in slices(batch, 0, size=500_000):
                got = [x for text in _texts(part, 0) for x in map(get, words_of(text)) if x]
                counts += np.bincount(np.array(got, np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["term", "n"])

    return run


def _windows(ids: dict[bytes, int], rank: np.ndarray):
    """item long, term (rarest), off, second, second_off, ids array, terms array of each distinct window."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                nums = _numbers(text, ids)
                size = min(WINDOW, len(nums))
                for w in {tuple(nums[i : i + size].tolist()) for i in range(len(nums) - size + 1)} if size else ():
                    order = sorted(range(size), key=lambda i: (rank[w[i]], w[i], i))
                    second = next((i for i in order if w[i] != w[order[0]]), order[0])
                    rows.append((item, w[order[0]], order[0], w[second], second, list(w), sorted(set(w))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "term", "off", "second", "second_off", "ids", "terms"])

    return run


def _index(ids: dict[bytes, int], anchor: np.ndarray):
    """Postings of the rarest terms, and one row with term -1 and the number of words for each document."""

    def run(batches):
        get = ids.get
        around = np.arange(-WINDOW + 1, WINDOW)
        for batch in batches:
            for part in slices(batch, 2):
                uids = part.column(0).to_numpy()
                sizes, own, terms, places, context = [], [], [], [], []
                for uid, text in zip(uids, _texts(part, 2), strict=True):
                    found = words_of(text)
                    sizes.append(len(found))
                    nums = np.fromiter((x or 0 for x in map(get, found)), np.int32, len(found))
                    at_ = np.flatnonzero(anchor[nums])
                    if len(at_):
                        padded = np.concatenate((np.full(WINDOW - 1, -1, np.int32), nums, np.full(WINDOW - 1, -1, np.int32)))
                        own.append(np.full(len(at_), uid))
                        terms.append(nums[at_])
                        places.append(at_)
                        context.append(padded[(at_ + WINDOW - 1)[:, None] + around].ravel())
                n, m = part.num_rows, sum(map(len, own))
                flat = np.concatenate(context) if m else np.zeros(0, np.int32)
                offsets = np.concatenate((np.zeros(n, np.int32), np.arange(m + 1, dtype=np.int32) * len(around))).astype(np.int32)
                join = lambda a, b, t: pa.array(np.concatenate([a, *b]).astype(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        join(uids, own, np.int64),
                        pa.concat_arrays([part.column(1).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                        join(np.full(n, -1), terms, np.int32),
                        join(np.array(sizes), places, np.int32),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    ],
                    names=["uid", "doc_id", "term", "pos", "ctx"],
                )

    return run


def phrase_matches(docs: DataFrame, items: DataFrame, ids: dict[bytes, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For one block of items: (documents uid, doc_id, n_words; matches uid, item, start, size, exact).

    docs: uid, doc_id, text; items: item, text. exact is false for proximity matches.
    """
    counted = docs.select("text").mapInArrow(_frequencies(ids), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rank = np.zeros(len(ids) + 1, np.int64)
    for row in counted.toLocalIterator():  # as many rows as the block has terms
        rank[row[0]] = row[1]
    windows = scratch.keep(items.mapInArrow(_windows(ids, rank), "item long, term int, off int, second int, second_off int, ids array<int>, terms array<int>"), "windows")
    anchor = np.zeros(len(ids) + 1, bool)
    for row in windows.select("term").distinct().toLocalIterator():
        anchor[row[0]] = True
    index = scratch.keep(docs.select("uid", "doc_id", "text").mapInArrow(_index(ids, anchor), "uid long, doc_id long, term int, pos int, ctx array<int>"), "index")
    at = lambda off: F.element_at("ctx", F.lit(WINDOW) - F.col("off") + F.col(off))
    both = index.where("term >= 0").select("uid", "term", "pos", "ctx").join(windows, "term")
    exact = (at("second_off") == F.col("second")) & (F.slice("ctx", F.lit(WINDOW) - F.col("off"), F.size("ids")) == F.col("ids"))
    near = F.array_contains("ctx", F.col("second")) & (F.size(F.array_intersect("ctx", "terms")) >= F.lit(NEAR) * F.size("terms")) & (F.size("terms") > 2)
    found = both.select("uid", "item", (F.col("pos") - F.col("off")).alias("start"), F.size("ids").alias("size"), exact.alias("exact"), near.alias("near"))
    matches = scratch.keep(found.where("exact or near").drop("near"), "matches")
    return index.where("term < 0").select("uid", "doc_id", F.col("pos").cast("long").alias("n_words")), matches


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    Repeated rows are judged each on its own. Null or empty texts have no words and no hits; an empty
    benchmark hits nothing. Items with a null item_id hit words but are not listed. n_near_items counts
    items with a proximity match (exact ones included). Other columns are not read.
    """
    ship(__name__)
    ship(f"{__package__}.common")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
        total = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
        blocks = max(1, -(-total // BLOCK_WORDS))
        if blocks > 1:
            rows = scratch.keep(rows, "rows")  # every block has to see the same row ids
        per_doc, found = None, None
        for b in range(blocks):
            own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
            ids = {bytes(r[0]): i + 1 for i, r in enumerate(own.select("text").mapInArrow(_vocabulary, "word binary").distinct().orderBy("word").toLocalIterator())}
            per_doc, matches = phrase_matches(rows, own, ids, scratch)
            found = matches if found is None else found.union(matches)
        exact = found.where("exact")
        places = exact.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_hit"))
        listed = exact.where("item is not null").select("uid", "item").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
        near = found.where("item is not null").select("uid", "item").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_near_items"))
        out = per_doc.join(places, "uid", "left").join(listed, "uid", "left").join(near, "uid", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        out = out.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"), zero("n_near_items").alias("n_near_items"))
        return scratch.result(out, "contamination")
