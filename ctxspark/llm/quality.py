"""Document quality by a linear-chain conditional random field over lines.

Every line gets surface features of its own and, as differences, of its neighbours; a two-state chain
(bad, good) with feature weights and a transition matrix is fitted by maximum conditional likelihood.
Labels exist for documents only, so training lines carry their document's label. Forward-backward
gives each line's marginal probability of good; the document's quality is their mean, weighted by
line length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

#: At most about so many labelled documents, and of these whole lines, are used to fit the model.
TRAIN_DOCS = 6_000
STEPS = 300
RIDGE = 1e-3
SLICE_ROWS = 512
N_OWN = 14
N_FEATURES = 1 + N_OWN + 2 * N_OWN
#: Kinds of bytes: 1 lower a-z, 2 upper A-Z, 3 digit, 4 blank, 5 end-of-sentence, 6 comma etc., 7 other ASCII, 8 non-ASCII.
_KIND = np.array([8 if b >= 128 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c" else 5 if b in b".!?" else 6 if b in b",;:'\"-()" else 7 for b in range(256)], np.uint8)


@dataclass
class QualityModel:
    weights: np.ndarray  # N_FEATURES, log-odds of good against bad
    transition: np.ndarray  # 2 x 2
    mean: np.ndarray
    scale: np.ndarray


def line_features(lines: list[bytes]) -> np.ndarray:
    """N_OWN surface features of each line, computed over the concatenated bytes."""
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    kind = _KIND[data]
    per = np.maximum(sizes, 1).astype(float)
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
    share = {k: count(kind == k) / per for k in range(1, 9)}
    share[4] = (count(kind == 4) - 1) / per
    same = np.empty(len(data), bool)
    same[0] = False
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] != 4)
    odd = np.empty(len(data), bool)  # signs next to signs, as in !! or ###
    odd[0] = False
    odd[1:] = (kind[1:] >= 5) & (kind[1:] <= 7) & (kind[:-1] >= 5) & (kind[:-1] <= 7)
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.float64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, n)
    repeat = np.fromiter((sum(map(bytes.__eq__, w, w[1:])) for w in words), np.float64, n)
    few = np.maximum(n_words, 1)
    return np.stack([share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], count(same) / per, count(odd) / per, distinct / np.sqrt(few * np.minimum(few, 60)), repeat / few, np.log1p(sizes), np.minimum(sizes / few, 40) / 10], 1)


def chain_features(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, a constant, and what the line before and the line after add (0 at document ends)."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        before[1:] = own[:-1] - own[1:]
        after[:-1] = own[1:] - own[:-1]
    before[starts] = 0
    after[np.concatenate((starts[1:] - 1, [n - 1]))] = 0
    return np.concatenate((np.ones((n, 1)), own, before, after), 1)


def marginals(good: np.ndarray, transition: np.ndarray, starts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), and the expected counts of the transitions, of chains that start at `starts`.

    good: log-odds of each line; weight: of each line's transition from the line before, 1 without it. All chains advance together, longest first.
    """
    n, ends = len(good), np.concatenate((starts[1:], [len(good)]))
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    emit = np.stack((np.zeros(n), good), 1)
    emit -= emit.max(1, keepdims=True)
    emit = np.exp(emit)
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    alpha[starts] = emit[starts]
    alpha[starts] /= alpha[starts].sum(1, keepdims=True)
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        a = (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        b = (beta[at] * emit[at]) @ move.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * move * (beta[at] * emit[at])[:, None, :]
    joint = joint / joint.sum((1, 2), keepdims=True) * (1.0 if weight is None else weight[at][:, None, None])
    return p[:, 1], joint.sum(0) if len(at) else np.zeros((2, 2))


def documents_lines(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All lines of all texts, and where each text starts; a null or empty text is one empty line."""
    parts = [(t or b"").split(b"\n") for t in texts]
    return [x for p in parts for x in p], np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)


def scores(texts: list[bytes | None], model: QualityModel) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    lines, starts = documents_lines(texts)
    own = (line_features(lines) - model.mean) / model.scale
    good, _ = marginals(chain_features(own, starts) @ model.weights, model.transition, starts)
    weight = np.fromiter(map(len, lines), np.float64, len(lines)) + 1e-3
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def train_split(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 != 0


def fit_chain(texts: list[bytes | None], labels: np.ndarray) -> QualityModel:
    """Maximum weighted conditional likelihood by Adam: a document's chain weighs one over the root of its lines; both classes weigh the same."""
    lines, starts = documents_lines(texts)
    own = line_features(lines)
    mean, scale = own.mean(0), own.std(0) + 1e-6
    x = chain_features((own - mean) / scale, starts)
    sizes = np.diff(np.concatenate((starts, [len(lines)])))
    y = np.repeat(labels.astype(float), sizes)
    own_weight = 1.0 / np.sqrt(sizes)
    for v in (0, 1):
        own_weight[labels == v] *= 0.5 / max(own_weight[labels == v].sum(), 1e-9)
    weight = np.repeat(own_weight, sizes)
    same = [(own_weight * (sizes - 1))[labels == v].sum() for v in (0, 1)]
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        p, moves = marginals(x @ w, trans, starts, weight)
        g_w = x.T @ ((p - y) * weight) + RIDGE * w
        g_t = moves - np.diag(same) + RIDGE * 10 * trans
        g = np.concatenate((g_w, g_t.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, trans = w - move[:-4], trans - move[-4:].reshape(2, 2)
    return QualityModel(w, trans, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, train=train_split) -> QualityModel:
    """Fit on at most about TRAIN_DOCS labelled rows for which train(doc_id) holds; whole texts.

    Without usable labels of both kinds every text scores one half. A document with both labels is good.
    """
    with Scratch(docs.sparkSession) as scratch:
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(train(F.col("doc_id")))
        known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        size = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
        bad, good = size.get(0, 0), size.get(1, 0)
        if not bad or not good:
            return QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_OWN), np.ones(N_OWN))
        share = F.when(F.col("quality") == 0, int(min(1, TRAIN_DOCS / 2 / bad) * 1e6)).otherwise(int(min(1, TRAIN_DOCS / 2 / good) * 1e6))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
        sample = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id"), "sample")
        texts, marks = [], []
        for row in sample.orderBy("doc_id").toLocalIterator():  # bounded by TRAIN_DOCS
            texts.append((row["text"] or "").encode())
            marks.append(row["quality"])
        return fit_chain(texts, np.array(marks)) if len(set(marks)) == 2 else QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_OWN), np.ones(N_OWN))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, quality (0 to 1) of every row's whole text; null and empty texts count as one empty line."""
    ship(__name__)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).cast(pa.binary()).to_pylist(), model))], names=["doc_id", "quality"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality double")
