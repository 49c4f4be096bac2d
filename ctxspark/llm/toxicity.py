"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds of occurring in a toxic against a clean document with an informative
Dirichlet prior (the words' overall shares), brought towards 0 by a confidence bound; every token also
costs a fixed amount, so that words without evidence pull the score down and clean words more so. A word
without evidence of its own has that of its stem (its first bytes). Every maximal segment is found in one linear scan (Ruzzo and Tompa).
The best segment of n clean words follows an extreme-value law with parameters lambda and K (Karlin and
Altschul), fitted on clean documents that the word counts have not seen; the segments of a document are aggregated into one
p-value by the sum statistic, and a logistic curve maps -ln p to the probability of label 1. Passages are
the segments that are significant by that law.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settle, ship, slices

#: At most about so many labelled documents are used to fit the model (a hash of doc_id chooses them).
TRAIN_DOCS = 50_000
PRIOR = 200.0
#: Added to every word's prior count: what a word never seen in a class may still have.
BASE = 1.0
CONFIDENCE = 2.33
MOST = 8.0
#: Score of every word without evidence; words with clean evidence score lower still.
REST = -1.0
#: A stem is the first so many bytes of a longer word; stems are kept beside words behind this mark.
STEM, STEM_MARK = 6, b"\0"
#: Segments below this score are noise and are not aggregated.
LEAST = 1.0
#: Normalised score (-ln of the expected number of such segments by chance) that makes a segment significant.
SIGNIFICANT = 3.0
#: Minima of word 3-shingles under so many hashes: training documents that agree in all are copies and count once.
COPY_HASHES = 4
#: In the chance level, a word that also stands within so many words before counts like a word without evidence.
REPEAT = 10
#: Share of the training documents that is held back from the word counts to calibrate the scores.
CALIBRATE = 0.3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class ToxicityModel:
    scores: dict[bytes, float]  # words and marked stems with evidence
    rest: float
    lam: float
    k: float
    slope: float
    shift: float


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation at their ends; a word of punctuation alone is b''."""
    return [w.strip(_EDGE) for w in text.translate(_LOWER).split()] if text else []


def segments(places: list[int], scores: list[float], rest: float, n: int) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) of n words.

    places and scores hold the words that differ from `rest` (a negative score of every other word).
    """
    runs: list[list] = []  # left sum, right sum, first, last
    total, last = 0.0, -1
    for p, s in zip(places, scores, strict=True):
        total += rest * (p - last - 1)
        last = p
        if s <= 0:
            total += s
            continue
        left, total = total, total + s
        new = [left, total, p, p]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][0] >= new[0]:
                j -= 1
            if j < 0 or runs[j][1] >= new[1]:
                runs.append(new)
                break
            new = [runs[j][0], new[1], runs[j][2], new[3]]
            del runs[j:]
    return [(r[1] - r[0], r[2], r[3]) for r in runs]


def document_segments(text: bytes | None, model: ToxicityModel, damped: bool = False) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of words, and the segments that aren't noise. Every occurrence of a word counts, unless damped."""
    found = words_of(text)
    get = model.scores.get
    hits, last = [], {}
    for i, s in enumerate(map(get, found)):
        if s is None and len(found[i]) > STEM:
            s = get(STEM_MARK + found[i][:STEM])
        if s is not None:
            if not damped or i - last.get(found[i], -REPEAT - 1) > REPEAT:
                hits.append((i, s))
            last[found[i]] = i
    got = segments([h[0] for h in hits], [h[1] for h in hits], model.rest, len(found)) if hits else []
    return len(found), [x for x in got if x[0] >= LEAST]


def normalised(score: float, n: int, lam: float, k: float) -> float:
    """-ln of the expected number of segments of this score or more in n clean words."""
    return lam * score - math.log(max(k * max(n, 1), 1e-9))


def evidence(n: int, found: list[tuple[float, int, int]], lam: float, k: float) -> float:
    """-ln p of the best sum of normalised segment scores; 0 without segments."""
    best, total = 0.0, 0.0
    for r, (score, _, _) in enumerate(sorted(found, reverse=True), 1):
        normal = normalised(score, n, lam, k)
        if normal < (SIGNIFICANT if r > 1 else 0.0):  # the best one counts even where it isn't significant
            break
        total += normal
        # P(sum >= T) is about exp(-T) T^(r-1) / (r! (r-1)!); 2^-r pays for the choice of r
        log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = max(best, -log_p)
    return min(best, 60.0)


def train_split(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 != 2


def _training_words(batches):
    for batch in batches:
        for part in slices(batch, 0, size=500_000):
            out = [[], []]
            for text, toxic in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = set(words_of(text))
                for w in found | {STEM_MARK + w[:STEM] for w in found if len(w) > STEM}:
                    out[0].append(w)
                    out[1].append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32())], names=["word", "toxic"])


def _copy_keys(batches):
    for batch in (part for whole in batches for part in slices(whole, 1, size=500_000)):
        keys = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            found = words_of(text)
            shingles = {b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))}
            keys.append([min(xxhash.xxh3_64_intdigest(x, seed) for x in shingles) >> 1 for seed in range(COPY_HASHES)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])


def _evidence_rows(model: ToxicityModel):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0, size=500_000)):
            got = [document_segments(t, model) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([evidence(n, x, model.lam, model.k) for n, x in got], pa.float64()), batch.column(1).cast(pa.int32())], names=["e", "toxic"])

    return run


def _best_rows(model: ToxicityModel):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0, size=500_000)):
            got = [document_segments(t, model, damped=True) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([max((s for s, _, _ in x), default=0.0) for _, x in got], pa.float64())], names=["n", "best"])

    return run


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-feature logistic regression with a weak ridge, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train=train_split) -> ToxicityModel:
    """Fit on at most about TRAIN_DOCS labelled rows for which train(doc_id) holds.

    Without usable labels of both kinds the model scores every text 0. A document with both labels is
    toxic; so is the one that stands for several copies of which one is toxic.
    """
    ship(__name__)
    ship(f"{__package__}.common")
    settle(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(train(F.col("doc_id")))
        known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        held_back = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(100)) < int(CALIBRATE * 100)
        share = min(1.0, TRAIN_DOCS / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic", held_back.alias("held_back"))
        sample = scratch.keep(sample.mapInArrow(_copy_keys, "doc_id long, text string, toxic int, held_back boolean, keys array<long>"), "labelled")
        first = scratch.keep(sample.groupBy(F.hash("keys").alias("a"), F.xxhash64("keys").alias("b")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "firsts")
        sample = scratch.keep(sample.drop("keys", "toxic").join(first, "doc_id").dropDuplicates(["doc_id"]), "sample")
        size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
        if not size.get(0) or not size.get(1):
            return ToxicityModel({}, -1.0, 1.0, 1.0, 0.0, -30.0)
        counts = sample.where("not held_back").select("text", "toxic").mapInArrow(_training_words, "word binary, toxic int")
        counts = scratch.keep(counts.groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0")), "counts")
        words = ~F.startswith("word", F.lit(bytearray(STEM_MARK)))
        t1, t0 = (float(x or 0) for x in counts.where(words).agg(F.sum("y1"), F.sum("y0")).first())
        y1, y0 = F.col("y1"), F.col("y0")
        prior = F.lit(PRIOR) * (y1 + y0) / F.lit(max(t1 + t0, 1.0)) + F.lit(BASE)
        odds = F.log((y1 + prior) / F.lit(t1 + PRIOR)) - F.log((y0 + prior) / F.lit(t0 + PRIOR))
        doubt = F.lit(CONFIDENCE) * F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        rows = counts.select("word", F.when(odds > doubt, F.least(F.lit(MOST), odds - doubt)).when(odds < -doubt, F.lit(REST) + odds + doubt).alias("score")).where("score is not null").toArrow()  # words of a bounded sample
        model = ToxicityModel(dict(zip(map(bytes, rows.column("word").to_pylist()), rows.column("score").to_pylist(), strict=True)), REST, 1.0, 1.0, 0.0, -30.0)
        best = sample.where("held_back and toxic = 0").select("text").mapInArrow(_best_rows(model), "n long, best double").where("n > 0").toPandas()
        over = best["best"][best["best"] >= LEAST]
        # exceedances of the law are exponential; one pseudo-observation keeps both estimates finite
        model.lam = (len(over) + 1) / (float((over - LEAST).sum()) + 1.0)
        model.k = (len(over) + 1) * math.exp(model.lam * LEAST) / (float(best["n"].sum()) + 1.0)
        got = sample.where("held_back").select("text", "toxic").mapInArrow(_evidence_rows(model), "e double, toxic int").toPandas()
        if got["toxic"].nunique() == 2:
            model.slope, model.shift = logistic(got["e"].to_numpy(), got["toxic"].to_numpy().astype(float))
        else:
            model.slope, model.shift = 1.0, -5.0
        return model


def probability(e: float, model: ToxicityModel) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * e + model.shift))))


def _scores(model: ToxicityModel):
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                score, spans, chance = [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    n, found = document_segments(t, model)
                    score.append(probability(evidence(n, found, model.lam, model.k), model))
                    found = [(x, normal) for x in found if (normal := normalised(x[0], n, model.lam, model.k)) >= SIGNIFICANT]
                    spans.append([{"first": a, "last": b, "score": s} for (s, a, b), _ in found])
                    chance.append([-math.expm1(-math.exp(-normal)) for _, normal in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(spans, passage), pa.array(chance, pa.list_(pa.float64()))], names=["doc_id", "toxicity", "passages", "p_values"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, toxicity (0 to 1), passages (first and last word, score) and their p_values of every row's whole text.

    Only passages that are significant are listed. Null, empty and wordless texts have none and the lowest
    score. Repeated rows stay repeated.
    """
    ship(__name__)
    ship(f"{__package__}.common")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, toxicity double, passages array<struct<first:long,last:long,score:double>>, p_values array<double>")


def _toxic_texts(model: ToxicityModel, threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                got = [document_segments(t, model) for t in part.column(1).cast(pa.binary()).to_pylist()]
                keep = [probability(evidence(n, x, model.lam, model.k), model) < threshold for n, x in got]
                yield part.filter(pa.array(keep, pa.bool_())).select([0])

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Null and empty texts stay."""
    ship(__name__)
    ship(f"{__package__}.common")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_toxic_texts(model, threshold), rows.select("row").schema).select("row.*")
