"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the token before and the token after it. Tokens
have classes: each frequent word its own, other words one of a few by their ending, document ends one.
The network (embeddings of both neighbours, a tanh layer, a softmax over classes) is trained in numpy on
the counts of all (left, token, right) class triples of the corpus; a word's share of its class comes
from the counts of all words: the most frequent ones are part of the model, all others a written table
that documents' words are joined with. Words the corpus does not hold are spelled by byte frequencies. A
document's score is the sum of the conditional log-probabilities of its tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

CLASSES = 128
#: Frequent words with a class of their own; class 0 is the document end, the rest are by word ending.
OWN_CLASS = 80
#: Most frequent words, whose shares are part of the model; shares of all others are in its table.
VOCABULARY = 50_000
WIDTH, STEPS, RATE = 32, 250, 0.02
SLICE_ROWS = 512
FLUSH_WORDS = 400_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass
class MaskedModel:
    classes: dict[bytes, int]  # words with a class of their own
    shares: dict[bytes, float]  # log share of a frequent word in its class
    spelled: np.ndarray  # log share of all words of a class that the corpus does not hold
    letters: np.ndarray  # log frequency of bytes, and of the word's end at 256
    table: np.ndarray  # log P(class | left, right) as [left, right, class]
    others: DataFrame | None = None  # word, share of all words that are not in shares


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def class_of(word: bytes, classes: dict[bytes, int]) -> int:
    return classes.get(word) or 1 + OWN_CLASS + zlib.crc32(word[-2:]) % (CLASSES - OWN_CLASS - 1)


class _Classes(dict):
    """Class of each word, remembered up to a bound."""

    def __init__(self, classes):
        super().__init__()
        self.own = classes

    def __missing__(self, word):
        if len(self) > FLUSH_WORDS:
            self.clear()
        c = self[word] = class_of(word, self.own)
        return c


def _texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()


def _word_counts(batches):
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for _, texts in _texts(batches):
        for text in texts:
            counts.update(words_of(text))
        if len(counts) > FLUSH_WORDS:
            yield out()
    if counts:
        yield out()


def _triples(classes: dict[bytes, int]):
    def run(batches):
        memo = _Classes(classes)
        total = np.zeros(CLASSES**3, np.int64)
        for _, texts in _texts(batches):
            codes = []
            for text in texts:
                found = words_of(text)
                if found:
                    c = np.zeros(len(found) + 2, np.int64)
                    c[1:-1] = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
                    codes.append((c[:-2] * CLASSES + c[2:]) * CLASSES + c[1:-1])
            if codes:
                total += np.bincount(np.concatenate(codes), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "n"])

    return run


def _letter_counts(batches):
    total = np.zeros(257, np.int64)
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        # whole numbers below 2^53 stay exact as weights
        total[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), weights=np.repeat(n, [len(w) for w in words]), minlength=256).astype(np.int64)
        total[256] += n.sum()
    yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total)], names=["letter", "n"])


def _other_shares(classes: dict[bytes, int], frequent: frozenset, whole: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = [(w, n, class_of(w, classes)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in frequent]
            share = np.log(np.array([n for _, n, _ in rows], float) / (whole[[c for _, _, c in rows]] + 1.0)) if rows else []
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in rows], pa.binary()), pa.array(share, pa.float64())], names=["word", "share"])

    return run


def train(counts: np.ndarray) -> np.ndarray:
    """log P(class | left, right) by a small network fitted to the counts [left, right, class]."""
    rng = np.random.default_rng(7)
    n = counts.reshape(-1, CLASSES).astype(np.float32)
    per = n.sum(1, keepdims=True)
    total = max(1.0, float(per.sum()))
    left, right = np.divmod(np.arange(CLASSES * CLASSES), CLASSES)
    p = {"l": rng.normal(0, 0.3, (CLASSES, WIDTH)), "r": rng.normal(0, 0.3, (CLASSES, WIDTH)), "w": rng.normal(0, 0.1, (WIDTH, CLASSES)), "b": np.log(n.sum(0) + 1.0) - np.log(total + CLASSES)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    used = np.flatnonzero(per[:, 0] > 0)
    for step in range(1, STEPS + 1):
        if not len(used):
            break
        h = np.tanh(p["l"][left[used]] + p["r"][right[used]])
        z = h @ p["w"] + p["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = (z / z.sum(1, keepdims=True) * per[used] - n[used]) / total
        g = {"w": h.T @ d, "b": d.sum(0)}
        dh = (d @ p["w"].T) * (1 - h * h)
        for name, side in (("l", left), ("r", right)):
            full = np.zeros((CLASSES * CLASSES, WIDTH), np.float32)
            full[used] = dh
            g[name] = full.reshape(CLASSES, CLASSES, WIDTH).sum(1 if name == "l" else 0)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
    z = np.tanh(p["l"][left] + p["r"][right]) @ p["w"] + p["b"]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z.reshape(CLASSES, CLASSES, CLASSES)


def fit(docs: DataFrame, keep: Scratch | None = None) -> MaskedModel:
    """Count all words and class triples of docs and train the network. An empty table gives a flat model.

    The table of other words is deleted with `keep`; without it, it stays.
    """
    ship(__name__)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        kept = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]  # a bounded number
        classes = {w: i + 1 for i, (w, _) in enumerate(kept[:OWN_CLASS])}
        code = np.zeros(CLASSES**3, np.int64)
        triples = texts.mapInArrow(_triples(classes), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # CLASSES^3 rows at most
        code[triples["code"].to_numpy()] = triples["n"].to_numpy()
        counts = code.reshape(CLASSES, CLASSES, CLASSES)
        whole = counts.sum((0, 1)).astype(float)
        letters = np.ones(257)
        for r in words.select("word", "n").mapInArrow(_letter_counts, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():  # 257 rows at most
            letters[r["letter"]] += r["n"]
        shares = {w: float(np.log(n / (whole[class_of(w, classes)] + 1.0))) for w, n in kept}
        others = words.select("word", "n").mapInArrow(_other_shares(classes, frozenset(shares), whole), "word binary, share double")
        others = keep.keep(others, "others") if keep else scratch.result(others, "others")
        return MaskedModel(classes, shares, -np.log(whole + 1.0), np.log(letters / letters.sum()), train(counts), others)


class _Scores(dict):
    """Number of each word in growing lists of classes and log shares (0 for words that aren't frequent,
    which `others` has with their log share if spelled), remembered up to a bound."""

    def __init__(self, model: MaskedModel):
        super().__init__()
        self.model, self.cls, self.log, self.others = model, [], [], {}

    def __missing__(self, word):
        m = self.model
        c = class_of(word, m.classes)
        share = m.shares.get(word)
        n = self[word] = len(self.cls)
        if share is None:
            share = 0.0
            self.others[n] = word, float(m.spelled[c] + m.letters[256] + m.letters[np.frombuffer(word, np.uint8)].sum())
        self.cls.append(c)
        self.log.append(share)
        return n


def score(docs: DataFrame, model: MaskedModel) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens), mean_log_likelihood of every row's whole text.

    Null, empty and blank texts have no tokens and score 0. Repeated rows stay repeated.
    """
    ship(__name__)
    local = replace(model, others=None)  # tables can't be sent to executors
    other = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("spelled", pa.float64())])

    def run(batches):
        memo = _Scores(local)
        for part, texts in _texts(batches):
            if len(memo) > FLUSH_WORDS:
                memo = _Scores(local)
            index = [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
            cls, log = np.array(memo.cls, np.int64), np.array(memo.log)
            rare = np.zeros(len(cls), bool)
            rare[list(memo.others)] = True
            sizes, sums, ends, words, times, spelled = [len(x) for x in index], [], [0], [], [], []
            for x in index:
                if len(x):
                    c = np.zeros(len(x) + 2, np.int64)
                    c[1:-1] = cls[x]
                    sums.append(float(local.table[c[:-2], c[2:], c[1:-1]].sum(dtype=np.float64) + log[x].sum()))
                    which, n = np.unique(x[rare[x]], return_counts=True)
                    for w, s in map(memo.others.__getitem__, which.tolist()):
                        words.append(w)
                        spelled.append(s)
                    times.append(n)
                else:
                    sums.append(0.0)
                ends.append(len(words))
            rows = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(np.concatenate([*times, np.zeros(0, np.int64)])), pa.array(spelled, pa.float64())], fields=list(other))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["doc_id", "n_tokens", "known", "others"])

    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, known double, others array<struct<word:binary,n:long,spelled:double>>")
        rows = scratch.keep(rows.withColumn("id", F.monotonically_increasing_id()), "known")
        each = rows.select("id", F.inline("others"))
        each = each.join(model.others, "word", "left") if model.others is not None else each.withColumn("share", F.lit(None).cast("double"))
        more = each.groupBy("id").agg(F.sum(F.col("n") * F.coalesce("share", "spelled")).alias("more"))
        total = F.col("known") + F.coalesce("more", F.lit(0.0))
        out = rows.drop("others").join(more, "id", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"))
        return scratch.result(out, "scores")
