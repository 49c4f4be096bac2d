"""The corpus operators against brute force, round trips or held-out labels, and on awkward rows."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import common, decontaminate, fingerprint, jaccard_join, license_scan, line_dedup, masked_lm, quality, sentencepiece_sa, toxicity, url_rules
from ctxspark.llm.queries import ORACLE, PIECE_MODEL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD5 = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, texts, extra=True):
    """Rows with repeated, null, empty and very long texts and columns that clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("uid", "k", "row", "score", "toxicity", "h", "ord", "th", "drops", "n", "term"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


AWKWARD = [None, "", " ", "\n\n", "word", "word", "two words", "a b c d e f g", "a b c d e f g", "A B c d e f G", "é ü\u00a0x", "x" * 5000, " ".join(f"w{i % 700}" for i in range(9000)), "\x00 nul", "▁ bar"]


def union_find(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = WORD5.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    links = []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x] if j < i)
        links += [(j, i) for j, c in shared.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, union_find(len(texts), links)))}


@pytest.mark.parametrize("crowd, rounds", [(48, jaccard_join.STAR_ROUNDS), (1, ((0,),))])
def test_jaccard(spark, documents, monkeypatch, crowd, rounds):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    base = [f"t{i}" for i in range(60)]
    near = [" ".join(base[:k] + ["odd"] + base[k + 1 :]) for k in range(0, 60, 3)]
    texts = AWKWARD + near + [r["text"] for r in documents.orderBy("doc_id").limit(120).collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_jaccard(texts)


def test_jaccard_empty_and_null_ids(spark):
    df = docs_of(spark, AWKWARD)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    nulls = df.where("text = 'word'").withColumn("doc_id", F.when(F.col("doc_id") == 5, F.col("doc_id")))
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(nulls).collect()} == {(None, 5), (5, 5)}
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 10, 11, 12, 13, 14]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 1)] + [(300, x) for x in range(301, 340)]
    with common.Scratch(spark) as scratch:
        got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        none = common.components(spark.createDataFrame([], "a long, b long"), scratch).count()
    assert got == {**dict.fromkeys([*range(41), 200], 0), 100: 100, 101: 100, **dict.fromkeys(range(300, 340), 300)} and none == 0


def brute_contamination(texts, items):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, sf_dir, documents, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "two words"), (901, None), (902, ""), (903, "word"), (904, items[0][1]), (None, "nul"), (10, "zz " * 30)]
    texts = AWKWARD + [f"Before {items[1][1].upper()} after", "zz " * 25, "words two"] + [r["text"] for r in documents.limit(150).collect()]
    want = brute_contamination(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    for block in (decontaminate.BLOCK_WORDS, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        rows = decontaminate.contamination(docs_of(spark, texts), bench).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert decontaminate.contamination(docs_of(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contamination(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "alpha beta delta gamma epsilon zeta eta theta iota kappa"
    rows = decontaminate.contamination(docs_of(spark, [swapped, item, "alpha beta"]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in rows} == {0: (0, 1), 1: (1, 1), 2: (0, 0)}


def brute_lines(texts):
    """(kept text, lines kept, lines dropped) of each text, by all pairs of lines with the 8-character windows at every position."""
    blanks = " \t\r\x0b\x0c"
    at = defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(blanks):
                at[line.strip(blanks).lower()].append((d, p))
    names = list(at)
    sets = [{n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in names]
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            if 4 * min(len(x), len(sets[j])) >= 3 * max(len(x), len(sets[j])) and 100 * (c := len(x & sets[j])) >= 75 * (len(x) + len(sets[j]) - c):
                links.append((i, j))
    groups = defaultdict(list)
    for n, c in zip(names, union_find(len(names), links)):
        groups[c] += at[n]
    keep = {min(v) for v in groups.values()}
    out = {}
    for d, t in enumerate(texts):
        lines = list(enumerate((t or "").split("\n")))
        full = {p for p, x in lines if x.strip(blanks)}
        gone = {p for p in full if (d, p) not in keep}
        out[d] = "\n".join(x for p, x in lines if p not in gone), len(full - gone), len(gone)
    return out


def test_line_dedup(spark, documents):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    texts = [*AWKWARD, line, "x\n" + line.replace("quick", "quack") + "\n\nend", line.upper(), "x", "https://example.com/a/1", "https://other.org/zzz", "item-00001\nitem-00002", "foo\rbar\nfoo", "\u4e2d" * 30, "".join(map(chr, range(0x4E00, 0x4E40)))]
    texts += [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    df = docs_of(spark, texts)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "line_dedup"]
    rows = {r["doc_id"]: r for r in out.collect()}
    want = brute_lines(texts)
    assert {d: (r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) for d, r in rows.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    again = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df.union(df)).collect()}
    assert again == {d: r["text"] for d, r in rows.items()}  # repeated rows are one document
    clash = line_dedup.dedup_lines(df.withColumn("line_dedup", F.lit(1)))
    assert clash.columns == [*df.columns, "line_dedup"] and clash.where("line_dedup.n_dropped > 0").count() == sum(n > 0 for _, _, n in want.values())
    assert line_dedup.drop_repeats(df.withColumn("line_dedup", F.lit(1))).columns == [*df.columns, "line_dedup"]


def test_line_dedup_recall(spark):
    """Lines with one character changed are found whenever their windows are alike enough."""
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(list("abcdefghijklmnop"), 90))
        at = int(rng.integers(0, 90))
        b = a[:at] + "Z" + a[at + 1 :]
        x, y = ({t[i : i + 8] for i in range(83)} for t in (a.lower(), b.lower()))
        if 100 * len(x & y) >= 75 * len(x | y):
            pairs.append(f"{a}\n{b}")
    out = line_dedup.dedup_lines(docs_of(spark, pairs))
    assert len(pairs) > 250 and out.agg(F.sum("line_dedup.n_dropped")).first()[0] / len(pairs) >= 0.97


def held_out_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality(spark, sf_dir):
    out = QUERIES["op1_quality_crf"](spark, sf_dir.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    rows = [(r["score"], r["quality"]) for r in out.where("held_out").join(labels, "doc_id").collect()]
    assert held_out_auc(rows) > 0.95
    assert out.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_quality_awkward(spark):
    df = docs_of(spark, AWKWARD)
    flat = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["quality"] for r in quality.score_quality(df, flat).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), flat).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    good, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    starts = np.array([0, 1])  # chains of 1 and 4 lines
    got, _ = quality.marginals(good, trans, starts)
    paths = [[(i >> b) & 1 for b in range(4)] for i in range(16)]
    weight = [np.exp(sum(good[1 + t] * s for t, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths]
    want = [sum(w for w, p in zip(weight, paths) if p[t]) / sum(weight) for t in range(4)]
    assert np.allclose(got, [1 / (1 + np.exp(-good[0])), *want])


def brute_segments(scores):
    """Maximal segments by the recursive definition: the best segment, then what is left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 1e-12:
        return []
    _, _, i, j = best
    return brute_segments(scores[:i]) + [(round(best[0], 6), i, j - 1)] + [(s, a + j, b + j) for s, a, b in brute_segments(scores[j:])]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = [float(x) if rng.random() < 0.5 else -1.0 for x in rng.normal(0.3, 1.3, 14)]
        places = [i for i, s in enumerate(scores) if s != -1.0]
        got = toxicity.segments(places, [scores[i] for i in places], -1.0, len(scores))
        assert [(round(s, 6), a, b) for s, a, b in got] == brute_segments(scores)


def test_toxicity(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    if not os.path.isdir(big):
        pytest.skip("needs sf0.1")
    out = QUERIES["op2_toxicity_segments"](spark, big)
    rows = [(r["score"], r["toxic"]) for r in out.where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()]
    assert held_out_auc(rows) > 0.9 and sum(s >= 0.3 for s, y in rows if y == 0) <= 0.02 * len(rows)


def test_toxicity_awkward(spark):
    df = docs_of(spark, AWKWARD)
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_toxicity(df, none).where("toxicity >= 0.3 or size(passages) > 0").isEmpty()
    model = toxicity.ToxicityModel({b"scum": 5.0}, -1.0, 1.0, 0.01, 1.0, -4.0)
    bad = docs_of(spark, ["you scum, utter SCUM and more words between scum!", *AWKWARD])
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(bad, model).collect()}
    assert scored[0]["toxicity"] > 0.3 and scored[0]["passages"][0]["first"] == 1 and len(scored) == len(AWKWARD) + 1
    kept = toxicity.drop_toxic(bad, model)
    assert kept.columns == bad.columns and kept.count() == len(AWKWARD)


def test_masked_lm(spark, documents):
    model = masked_lm.fit(documents)
    table = np.exp(model.table).sum(axis=2)
    assert np.allclose(table, 1, atol=1e-3)  # probabilities of classes between any two neighbours
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(20).collect()]
    rows = {r["doc_id"]: r for r in masked_lm.score(docs_of(spark, AWKWARD + texts), model).collect()}
    assert [rows[i]["log_likelihood"] for i in range(4)] == [0.0] * 4 and all(r["log_likelihood"] <= 0 for r in rows.values())

    def by_hand(text):
        words = masked_lm.words_of(text.encode())
        cls = [0] + [masked_lm.class_of(w, model.classes) for w in words] + [0]
        total = 0.0
        for i, w in enumerate(words, 1):
            share = model.shares.get(w, model.spelled[cls[i]] + model.letters[256] + sum(model.letters[b] for b in w))
            total += model.table[cls[i - 1], cls[i + 1], cls[i]] + share
        return total

    for i, t in enumerate(texts, len(AWKWARD)):
        assert abs(rows[i]["log_likelihood"] - by_hand(t)) < 1e-2 * max(1, abs(by_hand(t)) * 1e-3)
    shuffled = [" ".join(sorted(t.split(), key=lambda w: hashlib.md5(w.encode()).digest())) for t in texts]
    mixed = {r["doc_id"]: r for r in masked_lm.score(docs_of(spark, shuffled), model).collect()}
    assert np.mean([rows[len(AWKWARD) + i]["mean_log_likelihood"] > mixed[i]["mean_log_likelihood"] for i in range(20)]) >= 0.6
    flat = masked_lm.fit(documents.limit(0))
    assert masked_lm.score(docs_of(spark, AWKWARD), flat).count() == len(AWKWARD)


def test_url_parts(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.com/en/7?x://y", "a://b", "a://b?q", "a://H\nx/p\nq#f", "x://sub.example.net/de/8a/b", "y://EXAMPLE.ORG/es/", "z://myexample.com/en/7", "q://com/en/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    got = {r["page_id"]: tuple(r)[1:5] for r in url_rules.judge(pages, spark.createDataFrame([], "url string, bad boolean"), rules).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("example.com", "/en/7", "example.com/en/7", "allow"), 4: ("b", "", None, "allow"), 5: ("b", "", None, "allow"),
        6: ("h\nx", "/p\nq", None, "allow"), 7: ("sub.example.net", "/de/8a/b", "example.net/de/8", "block"), 8: ("example.org", "/es/", "org/es/", "block"), 9: ("myexample.com", "/en/7", "com/en/", "block"), 10: ("com", "/en/x", "com/en/", "block"),
    }


def test_url_mining(spark):
    good = [(f"http://site{i % 9}.org/{'ads' if i % 2 else 'news'}/{i}", False) for i in range(200)]
    bad = [(f"http://spam{i % 3}.biz/ads/{i}?ref=1", True) for i in range(60)]
    labelled = spark.createDataFrame(good + bad + [(None, True), ("http://x.y/", None)], "url string, bad boolean")
    mined = url_rules.mine(labelled)
    rules = url_rules.without_longer(mined)
    every = [set(r["tokens"]) for r in mined.collect()]
    kept = [set(r["tokens"]) for r in rules.collect()]
    rows = labelled.where("url is not null and bad is not null").select(url_rules.tokens_of(F.col("url")).alias("t"), "bad", "url").collect()
    for s in every:  # brute force of support, confidence and lift
        hits = [r["bad"] for r in rows if s <= set(r["t"])]
        assert sum(hits) >= 20 and sum(hits) / len(hits) >= 0.6
    assert kept and all(not any(o < s for o in every) for s in kept)
    urls = spark.createDataFrame([("http://spam9.biz/x",), ("http://site1.org/ads/5",), ("http://q.org/ads?ref=2",), (None,), ("plain",)], "url string")
    want = {u for u, t in urls.select("url", url_rules.tokens_of(F.col("url"))).collect() if t and any(s <= set(t) for s in kept)}
    assert {r["url"] for r in url_rules.matches(urls, rules).collect()} == want and "http://spam9.biz/x" in want
    assert url_rules.mine(labelled.limit(0)) is None


def test_fingerprints(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 20)
    texts = AWKWARD + [r["text"] for r in documents.orderBy("doc_id").limit(100).collect()]
    df = docs_of(spark, texts).repartition(5)
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        own = fingerprint.of_text(t)
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["fingerprint"] == str(own) and rows[i]["edited_fingerprint"] == str(fingerprint.of_text(edited))
        assert abs(rows[i]["near_next"] - own.likeness(fingerprint.of_text(following))) < 1e-9
        assert rows[i]["near_edited"] == own.likeness(fingerprint.of_text(edited))
    long = [i for i, t in enumerate(texts) if t and len(t.split()) > 60 and len(set(t.split())) > 30]
    assert np.mean([rows[i]["near_edited"] > 0.5 for i in long]) > 0.95
    one = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(spark, ["a b c d e f g h"])).collect()}
    assert one[0]["near_next"] == 1.0 and fingerprint.fingerprints(df.limit(0)).count() == 0


def test_fingerprint_is_homomorphic():
    h = fingerprint.WordHashes()
    a, b = ["one two three four", "five"], ["six seven eight", "one two three four"]
    f = lambda x: fingerprint.of_paragraphs(x, h)
    assert f(a + b) == f(b + a) == f(a) + f(b) and f(a + b) - f(b) == f(a) and f(a) != f(b) and f([]) == fingerprint.Fingerprint()
    assert f(a + a) != f(a)


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no piece model")
def test_sentencepiece(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    pieces = sentencepiece_sa.load(PIECE_MODEL)
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("ab  \n\té日T.,1<>"), int(n))) for n in rng.integers(1, 80, 60)]
    texts = AWKWARD + odd + ["ab" * 400 + "日" * 300, " " * 40 + "q  ", "<s> <0x41> </s>", "𝒳\u200b"] + [r["text"] for r in documents.limit(100).collect()]
    rows = {r["doc_id"]: r for r in sentencepiece_sa.encode(docs_of(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["token_ids"] == library.encode(t or "")
        assert sentencepiece_sa.decode(rows[i]["token_ids"], pieces) == library.decode(rows[i]["token_ids"])
        assert rows[i]["round_trip"] == ("▁" not in (t or ""))
    kept = sentencepiece_sa.with_ids(docs_of(spark, texts), pieces)
    assert kept.columns == [*docs_of(spark, texts).columns, "token_ids"] and kept.count() == len(texts)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_sa.decode_rows(kept, pieces).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    assert sentencepiece_sa.encode(docs_of(spark, texts).limit(0), pieces).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    order, _ = sentencepiece_sa.suffix_array(data, 64)
    raw = data.tobytes()
    got = [raw[i : i + 64] for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(400))


def test_licenses(spark):
    texts = [*AWKWARD, "Intro\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "licensed under CC BY-NC 4.0", "All rights reserved.\nReleased under the MIT License.", "The driver must renew the license of the car.", "all of the general public reserved a file of version 2.0"]
    rows = {r["doc_id"]: r for r in license_scan.document_licenses(docs_of(spark, texts)).collect()}
    n = len(AWKWARD)
    assert [rows[i]["licenses"] for i in range(n)] == ["unknown"] * n
    assert [rows[n + i]["licenses"] for i in range(7)] == ["mit", "apache", "gpl", "cc-by-nc", "mit,proprietary", "unknown", "unknown"]
    assert license_scan.document_licenses(docs_of(spark, texts).limit(0)).count() == 0


def test_license_scores_by_hand(spark):
    families, weights, bias, _ = license_scan.model()
    text = "Licensed under the BSD 3-Clause License."
    z = (bias + sum(weights[t] for t in license_scan.plain_terms(text) if t in weights)) / license_scan.temperature()
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    row = license_scan.scan(docs_of(spark, [text])).first()
    assert row["family"] == families[int(p.argmax())] == "bsd" and abs(row["probability"] - p.max()) < 1e-9


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == [*docs.columns, "token_ids"] and final.select("doc_id").distinct().count() == final.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
