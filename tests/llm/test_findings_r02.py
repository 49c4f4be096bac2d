"""Cases of FINDINGS_r02.md, each of which the code before got wrong, and of the code that settles them."""

import numpy as np
import pyarrow as pa
import pytest
from test_advice_r01 import full_lines
from test_llm import docs_of, union_find

from ctxspark.llm import common, jaccard_join, line_dedup


def test_crowded_buckets_lose_no_link(spark):
    """Lines that share a long passage fill buckets without being alike; each one's near copy is found all the same."""
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefghijklmnop"), 157))
    ends = ["".join(rng.choice(list("qrstuvwxyz"), 52)) for _ in range(300)]
    texts = [*[passage + x[:29] for x in ends], *[passage + x[:6] + x[29:] for x in ends]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == full_lines(texts) and not any(got[i] for i in range(300, 600))


def test_roots():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (40, 20), (300, 280), (2000, 1990)):
        a, b = rng.integers(0, n, (2, m)) - n // 2
        nodes, found = common.roots(a, b)
        label = union_find(n, [(int(x) + n // 2, int(y) + n // 2) for x, y in zip(a, b, strict=True)])
        low = {}
        for i in range(n):
            low.setdefault(label[i], i - n // 2)
        assert sorted({*a.tolist(), *b.tolist()}) == nodes.tolist() and [low[label[x + n // 2]] for x in nodes.tolist()] == found.tolist()


def test_components_either_way(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([tuple(x) for x in rng.integers(-150, 150, (170, 2)).tolist()] + [(10**12, -(10**12)), (7, 7)], "a long, b long")
    with common.Scratch(spark) as scratch:
        few = sorted(map(tuple, common.components(edges, scratch).collect()))
        monkeypatch.setattr(common, "FEW_EDGES", -1)
        assert sorted(map(tuple, common.components(edges, scratch).collect())) == few


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_tokens_of_several_classes(rows):
    rng = np.random.default_rng(6)
    table = sorted((int(t), int(k) - 4, int(k) + 9) for t, k in rng.integers(0, (60, 9), (200, 2)))
    table += [(70, 1, 1)] * 5 + [(71, 2, 2)] * 3 + [(71, 3, 3)] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*table[i : i + rows], strict=True)], names=["token", "k", "n"]) for i in range(0, len(table), rows)]
    got = {tuple(r.values()) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()}
    assert got == {r for r in table if len({k for t, k, _ in table if t == r[0]}) > 1}


def passages(rng, families, size):
    """Lines that share most of a passage with the others of their family without being alike, and a near copy of each third one."""
    texts = []
    for _ in range(families):
        passage = "".join(rng.choice(list("abcdefghijklmnop"), 157))
        ends = ["".join(rng.choice(list("qrstuvwxyz"), 52)) for _ in range(size)]
        texts += [*[passage + x[:29] for x in ends], *[passage + x[:6] + x[29:] for x in ends[::3]]]
    return texts


def test_small_buckets_are_compared_without_a_prefix_join(spark, monkeypatch):
    def unneeded(*_):
        raise AssertionError("no bucket holds more than FEW lines")

    monkeypatch.setattr(line_dedup, "_prefixes", unneeded)
    texts = passages(np.random.default_rng(7), 12, 12)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == full_lines(texts) and sum(not t for t in got.values()) >= 12 * 4


@pytest.mark.parametrize("few", [1, 10])
def test_small_and_large_buckets_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
    texts = [*passages(np.random.default_rng(8), 6, 6), *passages(np.random.default_rng(9), 1, 40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == full_lines(texts)


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
@pytest.mark.parametrize("most", [3, 500_000])
def test_tokens_of_several_components(rows, most, monkeypatch):
    """Postings carry components, so that what one component has alone is dropped where it is read; repeats go."""
    monkeypatch.setattr(jaccard_join, "MOST_HELD", most, raising=False)
    rng = np.random.default_rng(10)
    table = sorted((int(t), int(k) % 3, int(k), int(k) + 9) for t, k in rng.integers(0, (70, 9), (200, 2)))
    table += [(70, 1, k, k) for k in (1, 4, 4, 7, 10, 13, 16, 19)] + [(71, 1, 1, 1), (71, 1, 4, 4), (71, 2, 2, 2), (72, 0, 0, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*table[i : i + rows], strict=True)], names=["token", "comp", "k", "n"]) for i in range(0, len(table), rows)]
    got = [tuple(r.values()) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
    mixed = {r for r in table if len({c for t, c, *_ in table if t == r[0]}) > 1}
    assert len(got) == len(set(got)) and mixed <= set(got)
    assert set(got) - mixed <= (set() if most > 3 else {r for r in table if r[0] == 70})


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_with_or_without_a_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "BROADCAST_GROUPS", most, raising=False)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", ((0,),))
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 90)]
        texts += [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in (0, 30, 60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, texts)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label, low = union_find(len(texts), links), {}
    for i, c in enumerate(label):
        low.setdefault(c, i)
    assert got == {i: low[c] for i, c in enumerate(label)}
