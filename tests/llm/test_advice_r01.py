
import numpy as np
from test_llm import docs_of, union_find

from ctxspark.llm import license_scan, line_dedup, masked_lm, toxicity


def full_lines(texts):
    """Kept lines of each text by all pairs of lines, with the shingles of every position."""
    at = {}
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                at.setdefault(line.strip().lower(), []).append((d, p))
    names = list(at)
    sets = [{n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if 100 * (c := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - c)]
    groups = {}
    for n, c in zip(names, union_find(len(names), links)):
        groups.setdefault(c, []).extend(at[n])
    keep = {min(v) for v in groups.values()}
    return {d: "\n".join(x for p, x in enumerate((t or "").split("\n")) if not x.strip() or (d, p) in keep) for d, t in enumerate(texts)}


def test_lines_of_one_start(spark):
    long = "some words of a line that is long enough to have a copy with one other character in it, as OCR makes them"
    texts = ["https://example.com/a", "https://other.org/b", "andththwhes.", "andththwhwh.", long, long.replace("enough", "enOugh").replace("copy", "c0py"), "short", "short\nshorter", "\U0001f600" * 9, "\U0001f600" * 7, "\U0001f600" * 9 + "x", None]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == full_lines(texts)
    assert [got[i] for i in range(6)] == [*texts[:5], ""]


def test_words_beyond_the_frequent_ones_have_their_shares(spark, monkeypatch):
    texts = ["the cat sat on the mat rarely", "the dog sat rarely", "a dog and a cat ate odd odd bits", None, "", "Odd"]
    df = docs_of(spark, texts)
    other = docs_of(spark, ["an unseen rarely word"])
    monkeypatch.setattr(masked_lm, "VOCABULARY", 8)
    monkeypatch.setattr(masked_lm, "OWN_CLASS", 8)
    few = masked_lm.fit(df)
    assert len(few.shares) == 8 and few.others.count() == len({w for t in texts for w in (t or "").lower().split()}) - 8
    monkeypatch.setattr(masked_lm, "VOCABULARY", 50_000)
    every = masked_lm.fit(df)
    assert np.allclose(few.letters, every.letters) and np.allclose(few.spelled, every.spelled)
    for docs in (df.union(df), other):
        got, want = (sorted(tuple(r) for r in masked_lm.score(docs, m).collect()) for m in (few, every))
        assert len(got) == docs.count() and np.allclose(got, want, atol=1e-9)


def test_repeated_toxic_words_count_each_time(spark):
    model = toxicity.ToxicityModel({b"scum": 5.0}, -1.0, 1.0, 0.01, 1.0, -4.0)
    texts = ["scum " * n for n in (1, 2, 3, 10, 11, 1000)] + ["scum a b c d e f scum"]
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs_of(spark, texts), model).collect()}
    scores = [rows[i]["toxicity"] for i in range(6)]
    assert scores[0] > 0.9 and scores == sorted(scores)
    assert [tuple(x) for x in rows[5]["passages"]] == [(0, 999, 5000.0)]
    assert [tuple(x) for x in rows[6]["passages"]] == [(0, 0, 5.0), (7, 7, 5.0)]
    assert toxicity.drop_toxic(docs_of(spark, texts), model).isEmpty()


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction"""


def test_wrapped_notices(spark):
    texts = [GPL, BSD, MIT, f"{GPL}\n#\n{BSD}", f"Released under the MIT License.\n{GPL}", f"first\n\n\n{BSD.replace(chr(10), chr(13) + chr(10))}\n\n", f"{GPL}\nAll rights reserved.\n\n{MIT}", "the driver must renew\nthe license of the car", "\n\n", None]
    rows = {r["doc_id"]: r for r in license_scan.document_licenses(docs_of(spark, texts)).collect()}
    assert [rows[i]["licenses"] for i in range(10)] == ["gpl", "bsd", "mit", "bsd,gpl", "gpl,mit", "bsd", "gpl,mit,proprietary", "unknown", "unknown", "unknown"]
    assert [rows[i]["n_paragraphs"] for i in (0, 3, 4, 6, 7)] == [1, 2, 2, 3, 0]
    assert [r["pos"] for r in license_scan.scan(docs_of(spark, texts[5:6])).collect()] == [3]
