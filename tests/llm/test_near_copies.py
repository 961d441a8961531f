"""The near-copy stage against brute-force Jaccard similarity."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np

from syncsift.llm import near_copies

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(sets):
    """The first index of each set's group, by all pairs that share a shingle or are equal."""
    up = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if up[i] != up[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    return up


def texts():
    rng = random.Random(4)
    out = []
    for n in (3, 6, 12, 40, 100, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(500)}" for _ in range(n)]
            out.append(base)
            for changes in (1, 2, 3, 5, 8, 12):
                other = list(base)
                for _ in range(changes):
                    other[rng.randrange(n)] = f"W{rng.randrange(500)}"
                out.append(other)
                base = other if rng.random() < 0.3 else base  # chains
    return [" ".join(x) for x in out]


def test_groups_are_those_of_all_pairs():
    every = [*dict.fromkeys(texts()), ""]
    got = near_copies.groups(near_copies.Shingles(5).of([t.encode() for t in every]), 0.8)
    assert got.tolist() == brute([shingles(t) for t in every])


def test_stage_keeps_one_of_each_group(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[5][1].upper() + " "), (None, rows[8][1]), (None, "of no other group x y"), (None, "of no other group x y"), (904, rows[60][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    up = brute([shingles(t) for _, t in rows])
    want = Counter(min((i for (i, _), u in zip(rows, up, strict=True) if u == g and i is not None), default=None) for g in set(up))
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == want
    assert 20 < sum(want.values()) < len(rows) - 20


def test_large_components_in_chunks(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    every = texts()
    for n in (1, 2, 5, 7):  # a dense group, and texts at its edge
        for _ in range(15):
            other = list(base)
            for _ in range(n):
                other[rng.randrange(80)] = f"v{rng.randrange(900)}"
            every.append(" ".join(other))
    rows = list(enumerate(every)) + [(1000 + i, every[-1]) for i in range(9)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    up = brute([shingles(t) for _, t in rows])
    want = sorted(min(i for (i, _), u in zip(rows, up, strict=True) if u == g) for g in set(up))
    for chunk in (5, 20, 8192):
        assert sorted(r.doc_id for r in near_copies.near_dedup(docs, chunk=chunk).collect()) == want


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = [shingles(t) for _, t in rows]
    up = np.arange(len(sets))
    held = {}
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in held.get(x, ()))
        for j, both in met.items():
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                a, b = sorted((up[i], up[j]))
                up[up == b] = a
        for x in s:
            held.setdefault(x, []).append(i)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [rows[i][0] for i in sorted(set(up.tolist()))]
    assert out.exceptAll(docs).count() == 0 and len(set(up.tolist())) < len(rows)
