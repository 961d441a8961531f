"""SimHash retrieves the near-copy stage's candidates; bands are for those that it can't reach."""

import random

from syncsift.llm import near_copies, simhash
from tests.llm.test_near_copies import brute, shingles


def test_simhash_alone_retrieves_what_is_within_its_radius(spark):
    rng = random.Random(9)
    texts = ["one two"]
    for _ in range(12):  # a long text, and copies with a word less at an end, with other letter case, with a word more
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(300, 900))]
        texts += [" ".join(x) for x in (base, base[1:], [w.upper() for w in base], [*base, "more"])]
    texts += [" ".join(f"v{rng.randrange(5000)}" for _ in range(100)) for _ in range(20)] + ["", None, "One  Two"]
    prints = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    near = [[j for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(texts))]
    up = brute([shingles(t) for t in texts])
    assert all(up[i] == up[j] for i, js in enumerate(near) for j in js)  # here, all that SimHash links is similar
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in js) for js in near]
    want = sorted({i for i, x in enumerate(label) if i == x})
    assert len(set(up)) <= len(want) < len(texts) - 24
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = lambda **how: sorted(r.doc_id for r in near_copies.near_dedup(docs, **how).collect())
    assert kept(bands=0) == want  # without SimHash nothing is retrieved
    assert kept() == sorted(set(up))


def test_texts_that_only_simhash_brings_together_are_verified(spark):
    say = lambda n, at: " ".join(f"w{at + i}" for i in range(n))
    docs = spark.createDataFrame([(1, say(60, 0)), (2, say(60, 500)), (3, f"{say(60, 0)} x")], "doc_id long, text string")
    kept = near_copies.near_dedup(docs, bands=0, radius=64)  # every text is a candidate of every other
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
