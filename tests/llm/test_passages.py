"""The passage stage against brute force over windows of 51 words and strings of 400 bytes."""

import random

import corpus_pipeline

from tests.llm.test_documents import repeated


def texts():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["oak", "ash", "öl", "elm"]) + str(rng.randrange(90)) for _ in range(n))
    out = [say(150) for _ in range(12)]
    short, long, under = say(51), say(90), say(45)
    solid = "".join(rng.choice("漢字仮名交文章") for _ in range(150))
    for p in (short, long, under, solid):
        out += [f"{say(30)}\n{p} {say(30)}" for _ in range(3)]
    left, right = say(45), say(45)  # neighbours that repeat singly: no passage of over 50 words does
    out += [f"{say(9)} {left} {right} {say(9)}", f"{say(30)} {left} {say(30)}", f"{say(30)} {right} {say(30)}"]
    twice = say(55)
    return [*out, f"{twice} {say(20)} {twice}", None, "", "x"]


def test_passage_stage(spark):
    rows = list(enumerate(texts()))
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = {i: len(b) - int((gone | told).sum()) for (i, b), (gone, told) in zip(raw, repeated([b for _, b in raw]), strict=True)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: len((r.text or "").encode()) for r in corpus_pipeline.drop_passages(spark, docs, "").collect()}
    assert set(got) == {i for i, _ in rows}
    cut = [i for i, b in raw if want[i] < len(b)]
    assert {i for i in got if got[i] < len(raw[i][1])} == set(cut) and all(0 <= got[i] - want[i] <= 4 for i in got)  # part of a character stays whole
    assert len(cut) == 10 and all(len(raw[i][1]) == got[i] for i in range(18, 21))
