"""Each stage of the pipeline against a plain restatement on its own input, with nulls, empties, repeats and clashing columns."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from syncsift.llm import packing
from tests.llm.test_documents import key, repeated
from tests.llm.test_near_copies import brute, shingles

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect()))


@pytest.fixture(scope="module")
def small(spark):
    """Documents of every kind that a stage must handle, with two columns more than documents have."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["river", "stone", "élan", "light"]) + str(rng.randrange(300)) for _ in range(n))
    line, passage, base = "a line of more than forty characters that many documents hold", say(60), say(120)
    texts = [(i, say(40)) for i in range(6)]
    texts += [(10 + i, f"{line}\n{say(25)}\n {line.upper()}") for i in range(6)] + [(20, line), (21, line)]  # the last is left with its line
    texts += [(30 + i, f"{say(20)} {passage} {say(20)}") for i in range(3)] + [(33, passage)]
    texts += [(40, base), (41, base), (42, base.replace("stone", "STONE")), (43, f"{base} and more"), (None, base), (None, f"{base} and"), (41, say(30))]
    texts += [(50, None), (51, ""), (52, " \n "), (53, "x"), (54, "long " * 5000)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k") for i, t in texts], f"{SCHEMA}, node_ int, spans string").repartition(3).persist()


def test_line_stage(spark, small):
    docs = [(r.doc_id, r.text or "") for r in small.collect()]
    held = defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            held[key(line)].add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        if len(kept) == len(lines) or "\n".join(kept).strip():
            want.append((i if i is not None else -1, "\n".join(kept)))
    out = STAGES["line dedup"](spark, small, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS) and rows_of(out) == sorted(want)
    assert len(want) == len(docs) - 1 and out.where("n_chars <> char_length(text)").count() == 0  # document 20 has lost its only line


def test_near_copy_stage(spark, small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    group = brute([shingles(t) for _, t in docs])
    out = STAGES["SimHash near-dedup"](spark, small, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    best = {}
    for (i, t), g in zip(docs, group, strict=True):
        best.setdefault(g, []).append((i is None, i or 0))
    kept = Counter(-1 if min(v)[0] else min(v)[1] for v in best.values())
    assert Counter(i for i, _ in rows_of(out)) == kept and len(best) < len(docs) - 4
    assert set(rows_of(out)) <= set(rows_of(small))


def test_passage_stage_of_every_kind(spark, small):
    docs = [(r.doc_id, (r.text or "").encode()) for r in small.collect()]
    want = []
    for (i, b), (gone, told) in zip(docs, repeated([b for _, b in docs]), strict=True):
        rest = np.frombuffer(b, np.uint8)[~(gone | told)].tobytes()
        if rest.strip() or not b.strip():
            want.append((i if i is not None else -1, len(rest)))
    out = STAGES["suffix-array dedup"](spark, small, SF)
    got = sorted((i, len(t.encode())) for i, t in rows_of(out))
    assert out.columns == list(corpus_pipeline.COLUMNS) and len(got) == len(want) < len(docs)
    assert all(a[0] == b[0] and 0 <= a[1] - b[1] <= 8 for a, b in zip(got, sorted(want), strict=True))  # parts of characters stay


def test_packing_stage(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in small.collect())
    out = STAGES["packing"](spark, small, SF)
    assert out.agg(F.sum("length")).first()[0] == want


def test_quality_stage(spark, small):
    from syncsift.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = docs.withColumn("score", F.lit("clash")).unionByName(small.limit(0), allowMissingColumns=True)
    out = STAGES["quality"](spark, mixed, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(r.doc_id for r in docs.select("doc_id", "text").collect() if model.score(np.array([quality.statistics((r.text or "").encode())]))[0] >= 0.3)
    assert out.columns == list(corpus_pipeline.COLUMNS) and sorted(r.doc_id for r in out.collect()) == want and 0 < len(want) < docs.count()
    odd = small.where("doc_id >= 50 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    assert STAGES["quality"](spark, odd, SF).exceptAll(odd.select(*corpus_pipeline.COLUMNS)).count() == 0  # no label: a share of 0.5 rejects nothing


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_on_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    assert STAGES[name](spark, docs, SF).count() == 0


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, SCHEMA)
        assert len({r.doc_id for r in rows}) == len(rows), name
    told = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect())
    assert told(corpus_pipeline.run(spark, SF)) == told(STAGES["packing"](spark, docs, SF))
