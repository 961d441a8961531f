"""The cuckoo filter, its index under inserts and deletes, and exact dedup against a plain grouping."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncsift.llm import exact_dedup
from syncsift.llm.exact_dedup import Cuckoo, Shard

SCHEMA = "doc_id long, text string, digest long, sha string, rid long, salt int"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=300), st.data())
def test_filter(digests, data):
    digests = np.array(digests, np.int64)
    f, _ = Cuckoo.of(digests)
    assert f.contains(digests).all() and (f.slots != 0).sum() == len(digests)
    gone = np.array([data.draw(st.booleans()) for _ in digests], bool)
    f.delete(digests[gone])
    assert f.contains(digests[~gone]).all() and (f.slots != 0).sum() == (~gone).sum()


def test_filter_overflows():
    digests = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    assert not Cuckoo(512).insert(digests)
    f, doubled = Cuckoo.of(digests, 1024)
    assert f.contains(digests).all() and doubled >= 0
    assert f.contains(np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.01


def test_shard_grows_from_its_store():
    rng, s, live = random.Random(3), Shard(np.zeros(0, np.int64), np.zeros(0, np.int64)), Counter()
    for _ in range(60):
        some = np.array(rng.sample(range(3000), rng.randint(1, 400)), np.int64)
        by = np.array([rng.choice([1, 2, -1]) for _ in some], np.int64)
        s.change(some, by)
        for d, n in zip(some.tolist(), by.tolist(), strict=True):
            live[d] = max(0, live[d] + n)
    want = {d: n for d, n in live.items() if n}
    assert dict(zip(s.digests.tolist(), s.rows.tolist(), strict=True)) == want
    assert s.resized > 0 and s.hits > 0 and s.filter.contains(s.digests).all() and (s.filter.slots != 0).sum() == len(want)


def test_index(spark):
    change = lambda rows: spark.createDataFrame(rows, "digest long, by long").repartition(3)
    read = lambda index: {r.digest: r.rows for r in exact_dedup.stored(index).collect()}
    index = exact_dedup.updated(None, change([(d % 500, 1) for d in range(1200)]), shards=5)
    assert read(index) == {d: 3 if d < 200 else 2 for d in range(500)}
    index = exact_dedup.updated(index, change([(d, -2) for d in range(300)] + [(7000, 1), (9000, -1)]))
    want = {d: 1 for d in range(200)} | {d: 2 for d in range(300, 500)} | {7000: 1}
    assert read(index) == want
    wider = exact_dedup.resharded(index, 11)
    assert read(wider) == want and {r.shards for r in wider.select("shards").collect()} == {11}
    asked = exact_dedup.probe(wider, change([(d, 0) for d in [*range(250, 320), 7000, 7000, 12345]])).where("rows > 0")
    assert {r.digest: r.rows for r in asked.collect()} == {d: 2 for d in range(300, 320)} | {7000: 1}
    assert exact_dedup.stored(exact_dedup.updated(None, change([]))).count() == 0


def restated(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        last = max((x for x in ids if x is not None), default=None)
        stays = iter([True])
        out += [(i, last, len(ids), i == last and next(stays, False), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "A", "é", "é", "x" * 300_000, "y" * 300_000, "a\n", "a\0"] + [f"text {i}" for i in range(60)]
    return [(rng.choice([None, i, i, i // 2]), rng.choice(texts)) for i in range(400)] + [(500 + i, "hot") for i in range(300)] + [(9, "a"), (9, "a")]


def test_exact_dedup(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], SCHEMA).repartition(5)
    read = lambda out: sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert read(exact_dedup.exact_dedup(df)) == restated(rows)
    # digests that collide join nothing
    assert read(exact_dedup.exact_dedup(df, lambda t: F.char_length(t).cast("long"))) == restated(rows)
    assert read(exact_dedup.exact_dedup(df, lambda t: F.lit(1).cast("long"))) == restated(rows)
    assert exact_dedup.exact_dedup(df.where("doc_id = -5")).count() == 0


def test_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if "\0" not in (r[1] or "")])
    assert sorted(con.sql(exact_dedup.ORACLE).fetchall(), key=str) == restated([r for r in rows if "\0" not in (r[1] or "")])
