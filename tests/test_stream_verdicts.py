"""Streamed verdicts against a scan from nothing, after each of several batches."""

import random

import pytest
from pyspark.sql import functions as F

from syncsift.operators import verdicts as batch
from syncsift.streaming import verdicts

HASHED = "path string, base string, size long, partial string, full string, error string"


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_follow_changes(spark, tmp_path, seed):
    rng, now = random.Random(seed), {}
    feed, out, marks = (str(tmp_path / x) for x in ("feed", "out", "marks"))
    frame = lambda files: spark.createDataFrame([(p, *v) for p, v in files.items()], HASHED)

    def file():
        partial = rng.choice("pq")
        return rng.choice("fgh"), rng.choice([5, 6]), partial, partial + rng.choice("12"), rng.choice([None] * 9 + ["no content"])

    for step in range(3):
        before = dict(now)
        for n in range(14):
            if rng.random() < 0.4:
                now.pop(f"/{n}", None)
            elif rng.random() < 0.7:
                now[f"/{n}"] = file()
        if step == 2:
            now = {p: v for p, v in now.items() if v[0] != "f"}  # a group goes
        verdicts.events(frame(before), frame(now)).repartition(2).write.mode("append").parquet(feed)
        verdicts.follow(spark.readStream.schema(verdicts.EVENTS).parquet(feed), out, marks).awaitTermination()
        hashed = frame(now).withColumn("read_error", F.col("error"))
        want = batch.verdicts(hashed).where("members > 1")
        assert sorted(map(tuple, verdicts.latest(spark, out).collect())) == sorted(map(tuple, want.select("base", "size", "members", "verdict", "hash").collect())), step
    rows = spark.read.schema(verdicts.LOG).parquet(out)
    assert rows.groupBy("base", "size", "version").count().where("count > 1").count() == 0


def test_whole_hashes_that_come_later():
    from collections import Counter

    two = Counter(p=2)
    assert verdicts.verdict(2, 0, two, Counter()) == ("undecided", None) == verdicts.verdict(2, 0, two, Counter(f=1))
    assert verdicts.verdict(2, 0, two, Counter(f=2)) == ("identical_duplicate", "f")
    assert verdicts.verdict(2, 0, two, Counter(f=1, g=1)) == ("real_conflict", None)
    assert verdicts.verdict(2, 0, Counter(p=1, q=1), Counter()) == ("eliminated_l2", None) and verdicts.verdict(1, 0, Counter(p=1), Counter()) == (None, None)
    assert verdicts.verdict(2, 1, Counter(p=1), Counter()) == ("unresolved", None)
