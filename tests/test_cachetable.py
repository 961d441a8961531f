"""The cache table: merged on read, compacted, and whole after a writer that dies at any step."""

import json

import pytest
from pyspark.sql import functions as F

from syncsift.operators import cache, cachetable
from syncsift.operators.cachetable import CacheTable

FILES = "path string, size long, mtime_ticks long, partial string, full string"


def files(spark, some):
    return spark.createDataFrame([(f"/{n}", n, 7, f"p{v}{n}", f"f{v}{n}") for n, v in some], FILES)


def opened(spark, tmp_path):
    return CacheTable(spark, f"file://{tmp_path}/cache", buckets=4)


def known(table, asked):
    return {r.path: (r.known_partial, r.known_full) for r in table.lookup(asked).collect()}


def test_base_and_deltas(spark, tmp_path):
    table, every = opened(spark, tmp_path), files(spark, [(n, "x") for n in range(20)])
    assert set(known(table, every).values()) == {(None, None)} and table.entries().count() == 0
    table.append(cache.entries(files(spark, [(n, "a") for n in range(10)]), 1))
    want = {f"/{n}": (f"pa{n}", f"fa{n}") if n < 10 else (None, None) for n in range(20)}
    assert known(table, every) == want
    table.compact().append(cache.entries(files(spark, [(n, "b") for n in range(8, 12)]), 2)).append(cache.entries(files(spark, [(11, "c")]), 3))
    want |= {f"/{n}": (f"pb{n}", f"fb{n}") for n in range(8, 11)} | {"/11": ("pc11", "fc11")}
    assert known(table, every) == want == known(opened(spark, tmp_path), every)
    assert sorted(r.hash_full for r in table.entries().collect()) == sorted(f for _, f in want.values() if f)
    table.compact()
    assert known(table, every) == want and table.entries().count() == 12 and table.version.deltas == []
    assert len(table.vacuum()) > 4 and known(opened(spark, tmp_path), every) == want and table.vacuum() == []


def test_a_lookup_doesnt_shuffle_the_base(spark, tmp_path):
    table = opened(spark, tmp_path).append(cache.entries(files(spark, [(n, "a") for n in range(50)]), 1)).compact()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = table.lookup(files(spark, [(n, "x") for n in range(5)]))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # of the files that ask
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_deltas_become_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cachetable, "MOST_DELTAS", 2)
    table = opened(spark, tmp_path)
    for n in range(3):
        table.append(cache.entries(files(spark, [(n, "a")]), n))
    assert table.version.deltas == [] and table.version.base and table.entries().count() == 3


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["append", "compact"])
def test_a_writer_that_dies_before_its_version_loses_nothing(spark, tmp_path, monkeypatch, step):
    table, every = opened(spark, tmp_path), files(spark, [(n, "x") for n in range(6)])
    table.append(cache.entries(files(spark, [(n, "a") for n in range(4)]), 1))
    before = known(table, every)

    def die(self, version):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(CacheTable, "_commit", die)
        with pytest.raises(Died):
            table.append(cache.entries(files(spark, [(5, "z")]), 2)) if step == "append" else table.compact()
    again = opened(spark, tmp_path)
    assert known(again, every) == before and len(again.vacuum()) == 1 and known(again, every) == before


def test_of_two_writers_one_is_told(spark, tmp_path):
    one, two = opened(spark, tmp_path), opened(spark, tmp_path)
    one.append(cache.entries(files(spark, [(1, "a")]), 1))
    with pytest.raises(RuntimeError, match="another writer"):
        two.append(cache.entries(files(spark, [(2, "b")]), 1))
    assert opened(spark, tmp_path).entries().count() == 1


def test_what_is_no_cache_is_refused(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    assert opened(spark, tmp_path).version.number == 0  # an empty folder will do
    (tmp_path / "cache/letter.txt").write_text("keep me")
    with pytest.raises(ValueError, match="not a hash cache"):
        opened(spark, tmp_path)
    (tmp_path / "cache/letter.txt").unlink()
    table = opened(spark, tmp_path).append(cache.entries(files(spark, [(1, "a"), (2, "a")]), 1))
    with pytest.raises(Exception, match="altered"):
        table.append(cache.entries(files(spark, [(3, "a")]), 1).withColumn("hash_full", F.lit("evil"))).lookup(files(spark, [(3, "x")])).collect()
    delta = next(p for p in (tmp_path / "cache").glob("delta-*") if p.name == table.version.deltas[0])
    spark.read.parquet(f"file://{delta}").limit(1).write.parquet(f"file://{tmp_path}/less")
    delta.rename(tmp_path / "moved")
    with pytest.raises(ValueError, match="lost"):
        opened(spark, tmp_path)
    (tmp_path / "less").rename(delta)
    with pytest.raises(ValueError, match="altered"):
        opened(spark, tmp_path)
    last = tmp_path / "cache/version-00000009.json"
    for text, why in (("{", "broken"), (json.dumps({"number": 9, "hash_version": 7}), "version 7")):
        last.write_text(text)
        with pytest.raises(ValueError, match=why):
            opened(spark, tmp_path)


def test_the_default_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    table = CacheTable(spark).append(cache.entries(files(spark, [(1, "a")]), 1))
    assert table.folder == f"file://{cache.default_path()}" and CacheTable(spark).entries().count() == 1
