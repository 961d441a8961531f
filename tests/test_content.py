"""The content store: what a scan of it opens, what it decides, appended and replaced rows."""

import os

import pytest

from syncsift.plans import scan
from syncsift.schema import TICKS_AT_EPOCH
from syncsift.sources import content

SCHEMA = "path string, size long, mtime_ticks long, attributes int, volume_id string, file_id string, placeholder_kind string, content binary"


def rows(spark, files, marked=()):
    return spark.createDataFrame([(p, len(c), TICKS_AT_EPOCH, 0x1000 if p in marked else 0, "v", p, None, bytearray(c)) for p, c in files.items()], SCHEMA).repartition(3)


def opened(df):
    """(files, bytes) that the scan of a table opened, by its own metrics."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    value = lambda s, name: s.metrics().get(name).get().value()
    found = [s for s in scans if "FileScan" in s.nodeName() or "Scan parquet" in s.nodeName()]
    return sum(value(s, "numFiles") for s in found), sum(value(s, "filesSize") for s in found)


@pytest.fixture(scope="module")
def files():
    some = {f"/r/{i}/lone{i}.bin": os.urandom(3000) for i in range(300)}
    some |= {f"/r/{d}/pair{i}.bin": bytes([i]) * (100 + i) for i in range(20) for d in "ab"}
    return some | {f"/r/{d}/clash.bin": b"x" * 200 + d.encode() + b"x" * 200 for d in "ab"}


def test_only_members_are_opened(spark, files, tmp_path):
    folder = str(tmp_path / "store")
    held = content.store(rows(spark, files), folder, parts=8)
    size = lambda top: sum(p.stat().st_size for p in (tmp_path / "store/content" / top).rglob("*.parquet"))
    wanted = spark.createDataFrame([(p,) for p in files if "lone" not in p], "path string")
    found = held.contents(wanted)
    n, read = opened(found)
    assert {r.path for r in found.collect()} == {p for p in files if "lone" not in p}
    assert n and read == size("lone=false") and 40 * read < size("lone=true")
    one = held.contents(wanted.where("path = '/r/a/pair3.bin'"))
    assert 0 < opened(one)[1] < read / 2 and {"/r/a/pair3.bin", "/r/b/pair3.bin"} <= {r.path for r in one.collect()}
    assert held.contents(wanted.where("false")).count() == 0
    stored, plain = scan.scan(held, "/r", window=64), scan.scan(rows(spark, files), "/r", window=64)
    for x, y in ((stored.duplicates, plain.duplicates), (stored.conflicts, plain.conflicts), (stored.telemetry, plain.telemetry)):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))


def test_rows_that_come_later(spark, files, tmp_path):
    held = content.store(rows(spark, files), str(tmp_path / "store"), parts=8)
    more = {"/r/z/lone7.bin": files["/r/7/lone7.bin"], "/r/a/pair1.bin": bytes([1]) * 100 + b"!", "/r/new.bin": b"n"}
    content.store(rows(spark, more), str(tmp_path / "store"), added=1, parts=8)
    now = files | more
    found = scan.scan(held, "/r", window=64)
    plain = scan.scan(rows(spark, now), "/r", window=64)
    said = lambda s: sorted(map(str, s.members.select("path", "partial", "full", "verdict").collect()))
    assert said(found) == said(plain) and any("lone7" in x for x in said(found))
    assert {r.path: bytes(r.content) for r in held.contents(spark.createDataFrame([(p,) for p in more], "path string")).collect() if r.path in more} == more
    tight = content.compacted(held, str(tmp_path / "tight"), parts=8)
    assert said(scan.scan(tight, "/r", window=64)) == said(plain) and tight.metadata.count() == len(now)
    lies = lambda store: {r.lone for r in store._table("metadata").where("path = '/r/7/lone7.bin'").collect()}
    assert lies(held) == {True} and lies(tight) == {False}


def test_placeholders_are_not_stored(spark, tmp_path):
    files = {"/r/a/f": b"same", "/r/b/f": b"same", "/r/c/f": b"same"}
    held = content.store(rows(spark, files, marked=("/r/c/f",)), str(tmp_path / "store"))
    assert {r.path for r in held._table("content").collect()} == {"/r/a/f", "/r/b/f"} and held.metadata.count() == 3
    assert scan.scan(held, "/r").telemetry.first().placeholder_bytes_read == 0
    none = content.store(rows(spark, files).where("false"), str(tmp_path / "none"))
    assert none.metadata.count() == 0 and none.contents(none.metadata).count() == 0
