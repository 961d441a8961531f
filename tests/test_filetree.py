"""The walk: pushed filters, depth, large folders in slices, and trees as streams."""

import os

import pytest

from syncsift.plans import scan
from syncsift.schema import RESERVED
from syncsift.sources import filetree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for d in ("a/x", "a/y", "ab", "b/deep/er", RESERVED + "/old"):
        (root / d).mkdir(parents=True)
        for n in range(3):
            (root / d / f"{n}.txt").write_text(d)
    (root / "top.txt").write_text("top")
    return root


def entered(monkeypatch):
    """The folders that are listed from now on, in this process."""
    seen, scandir = [], os.scandir

    def watch(path):
        seen.append(str(path))
        return scandir(path)

    monkeypatch.setattr(os, "scandir", watch)
    return seen


def walked(root, filters=(), **options):
    reader = filetree.FileTreeReader(str(root), "v", **options)
    left = list(reader.pushFilters(list(filters)))
    return sorted((os.path.relpath(r[0], root), r[-1]) for p in reader.partitions() for r in reader.read(p)), left


@pytest.mark.parametrize("listed", [1, 64])
def test_filters_are_pushed_into_the_walk(tree, monkeypatch, listed):
    monkeypatch.setattr(filetree, "LISTED", listed)
    path = ("path",)
    begins = filetree.StringStartsWith(path, f"{tree}/a/")
    seen = entered(monkeypatch)
    rows, left = walked(tree, [begins])
    assert [r[0] for r in rows] == [f"a/{d}/{n}.txt" for d in "xy" for n in range(3)] and left == []
    assert {os.path.relpath(p, tree) for p in seen} <= {".", "a", "a/x", "a/y"}
    seen.clear()
    rows, left = walked(tree, [filetree.Not(filetree.StringStartsWith(path, f"{tree}/{RESERVED}/")), filetree.EqualTo(("size",), 3)])
    assert len(rows) == 13 and not any(RESERVED in p for p in seen) and len(left) == 1
    seen.clear()
    one = filetree.EqualTo(path, f"{tree}/b/deep/er/1.txt")
    rows, left = walked(tree, [one])
    assert [r[0] for r in rows] == ["b/deep/er/1.txt"] and left == [one] and not any(p.endswith(("/a", "/ab")) for p in seen)


@pytest.mark.parametrize("listed", [1, 64])
def test_depth_is_pushed_into_the_walk(tree, monkeypatch, listed):
    monkeypatch.setattr(filetree, "LISTED", listed)
    seen = entered(monkeypatch)
    rows, _ = walked(tree, max_depth=2)
    files = [p for p, e in rows if not e]
    assert files == ["ab/0.txt", "ab/1.txt", "ab/2.txt", "top.txt"]
    assert {p for p, e in rows if e} == {"a/x", "a/y", "b/deep", f"{RESERVED}/old"} and not any(p.endswith(("/x", "/deep")) for p in seen)


def test_spark_pushes_filters(spark, tree):
    filetree.register(spark)
    rows = spark.read.format("filetree").load(str(tree))
    some = rows.where(rows.path.startswith(f"{tree}/a/") & ~rows.path.startswith(f"{tree}/a/y/"))
    assert sorted(os.path.relpath(r.path, tree) for r in some.collect()) == ["a/x/0.txt", "a/x/1.txt", "a/x/2.txt"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan" in plan  # nothing is left above the scan
    assert spark.read.format("filetree").option("maxDepth", 1).load(str(tree)).where("error is null").count() == 1


def test_a_large_folder_is_many_parts(tree, monkeypatch):
    for n in range(300):
        (tree / "ab" / f"many{n}").write_text("x")
    (tree / "ab/sub").mkdir()
    (tree / "ab/sub/f").write_text("x")
    monkeypatch.setattr(filetree, "TOGETHER", 100)
    want = sorted(os.path.relpath(p, tree) for p in tree.rglob("*") if p.is_file())
    reader = filetree.FileTreeReader(str(tree), "v")
    parts = reader.partitions()
    assert sum(p.slice_ is not None for p in parts) == filetree.SLICES and all(len(p.paths) <= 100 for p in parts)
    assert sorted(os.path.relpath(r[0], tree) for p in parts for r in reader.read(p)) == want
    monkeypatch.setattr(filetree, "TOGETHER", 2)  # the root, too
    reader = filetree.FileTreeReader(str(tree), "v")
    parts = reader.partitions()
    assert sorted(os.path.relpath(r[0], tree) for p in parts for r in reader.read(p)) == want and len(parts) == filetree.SLICES


def test_a_tree_as_a_stream(spark, tree, tmp_path):
    filetree.register(spark)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def batch():
        rows = spark.readStream.format("filetree").option("settle", 0.1).load(str(tree)).where("error is null").select("path", "size")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.relpath(r.path, tree), r.size) for r in spark.read.schema("path string, size long").parquet(out).collect())

    import time

    time.sleep(0.3)
    first = batch()
    assert len(first) == 16
    (tree / "ab/0.txt").write_text("changed")
    (tree / "new.txt").write_text("n")
    time.sleep(0.3)
    assert sorted(set(batch()) - set(first)) == [("ab/0.txt", 7), ("new.txt", 1)]
    time.sleep(0.2)
    assert len(batch()) == 18  # nothing is new


def test_a_scan_of_the_filtered_tree(spark, tree):
    s = scan.scan_tree(spark, str(tree))
    assert s.inventory.counts.first().files_excluded == 3
