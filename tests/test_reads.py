"""Reads: in bounded pieces, by ranges, bracketed by the file's state, counted, and remembered."""

import builtins
import os

import pytest
from pyspark.sql import functions as F

from syncsift.functions import hashing
from syncsift.functions.hashing import PIECE, Blake3, blake3, blake3_root
from syncsift.operators import cache, inventory, verdicts
from syncsift.plans import registry, scan
from syncsift.schema import TICKS_AT_EPOCH
from syncsift.sources import filetree

SF = "/root/testdata/sf0.001"


def by_definition(data, first=0, root=True):
    """A left subtree of the largest power of two of chunks, the rest to the right."""
    chunks = max(1, -(-len(data) // 1024))
    if chunks == 1:
        return hashing._node(data, first, root)
    left = 1 << (chunks - 1).bit_length() - 1
    two = by_definition(data[: left * 1024], first, False), by_definition(data[left * 1024 :], first + left, False)
    return hashing._up(hashing.np.concatenate(two), root)


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 5000, PIECE - 1, PIECE, PIECE + 1, 2 * PIECE, 3 * PIECE + 7, 5 * PIECE + 1024])
def test_a_hash_is_that_of_any_cut(size):
    data = bytes(i * 7 % 251 for i in range(size))
    want = by_definition(data)[0].astype("<u4").tobytes().hex()
    assert blake3(data) == want
    h = Blake3()
    for at in range(0, size, 100_003):
        h.update(data[at : at + 100_003])
    assert h.hexdigest() == want
    for span in (PIECE, 2 * PIECE) if size > 20_000 else (1024, 4096):
        nodes = []
        for at in range(0, max(1, size), span):
            n = Blake3(at // 1024)
            n.update(data[at : at + span])
            nodes.append(n.node(root=size <= span))
        assert blake3_root(nodes) == want


def test_published_vectors():
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert blake3(pattern(1)) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3(pattern(1024)) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"


def test_no_read_is_larger_than_a_piece(tmp_path, monkeypatch):
    path, asked = tmp_path / "f", []
    path.write_bytes(os.urandom(3 * PIECE + 5))

    class Watched:
        def __init__(self, *a, **k):
            self.f = open_(*a, **k)

        def read(self, n):
            asked.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    open_ = builtins.open
    monkeypatch.setattr(builtins, "open", Watched)
    error, got, before, after = hashing._read(str(path), Blake3(), [(0, 3 * PIECE + 5)], True, False)
    assert error is None and got == 3 * PIECE + 5 and before == after and max(asked) <= PIECE and len(asked) == 4


def pair(tmp_path, make):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        make(tmp_path / d / "f.bin")


def test_a_file_larger_than_memory(spark, tmp_path):
    path, size = tmp_path / "f.bin", (4 << 30) + 5  # sparse; the session has four gigabytes
    with open(path, "wb") as f:
        f.truncate(size)
    read = spark.createDataFrame([(str(path), size, False)], "path string, size long, marked boolean").select(hashing.path_hasher(None)("path", "size", "marked").alias("r")).first().r
    assert read.error is None and read.bytes == size and read.before.size == size


def test_ranges_of_a_file_are_tasks_of_their_own(spark, tmp_path):
    data = os.urandom(4 * PIECE + 99)
    pair(tmp_path, lambda path: path.write_bytes(data))
    filetree.register(spark)
    files = spark.read.format("filetree").load(str(tmp_path)).withColumn("is_placeholder", F.lit(False))
    told = hashing.tree_hashed(files, PIECE).collect()
    assert [(r.hash, r.error, r.bytes, r.before == r.after) for r in told] == [(blake3(data), None, len(data), True)] * 2
    s = scan.scan_tree(spark, str(tmp_path), algorithm="blake3")
    assert s.duplicates.first().hash == blake3(data) and s.telemetry.first().bytes_read_full == 2 * len(data)
    with pytest.raises(ValueError, match="power of two"):
        hashing.range_hasher(PIECE + 1)
    assert registry.queries()["blake3_ranges"](spark, SF).where("NOT equal").count() == 0


def listed(spark, root):
    filetree.register(spark)
    rows = spark.read.format("filetree").load(str(root))
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.mark.parametrize("algorithm", ["sha256", "blake3"])
def test_a_file_that_changed_since_it_was_listed(spark, tmp_path, algorithm):
    pair(tmp_path, lambda path: path.write_text("same"))
    before = listed(spark, tmp_path)
    (tmp_path / "a/f.bin").write_text("SAME")  # of equal size
    os.utime(tmp_path / "a/f.bin", ns=(1, 10**18))
    s = scan.scan(before, str(tmp_path), algorithm=algorithm)
    assert s.exit_code() == 3 and s.unresolved.first().files[0].reason.startswith("mtime diverged: pre=")
    assert s.cache().count() == 1 and s.telemetry.first().bytes_read == 8  # both were read, one is remembered


def test_a_file_that_changes_while_it_is_read(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"x" * 2 * PIECE)

    class Spoiler(Blake3):
        def update(self, data):
            with open(path, "ab") as f:
                f.write(b"y")
            super().update(data)

    error, got, before, after = hashing._read(str(path), Spoiler(), [(0, 2 * PIECE)], True, False)
    assert error is None and before[0] == 2 * PIECE and after[0] == 2 * PIECE + 2 and got == 2 * PIECE


def test_states(spark):
    row = spark.createDataFrame([(5, 7, "", (5, 7, "9"), (5, 8, "9"))], "size long, mtime_ticks long, file_id string, b struct<size:long,mtime_ticks:long,file_id:string>, a struct<size:long,mtime_ticks:long,file_id:string>")
    found = row.select(inventory.divergence(inventory.listed(), inventory.state("b.")).alias("x"), inventory.divergence(inventory.state("b."), inventory.state("a.")).alias("y")).first()
    assert tuple(found) == (None, "mtime diverged: pre=7, post=8")


def test_the_gate_fires_for_a_reader_that_opens_placeholders(spark, tmp_path):
    pair(tmp_path, lambda path: path.write_text("online only"))
    rows = listed(spark, tmp_path).withColumns({"base": F.lit("f.bin"), "is_placeholder": F.col("path").contains("/a/")})
    counts = spark.createDataFrame([(2, 1, 0, 0)], "files_enumerated long, files_placeholder long, files_excluded long, files_rejected long")
    for algorithm in ("sha256", "blake3"):
        told = verdicts.telemetry(counts, verdicts.judged_members(verdicts.hashed_paths(rows, algorithm=algorithm)))
        assert verdicts.gated(told).first().placeholder_bytes_read == 0
        opened = verdicts.telemetry(counts, verdicts.judged_members(verdicts.hashed_paths(rows, algorithm=algorithm, guarded=False)))
        assert opened.first().placeholder_bytes_read == 2 * 11 and verdicts.telemetry_violations(opened).count() > 0
        with pytest.raises(Exception, match="placeholder content was read"):
            verdicts.gated(opened).collect()


def test_bytes_are_those_that_were_read(spark, tmp_path):
    pair(tmp_path, lambda path: path.write_bytes(b"x" * 300_000))
    before = listed(spark, tmp_path)
    os.truncate(tmp_path / "a/f.bin", 100_000)  # the first window can be read, the last can't
    t = scan.scan(before, str(tmp_path)).telemetry.first()
    assert (t.bytes_read_partial, t.bytes_read_full) == (65_536 + 2 * 65_536, 0)


def test_a_cache_keeps_whole_hashes_of_files_whose_twin_is_gone(spark, tmp_path):
    pair(tmp_path, lambda path: path.write_bytes(b"x" * 300_000))
    first = scan.scan_tree(spark, str(tmp_path)).cache(now=1)
    assert first.where("hash_full IS NOT NULL").count() == 2
    (tmp_path / "b/f.bin").rename(tmp_path / "gone")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/f.bin").write_bytes(b"z" * 300_000)  # of another beginning, so no whole file is compared
    (tmp_path / "gone").rename(tmp_path.parent / f"{tmp_path.name}-gone")
    second = scan.scan_tree(spark, str(tmp_path), cache=first).cache(first, now=2)
    assert second.where("hash_full IS NOT NULL").count() == 2 and second.count() == 3
    (tmp_path.parent / f"{tmp_path.name}-gone").rename(tmp_path / "b/f.bin")
    (tmp_path / "c/f.bin").unlink()
    third = scan.scan_tree(spark, str(tmp_path), cache=second)
    assert third.telemetry.first().bytes_read == 0 and third.duplicates.count() == 1  # the twin is back: nothing is read again
    assert cache.upsert(second, third.cache(second, now=3)).count() == 3


def test_ticks(tmp_path):
    path = tmp_path / "f"
    path.write_text("x")
    with open(path, "rb") as f:
        assert hashing._state(f) == (1, os.stat(path).st_mtime_ns // 100 + TICKS_AT_EPOCH, str(os.stat(path).st_ino))
