"""Whole scans of a file tree, and what follows from them."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from syncsift import cli, paths
from syncsift.functions.hashing import blake3
from syncsift.operators import cache, inventory, quarantine, report, resolution, verdicts
from syncsift.plans import scan
from syncsift.schema import RESERVED, TICKS_AT_EPOCH
from syncsift.sources import filetree


def std(seed, n):
    return bytes((seed + i % 251) % 256 for i in range(n))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Fifty files: eleven identical pairs, a trio, five conflicts whose windows agree, fifteen single files."""
    root, k = tmp_path_factory.mktemp("tree"), 1024
    big = 200 * k

    def put(name, data):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    for n in range(11):
        for top in ("dups", "backup"):
            put(f"{top}/p{n:02d}/pier{n:02d}.png", std(0x30 + n, big if n % 2 == 0 else (16 + n) * k))
    for folder in ("", "copy1/", "copy2/"):
        put(f"trio/{folder}three.bin", std(0xE0, big + 7))
    for n in range(5):
        for name, one, two in ((f"conflicts/ledger{n:02d}.bin", 0x10, 0x50), (f"conflicts/mirror/ledger{n:02d}-DESKTOP-HOST0{n}.bin", 0x50, 0x10)):
            w = 64 * k
            middle = bytes((one if i // 4096 % 2 == 0 else two) + n for i in range(w, big - w))
            put(name, bytes((0xAA + i % 13) % 256 for i in range(w)) + middle + bytes((0xBB + i % 17) % 256 for i in range(w)))
    for name in ("Zebra.txt", "apple.txt", "Apple.txt", "zebra.txt", "Árvore.txt"):
        put(f"unique/{name}", name.encode() * 9)
    for n in range(5, 15):
        put(f"unique/single{n:02d}.txt", std(0x70 + n, 5000 + 997 * n))
    return root


@pytest.fixture(scope="module")
def scanned(spark, tree):
    return scan.scan_tree(spark, str(tree))


def test_counters_and_verdicts(scanned):
    t = scanned.telemetry.first()
    assert (t.files_enumerated, t.files_partial_hashed, t.files_full_hashed, t.files_skipped) == (50, 35, 35, 15)
    assert (t.bytes_read_partial, t.bytes_read_full, t.bytes_read, t.placeholder_bytes_read) == (3_491_840, 5_335_061, 8_826_901, 0)
    assert (scanned.groups.count(), scanned.duplicates.count(), scanned.conflicts.count(), scanned.unresolved.count()) == (17, 12, 5, 0)
    assert scanned.exit_code() == 2


def test_a_second_scan_reads_what_changed(spark, tree, scanned):
    again = scan.scan_tree(spark, str(tree), cache=scanned.cache(now=1))
    t = again.telemetry.first()
    assert (t.files_enumerated, t.files_partial_hashed, t.bytes_read) == (50, 35, 0)
    assert again.json(again.started).split("bytes_read")[0].count("files") and again.duplicates.exceptAll(scanned.duplicates).count() == 0
    some = scanned.cache(now=1).where("size <> 204807")  # the cache doesn't know the trio
    t = scan.scan_tree(spark, str(tree), cache=some).telemetry.first()
    assert (t.bytes_read_partial, t.bytes_read_full) == (3 * 2 * 65_536, 3 * 204_807)


def test_only_groups_that_meet_are_hashed_whole(spark):
    rows = [(f"/r/{d}/{name}.txt", 200, TICKS_AT_EPOCH, 0, "v", f"{d}{name}", None, bytearray(text)) for d, name, text in [("a", "x", b"1" * 200), ("b", "x", b"2" * 200), ("a", "y", b"3" * 200), ("b", "y", b"3" * 200), ("a", "z", b"4" * 200)]]
    df = spark.createDataFrame(rows, "path string, size long, mtime_ticks long, attributes int, volume_id string, file_id string, placeholder_kind string, content binary")
    s = scan.scan(df, "/r", window=64)
    got = {r.path: (r.partial is not None, r.full is not None) for r in s.members.collect()}
    assert got == {"/r/a/x.txt": (True, False), "/r/b/x.txt": (True, False), "/r/a/y.txt": (True, True), "/r/b/y.txt": (True, True)}
    marks = verdicts.marker(df.where("path like '%y.txt'").select("path"))
    plan = df.where(marks(F.col("path"))).select("path", F.sha2("content", 256).alias("full"))
    assert {r.path for r in plan.collect()} >= {"/r/a/y.txt", "/r/b/y.txt"} and plan.count() < 5
    steps = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "sha2" in steps[0] and "getbit" in steps[1].lower()  # the hash stands above the filter on the key
    b3 = scan.scan(df, "/r", window=64, algorithm="blake3")
    assert [r.hash for r in b3.duplicates.collect()] == [blake3(b"3" * 200)] and '"BLAKE3"' in b3.json()


def test_the_placeholder_gate(spark, scanned):
    assert verdicts.gated(scanned.telemetry).first() == scanned.telemetry.first()
    with pytest.raises(Exception, match="placeholder content was read"):
        verdicts.gated(scanned.telemetry.withColumn("placeholder_bytes_read", F.lit(1).cast("long"))).collect()


def test_marker_passes_every_key_at_any_size(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS path")
    for bits in (10, 24):
        mark = verdicts.marker(keys, bits)
        assert keys.where(mark(F.col("path"))).count() == 3000
    assert spark.range(3000).selectExpr("concat('other', id) AS path").where(mark(F.col("path"))).count() < 600
    assert keys.where(verdicts.marker(keys.where("false"))(F.col("path"))).count() == 0


def test_command_line(spark, tree, tmp_path, capsys):
    run = lambda *args: (cli.main(list(args), lambda: spark), capsys.readouterr())
    code, out = run("scan", str(tree), "--json")
    assert code == 2 and report.validated(out.out) == [] and not out.err
    folder = str(tmp_path / "cache")
    assert run("scan", "--quiet", str(tree), "--cache", folder) == (2, ("", ""))
    code, out = run("scan", str(tree), "--json", "--cache", folder)
    assert code == 2 and json.loads(out.out)["telemetry"]["bytes_read"] == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    assert run("scan", str(empty))[0] == 0
    (tmp_path / "file").write_text("x")
    for bad in ((), ("look", str(tree)), ("scan",), ("scan", "--loud", str(tree)), ("scan", str(tree), str(tree)), ("scan", str(tmp_path / "none")), ("scan", str(tmp_path / "file")), ("scan", str(tree), "--cache")):
        code, out = run(*bad)
        assert code == 1 and not out.out and out.err
    pair = tmp_path / "pair"
    for d in ("a", "b"):
        (pair / d).mkdir(parents=True)
        (pair / d / "f.txt").write_text("same")
    (pair / "loop").symlink_to(pair)
    assert run("scan", str(pair), "--quiet")[0] == 3  # a duplicate, and a folder that was not entered


def test_report(scanned):
    when = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    text = scanned.json(when)
    assert report.validated(text) == [] and text.endswith("}\n") and text.isascii()
    r = json.loads(text)
    assert r["identical_duplicates"][0]["files"] == ["backup/p00/pier00.png", "dups/p00/pier00.png"]
    assert scanned.json(when) == text
    assert "conflict ledger00.bin" in scanned.text()
    assert report.dumps("<é'&") == '"\\u003C\\u00E9\\u0027\\u0026"\n'
    odd = 'a"b\\u00e9\\"c\n\x7f\x01😀'
    assert report.dumps(odd) == r'"a\u0022b\\u00e9\\\u0022c\n\u007F\u0001\uD83D\uDE00"' + "\n" and json.loads(report.dumps(odd)) == odd


def test_tree_rules(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/f.txt").write_text("one")
    os.link(tmp_path / "a/f.txt", tmp_path / "a/g.txt")  # a second link to one file
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / ".hidden").write_text("one")
    (tmp_path / RESERVED / "x").mkdir(parents=True)
    (tmp_path / RESERVED / "x/old.dat").write_text("z")
    (tmp_path / "b").mkdir()
    for name in ("b/online.txt", "online.txt"):
        (tmp_path / name).write_text("content")
    (tmp_path / "b/online.txt.placeholder-meta.json").write_text('{"kind": "offline"}')
    deep = tmp_path.joinpath(*["d"] * 17)
    deep.mkdir(parents=True)
    (deep / "f").write_text("x")
    s = scan.scan_tree(spark, str(tmp_path))
    files = {os.path.relpath(r.path, tmp_path): r for r in s.inventory.files.collect()}
    assert set(files) == {"a/f.txt", ".hidden", "b/online.txt", "online.txt"}
    assert files["b/online.txt"].placeholder_kind == "offline" and files["b/online.txt"].is_placeholder
    errors = {os.path.relpath(r.path, tmp_path): r.message for r in s.inventory.errors.collect()}
    assert set(errors) == {"a/g.txt", "loop", "d/" * 17 + "f"}
    counts = s.inventory.counts.first()
    assert (counts.files_enumerated, counts.files_placeholder, counts.files_excluded, counts.files_rejected) == (4, 1, 1, 2)
    assert s.members.count() == 0 and s.exit_code() == 0  # the online-only copy was not read, so there is no pair


def test_unreadable_members_leave_a_group_undecided(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.txt").write_text("same")
    filetree.register(spark)
    listed = spark.read.format("filetree").load(str(tmp_path))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    (tmp_path / "a/f.txt").unlink()  # between the listing and the scan
    s = scan.scan(listed, str(tmp_path))
    assert [r.verdict for r in s.members.select("verdict").distinct().collect()] == ["unresolved"]
    assert len(s.unresolved.first().files) == 1 and s.exit_code() == 3


def test_a_verdict_covers_the_whole_group(spark):
    ends = b"h" * 64
    content = {"a": ends + b"1" + ends, "b": ends + b"1" + ends, "c": b"H" * 64 + b"1" + ends}
    rows = [(f"/r/{k}/f.txt", len(v), TICKS_AT_EPOCH, 0, "v", k, None, bytearray(v)) for k, v in content.items()]
    df = spark.createDataFrame(rows, "path string, size long, mtime_ticks long, attributes int, volume_id string, file_id string, placeholder_kind string, content binary")
    s = scan.scan(df, "/r", window=64)
    assert len(s.conflicts.first().files) == 3
    for changed in ({"spark.sql.shuffle.partitions": "1"}, {"spark.sql.adaptive.enabled": "false"}):
        old = {k: spark.conf.get(k) for k in changed}
        for k, v in changed.items():
            spark.conf.set(k, v)
        again = scan.scan(df.orderBy(F.desc("path")), "/r", window=64)
        assert again.conflicts.collect() == s.conflicts.collect()
        for k, v in old.items():
            spark.conf.set(k, v)


def test_resolution(spark):
    rows = [("b", 1, "/r/x-DESKTOP-ABC123.t", 1, 5), ("b", 1, "/r/y.t", 1, 9), ("b", 1, "/r/a.t", 1, 9)]
    df = spark.createDataFrame(rows, "base string, size long, path string, n int, mtime_ticks long")
    kept = lambda plan: [r.path for r in plan.where("kept").collect()]
    assert kept(resolution.keep_newest(df)) == ["/r/a.t"]
    assert kept(resolution.keep_largest(df.withColumn("size", F.lit(1)))) == ["/r/a.t"]
    assert kept(resolution.keep_machine(df, "ABC123")) == ["/r/x-DESKTOP-ABC123.t"]
    one = spark.createDataFrame([("b", 1, "/r/y.t")], "base string, size long, chosen string")
    assert kept(resolution.keep_manual(df, one)) == ["/r/y.t"]
    assert {r.reason for r in resolution.sacrifices(resolution.keep_newest(df)).collect()} == {"keep-newest"}
    for bad in (lambda: resolution.keep_machine(df, "ZZZ999"), lambda: resolution.keep_manual(df, one.withColumn("chosen", F.lit("/else"))), lambda: resolution.keep_newest(df.limit(1))):
        with pytest.raises(Exception, match="group"):
            bad().collect()


def test_cache_never_serves_an_altered_row(spark):
    files = spark.createDataFrame([("/a", 3, 7, "p", "f"), ("/b", 4, 8, "q", "g")], "path string, size long, mtime_ticks long, partial string, full string")
    stored = cache.entries(files, 1)
    cache.validate(stored)
    assert {r.path: r.known_full for r in cache.lookup(files.withColumn("mtime_ticks", F.when(F.col("path") == "/b", 9).otherwise(F.col("mtime_ticks"))), stored).collect()} == {"/a": "f", "/b": None}
    with pytest.raises(Exception, match="altered"):
        cache.lookup(files, stored.withColumn("hash_full", F.lit("evil"))).collect()
    assert cache.upsert(stored, cache.entries(files.limit(1), 2)).groupBy("last_seen").count().count() == 2
    twice = stored.unionByName(cache.entries(files.withColumn("full", F.lit("newer")), 2))
    assert sorted((r.path, r.known_full) for r in cache.lookup(files, twice).collect()) == [("/a", "newer"), ("/b", "newer")]
    altered = stored.withColumn("hash_full", F.when(F.col("size") == 4, "evil").otherwise(F.col("hash_full")))
    assert cache.lookup(files.where("size = 3"), altered).first().known_full == "f"  # no file asks for the altered row
    with pytest.raises(ValueError, match="cache"):
        cache.validate(stored.drop("entry_mac"))
    with pytest.raises(ValueError, match="version 7"):
        cache.validate(stored.withColumn("hash_version", F.lit(7)))


def test_quarantine_moves_and_restores(tmp_path):
    items = []
    for name in ("b.txt", "a.txt", "stale.txt"):
        path = tmp_path / name
        path.write_text(name)
        s = path.stat()
        items.append({"path": str(path), "size": s.st_size + (name == "stale.txt"), "mtime_ticks": s.st_mtime_ns // 100 + TICKS_AT_EPOCH, "reason": "keep-newest", "rule": "demo"})
    when = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    done = quarantine.move(items, str(tmp_path), when)
    assert [os.path.basename(p) for p in done.moved] == ["a.txt", "b.txt"] and done.skipped == [str(tmp_path / "stale.txt")]
    assert done.operation_id.startswith("20260102T030405Z-")
    manifest = json.loads((done.folder / "manifest.json").read_text())
    assert [i["quarantine_path"] for i in manifest["items"]] == ["payload/0001.dat", "payload/0002.dat"]
    (tmp_path / "a.txt").write_text("occupied")
    with pytest.raises(quarantine.Occupied):
        quarantine.restore(done.operation_id, str(tmp_path))
    (tmp_path / "a.txt").rename(tmp_path / "other.txt")
    assert not (tmp_path / "b.txt").exists()
    assert len(quarantine.restore(done.operation_id, str(tmp_path))) == 2
    assert (tmp_path / "b.txt").read_text() == "b.txt"


def test_a_failed_move_leaves_a_partial_manifest(tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("x")
    item = {"path": str(path), "size": 1, "mtime_ticks": path.stat().st_mtime_ns // 100 + TICKS_AT_EPOCH}
    now = datetime.now(timezone.utc)

    def spoil(a, b):
        os.rename(a, b)
        with open(b, "w") as f:
            f.write("y")

    for bad, rename in ((item, spoil), (item | {"is_placeholder": True}, os.rename), (item | {"path": "/etc/hostname"}, os.rename)):
        with pytest.raises(quarantine.PartialMove) as e:
            quarantine.move([bad], str(tmp_path), now, rename)
        assert json.loads(e.value.manifest.read_text())["status"] == "partial"
    assert path.exists()


def test_both_hashes_of_a_spoilt_move_are_kept(tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("x")
    item = {"path": str(path), "size": 1, "mtime_ticks": path.stat().st_mtime_ns // 100 + TICKS_AT_EPOCH}

    def spoil(a, b):
        os.rename(a, b)
        with open(b, "w") as f:
            f.write("y")

    with pytest.raises(quarantine.PartialMove) as e:
        quarantine.move([item], str(tmp_path), datetime.now(timezone.utc), spoil)
    told = json.loads((e.value.manifest.parent / "manifest-failed.json").read_text())
    assert told["status"] == "failed" and told["items"][0]["hash_pre_move"] != told["items"][0]["hash_post_move"] and path.exists()


def test_paths_stay_under_the_root(tmp_path):
    (tmp_path / "root/in").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "root/way").symlink_to(tmp_path / "out")
    root = paths.canonical_root(f"{tmp_path}/root/./in/..//")
    assert root == str(tmp_path / "root") and paths.combined(root, "in", "../x") == f"{root}/x" and paths.combined(root, "/etc") == "/etc"
    assert paths.contained(f"{root}/in/f", root).name == "f" and paths.contained(root, root)
    for bad in (f"{root}/way/f", f"{root}/../out/f", f"{root}-other/f", "/etc/hostname"):
        with pytest.raises(ValueError, match="outside"):
            paths.contained(bad, root)
    for bad in (lambda: paths.canonical_root(" "), lambda: paths.combined(root, "")):
        with pytest.raises(ValueError):
            bad()
    assert len({paths.operation_id() for _ in range(20)}) == 20 and len(paths.operation_id()) == 32
    (tmp_path / "out/f").write_text("x")
    s = (tmp_path / "out/f").stat()
    with pytest.raises(quarantine.PartialMove, match="outside"):  # a linked folder leads outside
        quarantine.move([{"path": f"{root}/way/f", "size": 1, "mtime_ticks": s.st_mtime_ns // 100 + TICKS_AT_EPOCH}], root, datetime.now(timezone.utc))
    assert (tmp_path / "out/f").exists()


def test_a_tree_is_listed_in_parts(spark, tmp_path, monkeypatch):
    for d in ("a/x", "b", "c/y/z"):
        (tmp_path / d).mkdir(parents=True)
        for n in range(5):
            (tmp_path / d / f"{n}.txt").write_text("x")
    for n in range(12):
        (tmp_path / f"flat{n}").write_text("x")
    (tmp_path / "loop").symlink_to(tmp_path)
    want = sorted(str(p) for p in tmp_path.rglob("*") if p.is_file() or p.is_symlink())
    for listed, together in ((1, 3), (4, 4), (64, 1000)):
        monkeypatch.setattr(filetree, "LISTED", listed)
        monkeypatch.setattr(filetree, "TOGETHER", together)
        reader = filetree.FileTreeReader(str(tmp_path), "v")
        parts = reader.partitions()
        assert all(len(p.paths) <= together for p in parts)
        assert sorted(r[0] for p in parts for r in reader.read(p)) == want

    class Cloud:
        st_file_attributes = 0x1000

    assert filetree._untouchable(Cloud()) and not filetree._untouchable(os.lstat(tmp_path))
    monkeypatch.setattr(filetree, "_untouchable", lambda s: s.st_ino == os.lstat(tmp_path / "b").st_ino)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(os.path.basename(r[0]), r[-1]) for r in rows if r[-1]] == [("b", "a placeholder folder is not entered"), ("loop", "a link to a directory is not followed")]


def test_rows_without_a_file_id_are_files_of_their_own(spark):
    rows = [(f"/r/{i}.txt", 1, 1, 0, "v", fid, None) for i, fid in enumerate(["", "", None, "7", "7"])]
    df = spark.createDataFrame(rows, "path string, size long, mtime_ticks long, attributes int, volume_id string, file_id string, placeholder_kind string")
    assert {r.path: r.fate for r in inventory.judged(df, "/r").collect()} == {f"/r/{i}.txt": "repeated" if i == 4 else "kept" for i in range(5)}
    assert inventory.snapshot_by_path(df).first().file_id == "/r/0.txt" and inventory.snapshot(df).columns == ["path", "size", "mtime_ticks", "file_id"]


def test_blake3_vectors():
    x = bytearray(i % 251 for i in range(262_144))
    x[131_072:131_088] = b"\xaa" * 16
    assert blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(bytes((7 * i + 3) % 256 for i in range(96))) == "821a7efb8d49dad09c77ff47e829a28db9a9642ed33b83fd55b640e364137a89"
    assert blake3(bytes(x)) == "a231b86dbb971a220623d3b5bddf06548f74ac3efed175489f3b22c9a735ec20"
