"""The generated tree: the same for the same parameters, and what a scan must find in it."""

import hashlib
import json
import os

import pytest

from syncsift import generate
from syncsift.plans import scan

TREE = generate.Tree(files=120, duplicates=7, conflicts=6, placeholders=5, depth=3, seed=3)


def digest(root):
    h = hashlib.sha256()
    for folder, subs, names in os.walk(root):
        subs.sort()
        for n in sorted(names):
            path = os.path.join(folder, n)
            with open(path, "rb") as f:
                h.update(os.path.relpath(path, root).encode() + b"\0" + f.read() + b"\0")
    return h.hexdigest()


def test_same_parameters_same_tree(tmp_path):
    made = [generate.generate(str(tmp_path / d), TREE) for d in "ab"]
    assert made[0] == made[1] and made[0]["files"] == 120 and digest(tmp_path / "a") == digest(tmp_path / "b")
    other = generate.generate(str(tmp_path / "c"), generate.Tree(120, 7, 6, 5, 3, seed=4))
    assert digest(tmp_path / "c") != digest(tmp_path / "a") and other["placeholders"] == 5
    for bad in (lambda: generate.Tree(files=3), lambda: generate.Tree(depth=0), lambda: generate.generate(str(tmp_path / "a"), TREE)):
        with pytest.raises(ValueError):
            bad()


def test_the_same_tree_by_any_number_of_tasks(spark, tmp_path):
    want = generate.generate(str(tmp_path / "one"), TREE)
    for tasks in (1, 5):
        assert generate.generate_by_tasks(spark, str(tmp_path / str(tasks)), TREE, tasks) == want
        assert digest(tmp_path / str(tasks)) == digest(tmp_path / "one")


def test_a_scan_of_it(spark, tmp_path, capsys):
    args = ["--root", str(tmp_path / "t"), "--files", "120", "--duplicates", "7", "--conflicts", "6", "--placeholders", "5", "--depth", "3", "--seed", "3"]
    assert generate.main(args) == 0
    made = json.loads(capsys.readouterr().out)
    assert generate.main(args) == 1
    s = scan.scan_tree(spark, str(tmp_path / "t"))
    t = s.telemetry.first()
    assert (t.files_enumerated, t.files_placeholder, t.placeholder_bytes_read) == (120, 5, 0)
    assert t.files_partial_hashed == made["duplicate_files"] + made["conflict_files"]
    assert (s.duplicates.count(), s.conflicts.count(), s.unresolved.count()) == (7, 3, 0)
    kinds = {r.placeholder_kind for r in s.inventory.files.where("is_placeholder").collect()}
    assert kinds == {"reparse_point", "recall_on_data_access", "recall_on_open", "offline"}
