"""The bit-parallel alignment against the plain one, large texts, the table function, and files compared by path."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syncsift.operators import compare, comparefiles


def plain(left, right):
    """The same alignment with the lengths of all prefixes computed row by row."""

    def reach(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j] + 1 if x == y else row[j + 1]))
            row = new
        return row

    if not left or not right:
        return []
    if len(left) == 1:
        return [(0, right.index(left[0]))] if left[0] in right else []
    if len(right) == 1:
        return [(left.index(right[0]), 0)] if right[0] in left else []
    mid = len(left) // 2
    total = [x + y for x, y in zip(reach(left[:mid], right), reach(left[mid:][::-1], right[::-1])[::-1], strict=True)]
    cut = total.index(max(total))
    return plain(left[:mid], right[:cut]) + [(i + mid, j + cut) for i, j in plain(left[mid:], right[cut:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcdef"), max_size=40))
def test_the_same_lines_meet(left, right):
    assert compare.matches(left, right) == plain(left, right)


@pytest.mark.parametrize("small", [0, 8])
def test_masks_made_on_demand(monkeypatch, small):
    monkeypatch.setattr(compare, "SMALL", small)
    monkeypatch.setattr(compare, "MASK_BYTES", 4)
    rng = random.Random(2)
    for n in (1, 7, 64, 130):
        left, right = ([rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(n)] for _ in range(2))
        assert compare.matches(left, right) == plain(left, right)


def test_a_hundred_thousand_lines():
    rng = random.Random(3)
    left = [f"line {rng.randrange(20_000)}" for _ in range(100_000)]
    right = [x if rng.random() < 0.8 else f"other {rng.random()}" for x in left if rng.random() < 0.95]
    began = time.process_time()
    found = compare.regions(left, right)
    assert time.process_time() - began < 120
    assert sum(r[2] for r in found) == 100_000 and sum(r[4] for r in found) == len(right)
    kept = [r for r in found if r[0] == "Equal"]
    assert all(left[a : a + n] == right[b : b + m] for _, a, n, b, m in kept) and sum(r[2] for r in kept) > 70_000


def test_the_table_function(spark):
    compare.register(spark)
    spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, "", "")], "id int, l string, r string").createOrReplaceTempView("pairs_of_texts")
    rows = spark.sql("SELECT id, d.* FROM pairs_of_texts, LATERAL diff_regions('text', l, r) AS d ORDER BY id, left_start, right_start").collect()
    assert [tuple(r) for r in rows] == [(1, "Equal", 0, 1, 0, 1), (1, "Changed", 1, 1, 1, 1), (1, "Equal", 2, 1, 2, 1), (1, "Added", 3, 0, 3, 1), (2, "Equal", 0, 1, 0, 1)]


def test_files(spark, tmp_path):
    files = {"a.bin": b"x" * 900_000, "b.bin": b"x" * 700_000 + b"y" + b"x" * 199_999, "c.bin": b"x" * 300, "same.bin": b"x" * 900_000, "e.bin": b"", "f.txt": b"one\ntwo\n", "g.txt": b"one\nthree\n", "t.csv": b"a,b\n", "u.csv": b'"a",b\n'}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    at = lambda n: str(tmp_path / n)
    pairs = [("a.bin", "b.bin"), ("a.bin", "c.bin"), ("c.bin", "a.bin"), ("a.bin", "same.bin"), ("e.bin", "e.bin"), ("e.bin", "c.bin"), ("f.txt", "g.txt"), ("t.csv", "u.csv"), ("a.bin", "none.bin"), ("f.txt", "none.txt"), ("a.bin", "b.bin")]
    df = spark.createDataFrame([(at(x), at(y)) for x, y in pairs], "left string, right string")
    for span in (1 << 18, 1 << 26):
        got = {(r.left[len(at("")) :].strip("/"), r.right[len(at("")) :].strip("/")): r for r in comparefiles.compare_files(df, range_bytes=span).collect()}
        said = {k: None if r.regions is None else [tuple(x) for x in r.regions] for k, r in got.items()}
        assert said == {
            ("a.bin", "b.bin"): [("Changed", 700_000, 1, 700_000, 1)], ("a.bin", "c.bin"): [("Removed", 300, 899_700, 300, 0)], ("c.bin", "a.bin"): [("Added", 300, 0, 300, 899_700)], ("a.bin", "same.bin"): [], ("e.bin", "e.bin"): [],
            ("e.bin", "c.bin"): [("Added", 0, 0, 0, 300)], ("f.txt", "g.txt"): [("Equal", 0, 1, 0, 1), ("Changed", 1, 1, 1, 1)], ("t.csv", "u.csv"): [("Equal", 0, 1, 0, 1)], ("a.bin", "none.bin"): None, ("f.txt", "none.txt"): None,
        }
        assert got["a.bin", "none.bin"].error and got["f.txt", "none.txt"].error and got["f.txt", "g.txt"].comparison == "text"
    small = {r.comparison for r in comparefiles.compare_files(df.where("left like '%f.txt' AND right like '%g.txt'"), most_text=3).collect()}
    assert small == {"binary"}


def test_files_of_more_than_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 4096
    for name, last in (("a.bin", b"x"), ("b.bin", b"y")):
        with open(tmp_path / name, "wb") as f:  # sparse
            f.truncate(size - 1)
            f.seek(size - 1)
            f.write(last)
    row = comparefiles.compare_files(spark.createDataFrame([(str(tmp_path / "a.bin"), str(tmp_path / "b.bin"))], "left string, right string")).first()
    assert [tuple(r) for r in row.regions] == [("Changed", size - 1, 1, size - 1, 1)]
