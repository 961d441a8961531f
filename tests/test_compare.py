import random

import pytest
from pyspark.sql import functions as F

from syncsift.operators import compare as c


def test_line_regions_partition_and_are_longest():
    rng = random.Random(42)
    left = [f"L{rng.randint(0, 120):04d}" for _ in range(400)]
    right = [x if rng.random() > 0.25 else f"M{rng.randint(0, 50)}" for x in left]
    right[100:100] = ["new", "newer"]
    del right[300]
    r = c.regions(left, right)
    assert sum(x[2] for x in r) == 400 and sum(x[4] for x in r) == len(right)
    at = (0, 0)
    for kind, i, n, j, m in r:
        assert (i, j) == at
        at = (i + n, j + m)
        if kind == c.EQUAL:
            assert left[i : i + n] == right[j : j + m]
    row = [0] * (len(right) + 1)
    for x in left:
        old = row[:]
        for k, y in enumerate(right):
            row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
    assert sum(x[2] for x in r if x[0] == c.EQUAL) == row[-1]


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("", "", []),
        ("a\r\nb\r\n", "﻿a\nb", [("Equal", 0, 2, 0, 2)]),
        ("", "x", [("Added", 0, 0, 0, 1)]),
        ("a\nb\nc", "a\nx\ny\nc", [("Equal", 0, 1, 0, 1), ("Changed", 1, 1, 1, 1), ("Added", 2, 0, 2, 1), ("Equal", 2, 1, 3, 1)]),
        ("a\nb", "a ", [("Changed", 0, 1, 0, 1), ("Removed", 1, 1, 1, 0)]),
        ("x\nk", "k\nk", [("Removed", 0, 1, 0, 0), ("Equal", 1, 1, 0, 1), ("Added", 2, 0, 1, 1)]),
    ],
)
def test_text(left, right, want):
    assert c.regions(c.lines_of(left), c.lines_of(right)) == want


def test_csv():
    f = lambda a, b: c.csv_regions(c.lines_of(a), c.lines_of(b))
    assert f('a,b\n1,"x"', "a,b\n1,x") == [("Equal", 0, 1, 0, 1), ("Equal", 1, 1, 1, 1)]
    assert f('a,"b,""c"', 'a,"b,""d"') == [("Changed", 0, 1, 0, 1)]
    assert f("a;b\n", "a,b\n") == [("Changed", 0, 1, 0, 1)]
    assert c.delimiter(["", 'x;y;"1,2,3,4"']) == ";" and c.delimiter(["plain"]) == ","
    assert c.cells('a"b,"c ""d"",e",', ",") == ['a"b', 'c "d",e', ""]


def test_markdown():
    f = lambda a, b: c.markdown_regions(c.lines_of(a), c.lines_of(b))
    assert f("x\n# A", "x") == [("Equal", 0, 1, 0, 1), ("Changed", 1, 1, 1, 0)]
    assert f("```\n# A\n```", "```\n```")[1][0] == "Removed"
    assert f("#A\n", "")[0][0] == "Removed" and f("###### A", "")[0][0] == "Changed" and f("####### A", "")[0][0] == "Removed"


def test_columns(spark):
    rows = [("a.MD", "x\ny", "x\nz", b"abc", b"abd"), ("a.log", "x", "x", b"same", b"same"), ("b.csv", "a", "a", b"ab", b"abcd"), ("dir.x/noext", "", "", b"\x00" * 70_000 + b"zz", b"\x00" * 70_000)]
    df = spark.createDataFrame(rows, "p string, a string, b string, x binary, y binary").withColumn("kind", c.comparator(F.col("p")))
    got = df.select("kind", F.when(F.col("kind") != "binary", c.line_regions(F.when(F.col("kind") == "binary", "text").otherwise(F.col("kind")), F.col("a"), F.col("b"))).alias("r"), c.binary_region(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r.kind for r in got] == ["markdown", "text", "csv", "binary"]
    assert [len(r.r) if r.r is not None else None for r in got] == [2, 1, 1, None]
    assert [tuple(r.s) if r.s else None for r in got] == [("Changed", 2, 1, 2, 1), None, ("Added", 2, 0, 2, 2), ("Removed", 70_000, 2, 70_000, 0)]


def test_contents_in_utf16(spark):
    one, two = "a\nb\nü", "a\r\nc\r\nü"
    rows = [(bytearray(one.encode("utf-16")), bytearray(two.encode())), (None, bytearray(b"")), (bytearray(b"\xef\xbb\xbfa"), bytearray(b"a\n"))]
    df = spark.createDataFrame(rows, "a binary, b binary")
    got = [[tuple(x) for x in r.r] for r in df.select(c.content_regions(F.lit("text"), F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [[("Equal", 0, 1, 0, 1), ("Changed", 1, 1, 1, 1), ("Equal", 2, 1, 2, 1)], [], [("Equal", 0, 1, 0, 1)]]
