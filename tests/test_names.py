import random
import re

import pytest
from pyspark.sql import functions as F

from syncsift.functions import names

CASES = {
    "minutes (conflicted copy).odt": "minutes.odt",
    "ledger-DESKTOP-Q7R8S9.ods": "ledger.ods",
    "harbour (1).png": "harbour.png",
    "harbour (2).png": "harbour.png",
    "notes.md~": "notes.md",
    "~$letter.rtf": "letter.rtf",
    "index.sb-0c1d2e.json": "index.json",
    "~$Minutes-DESKTOP-Q7R8S9 (conflicted copy).odt": "Minutes.odt",
    "minutes (conflicted copy)b.odt": "minutes (conflicted copy)b.odt",
    "ledger-LAPTOP-Q7R8S9.ods": "ledger-LAPTOP-Q7R8S9.ods",
    ".bashrc (1)": ".bashrc",
    "a.b (1)": "a.b (1)",
    "x.sb-AB.txt": "x.sb-AB.txt",
    "x.sb-ab": "x.sb-ab",
    "x~.docx": "x~.docx",
    "n-DESKTOP-12345.txt": "n-DESKTOP-12345.txt",
    "n-DESKTOP-123456.txt": "n.txt",
    "n-DESKTOP-123456789012.txt": "n.txt",
    "n-DESKTOP-1234567890123.txt": "n-DESKTOP-1234567890123.txt",
    " (1)": " (1)",
    "~": "~",
    "~$": "~$",
    "a\n (1).txt": "a\n.txt",
    "harbour (3).png": "harbour (3).png",
    "f (1) (2) (1).txt": "f.txt",
}


def restated(name):
    """The rules again, by string operations."""
    for _ in range(8):
        for rule in range(7):
            dot = name.rfind(".")
            stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            suffix = {0: " (conflicted copy)", 2: " (1)", 3: " (2)"}.get(rule)
            if suffix and stem.endswith(suffix) and len(stem) > len(suffix):
                name = stem.removesuffix(suffix) + ext
            elif rule == 1 and "-DESKTOP-" not in ext and (m := re.search(r"-DESKTOP-[0-9A-Za-z]{6,12}\Z", stem)) and m.start():
                name = stem[: m.start()] + ext
            elif rule == 4 and name.endswith("~") and len(name) > 1:
                name = name[:-1]
            elif rule == 5 and name.startswith("~$") and len(name) > 2:
                name = name[2:]
            elif rule == 6 and ext and not ext.startswith(".sb-") and (m := re.search(r"\.sb-[0-9a-f]{1,32}\Z", stem)) and m.start():
                name = stem[: m.start()] + ext
    return name


def test_normalize(spark):
    rng = random.Random(7)
    bits = ["a", "B.c", " (1)", " (2)", " (conflicted copy)", "-DESKTOP-ABC123", "-DESKTOP-abcdefghijklm", ".sb-ab12", ".sb-", "~", "~$", ".", ".txt", "\n", "é"]
    some = {"".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(3000)} | set(CASES)
    df = spark.createDataFrame([(x,) for x in some], "n string").select("n", names.normalize_base_name(F.col("n")).alias("b"))
    got = dict(df.collect())
    assert {k: got[k] for k in CASES} == CASES
    assert {k: v for k, v in got.items() if restated(k) != v} == {}


@pytest.mark.parametrize(
    ("name", "valid"),
    [("a/b.txt", True), ("a\\b", True), ("", False), (None, False), ("a//b", False), ("/a", False), ("a/..", False), ("./a", False), ("a.", False), ("a ", False), ("CON", False), ("x/con.txt", False), ("lpt9.a.b", False), ("console.txt", True), ("a\tb", False), ("a." + "x" * 255, True), ("a." + "x" * 256, False)],
)
def test_valid_names(spark, name, valid):
    row = spark.createDataFrame([(name,)], "n string").select(names.is_valid_name(F.col("n")).alias("v"), names.canonical_name(F.col("n")).alias("c")).first()
    assert row.v is valid
    if name and len(name) > 257:
        assert row.c == name[:257]
    else:
        assert row.c == (name.replace("\\", "/") if valid else None)


def test_paths_and_forms(spark):
    rows = [("/r/a/b.txt", 1536, 638_000_000_000_012_345), ("/root-evil/x", 1 << 30, 621_355_968_000_000_000), ("/r", 1023, 621_355_968_000_019_999)]
    df = spark.createDataFrame(rows, "p string, n long, t long")
    p = F.col("p")
    got = df.select(names.relative(p, "/r"), names.depth(p, "/r"), names.contained(p, "/r"), names.format_bytes(F.col("n")), names.format_ticks(F.col("t")), names.has_bidi(F.concat(p, F.lit("‮")))).collect()
    assert [tuple(r) for r in got] == [
        ("a/b.txt", 2, True, "1.5 KB", "2022-09-28T22:13:20.001Z", True),
        ("/root-evil/x", 0, False, "1 GB", "1970-01-01T00:00:00.000Z", True),
        ("/r", 0, True, "1023 B", "1970-01-01T00:00:00.001Z", True),
    ]
