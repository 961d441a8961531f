"""Suffix dedup of texts in which sums modulo a power of two would agree: Thue-Morse words, Fibonacci words, periods and blocks of them."""

import hashlib
from collections import defaultdict

import pytest

from syncsift.llm import suffix_dedup


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def fibonacci(n):
    x, y = "a", "ab"
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


def restated(rows, length):
    held = defaultdict(int)
    for _, text in rows:
        raw = text.encode()
        for i in range(len(raw) - length + 1):
            held[raw[i : i + length]] += 1
    out = []
    for doc_id, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if held[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


TAIL = "".join(chr(33 + i * i % 89) for i in range(182))


@pytest.mark.parametrize("length", [1206, 400, 256])
def test_suffix_dedup(spark, length):
    rows = [
        (1, thue_morse(1024) + TAIL),
        (2, thue_morse(1024, "b", "a") + TAIL),
        (3, thue_morse(2048)[512:1600] + fibonacci(700)),
        (4, fibonacci(1500)),
        (5, "".join(thue_morse(64, x, y) for x, y in ("ab", "ba", "cd", "ba", "ab") * 4)),
        (6, "ab" * 400 + "ba" * 400),
        (7, thue_morse(1024, "\0", "\1") + TAIL),
        (8, thue_morse(1024, "\1", "\0") + TAIL),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.suffix_dedup(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == restated(rows, length)


def test_sql(spark):
    """The SQL and the operator on texts of every white space, repeated passages of words, repeats of bytes across characters."""
    import duckdb

    say = lambda n, k: " ".join(f"word{i * k % 97}" for i in range(n))
    rows = [(1, f" \t{say(120, 5)}"), (2, f"{say(120, 5)} \n\x0b"), (3, say(60, 7).replace(" ", "  ")), (4, say(60, 7).replace(" ", "\n")), (5, None), (6, ""), (7, "é" * 500), (8, "x" + "é" * 400 + " " + say(51, 11)), (9, say(51, 11)), (9, "ab" * 300), (None, "x" * 399)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(suffix_dedup.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("which", [0, 1])
def test_names_of_structured_strings_differ(which):
    np = suffix_dedup.np
    for n in (64, 256, 1024, 4096):
        texts = [thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, "a", "c"), fibonacci(n), "ab" * (n // 2), "ba" * (n // 2)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        names = suffix_dedup.Prefix(raw, which).of(np.arange(len(texts)) * n, n)
        assert len(set(names.tolist())) == len(texts)
        single = suffix_dedup.Prefix(raw, which, single=True).of(np.arange(len(texts)) * n, n) >> np.uint64(48)
        assert len(set(single.tolist())) == len(texts)
