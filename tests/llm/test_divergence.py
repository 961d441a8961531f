"""The divergence audit against its formula on all pairs and terms, by tiles and blocks of several sizes, and its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from syncsift.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def restated(rows, top=10):
    rows = [(i, *(x or "" for x in r)) for i, r in enumerate(rows)]
    out = []
    for lang in {r[2] for r in rows}:
        terms = [(source, TERM.findall(text.translate(LOWER))) for _, text, of, source in rows if of == lang]
        kept = {t for t, n in Counter(t for _, ts in terms for t in set(ts)).items() if n >= 10}
        counts = {s: Counter() for s, _ in terms}
        for s, ts in terms:
            counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = {o: sum(gap(p[s][t], p[o][t]) for t in kept) for o in counts if o != s}
            words = {t: gap(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("alpha", "Beta", "é", "日本", "ß", "x") for b in ("", "a", "é", "Z")]
    text = lambda: "".join(rng.choice(words[rng.randint(0, 8) :]) + rng.choice([" ", "1", "  ", "-", "\n", "'", "_", "\0", "\x7f", ". "]) for _ in range(rng.randint(0, 60)))
    some = [(text(), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "c", "d", "é", None, "", "z z"])) for _ in range(400)]
    some += [("hot hot words " * 20, "en", "hot")] * 150 + [("alpha " * 30_000, "fr", "a"), (None, "fr", "none"), ("", "xx", "a"), ("rare words only", "xx", "b"), ("1 2 3", "yy", "alone")]
    return some


def frame(spark, rows):
    return spark.createDataFrame([(i % 300, t, lang, s, 5, "q", 1.0) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, p double").repartition(5)


@pytest.mark.parametrize(("tile", "block"), [(512, 8 << 20), (3, 2000), (1, 1)])
def test_audit(spark, rows, tile, block):
    out = divergence.audit(frame(spark, rows), tile=tile, block_bytes=block)
    assert sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()) == restated(rows)


def test_empty(spark, rows):
    assert divergence.digest(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_sql(rows):
    rows = [(t and t.replace("\0", " "), lang, s) for t, lang, s in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (1, ?, ?, ?)", rows)
    assert sorted(con.sql(divergence.ORACLE).fetchall()) == restated(rows)
