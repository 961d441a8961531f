"""Operators on documents against plain restatements, with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncsift.llm import byte_bpe, licenses, line_dedup, packing, quality, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 string, score double, label int, a int"


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5, 3, 9) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta.", "épsilon", "zeta", "eta", "theta", "日本", "it's"]
    sentence = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    shared, line = sentence(90), "A Line That Many Documents Share, with more than forty characters"
    texts = [(i, sentence(rng.randint(1, 150))) for i in range(40)]
    texts += [(40 + i, f"{sentence(30)}\n {line.upper()} \n{shared}\n{sentence(20)}") for i in range(8)]
    texts += [(50 + i, texts[3][1]) for i in range(6)]  # exact copies
    texts += [(60 + i, texts[5][1] + f" {i}") for i in range(4)]  # near copies
    texts += [(70, None), (71, ""), (72, "   \n\t"), (73, "x"), (74, "a b"), (75, "é" * 700), (76, "ab" * 3000), (77, "\n".join([line] * 3)), (None, sentence(30)), (0, texts[0][1]), (78, "x " * 30_000)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).persist()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "x")]).where("doc_id < 0")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({ord(x): x.lower() for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_line_dedup(docs, texts, none):
    held = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    assert gone
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert Counter(map(tuple, line_dedup.digest(docs).collect())) == Counter(want)
    assert line_dedup.digest(none).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(texts, radius=4):
    """(doc_id, fingerprint, component) of each text, by comparing all pairs."""
    fps = [fingerprint(t) for _, t in texts]
    group = list(range(len(fps)))
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= radius and group[x] != group[y]:
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {g: min((texts[k][0] for k in range(len(fps)) if group[k] == g and texts[k][0] is not None), default=None) for g in group}
    return [(texts[k][0], f"{fps[k]:016x}", least[group[k]]) for k in range(len(fps))], group


def bridge():
    """Texts 1 and 2 are more than 4 bits apart, a text between them is within 4 bits of both."""
    rng = random.Random(2)
    base = [f"{rng.choice('abcdef')}{rng.randrange(999)}" for _ in range(400)]
    change = lambda at: [w if k not in at else f"z{k}" for k, w in enumerate(base)]
    for n in range(1, 60):
        a, b = range(0, 2 * n, 2), range(399, 399 - 2 * n, -2)
        one, two, mid = (" ".join(x) for x in (change(a), change(b), base))
        f = [fingerprint(x) for x in (one, two, mid)]
        if (f[0] ^ f[1]).bit_count() > 4 and max((f[0] ^ f[2]).bit_count(), (f[1] ^ f[2]).bit_count()) <= 4:
            return one, two, mid
    raise AssertionError("no such texts")


def test_simhash(spark, docs, texts, none):
    one, two, mid = bridge()
    lone = "of null ids " * 30
    texts = [*texts, (901, one), (None, mid), (902, two), (None, lone), (None, lone), (7, "another text of a repeated id " * 9)]
    want, group = linked(texts)
    assert [w[2] for w in want if w[0] in (901, 902)] == [901, 901]
    rows = frame(spark, texts)
    assert Counter(map(tuple, simhash.digest(rows).collect())) == Counter(want)
    assert simhash.digest(none).count() == 0
    clash = rows.withColumnsRenamed({"fp": "class", "a": "h", "k1": "place", "score": "keep_id"})
    kept = simhash.near_dedup(clash)
    assert kept.columns == clash.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min((w[0] for w, g in zip(want, group, strict=True) if g == own and w[0] is not None), default=None) for own in set(group))


def test_tree_links_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500, n)).astype(np.uint64), axis=1)
    fps = np.unique(np.concatenate([centre[rng.integers(0, 60, 1500)] ^ flips(3), rng.integers(0, 1 << 63, 800, dtype=np.uint64)]))
    want = simhash.Forest(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want.join(i, j)
    got = simhash.Forest(len(fps))
    for side in (0, 1):
        half = simhash._half(fps, side)
        tree = simhash.grow(half[::7], 4, rng)
        for _, rows, home in simhash.route(tree, half, np.arange(len(fps)), np.ones(len(fps), bool), 2):
            own = simhash.Forest(len(rows))
            simhash.links(fps[rows], home, side, 4, own)
            root = own.find(np.arange(len(rows)))
            got.join(rows, rows[root])
    assert (got.find(np.arange(len(fps))) == want.find(np.arange(len(fps)))).all()


def windows(raw, n=51):
    """(start, end, words) of each window of words."""
    w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    return [(w[k][0], w[k + n - 1][1], b" ".join(raw[a:b] for a, b in w[k : k + n])) for k in range(len(w) - n + 1)]


def runs(gone):
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def repeated(raws):
    """For each text which bytes repeated strings of 400 bytes cover, and which repeated windows of 51 words."""
    seen = Counter(b[k : k + 400] for b in raws for k in range(len(b) - 399))
    said = Counter(w for b in raws for _, _, w in windows(b))
    out = []
    for b in raws:
        gone, told = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        for x, y, w in windows(b):
            if said[w] > 1:
                told[x:y] = True
        out.append((gone, told))
    return out


def test_suffix_dedup(spark, docs, texts, none):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["oak", "öl", "elm"]) + str(rng.randrange(99)) for _ in range(n))
    passage, short = say(52), say(50)
    more = [(100, f"{say(20)} {passage} {say(9)}"), (101, f"{passage.replace(' ', chr(10))}"), (102, f"{short} {say(30)}"), (103, f"{say(5)} {short}"), (104, say(90))]
    texts = [*texts, *more]
    raw = [(i, (t or "").encode()) for i, t in texts]
    want = []
    for (i, b), (gone, told) in zip(raw, repeated([b for _, b in raw]), strict=True):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), runs(gone), hashlib.sha256(kept).hexdigest(), int(told.sum()), runs(told)))
    assert sum(w[2] for w in want) and [w[5] > 0 for w in want[-5:]] == [True, True, False, False, False]
    assert Counter(map(tuple, suffix_dedup.digest(frame(spark, texts)).collect())) == Counter(want)
    assert suffix_dedup.digest(none).count() == 0


def test_without_repeats(spark, none):
    same, tail = "é" * 300, "x" * 450
    rows = [(1, f"{same} one"), (2, f"{same} two"), (3, same), (4, None), (5, ""), (6, " \n"), (7, f"a{tail}"), (8, f"{tail}b"), (9, tail), (None, tail)]
    docs = frame(spark, rows).withColumnsRenamed({"k1": "spans", "fp": "s1", "a": "k2"})
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "one"), (2, "two"), (4, None), (5, ""), (6, " \n"), (7, "a"), (8, "b")]
    assert suffix_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("width", [3, 900])
def test_word_segments_of_a_long_text(monkeypatch, width):
    rng = random.Random(1)
    text = "".join(rng.choices(["a", "bc", "d" * width, " ", "\n ", "é"], k=4000)).encode()
    want = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    batch = pa.RecordBatch.from_pydict({"text": [text.decode()]})
    got, names = [], {}
    for seg in suffix_dedup.word_parts(51)([batch], 0):
        raw, base, ws, we, place, heads = seg[0], int(seg[2][0]), seg[6], seg[7], seg[9], seg[10]
        got += [(base + int(a), base + int(b)) for a, b in zip(ws[:heads], we[:heads], strict=True)]
        assert place[:heads].tolist() == list(range(len(got) - heads, len(got)))
        at, a, b, *_ = suffix_dedup.word_cover(51)(seg, 0)
        names |= {base + int(x): (int(p), int(q)) for x, p, q in zip(at, a, b, strict=True)}
    assert got == want
    monkeypatch.undo()
    whole = next(suffix_dedup.word_parts(51)([pa.RecordBatch.from_pydict({"text": [text.decode(), ""]})], 0))
    at, a, b, *_ = suffix_dedup.word_cover(51)(whole, 0)
    assert names == {int(x): (int(p), int(q)) for x, p, q in zip(at, a, b, strict=True)}


def test_suffix_segments_of_a_long_text(monkeypatch, docs, texts):
    assert len({(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == suffix_dedup.PERIOD
    monkeypatch.setattr(suffix_dedup, "SEGMENT", suffix_dedup.PERIOD * 11)
    import pyarrow as pa

    text = "".join(random.Random(1).choices("abc", k=9000))
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    whole = suffix_dedup.Prefix(np.frombuffer(text.encode(), np.uint8), 0)
    places = []
    for seg in suffix_dedup.segments([batch], 400):
        at, a, b, _, _ = suffix_dedup.cover_positions(seg, 400)
        at = at + seg[2][0]
        places += at.tolist()
        assert (a == whole.of(at, 218)).all()
        assert all((y == 0) == (x + 400 > 9000) for x, y in zip(at.tolist(), b.tolist(), strict=True))
    assert places == [x for x in range(9000 - 217) if x % suffix_dedup.PERIOD in suffix_dedup.COVER]


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, len(ids), ids.tobytes()] += 1
    rows = packing.pack(docs).toPandas()
    assert int(rows.length.sum()) == sum(n * k for (_, n, _), k in want.items())
    assert not rows.duplicated(["sequence_id", "offset"]).any()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all()
        total = int(s.length.sum())
        assert total <= 2048 and total & (total - 1) == 0 and (s.tier == total).all()
    single = rows[rows.doc_id.notna()]
    for (i, n, ids), k in want.items():
        if k == 1 and i not in (None, 0):
            own, at = single[single.doc_id == i].sort_values("start"), 0
            for r in own.itertuples():
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, n, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
                at += r.length
            assert at == n
    assert packing.pack(none).count() == 0


def test_packing_fills_several_tiers():
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 300), rng.randint(200, 3000)]) for _ in range(3000)] + [1] * 100
    packer = packing.Packer(2048, 256, 7 << 40, 1 << 16, 8 * 2048)
    batches = []
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i % 500, "<u4").tobytes())
        batches.append(packer.taken())
    packer.finish()
    rows = pa.Table.from_batches([b for b in [*batches, packer.taken()] if b is not None]).to_pandas()
    assert rows.groupby("doc_id").length.sum().tolist() == sizes
    totals = rows.groupby("sequence_id").agg(total=("length", "sum"), tier=("tier", "first"), group=("step_group", "first"))
    assert (totals.total == totals.tier).all() and totals.tier.map(lambda x: x & (x - 1) == 0).all()
    assert all((totals.tier == t).sum() > 5 for t in (256, 512, 1024, 2048)) and (totals.tier < 256).sum() <= 8
    groups = totals.groupby("group")
    assert (groups.tier.nunique() == 1).all() and (groups.total.sum() <= 8 * 2048).all()
    few = packing.Packer(2048, 256, 0, 1 << 16, 8 * 2048)
    for i in range(100):  # less than a sequence of any tier: powers of two
        few.add(i, packing.END)
    few.finish()
    assert sorted(few.taken().to_pandas().groupby("sequence_id").length.sum()) == [4, 32, 64]


def test_chunks_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    rng, path = random.Random(2), packing.default_tokenizer()
    alphabet = "aAbZé ß.,!'̱́  \t\nHh<|endoftext|>Σς»’日1²_-İſK\x00\x1f%$"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b <|ENDOFTEXT|>, x's it's. 's,"]
    texts += ["".join(rng.choices("abcdefXÉß'st.,-–“”12 ", k=30)) for _ in range(2000)]
    ids, tokenizer = packing.ChunkIds(path, most=500), Tokenizer.from_file(path)
    for t, got in zip(texts, ids.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def bpe_reference():
    import base64

    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, bpe_reference, none):
    rng = random.Random(4)
    texts = [(0, None), (1, ""), (2, "It's 12,5 €  \n\n x"), (3, "日本語のテキスト ßẞ"), (4, "a" * 900 + "=" * 700), (5, "".join(rng.choices("abcdeth", k=600))), (None, "x y"), (2, "again  z")]
    want = Counter()
    for i, t in texts:
        ids = bpe_reference.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.digest(frame(spark, texts).coalesce(1)).collect())) == want
    assert byte_bpe.digest(none).count() == 0
    few = byte_bpe.encode(frame(spark, texts).coalesce(1), held_words=2, piece_bytes=8).withColumn("decoded", byte_bpe.decoded(F.col("ids")))  # a task begins anew after a few rows
    got = Counter((r.doc_id, len(r.ids), hashlib.sha256(r.ids_bytes).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in few.collect())
    assert got == want


@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_byte_bpe_of_any_text(spark, bpe_reference, texts):
    rows = {r.doc_id: r for r in byte_bpe.encode(frame(spark, list(enumerate(texts)))).withColumn("decoded", byte_bpe.decoded(F.col("ids"))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == bpe_reference.encode_ordinary(t)
        assert rows[i].decoded == t.encode()


def plain_words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def runs_of(words, n):
    return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_license_scan(spark, docs, none):
    """Against every window of every template's class, and every place of a short template."""
    notices = dict(licenses.TEMPLATES)
    words = notices["MIT-text"].split()
    broken = " ".join(words[:20] + ["other"] + words[21:])
    full = notices["BSD-3-Clause-full"]
    texts = [(1, f"{'pad word ' * 50}{notices['MIT-text']}{' more text' * 40}"), (2, f"x y {broken} z"), (3, "Released under the MIT License."), (4, " ".join(words[:10])), (5, None), (6, "licensed UNDER cc by-nc 4.0")]
    texts += [(None, "Released under the MIT license"), (7, f"{'so it goes ' * 70}\n{full.replace(' ', chr(10))}\n{'the end ' * 33}"), (8, "spdx license identifier: mit"), (9, "SPDX-License-Identifier: Apache"), (10, ""), (3, "SPDX-License-Identifier: MIT, SPDX-License-Identifier: MIT")]
    got = sorted(((r.doc_id or -1, r.license, round(r.containment, 9)) for r in licenses.license_scan(frame(spark, texts)).collect()))
    want = []
    for i, t in texts:
        found = plain_words(t)
        for name, notice in licenses.TEMPLATES:
            n = min(5, len(plain_words(notice)))
            wanted = runs_of(plain_words(notice), n)
            size = max(4, 1 << (len(wanted) - 1).bit_length())
            step = 1 if n < 5 else size // 2
            best = max((len(wanted & runs_of(found[a : a + (n if n < 5 else 3 * size // 2 + 4)], n)) / len(wanted) for a in range(0, max(1, len(found)), step)), default=0)
            if best >= 0.8:
                want.append((i or -1, name, round(best, 9)))
    assert got == sorted(want)
    assert {(1, "MIT-text"), (2, "MIT-text"), (3, "MIT"), (6, "CC-BY-NC-4.0"), (7, "BSD-3-Clause-full"), (8, "SPDX-MIT"), (3, "SPDX-MIT")} <= {g[:2] for g in got}
    assert licenses.license_scan(none).count() == 0
    table = spark.createDataFrame([("own", "the one and only own license text"), ("two", "own license"), (None, "x"), ("y", None)], "name string, text string")
    found = licenses.license_scan(frame(spark, [(1, "see THE one and only own license text here"), (2, "license own"), (3, "own license")]), table)
    assert sorted((r.doc_id, r.license, r.first_word) for r in found.collect()) == [(1, "own", 0), (1, "two", 5), (3, "two", 0)]
    for bad in (lambda: licenses.Scanner((("none", "--"),), 4, 0.8), lambda: licenses.license_scan(docs, table, most_templates=1)):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = ["the", "tree", "river", "of", "stone", "light", "over", "a", "house", "walks"]
    rows, labels = [], []
    for i in range(900):
        good, toxic = rng.random() < 0.75, rng.random() < 0.2
        toxic = toxic and good  # the junk below keeps few words
        text = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 80))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vileword", "grimeslur", "foulname"]) + rng.choice(["", "ly", "ness"])
            text[rng.randrange(len(text))] = rng.choice(["vileword", "grimeslur", "foulname"])
        body = " ".join(text) if good else "!! ".join(x.upper() for x in text[:6] * 9)
        rows.append((i, body))
        labels.append((i, int(good), int(toxic), "clash"))
    rows += [(2000, None), (2001, ""), (None, "tree"), (5, "tree of light")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, labelled, module, target):
    docs, labels = labelled
    rows = module.classify(docs, labels).toPandas()
    assert len(rows) == 904 and rows.score.between(0, 1).all()
    assert (rows.held_out[rows.doc_id.notna()] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in rows.doc_id.dropna()]).all()
    held = rows[rows.held_out == True].merge(labels.select("doc_id", target).toPandas(), on="doc_id").drop_duplicates("doc_id")  # noqa: E712
    assert (held.predicted == held[target]).mean() > 0.95
    # Labels of the held-out fold change nothing, nor do lang and source.
    turned = labels.withColumn(target, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col(target)).otherwise(F.col(target)))
    again = module.classify(docs.withColumn("lang", F.lit("zz")), turned).toPandas()
    order = ["doc_id", "score"]
    assert again.sort_values(order).score.round(9).tolist() == rows.sort_values(order).score.round(9).tolist()
    empty = module.classify(docs.where("doc_id < 0"), labels)
    assert empty.count() == 0
    assert module.classify(docs.limit(3), labels.where("false")).count() == 3
