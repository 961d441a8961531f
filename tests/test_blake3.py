"""BLAKE3 of many contents at once: side by side, and equal to each alone."""

import random

import pandas as pd

from syncsift.functions import hashing

KNOWN = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
         1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}


def test_small_contents_are_compressed_side_by_side(monkeypatch):
    rng, calls, compressed = random.Random(2), [], hashing._compressed
    monkeypatch.setattr(hashing, "_compressed", lambda cv, *rest: calls.append(cv.shape[1]) or compressed(cv, *rest))
    contents = [rng.randbytes(rng.randrange(5000)) for _ in range(600)]
    got = hashing.blake3_of.func(pd.Series([None, *contents]))
    assert got[0] is None and len(calls) < 60  # 600 contents, one by one, take over 10,000
    starts = [list(range(0, max(1, len(x)), 4096)) for x in contents]
    pieces = [(x[a : a + 4096], a, len(s) == 1) for x, s in zip(contents, starts, strict=True) for a in s]
    calls.clear()
    nodes = iter(hashing.node_of.func(*(pd.Series(x) for x in zip(*pieces, strict=True))))
    files = [[next(nodes) for _ in s] for s in starts]
    assert list(hashing.root_of.func(pd.Series([None, *files]))) == [None, *got[1:]] and len(calls) < 60
    assert [hashing.blake3(x) for x in contents[:40]] == list(got[1:41])


def test_contents_of_every_size_in_one_batch():
    pattern = bytes(i % 251 for i in range(3 * hashing.PIECE))
    sizes = [*KNOWN, 63, 64, 65, 2048, 2049, 3073, 7168, hashing.PIECE, hashing.PIECE + 1, 3 * hashing.PIECE] * 2
    got = hashing.nodes_of([pattern[:n] for n in sizes], [0] * len(sizes), [True] * len(sizes))
    assert all(got[sizes.index(n)].hex() == known for n, known in KNOWN.items())
    for n, node in zip(sizes, got, strict=True):
        h = hashing.Blake3()
        for at in range(0, n, 1000):
            h.update(pattern[at : min(at + 1000, n)])
        assert h.node() == node
    assert hashing.nodes_of([], [], []) == [] and hashing.blake3_roots([]) == []
