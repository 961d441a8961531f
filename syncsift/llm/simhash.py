"""SimHash near-dedup with vantage-point trees over the Hamming distance.

Fingerprint: A-Z are lower-cased, words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, a shingle is ``words`` words
joined by one space (a shorter text is one shingle, a text without words has the fingerprint 0), h is XXH64 with seed
42, and a bit is 1 if it is set in over half of the h, repeats included. Documents link at ``radius`` or fewer
differing bits; a component is everything reachable by links.

Equal fingerprints are grouped first, so copies never meet each other in pairs: all later work is on distinct
fingerprints. If two of them differ in at most ``radius`` bits then in one 32-bit half they differ in at most
``radius // 2``. For each half a vantage-point tree is grown from a bounded sample (``sample`` fingerprints, at the
driver): an inner node has a vantage point and the median of the Hamming distances to it. Its leaves are the shards.
A fingerprint lives in one shard and visits each other shard that the triangle bound leaves open: the near side if
``d - r <= median``, the far side if ``d + r > median``. Inside a shard the same pruning goes on down to small blocks,
whose pairs are compared by all 64 bits. When everything in a block is within ``radius / 2`` of the vantage point, the
triangle inequality links it without a comparison. A shard returns one row for each linked fingerprint, pointing at the
smallest one that it reaches inside the shard, never all pairs; a distributed connected-components step joins shards.
The number of tree levels grows with the number of distinct fingerprints, from a count.

Defined results: null text is empty text; empty texts share the fingerprint 0 and so one component; a row with a null
doc_id links like any other, and its component is named by the smallest doc_id reachable, or null if there is none; rows
that repeat a doc_id are documents of their own (they link by their fingerprints, not by the doc_id); an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncsift.llm.common import SALTS, binary_of, by_key, components, dealt, dropped, only, released, slices, written

SEED = 42
SMALL = 1 << 18  # pairs that a block compares at once


def fingerprint(text: bytes, words: int = 4) -> int:
    """The fingerprint of one text; a chunk of shingles at a time, so that a very long text needs bounded memory."""
    import xxhash

    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)  # of one hash, every set bit is in over half
    total, ones = n - words + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, total, 1 << 16):
        b = min(a + (1 << 16), total)
        some = parts[a : b + words - 1]
        joined = b" ".join(some)
        size = np.fromiter(map(len, some), np.int64, len(some)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[: b - a].tolist()
        stops = (ends - 1)[words - 1 :].tolist()
        hashes = np.array([digest(joined[x:y], SEED) for x, y in zip(starts, stops, strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long, h long): the fingerprint's 64 bits as a signed long, and a hash of the text."""

    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            raw, at = binary_of(batch.column("text"))
            data, at = raw.tobytes(), at.tolist()
            found = np.array([fingerprint(data[a:b], words) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("h")], ["doc_id", "fp", "h"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(released(run), "doc_id long, fp long, h long")


# ---- the tree


def _half(fps: np.ndarray, side: int) -> np.ndarray:
    return ((fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def grow(half: np.ndarray, levels: int, rng: np.random.Generator) -> dict | None:
    """A vantage-point tree over sampled halves; None is a leaf. The vantage point is, of a few, that with the widest spread of distances."""
    if levels == 0 or len(half) < 4:
        return None
    some = rng.choice(half, min(16, len(half)), replace=False)
    spread = [float(np.std(np.bitwise_count(half ^ x))) for x in some]
    point = some[int(np.argmax(spread))]
    d = np.bitwise_count(half ^ point)
    median = int(np.median(d))
    if not (d <= median).any() or not (d > median).any():
        return None
    return {"p": int(point), "m": median, "near": grow(half[d <= median], levels - 1, rng), "far": grow(half[d > median], levels - 1, rng)}


def route(tree: dict | None, half: np.ndarray, rows: np.ndarray, home: np.ndarray, radius: int, path: int = 1) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(leaf, rows, is home)]: the shards that each row lives in or visits."""
    if not len(rows):
        return []
    if tree is None:
        return [(path, rows, home)]
    d = np.bitwise_count(half[rows] ^ np.uint32(tree["p"])).astype(np.int64)
    near, far = d - radius <= tree["m"], d + radius > tree["m"]
    inside = d <= tree["m"]
    return route(tree["near"], half, rows[near], (home & inside)[near], radius, 2 * path) + route(tree["far"], half, rows[far], (home & ~inside)[far], radius, 2 * path + 1)


# ---- links inside a shard


class Forest:
    """Union-find over 0..n-1 in arrays; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            keep = a != b
            a, b = a[keep], b[keep]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y


def links(fps: np.ndarray, home: np.ndarray, side: int, radius: int, forest: Forest) -> None:
    """Join in ``forest`` all pairs of a home fingerprint and any other of ``fps`` at ``radius`` or fewer differing bits."""
    half, r = _half(fps, side), radius // 2
    rng = np.random.default_rng(1)
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        mine, all_ = stack.pop()
        if not len(mine) or not len(all_):
            continue
        point = mine[int(rng.integers(len(mine)))]
        if len(mine) * len(all_) > SMALL:
            full = np.bitwise_count(fps[all_] ^ fps[point])
            core = all_[full <= radius // 2]
            if len(core) > 64:  # any two of these are within the radius, by the triangle inequality
                forest.join(core, np.full(len(core), point))
                rest = np.setdiff1d(mine, core, assume_unique=True)
                stack.append((rest, all_))
                out = np.setdiff1d(all_, core, assume_unique=True)
                _compare(fps, np.intersect1d(mine, core, assume_unique=True), out[np.bitwise_count(fps[out] ^ fps[point]) <= radius + radius // 2], radius, forest)
                continue
            d, e = np.bitwise_count(half[mine] ^ half[point]).astype(np.int64), np.bitwise_count(half[all_] ^ half[point]).astype(np.int64)
            m = int(np.median(d))
            if (d > m).any():
                stack.append((mine[d <= m], all_[e - r <= m]))
                stack.append((mine[d > m], all_[e + r > m]))
                continue
        _compare(fps, mine, all_, radius, forest)


def _compare(fps: np.ndarray, mine: np.ndarray, all_: np.ndarray, radius: int, forest: Forest) -> None:
    if not len(all_):
        return
    step = max(1, SMALL // len(all_))
    for a in range(0, len(mine), step):
        i, j = np.nonzero(np.bitwise_count(fps[mine[a : a + step], None] ^ fps[None, all_]) <= radius)
        if len(i):
            forest.join(mine[a + i], all_[j])


def near_links(distinct: DataFrame, radius: int = 4, sample: int = 1 << 13, most_sample: int = 1 << 16) -> DataFrame:
    """(a, b): pairs of the fingerprints in ``distinct`` (fp), a chain of links for each shard's components.

    The sample that trees grow from has ``sample`` fingerprints, more for very many of them, at most ``most_sample``.
    """
    n = distinct.count()
    levels = max(2, math.ceil(math.log(max(n, 4) / 64, 4))) if n > 64 else 0
    rng = np.random.default_rng(11)
    picked = distinct.orderBy(F.xxhash64("fp", F.lit(1))).limit(min(most_sample, max(sample, n >> 12))).select("fp").collect() if levels else []
    fps = np.array([r.fp for r in picked], np.int64).view(np.uint64)
    trees = [grow(_half(fps, side), levels, rng) for side in (0, 1)]
    r = radius // 2

    def send(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for side in (0, 1):
                for leaf, rows, home in route(trees[side], _half(fp.view(np.uint64), side), np.arange(len(fp)), np.ones(len(fp), bool), r):
                    if len(rows):
                        shard = np.full(len(rows), side << 40 | leaf, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, fp[rows], home)], ["shard", "fp", "home"])

    def search(batches):
        def done(key, held):
            fp, home = (np.concatenate([h[i] for h in held]) for i in range(2))
            forest = Forest(len(fp))
            links(fp.view(np.uint64), home, key[0] >> 40, radius, forest)
            root = forest.find(np.arange(len(fp)))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

        held, at = [], None
        for key, first, piece in by_key(batches, ("shard",)):
            if first and held:
                yield done(at, held)
                held = []
            at = key
            held.append((piece.column("fp").to_numpy(), piece.column("home").to_numpy(zero_copy_only=False)))
        if held:
            yield done(at, held)

    sent = distinct.select("fp").mapInArrow(released(send), "shard long, fp long, home boolean")
    return dealt(sent, ["shard"]).mapInArrow(released(search), "a long, b long")


def classes(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, h long, class long, component_id long) for every row of ``docs``.

    class is the smallest fingerprint reachable, component_id the smallest doc_id; h is a hash of the text.
    """
    fps = written(fingerprints(docs, words))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(near_links(distinct, radius))
    own = distinct.join(labels.hint("merge"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("key"), F.coalesce("label", "fp").alias("class"), "least")
    own = written(own)
    for table in (distinct, labels):
        dropped(table)
    names = own.groupBy("class").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.select("key", "class", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))  # a large component is no single task's
    class_of = written(salted.join(names.hint("merge"), ["class", "salt"]).select("key", "class", "component_id"))
    dropped(own)
    return fps.join(class_of.hint("merge"), F.col("fp") == F.col("key"), "left").select("doc_id", "fp", "h", "class", "component_id")


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with its columns: that with the smallest doc_id, then the smallest hash of its text.

    A row with a null doc_id stays only if its component has no other.
    """
    columns = docs.columns
    named = docs.toDF(*(f"c{i}_{x}" for i, x in enumerate(columns)))  # whatever the columns' names, keys don't clash
    text, doc_id = (F.col(f"c{columns.index(x)}_{x}") for x in ("text", "doc_id"))
    best = classes(docs, words, radius).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m"))
    keep = written(best.select(F.col("m.doc_id").alias("keep_id"), F.col("m.h").alias("keep_h")))
    kept = named.join(keep.hint("merge"), doc_id.cast("long").eqNullSafe(F.col("keep_id")) & (F.xxhash64(text) == F.col("keep_h")))
    first = Window.partitionBy("keep_id", "keep_h").orderBy(*(F.col(c) for c in named.columns if c != f"c{columns.index('text')}_text"))
    return kept.withColumn("place", F.row_number().over(first)).where("place = 1").select(*named.columns).toDF(*columns)


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
