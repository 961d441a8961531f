"""Approximate nearest neighbours by cosine with shifted space-filling curves.

Equal vectors are grouped first: a group is one point of the index with its k + 1 smallest rows, since further copies
can't be in any result. Each of ``curves`` Hilbert curves orders all points by the key of their unit vectors, projected to
``dims`` random orthonormal directions, shifted at random and quantised to ``bits`` bits (the spread of each direction
comes from a bounded sample). The keys of a curve are cut into ``ranges`` of equal counts; some neighbouring ranges are a tile,
and a tile is cut into blocks of ``block_rows`` points, by its own count: a dense ball of points whose keys are equal is one range,
and many blocks. A query looks at its own tile and the neighbouring tiles at either
side; exact cosines rerank what it meets, and the tops of all curves and blocks merge.

How many neighbouring ranges is measured, not set: for ``probes`` points of the sample the true neighbours among all points are
found (one pass over the points), and the smallest window that holds a share of ``want`` of them on some curve is taken; a
tile is about a third of it. So
vectors with structure, whose neighbours lie close on a curve, cost a small share of the points; vectors without any (as in the
test data, where the fifth neighbour's cosine is the tail of random ones) leave no index a small candidate set, and their
window is a large share. Lengths of no more points than there are ranges (``whole_rows``) are one range. tests/llm measure the
recall against brute force.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a
null id; a vector is compared with those of its own length; rows that repeat an id are rows of their own (each is a candidate
of the other and, if its id is asked for, a query); cosines are computed in extended precision and rounded to double, so that
parallel vectors tie; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives none; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncsift.llm.common import by_key, by_length, released, vector_rows, written


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of non-negative integers below 2^bits, as a long of dims * bits bits.

    From the top bit down, a row's orthant is turned into the curve's frame (reflection and exchange of axes), then
    the transposed bits are Gray-decoded.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for d in range(dims):
            upper = (x[d] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(upper, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def grouped(rows: DataFrame, keep: int) -> DataFrame:
    """(pid, v, ids): equal vectors with their ``keep`` first (id, rid); a common vector leaves its task as ``keep`` rows."""
    even = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    keyed = even.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v"), "salt": F.pmod(F.xxhash64(F.shiftright("rid", 33)), F.lit(32))})
    for by in (("h", "g", "salt"), ("h", "g")):
        first = Window.partitionBy(*by).orderBy("id", "rid")
        keyed = keyed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).drop("place")
    points = keyed.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("id", "rid"))).alias("ids"))
    return points.select(F.col("ids")[0]["rid"].alias("pid"), "v", "ids")


class Curves:
    """The curves of one length of vectors."""

    def __init__(self, width: int, sample: np.ndarray | None, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng([seed, width])
        self.dims, self.bits, self.axes, self.shift = min(dims, width), bits, [], []
        for _ in range(curves):
            q, _ = np.linalg.qr(rng.normal(size=(width, self.dims)))
            y = sample @ q
            spread = np.maximum(y.std(axis=0), 1e-9)
            self.axes.append(q / spread)
            self.shift.append(rng.uniform(0, 1, self.dims) - y.mean(axis=0) / spread)

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        return [hilbert_keys(np.clip(((unit @ a + s + 4) * (top / 9)).astype(np.int64), 0, top), self.bits) for a, s in zip(self.axes, self.shift, strict=True)]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosines of one vector with others, rounded to double."""
    x, rows = x.astype(np.longdouble), rows.astype(np.longdouble)
    return ((rows * x).sum(axis=1) / np.sqrt((x * x).sum() * (rows * rows).sum(axis=1))).astype(np.float64)


class Ranges:
    """Where points lie: lengths without curves are one range each."""

    def __init__(self, index: dict[int, Curves], cuts: dict[tuple[int, int], np.ndarray]):
        self.index, self.cuts = index, cuts

    def of(self, n: int, unit: np.ndarray) -> np.ndarray:
        """The range of each row on each curve."""
        if n not in self.index:
            return np.zeros((1, len(unit)), np.int64)
        return np.stack([np.searchsorted(self.cuts[n, c], key, side="right") for c, key in enumerate(self.index[n].keys(unit))])


def fitted(points: DataFrame, curves: int, dims: int, bits: int, ranges: int, whole_rows: int, sample: int, seed: int) -> tuple[Ranges, dict[int, int], dict[int, np.ndarray]]:
    """The ranges, the points of each length that has curves, and a bounded sample of unit vectors of these lengths."""
    counts = points.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("points"))
    large = {r["n"]: r["points"] for r in counts.where(F.col("points") > whole_rows).collect()}  # so no more than points / whole_rows
    mine = points.where(F.size("v").isin(list(large))) if large else points.where("false")
    picked = mine.select("pid", "v").orderBy(F.xxhash64("pid"), "pid").limit(sample).collect() if large else []
    some: dict[int, list] = {n: [] for n in large}
    for r in picked:
        some[len(r["v"])].append(r["v"])
    units = {n: _unit(np.array(v)) if v else np.zeros((0, n)) for n, v in some.items()}
    plain = lambda n: np.concatenate([np.eye(n), -np.eye(n)])  # noqa: E731  a length that the sample misses
    index = {n: Curves(n, units[n] if len(units[n]) > 1 else plain(n), curves, dims, bits, seed) for n in large}

    def keys(batches):
        for b in batches:
            for n, _, v in by_length(b.column("v")):
                found = index[n].keys(_unit(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(curves * len(v), n, np.int32)), pa.array(np.repeat(np.arange(curves, dtype=np.int32), len(v))), pa.array(np.concatenate(found))], ["n", "curve", "key"])

    cut = F.percentile_approx("key", [i / ranges for i in range(1, ranges)], F.lit(50 * ranges))
    got = mine.select("v").mapInArrow(released(keys), "n int, curve int, key long").groupBy("n", "curve").agg(cut.alias("cut")).collect() if large else []
    return Ranges(index, {(r["n"], r["curve"]): np.array(r["cut"]) for r in got}), large, units


def measured_window(points: DataFrame, placed: Ranges, units: dict[int, np.ndarray], k: int, probes: int, want: float) -> int:
    """The least number of neighbouring ranges at either side that holds a share of ``want`` of the true neighbours of some sampled points."""
    units = {n: u[:probes] for n, u in units.items() if len(u)}
    at = {n: placed.of(n, u) for n, u in units.items()}

    def nearest(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for n, _, v in by_length(b.column("v")):
                if n not in units:
                    continue
                for a in range(0, len(v), 4096):
                    unit = _unit(v[a : a + 4096])
                    near = units[n] @ unit.T
                    m = min(k + 1, near.shape[1])
                    rows = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    lies = placed.of(n, unit)
                    away = np.abs(lies[:, rows] - at[n][:, :, None]).min(axis=0)
                    score = np.take_along_axis(near, rows, axis=1)
                    if n in best:
                        score, away = np.hstack([best[n][0], score]), np.hstack([best[n][1], away])
                    keep = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    best[n] = np.take_along_axis(score, keep, axis=1), np.take_along_axis(away, keep, axis=1)
        for n, (score, away) in best.items():
            probe = np.repeat(np.arange(len(score)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probe), n, np.int32)), pa.array(probe), pa.array(score.ravel()), pa.array(away.ravel())], ["n", "probe", "score", "away"])

    found = points.select("v").mapInArrow(released(nearest), "n int, probe long, score double, away long")
    place = F.row_number().over(Window.partitionBy("n", "probe").orderBy(F.desc("score"), "away"))
    needs = [r["away"] for r in found.withColumn("place", place).where((F.col("place") > 1) & (F.col("place") <= k + 1)).select("away").collect()]  # the first is the probe itself
    return max(1, int(np.quantile(needs, want, method="higher"))) if needs else 1


def measured_parts(points: DataFrame, placed: Ranges, together: int, tiles: int, block_rows: int) -> dict[tuple[int, int], int]:
    """{(length, tile): blocks} of the tiles that hold more than ``block_rows`` points: no more than the points over block_rows, on each curve."""

    def count(batches):
        for b in batches:
            for n, _, v in by_length(b.column("v")):
                for c, tile in enumerate(placed.of(n, _unit(v)) // together):
                    found, times = np.unique(c * tiles + tile, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), pa.array(found.astype(np.int32)), pa.array(times)], ["n", "tile", "points"])

    counts = points.select("v").mapInArrow(released(count), "n int, tile int, points long").groupBy("n", "tile").agg(F.sum("points").alias("points"))
    return {(r["n"], r["tile"]): math.ceil(r["points"] / block_rows) for r in counts.where(F.col("points") > block_rows).collect()}


def neighbours(
    rows: DataFrame, is_query: Column, k: int = 5, curves: int = 8, dims: int = 4, bits: int = 9, window: int | None = None, want: float = 0.95, ranges: int = 512, block_rows: int = 16_384, whole_rows: int = 512, sample: int = 4096, probes: int = 192, seed: int = 3
) -> DataFrame:
    """(query_id, rank, vec_id, score) from (rid, id, v); ``is_query`` is a condition on id; ``window``: ranges at either side, measured if none is given."""
    points = written(grouped(rows, k + 1))
    placed, large, units = fitted(points, curves, dims, bits, ranges, whole_rows, sample, seed)
    window = measured_window(points, placed, units, k, probes, want) if window is None and large else window or 1
    together = max(1, math.ceil(window / 3))  # ranges of a tile
    reach, tiles = math.ceil(window / together), math.ceil(ranges / together)
    parts = measured_parts(points, placed, together, tiles, block_rows)

    queries = rows.where(is_query).select(F.col("rid").alias("own"), F.col("id").alias("query_id"), F.transform("v", lambda x: x + F.lit(0.0)).alias("qv")).withColumns({"h": F.xxhash64("qv"), "g": F.xxhash64(F.lit(7), "qv")})
    hashed = points.select("pid", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g"))
    owner = written(queries.drop("qv").join(hashed.hint("merge"), ["h", "g"]).select("own", "query_id", "pid"))
    asked = points.join(owner.select("pid").distinct().hint("merge"), "pid", "left_semi")

    def place(kind: int):
        def out(b, n, curve, tile, rows, pids):
            own = np.array([parts.get((n, t), 1) for t in (curve * tiles + tile).tolist()], np.int64)
            for p in range(own.max(initial=0)) if kind else (None,):
                at = np.flatnonzero(own > p) if kind else np.arange(len(rows))
                some, tile_of, p = b.take(pa.array(rows[at])), curve * tiles + tile[at], np.full(len(at), p) if kind else pids % own
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (np.full(len(at), n), tile_of, p, np.full(len(at), kind))] + list(some.columns), ["n", "tile", "part", "kind", *some.schema.names])

        def run(batches):
            for b in batches:
                pids = b.column("pid").to_numpy()
                for n, at, v in by_length(b.column("v")):
                    for c, tile in enumerate(placed.of(n, _unit(v)) // together):
                        for step in range(-reach, reach + 1) if kind and n in placed.index else (0,):
                            ok = np.flatnonzero((tile + step >= 0) & (tile + step < tiles))
                            yield from out(b, n, c, tile[ok] + step, at[ok], pids[at[ok]])

        return released(run)

    kinds = "n int, tile int, part int, kind int, pid long, v array<double>, ids array<struct<id: long, rid: long>>"
    every = points.mapInArrow(place(0), kinds).unionByName(asked.select("pid", "v", F.lit(None).cast("array<struct<id: long, rid: long>>").alias("ids")).mapInArrow(place(1), kinds))
    keys = ["n", "tile", "part"]
    ranged = every.repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")

    def search(batches):
        held, data, at = [], None, None
        for (n, tile, part, kind), _, piece in by_key(batches, (*keys, "kind")):
            if (n, tile, part) != at:
                held, data, at = [], None, (n, tile, part)
            if kind == 0:
                held.append(piece)
                continue
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                raw = np.concatenate([by_length(p.column("v"))[0][2] for p in held])
                ids = table.column("ids").combine_chunks()
                first = ids.flatten().field("id").to_numpy()[np.cumsum(ids.value_lengths().to_numpy()) - ids.value_lengths().to_numpy()]
                data, held = (table.column("pid").to_numpy(), first, raw, _unit(raw), ids), []
            if data is None:
                continue
            pids, first, raw, unit, ids = data
            asks = by_length(piece.column("v"))[0][2]
            who = piece.column("pid").to_numpy()
            for a in range(0, len(who), 256):
                near = _unit(asks[a : a + 256]) @ unit.T
                m = min(k + 1, near.shape[1])
                least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m] - 1e-9
                for i in range(len(near)):
                    rows = np.flatnonzero(near[i] >= least[i])  # ties are all here
                    s = cosines(asks[a + i], raw[rows])
                    best = np.lexsort((first[rows], -s))[: k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), who[a + i])), pa.array(pids[rows[best]]), pa.array(s[best]), ids.take(pa.array(rows[best]))], ["q", "pid", "score", "ids"])

    found = ranged.mapInArrow(released(search), "q long, pid long, score double, ids array<struct<id: long, rid: long>>")
    once = found.groupBy("q", "pid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]["id"], "pid")
    top = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "score", "ids")
    pairs = owner.join(top.hint("merge"), F.col("pid") == F.col("q")).select("own", "query_id", "score", F.explode("ids").alias("x")).where("x.rid <> own")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "x.id", "x.rid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("x.id").alias("vec_id"), "score")


def digest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    return neighbours(vector_rows(embeddings, "vec_id", "embedding", nonzero=True), F.col("id") % every == 0)
