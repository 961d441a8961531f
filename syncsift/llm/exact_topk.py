"""Exact top-k by inner product with vector-approximation files.

Vectors are dealt to blocks of about ``block_bytes``, and each query is sent to every block (a stated query set against
all rows, in blocks; rows aren't paired). A block quantises each dimension into 16 cells over its own range: the
approximation file, a byte for each component. For a batch of queries the scan of the cells, some thousand rows at a time,
gives an upper and a lower bound of every score (a cell's centre and half width, and the rounding of the scan); the
kth largest lower bound decides which rows stay open. Of these, exact vectors are read in the order of their upper bounds until the
next bound is below the kth exact score, so the block's top k is certain. The tops of the blocks meet per query, k rows
for each block.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a null
id; a vector is compared with those of its own length; rows that repeat an id are rows of their own (each is a candidate of
the other and, if its id is asked for, a query); ties go to the smaller id; fewer candidates give fewer rows; an empty
table gives none; other columns are ignored, whatever their names. Scores are sums of exact integers of any size; one
that a long can't hold is ranked exactly and returned as the nearest long.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncsift.llm.common import by_key, by_length, dealt, partitions, released, vector_rows

CELLS = 16
PLAIN = 2.0**40  # larger components have no cells: all their rows are open
EXACT = 2.0**53  # sums of integers below are exact in double precision
CHUNK = 4096  # rows that a scan widens at once


def whole(scale: float, v: np.ndarray) -> np.ndarray:
    """floor(scale * v), exact; Python integers where a double can't hold one of them."""
    with np.errstate(over="ignore"):
        found = np.floor(scale * v)
    if np.isfinite(found).all():
        return found
    return np.frompyfunc(lambda x: math.floor(Fraction(x) * Fraction(scale)), 1, 1)(v)


class Cells:
    """A block's vectors of one length: the cells of their components, and the exact components as whole numbers."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, exact: np.ndarray):
        self.rids, self.ids, self.exact = rids, ids, exact
        self.most = np.abs(exact).max(axis=0)
        self.plain = bool(self.most.max() < PLAIN)
        if self.plain:
            self.low = exact.min(axis=0)
            self.width = np.maximum((exact.max(axis=0) - self.low) / CELLS, 1e-9)
            self.cell = np.minimum((exact - self.low) / self.width, CELLS - 1).astype(np.uint8)
            self.half = self.width / 2 * (1 + 1e-6) + 1e-9 * (1 + self.most)

    def scan(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper bounds of all scores, by how much the lower bounds are less) for queries of plain components."""
        narrow, middle = queries.astype(np.float32), np.empty((len(queries), len(self.ids)), np.float32)
        for a in range(0, len(self.ids), CHUNK):
            centre = (self.low + (self.cell[a : a + CHUNK] + 0.5) * self.width).astype(np.float32)
            middle[:, a : a + CHUNK] = narrow @ centre.T
        size = np.abs(queries)
        rounding = (queries.shape[1] + 8) * 1.2e-7 * (size @ (self.most + self.half))
        reach = size @ self.half + rounding + 1e-6
        return middle + (reach * (1 + 1e-6))[:, None], 2 * reach * (1 + 1e-6)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> list[int]:
        if object not in (query.dtype, self.exact.dtype) and float(np.abs(query) @ self.most) < EXACT:
            return (self.exact[rows] @ query).astype(np.int64).tolist()
        q = list(map(int, query))
        return [sum(int(x) * y for x, y in zip(r, q, strict=True)) for r in self.exact[rows].tolist()]

    def top(self, query_rids: np.ndarray, queries: np.ndarray, k: int):
        """(query index, row, score) of each query's k best."""
        plain = self.plain and bool((np.abs(queries) < PLAIN).all())
        if plain:
            upper, twice = self.scan(queries)
        else:
            upper, twice = np.full((len(queries), len(self.ids)), np.inf, np.float32), np.full(len(queries), np.inf)
        upper[query_rids[:, None] == self.rids[None, :]] = -np.inf
        m = min(k, upper.shape[1])
        out = []
        for q in range(len(queries)):
            least = np.partition(upper[q], upper.shape[1] - m)[upper.shape[1] - m] - twice[q] if plain else -np.inf  # the kth largest lower bound
            open_rows = np.flatnonzero((upper[q] >= least) & (upper[q] > -np.inf))
            order = open_rows[np.argsort(-upper[q, open_rows], kind="stable")]
            best, at, step = [], 0, 4 * k
            while at < len(order) and (not plain or len(best) < k or upper[q, order[at]] >= -best[-1][0]):
                take = order[at : at + step]
                found = zip((-s for s in self.scores(queries[q], take)), self.ids[take].tolist(), take.tolist(), strict=True)
                best = sorted([*best, *found])[:k]
                at, step = at + len(take), 2 * step
            out += [(q, row, -s) for s, _, row in best]
        return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_bytes: int = 24 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score long) from (rid, id, v); ``is_query`` is a condition on id; components count as floor(scale * x)."""
    total = vectors.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long")).alias("size")).first()
    tasks = min(2 * partitions(vectors.sparkSession), -(-(total["n"] or 0) // 2048))  # for small tables, to keep all cores busy
    blocks = max(1, tasks, -(-8 * (total["size"] or 0) // block_bytes))
    data = vectors.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "rid", "id", "v")
    asked = vectors.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "rid", "id", "v")

    def search(batches):
        held: dict[int, list] = {}
        cells: dict[int, Cells] = {}
        for (_, kind), first, piece in by_key(batches, ("block", "kind")):
            rids, ids = piece.column("rid").to_numpy(), piece.column("id").to_numpy()
            if kind == 0:
                if first:
                    held, cells = {}, {}
                for n, rows, v in by_length(piece.column("v")):
                    held.setdefault(n, []).append((rids[rows], ids[rows], whole(scale, v)))
                continue
            for n, rows, v in by_length(piece.column("v")):
                if n in held:  # a block that has queries only has nothing here: kind 0 came first
                    cells[n] = Cells(*(np.concatenate([h[i] for h in held[n]]) for i in range(3)))
                    del held[n]
                if n not in cells:
                    continue
                own, asks = cells[n], whole(scale, v)
                step = max(1, min(256, (4 << 20) // len(own.ids)))
                for a in range(0, len(rows), step):
                    found = own.top(rids[rows[a : a + step]], asks[a : a + step], k)
                    if found:
                        q, row, score = zip(*found, strict=True)
                        at = rows[a + np.array(q)]
                        clipped = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in score]
                        ranks = [f"{s + (1 << 2200):0700x}" if s != c else None for s, c in zip(score, clipped, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rids[at]), pa.array(ids[at]), pa.array(own.ids[list(row)]), pa.array(clipped, pa.int64()), pa.array(ranks, pa.string())], ["q", "query_id", "vec_id", "score", "beyond"]
                        )

    found = dealt(data.unionByName(asked), ["block"], ["kind"]).mapInArrow(released(search), "q long, query_id long, vec_id long, score long, beyond string")
    # beyond orders scores that a long can't hold: above all others or below them, by its sign and then its digits.
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(F.when(F.col("score") > 0, F.coalesce("beyond", F.lit(""))).otherwise(F.coalesce("beyond", F.lit("~")))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    return top_k(vector_rows(embeddings, "vec_id", "embedding", nonzero=False), F.col("id") % every == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
