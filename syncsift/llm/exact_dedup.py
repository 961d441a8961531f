"""Exact dedup by a cuckoo-filter index of live digests: equal texts are found, verified by content, and all but one go.

A digest is 64 bits of a text (``xxhash64``). The index has a row for each shard of the digests (by their hash): a cuckoo
filter of 16-bit fingerprints in buckets of four, the stored digests, and how many live rows hold each. ``updated`` adds and
takes away digests: a digest that the filter doesn't know is new and is inserted without a look at the stored ones; a hit is
looked up, since filters have false positives; a digest whose last row goes is deleted from filter and store. A filter that
overflows is built again, twice as large, from the stored digests; ``resharded`` does the same for the whole index.

``exact_dedup`` puts all rows into an index. Digests that more than one row holds are hits; only texts of hits are bucketed by
digest and compared, byte by byte, as grouping keys, so digests that collide don't join different texts. The rows move as
(digest, hash, ids) of some 60 bytes. Texts meet the hits in a shuffle, whatever their number, so that the plan is the same at any
size (at scale Spark's runtime filter keeps most others out of it); texts of hits then move once more, copies summed.

Hot keys: changes are summed by (digest, salt) before they move, so that at most SALTS rows of a digest reach its shard,
however many copies there are; texts of hits are summed by (digest, salt, text) before they are by (digest, text); the join that
tells each row its group is a sort-merge join that adaptive execution splits. A shard is bounded by ``SHARD`` digests on average.

Defined results: a null text is an empty one and equals it; a null doc_id is a row like another and the smallest of all;
rows that repeat a doc_id count each, and of rows equal in text and doc_id one stays; an empty table gives no rows; texts
of any length are compared whole; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import dropped, only, partitions, release, written

SLOTS, TURNS, SALTS = 4, 200, 8
SHARD = 1 << 16  # digests of a shard, on average

INDEX = "shard int, shards int, slots binary, digests array<bigint>, rows array<bigint>, hits bigint, false_hits bigint, resized int"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class Cuckoo:
    """Fingerprints of 64-bit digests, each in one of two buckets; whoever uses it keeps the digests."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.mask = np.uint64(len(self.slots) - 1)

    @classmethod
    def of(cls, digests: np.ndarray, buckets: int = 2) -> tuple[Cuckoo, int]:
        """A filter of distinct digests, at most 0.9 full, and how often it had to be doubled after an overflow."""
        while buckets * SLOTS * 0.9 < len(digests):
            buckets *= 2
        for doubled in range(40):
            made = cls(buckets << doubled)
            if made.insert(digests):
                return made, doubled
        raise RuntimeError("digests that no filter holds: they repeat")

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ (mixed(prints) & self.mask)).astype(np.int64)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = mixed(digests)
        prints = np.maximum(m >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (m & self.mask).astype(np.int64)
        return prints, first, self._other(first, prints)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(digests)
        return (self.slots[a] == prints[:, None]).any(1) | (self.slots[b] == prints[:, None]).any(1)

    def insert(self, digests: np.ndarray) -> bool:
        """All at once, in turns: those that wait at a bucket take its free slots, one of the others puts an occupant out. False: overflow."""
        prints, b, _ = self._places(digests)
        for turn in range(TURNS):
            order = np.argsort(b, kind="stable")
            prints, b = prints[order], b[order]
            place = np.arange(len(b))
            nth = place - np.maximum.accumulate(np.where(np.diff(b, prepend=-1) != 0, place, 0))
            free = (self.slots[b] == 0).cumsum(1)
            fits = nth < free[:, -1]
            self.slots[b[fits], np.argmax(free[fits] == nth[fits, None] + 1, axis=1)] = prints[fits]
            prints, b = prints[~fits], b[~fits]
            if not len(b):
                return True
            if turn:
                first = np.diff(b, prepend=-1) != 0
                slot = (prints[first] + turn) % SLOTS
                out = self.slots[b[first], slot]
                self.slots[b[first], slot] = prints[first]
                prints[first] = out
            b = self._other(b, prints)
        return False

    def delete(self, digests: np.ndarray) -> None:
        """One fingerprint for each digest; all of them have to be in the filter."""
        for p, *buckets in zip(*self._places(digests), strict=True):
            b = next(b for b in buckets if (self.slots[b] == p).any())
            self.slots[b, np.flatnonzero(self.slots[b] == p)[0]] = 0


class Shard:
    """A filter, its stored digests in ascending order, and the live rows of each."""

    def __init__(self, digests: np.ndarray, rows: np.ndarray, slots: bytes | None = None):
        order = np.argsort(digests)
        self.digests, self.rows, self.hits, self.false_hits, self.resized = digests[order], rows[order], 0, 0, 0
        if slots is None:
            self.filter, _ = Cuckoo.of(self.digests)
        else:
            self.filter = Cuckoo(0, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())

    def change(self, digests: np.ndarray, by: np.ndarray) -> None:
        """Distinct digests, and how many rows of each come (or go, where negative). What isn't there doesn't go."""
        known = self.filter.contains(digests)
        at = np.searchsorted(self.digests, digests[known])
        true = at < len(self.digests)
        true[true] = self.digests[at[true]] == digests[known][true]
        self.hits, self.false_hits = self.hits + int(true.sum()), self.false_hits + int((~true).sum())
        self.rows[at[true]] = np.maximum(0, self.rows[at[true]] + by[known][true])
        gone = self.rows == 0
        if gone.any():
            self.filter.delete(self.digests[gone])
            self.digests, self.rows = self.digests[~gone], self.rows[~gone]
        new = ~known
        new[np.flatnonzero(known)[~true]] = True
        new &= by > 0
        if new.any():
            where = np.searchsorted(self.digests, digests[new])
            order = np.argsort(digests[new], kind="stable")
            self.digests = np.insert(self.digests, where[order], digests[new][order])
            self.rows = np.insert(self.rows, where[order], by[new][order])
            if not self.filter.insert(digests[new]):
                self.filter, doubled = Cuckoo.of(self.digests, 2 * len(self.filter.slots))
                self.resized += 1 + doubled


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), digest), F.lit(shards)).cast("int")


def updated(index: DataFrame | None, changes: DataFrame, shards: int | None = None) -> DataFrame:
    """The index after ``changes`` (digest long, by long: rows that come, or go); ``shards`` is for a first index."""
    spark = changes.sparkSession
    if index is None:
        index = spark.createDataFrame([], INDEX)
        shards = shards or partitions(spark)
    else:
        shards = index.agg(F.max("shards")).first()[0] or shards or partitions(spark)
    salted = changes.select("digest", "by", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"))
    salted = salted.groupBy("digest", "salt").agg(F.sum("by").alias("by")).select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "salt", "by")

    def change(key, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        empty = np.zeros(0, np.int64)
        s = Shard(np.array(held["digests"][0], np.int64), np.array(held["rows"][0], np.int64), held["slots"][0]) if len(held) else Shard(empty, empty)
        for come in (True, False):  # what comes goes in first, so that no digest is taken out before all its rows are counted
            for salt in range(SALTS):
                some = new[(new["salt"] == salt) & ((new["by"] > 0) == come)]
                s.change(some["digest"].to_numpy(np.int64), some["by"].to_numpy(np.int64))
        row = (int(key[0]), shards, s.filter.slots.tobytes(), s.digests, s.rows, s.hits, s.false_hits, s.resized)
        release()
        return pd.DataFrame([row], columns=[f.split()[0] for f in INDEX.split(", ")])

    return written(index.groupBy("shard").cogroup(salted.groupBy("shard")).applyInPandas(change, INDEX))


def stored(index: DataFrame) -> DataFrame:
    """(digest, rows) of all live digests."""
    return index.select(F.explode(F.arrays_zip("digests", "rows")).alias("e")).select(F.col("e.digests").alias("digest"), F.col("e.rows").alias("rows"))


def resharded(index: DataFrame, shards: int) -> DataFrame:
    """The same index in another number of shards, from its stored digests."""
    return updated(None, stored(index).select("digest", F.col("rows").alias("by")), shards)


def probe(index: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, rows long): for each digest of the column ``digest`` that the filters know, its live rows; 0 is a false positive."""
    shards = index.agg(F.max("shards")).first()[0] or 1
    asked = digests.select("digest").distinct().select(shard_of(F.col("digest"), shards).alias("shard"), "digest")

    def look(key, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(new):
            return pd.DataFrame({"digest": np.zeros(0, np.int64), "rows": np.zeros(0, np.int64)})
        s = Shard(np.array(held["digests"][0], np.int64), np.array(held["rows"][0], np.int64), held["slots"][0])
        found = new["digest"].to_numpy(np.int64)
        found = found[s.filter.contains(found)]
        at = np.minimum(np.searchsorted(s.digests, found), max(0, len(s.digests) - 1))
        rows = np.where(s.digests[at] == found, s.rows[at], 0) if len(s.digests) else np.zeros(len(found), np.int64)
        return pd.DataFrame({"digest": found, "rows": rows})

    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(look, "digest long, rows long")


def digest_of(text: Column) -> Column:
    return F.xxhash64(text)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, text_sha256) for every row of ``docs``: of equal texts the row with the largest doc_id stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = only(docs, "doc_id", "text").select("doc_id", digest(text).alias("digest"), text.alias("text"))
    rows = written(texts.select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("rid")))
    n = rows.count()
    index = updated(None, rows.select("digest", F.lit(1).cast("long").alias("by")), max(partitions(docs.sparkSession), -(-n // SHARD)))
    hits = written(stored(index).where("rows > 1").select("digest"))
    # Texts of hits alone are bucketed; copies are summed before they move.
    salted = hits.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    bucketed = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["digest", "salt"], "left_semi")
    some = bucketed.groupBy("digest", "salt", "text").agg(F.count("*").alias("n"))
    equal = some.groupBy("digest", "text").agg(F.sum("n").alias("n")).where("n > 1").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "n")
    last = rows.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("last"))
    groups = written(equal.join(last.hint("merge"), "sha").select(F.col("sha").alias("group"), "n", F.col("last.doc_id").alias("keep_id"), F.col("last.rid").alias("keep_rid")))
    for table in (index, hits):
        dropped(table)
    one = F.col("n").isNull()
    return rows.join(groups.hint("merge"), F.col("sha") == F.col("group"), "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n, arg_max(rid, (coalesce(doc_id, -9223372036854775808), rid)) AS keep_rid FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n::BIGINT AS group_size, d.rid = g.keep_rid AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
