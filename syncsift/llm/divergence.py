"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Terms are runs of letters and of bytes above ASCII, A-Z in lower case. Two passes over the texts, both exact. The first counts
documents by term and keeps, for each language, the terms of at least ``min_docs`` documents. The second counts occurrences with
an Aho-Corasick automaton of the kept terms, each between delimiters, over the text with every other byte turned into a
delimiter, so that a term matches whole runs only.

Blocks: a document belongs to (lang, source, a part of the source's bytes by its hash), so a source of any size is many blocks
of about ``block_bytes``, and the automaton of a block has only the kept terms that its own documents hold. So no
vocabulary is broadcast or held whole; the kept terms of a block reach it by a join on the term and a shuffle on the block. The first
pass gives a row for each (block, term), the second one too: texts move twice, within a block's key.

Counts are sparse postings (lang, source, term, count). Terms that a source lacks have one smoothed share p0 for the source,
so a pair's sum is: over terms of both, of the one, of the other, and the number of terms of neither times one value. Postings are
dealt by (lang, tile of sources, tile of sources, part of the terms), and a task adds up each pair before anything is shuffled; a
tile is ``TILE`` sources at most, so a task's matrices are bounded. All shares are integers, computed as decimals of 38 digits.

Defined results: a null text, lang or source is an empty one; a group without terms, or a language without kept terms, still has its pairs,
with the shares that the formula gives (no kept terms: value 0); rows that repeat a doc_id, or that are equal, count each; texts are
read whole; an empty table gives no rows; other columns, whatever their names, are ignored; a null doc_id is like any other.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from syncsift.llm.common import arrow, by_key, dealt, dropped, only, partitions, slices, written

#: Bytes that end a term become spaces, A-Z become a-z, all others stay.
TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x > 0x7F or 0x61 <= x <= 0x7A else 0x20 for x in range(256))
SCALE, TILE = 1_000_000_000, 512


def in_blocks(docs: DataFrame, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, source, part, text) of the documents, and the written groups (lang, source, parts)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = only(docs, "doc_id", "text", "lang", "source").select("doc_id", named("text"), named("lang"), named("source"))
    size = F.sum(F.octet_length("text").cast("long"))
    groups = written(rows.groupBy("lang", "source").agg(F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")).cast("int").alias("part")
    return rows.join(groups, ["lang", "source"]).select("lang", "source", part, "text"), groups  # broadcast if the groups' measured size allows


BLOCK = ("lang", "source", "part")


def _words(column: pa.Array) -> list[bytes]:
    return [x.translate(TABLE) for x in column.cast(pa.binary()).to_pylist()]


def _rows(lang, source, part, counts: dict, names: list[str]) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names
    )


def documents_of(blocks: DataFrame) -> DataFrame:
    """(lang, source, part, term, n): in how many documents of each block a term is."""

    def run(batches):
        key, counts = None, Counter()
        for now, first, piece in by_key(slices(batches, "text"), BLOCK):
            if first and key is not None:
                yield _rows(*key, counts, [*BLOCK, "term", "n"])
                counts = Counter()
            key = now
            for text in _words(piece.column("text")):
                counts.update(set(text.split()))
        if key is not None:
            yield _rows(*key, counts, [*BLOCK, "term", "n"])

    return arrow(run, dealt(blocks, list(BLOCK)), "lang string, source string, part int, term string, n long")


def occurrences_of(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each block's documents hold the block's kept terms (lang, source, part, term)."""
    import ahocorasick  # here, so that driver and worker say the same where it is missing

    terms = kept.select(*BLOCK, F.lit(0).alias("kind"), F.col("term").alias("text"))
    texts = blocks.select(*BLOCK, F.lit(1).alias("kind"), "text")

    def run(batches):
        names, found, counts, key = [], None, None, None

        def out():
            at = np.flatnonzero(counts)
            n = len(at)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array([names[i] for i in at.tolist()], pa.string()), pa.array(counts[at])], ["lang", "source", "term", "n"]
            )

        for (*block, kind), first, piece in by_key(slices(batches, "text"), (*BLOCK, "kind")):
            if block != key:
                if counts is not None:
                    yield out()
                names, found, counts, key = [], None, None, block
            if kind == 0:
                names += piece.column("text").to_pylist()
                continue
            if not names:
                continue  # a block without kept terms
            if found is None:
                found, counts = ahocorasick.Automaton(), np.zeros(len(names), np.int64)
                for i, term in enumerate(names):
                    found.add_word(f" {term} ", i)
                found.make_automaton()
            for text in _words(piece.column("text")):
                counter = Counter(map(itemgetter(1), found.iter(f" {text.decode("utf-8", "replace")} ")))
                counts[np.fromiter(counter.keys(), np.int64, len(counter))] += np.fromiter(counter.values(), np.int64, len(counter))
        if counts is not None:
            yield out()

    return arrow(run, dealt(terms.unionByName(texts), list(BLOCK), ["kind"]), "lang string, source string, term string, n long")


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)) of columns or numbers, exact; null where nothing is kept."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ((({wide(n)} + 2) * CAST({SCALE} AS DECIMAL(10,0))) div ({wide(total)} + 2 * {wide(v)})) END")


def gap(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of positive integers of at most SCALE + 1: 63 bits hold the square."""
    return (p - q) * (p - q) // (p + q)


GAP = "((p - q) * (p - q)) div (p + q)"


class Pairs:
    """Sums over the terms of a task, for the sources of one tile against those of another."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None):
        """The shares of absent terms; ``second`` None: the same tile."""
        self.same, self.p0 = second is None, (first, first if second is None else second)
        shape = len(first), len(self.p0[1])
        self.both, self.common, self.one, self.other = (np.zeros(shape, np.int64) for _ in range(4))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Shares by term and source, 0 where a source hasn't the term."""
        for i in np.flatnonzero(a.any(axis=0)).tolist():
            at = a[:, i] > 0
            q, has = b[at], b[at] > 0
            f = gap(a[at, i][:, None], np.where(has, q, self.p0[1]))
            self.both[i] += np.where(has, f, 0).sum(axis=0)
            self.one[i] += np.where(has, 0, f).sum(axis=0)
            self.common[i] += has.sum(axis=0)
        if not self.same:
            for j in np.flatnonzero(b.any(axis=0)).tolist():
                at = b[:, j] > 0
                self.other[:, j] += np.where(a[at] > 0, 0, gap(b[at, j][:, None], self.p0[0])).sum(axis=0)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, sum over the terms of either, number of terms of both), each pair once."""
        i, j = np.triu_indices(len(self.p0[0]), 1) if self.same else (x.ravel() for x in np.indices(self.both.shape))
        value = self.both + self.one + (self.one.T if self.same else self.other)
        return i, j, value[i, j], self.common[i, j]


def pair_sums(postings: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value, common) by numbers of sources, a < b, from postings (lang, number, term, p) and groups (lang, number, p0, sources)."""
    n = partitions(postings.sparkSession)
    mine = F.expr(f"number div {tile}").cast("int")
    tiles = F.expr(f"(sources - 1) div {tile}").cast("int")
    parts = F.sequence(F.lit(0), F.lit(n - 1))
    zero = groups.where("p0 IS NOT NULL").select("lang", "sources", "number", F.explode(parts).alias("part"), F.lit("").alias("term"), F.col("p0").alias("p"), F.lit(0).alias("kind"))
    some = postings.join(groups.select("lang", "number", "sources"), ["lang", "number"]).select("lang", "sources", "number", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("part"), "term", "p", F.lit(1).alias("kind"))
    every = zero.unionByName(some).withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), tiles)))
    every = every.select("lang", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "part", "kind", "term", "number", "p")

    def run(batches):
        key, sums, shares, left = None, None, [], None

        def out():
            i, j, value, common = sums.sums()
            at = np.flatnonzero((value != 0) | (common != 0))
            columns = [pa.array([key[0]] * len(at), pa.string()), *(pa.array(x[at].astype(np.int64)) for x in (i + key[1] * tile, j + key[2] * tile, value, common))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value", "common"])

        def whole(term, number, p):
            """Adds up terms of which all rows are here, some thousand cells at a time."""
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            place = np.cumsum(np.r_[False, term[1:] != term[:-1]])
            step = max(1, (1 << 20) // max(sums.both.shape))
            for at in range(0, len(starts), step):
                rows = slice(starts[at], starts[at + step] if at + step < len(starts) else len(term))
                tile_of, t = number[rows] // tile, place[rows] - at
                made = []
                for k in range(1 if sums.same else 2):
                    m = np.zeros((min(step, len(starts) - at), sums.both.shape[k]), np.int64)
                    of = tile_of == key[1 + k]
                    m[t[of], number[rows][of] - key[1 + k] * tile] = p[rows][of]
                    made.append(m)
                sums.add(made[0], made[-1])

        def begin():
            number, p = (np.concatenate(x) for x in zip(*shares, strict=True))
            first, second = (np.ones(number[number // tile == k].max() - k * tile + 1, np.int64) for k in key[1:3])
            for k, into in ((key[1], first), (key[2], second)):
                of = number // tile == k
                into[number[of] - k * tile] = p[of]
            return Pairs(first, None if key[1] == key[2] else second)

        for (*now, kind), _, piece in by_key(batches, ("lang", "i", "j", "part", "kind")):
            if now != key:
                if sums is not None:
                    if left is not None:
                        whole(*left)
                    yield out()
                key, sums, shares, left = now, None, [], None
            term, number, p = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("term", "number", "p"))
            if kind == 0:
                shares.append((number.astype(np.int64), p.astype(np.int64)))
                continue
            if sums is None:
                sums = begin()
            if left is not None:
                term, number, p = (np.concatenate([x, y]) for x, y in zip(left, (term, number, p), strict=True))
            cut = int(np.flatnonzero(term != term[-1])[-1]) + 1 if (term != term[-1]).any() else 0  # the last term may go on
            if cut:
                whole(term[:cut], number[:cut], p[:cut])
            left = term[cut:], number[cut:], p[cut:]
        if sums is not None:
            if left is not None:
                whole(*left)
            yield out()

    found = arrow(run, dealt(every, ["lang", "i", "j", "part"], ["kind", "term"]), "lang string, a long, b long, value long, common long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("common").alias("common"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, tile: int = TILE, block_bytes: int = 8 << 20) -> DataFrame:
    """(lang, source, part, item, value long, rank int): for each source all others of its language, and its ``top`` terms."""
    blocks, named = in_blocks(docs, block_bytes)
    first = written(documents_of(blocks))
    kept = written(first.groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"))
    counts = written(occurrences_of(blocks, first.join(kept.hint("merge"), ["lang", "term"])).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    dropped(first)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    info = named.drop("parts").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "held", "v"])
    in_lang = Window.partitionBy("lang")
    info = info.withColumns({"sources": F.count("*").over(in_lang), "number": F.row_number().over(in_lang.orderBy("source")).cast("long") - 1, "lang_total": F.sum("total").over(in_lang), "p0": share("0", "total", "v")})
    info = written(info)
    shares = written(counts.join(info, ["lang", "source"]).select("lang", "source", "number", "term", "lang_total", "v", share("n", "total", "v").alias("p")))
    # Terms: against the whole language.
    in_all = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.join(in_all.hint("merge"), ["lang", "term"]).withColumn("q", share("n", "lang_total", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(GAP).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # Pairs: sums over the terms of either, and one value for each of the others.
    side = lambda x: info.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "number", "held", "p0")), *(["v"] if x == "a" else []))
    sums = written(pair_sums(shares.select("lang", "number", "term", "p"), info.select("lang", "number", "p0", "sources"), tile))
    pairs = side("a").join(side("b"), "lang").where("number_a < number_b")
    pairs = pairs.join(sums.withColumnsRenamed({"a": "number_a", "b": "number_b"}).hint("merge"), ["lang", "number_a", "number_b"], "left").na.fill(0, ["value", "common"])
    neither = F.expr("CASE WHEN v = 0 THEN 0 ELSE (v - held_a - held_b + common) * (((p0_a - p0_b) * (p0_a - p0_b)) div (p0_a + p0_b)) END")
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("e"), (F.col("value") + neither).alias("value")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10
"""
