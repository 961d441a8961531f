"""Near copies: SimHash and MinHash retrieve candidates by word shingles, exact Jaccard similarity verifies them.

Words are those of ``simhash`` (A-Z lower-cased, runs of bytes outside ``[\\x20\\x09-\\x0D]``), a shingle is ``words`` words (a
shorter text is one shingle), and two texts are near copies if the Jaccard similarity of their sets of shingles is
``least`` or more.

``simhash.classes`` links the texts whose fingerprints of these shingles differ in ``radius`` or fewer of 64 bits, through its
vantage-point trees. That isn't all: at a similarity of 0.8 fingerprints differ in about 10 bits with a wide spread, and at a
radius wide enough for all of them a tree prunes nothing. The rest is found by bands: each text has ``bands`` keys of ``rows``
minima each, and a band of four is shared with a probability of 0.41 at the least similarity of 0.8, so 24 bands miss a pair
with one of 3e-6. Neither way decides anything: both only say which texts are compared.

Texts that share a SimHash class or a band are candidates. Keys of both kinds are dealt and linked to
the smallest text of each, and connected components join the links: any two candidates lie in one component. Only texts
of such a component are sent, once, and compared there by their whole sets, as 64-bit hashes of shingles. A group is
everything reachable by verified links. A text is compared with all others at once, through an inverted
index; texts that are known to be of the same group need no comparison with each other.

A task holds the sets of ``chunk`` texts, or of two such chunks: a component of more is dealt to chunks by hash. First each
chunk is compared in itself and with the first one, which joins nearly all of a dense group; then the texts outside of the
component's largest group so far, in parts of ``chunk``, are compared with every chunk. So each pair of texts of different
groups has met, and a group that holds a third of all texts costs each of its chunks a constant number of comparisons.

Defined results: equal texts are near copies, texts without words too; null text is empty text; of a group the row with
the smallest doc_id stays, a row with a null doc_id only if the group has no other (that with the smallest hash of its
text); rows that repeat a doc_id are texts of their own; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncsift.llm import simhash
from syncsift.llm.common import SALTS, binary_of, by_key, components, dealt, released, slices, written

MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Hashes of the shingles of texts, from a bounded table of word hashes."""

    def __init__(self, words: int, most: int = 1 << 17):
        self.words, self.most, self.known = words, most, {}

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        import xxhash

        split = [t.lower().split() for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        for w in set().union(*split).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return [self._set(s) for s in split]

    def _set(self, parts: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(self.known.__getitem__, parts), np.uint64, len(parts))
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1 if width else 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + len(out)]) * MIX
            out ^= out >> np.uint64(32)
        return np.unique(out)


def band_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 13) -> np.ndarray:
    """A key for each set and band."""
    odd = np.random.default_rng(seed).integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.concatenate(sets)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            x = h * odd[b * rows + r]
            key = (key ^ np.minimum.reduceat(x ^ (x >> np.uint64(31)), begins)) * MIX
            key ^= key >> np.uint64(32)
        keys[:, b] = key
    return keys


def groups(sets: list[np.ndarray], least: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the first index of its group: everything reachable by similarities of ``least`` or more, or of one ``known`` class."""
    m = len(sets)
    up = np.arange(m)
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        up = first[of]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    waiting = np.ones(m, bool)
    while waiting.any():
        classes, counts = np.unique(up[waiting], return_counts=True)
        if len(classes) == 1:  # any two that were not compared are of one group
            break
        rare = classes[np.argmin(counts)] if waiting.sum() < m else up[0]
        x = int(np.flatnonzero(waiting & (up == rare))[0])
        waiting[x] = False
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
        both = np.bincount(owner[at], minlength=m)
        near = np.unique(up[both >= least * (sizes + sizes[x] - both)])
        up[np.isin(up, near)] = near[0]
    return up


def copy_groups(keyed: DataFrame, words: int, least: float, bands: int, rows: int, chunk: int, radius: int) -> DataFrame:
    """(node, class): the group of each text of (node, text) that was compared with another; class is its smallest node.

    ``node`` is the xxhash64 of the text, which ``simhash.classes`` names it by.
    """

    def sketch(batches):
        shingles = Shingles(words)
        for batch in slices(batches, "text", 1 << 20):
            if not len(batch):
                continue
            raw, at = binary_of(batch.column("text"))
            data, at = raw.tobytes(), at.tolist()
            keys = band_keys(shingles.of([data[a:b] for a, b in zip(at, at[1:], strict=False)]), bands, rows)
            node = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    def chain(batches):
        last, first = None, None
        for batch in batches:
            if not len(batch):
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            fresh[0] = last is None or key[0] != last
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            least_node = np.where(begin >= 0, node[begin], node[0] if first is None else first)
            last, first = key[-1], least_node[-1]
            linked = node != least_node
            linked[1:] &= fresh[1:] | (node[1:] != node[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(least_node[linked])], ["a", "b"])

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, node in enumerate(batch.column("node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            if len(seen) > 1 << 20:
                seen = set()
            yield batch.take(pa.array(new, pa.int64()))

    def verify(batches):
        def done(nodes, sets, known):
            nodes = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[groups(sets, least, np.array(known, np.int64))])], ["node", "class"])

        shingles, nodes, sets, known = Shingles(words), [], [], []
        for _, first, piece in by_key(batches, ("label", "part", "other")):
            if first and nodes:
                yield done(nodes, sets, known)
                nodes, sets, known = [], [], []
            for some in slices([piece], "text", 1 << 20):
                node = some.column("node").to_numpy()
                new = np.ones(len(node), bool)
                new[1:] = node[1:] != node[:-1]
                new[0] = not nodes or node[0] != nodes[-1]
                some = some.filter(pa.array(new))
                if not len(some):
                    continue
                raw, at = binary_of(some.column("text"))
                data, at = raw.tobytes(), at.tolist()
                nodes += node[new].tolist()
                known += some.column("known").to_pylist()
                sets += shingles.of([data[a:b] for a, b in zip(at, at[1:], strict=False)])
        if nodes:
            yield done(nodes, sets, known)

    def compared(held: DataFrame) -> DataFrame:
        """(node, class) within each (label, part, other); ``known``: the class so far."""
        return dealt(held.select("label", "part", "other", "node", "known", "text"), ["label", "part", "other"], ["node"]).mapInArrow(released(verify), "node long, class long")

    def up_to(n, c="n"):
        return F.explode(F.sequence(F.lit(0), n - 1)).alias(c)

    alike = simhash.classes(keyed.select(F.col("node").alias("doc_id"), "text"), words, radius).select(F.col("class").alias("key"), F.col("h").alias("node"))
    keys = keyed.mapInArrow(released(sketch), "key long, node long").unionByName(alike)
    links = dealt(keys, ["key"], ["node"]).mapInArrow(released(chain), "a long, b long")
    labels = components(links)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).select("label", "parts", up_to(F.lit(SALTS), "salt"))
    placed = labels.select("node", "label", salt).join(sizes.hint("merge"), ["label", "salt"]).select("node", "label", "parts", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int").alias("part"))
    held = keyed.join(placed.hint("merge"), "node").select("label", "parts", "part", "node", "text")
    held = written(held.mapInArrow(released(once), held.schema)).withColumns({"other": F.lit(0), "known": F.col("node")})
    lead = held.where("part = 0 AND parts > 1").select("label", "parts", up_to(F.col("parts"), "part"), "node", "text", "other", "known").where("part > 0")
    found = written(compared(held.unionByName(lead)))
    large = held.where("parts > 1").select("label", "parts", "part", "node", "text")
    if large.isEmpty():
        return found
    return _large_components(found, large, components, compared, up_to, chunk)


def _large_components(found: DataFrame, large: DataFrame, components, compared, up_to, chunk: int) -> DataFrame:
    """copy_groups' result where ``large`` has rows: texts outside of their component's largest group meet every chunk."""
    joined = components(found.select(F.col("node").alias("a"), F.col("class").alias("b")))
    classes = written(found.select("node").distinct().join(joined.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("known")))
    own = written(large.join(classes.hint("merge"), "node"))
    counts = own.select("label", "parts", "known", "node").distinct().groupBy("label", "parts", "known").agg(F.count("*").alias("n"))
    top = counts.groupBy("label", "parts").agg(F.max(F.struct("n", "known")).alias("m"), F.sum("n").alias("all"))
    top = top.select("label", "parts", F.col("m.known").alias("top"), F.ceil((F.col("all") - F.col("m.n")) / chunk).cast("int").alias("others")).where("others > 0")
    left = own.drop("parts").join(top.select("*", up_to(F.col("parts"), "part")).hint("merge"), ["label", "part"])
    other = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("others")).cast("int").alias("other")
    every = left.select("label", "part", up_to(F.col("others"), "other"), "node", "known", "text")
    rest = left.where("known <> top").select("label", "parts", other, "node", "known", "text").select("label", up_to(F.col("parts"), "part"), "other", "node", "known", "text")
    met = compared(every.unionByName(rest))
    both = met.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(classes.select(F.col("node").alias("a"), F.col("known").alias("b")))
    joined = components(both)
    return written(classes.select("node").join(joined.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("class")))


def near_dedup(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 24, rows: int = 4, chunk: int = 2048, radius: int = 4) -> DataFrame:
    """One row of each group of near copies, with its columns."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.withColumn("node_", F.xxhash64(text))
    found = written(copy_groups(hashed.select(F.col("node_").alias("node"), text.alias("text")), words, least, bands, rows, chunk, radius))
    thin = hashed.select("node_", "doc_id").join(found.hint("merge"), F.col("node_") == F.col("node"), "left")
    best = thin.groupBy(F.coalesce("class", "node_").alias("class")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node_").alias("n"))).alias("m"))
    keep = written(best.select(F.col("m.n").alias("n_"), F.col("m.doc_id").alias("i_")))
    first = Window.partitionBy("node_").orderBy(*(F.col(c) for c in docs.columns if c != "text"))
    kept = hashed.join(keep.hint("merge"), (F.col("node_") == F.col("n_")) & F.col("doc_id").eqNullSafe(F.col("i_")), "left_semi")
    return kept.withColumn("place_", F.row_number().over(first)).where("place_ = 1").drop("place_", "node_")
