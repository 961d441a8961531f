"""Suffix-array dedup: bytes covered by a ``length``-byte string that starts anywhere else are removed.

Blockwise suffix sorting with a difference cover, to the depth of ``length`` bytes that the question needs:

1. Cover sample. Suffixes that start at offsets in the difference cover D modulo 183 are the sample (14 of 183
   positions). For any two positions i, j some d < 183 puts both i + d and j + d into the sample, so equal strings of
   ``length`` bytes share a sampled suffix that agrees on its first length - 182 bytes. A sampled suffix gets two
   names, fingerprints of its first length - 182 bytes and of its first ``length`` bytes; a bucket of names is sorted at
   a time, and names that occur once are dropped. This decides for nearly all text that no suffix in it can have an
   equal, and for nearly all repeated text that it is covered.
2. Suffix blocks. Suffixes with a repeated sample within reach are sorted, one bucket of a hash at a time, by 78 bits of
   a fingerprint of their first ``length`` bytes; equal neighbours are repeats. Those that repeated samples of full length
   cover already need no answer: they send the name alone, for others to meet. The cover's names have thus resolved
   the long ties before, and a bucket's memory is the suffixes left over the number of buckets.

Passages of ``words`` words (their hashes, whatever white space separates them) are found the same way, with positions in
words: the cover is D modulo 13 (4 of 13 words), and names are of words - 12 and of ``words`` words.

Names are fingerprints and not lexicographic ranks: the task asks which suffixes agree to a depth, not their order, and to
rank sampled suffixes of 218 bytes each would send 17 times the text. A name is two polynomials over a field of 2^31 - 1
elements and 16 bits of a third one, so strings of any structure differ in it as random ones do: some two of n different strings
have equal names with a probability of n squared / 2^79.
Positions travel as packed arrays of 10 to 20 bytes each, in blocks. A string that repeats inside a block of documents is decided
there and sent once, so a passage or a run of one byte that holds a third of all positions adds one entry per block.
A text moves between tasks once if it shares a sample with another place, and again to be cut; other texts don't move.
Written tables are deleted as soon as no later step reads them.

Defined results: texts are UTF-8 bytes; a null or empty text has n_bytes 0; matches don't cross documents; strings are
judged on the input; rows that repeat a doc_id are places of their own; an empty table gives no rows; a null doc_id is
kept; other columns are ignored, whatever their names; a text longer than a slice is read in overlapping segments.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import binary_of, by_key, dealt, dropped, only, partitions, released, slices, written

#: A perfect difference set: the differences of its members give each residue modulo PERIOD (fixed values).
PERIOD, COVER = 183, (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)
WORD_PERIOD, WORD_COVER = 13, (0, 1, 3, 9)
SEGMENT = PERIOD * 11_500  # bytes of text that a worker hashes at once
BLOCK = 1 << 20  # positions of a block
TOP, NONE = np.uint32(1 << 31), np.uint32(0xFFFFFFFF)  # marks: decided in its block; asks for no answer


PRIME = np.uint64((1 << 31) - 1)
HALF = np.uint64(31)


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 to congruent ones of at most 2^31, in place."""
    for _ in range(2):
        high = x >> HALF
        x &= PRIME
        x += high
    return x


@lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random residue for each byte, the powers of a base and those of its inverse, modulo the prime."""
    rng = np.random.default_rng(71 + which)
    letters = rng.integers(1, int(PRIME), 256, dtype=np.uint64)
    base = int(rng.integers(1 << 20, int(PRIME)))
    out = []
    for b in (base, pow(base, -1, int(PRIME))):
        p, have = np.ones(n + 1, np.uint32), 1
        while have <= n:
            more = min(have, n + 1 - have)
            p[have : have + more] = _folded(p[:more].astype(np.uint64) * np.uint64(pow(b, have, int(PRIME)))) % PRIME
            have += more
        out.append(p)
    return letters, *out


class Prefix:
    """Fingerprints of any substrings of one array of bytes, or of hashes, from sums over its prefixes.

    Two polynomials over the field of 2^31 - 1 elements, at bases of their own: two different strings of n letters agree in both for
    at most (n / 2^31)^2 of all pairs of bases, whatever the strings. (Modulo a power of two, strings of much
    structure agree at every base.) ``single``: one polynomial, of which the name's upper bits are used.
    """

    def __init__(self, raw: np.ndarray, which: int, single: bool = False):
        self.size = max(SEGMENT + 4096, 1 << max(1, len(raw) - 1).bit_length()) if len(raw) > SEGMENT + 4096 else SEGMENT + 4096
        self.fields = (2 * which, 2 * which + 1)[: 1 if single else 2]
        self.sums = []
        for k, field in enumerate(self.fields):
            letters, up, _ = _powers(field, self.size)
            sums = np.zeros(len(raw) + 1, np.uint64)
            x = letters[raw] if raw.dtype == np.uint8 else (raw >> np.uint64(31 * k)) & PRIME
            x *= up[: len(raw)]
            np.cumsum(_folded(x), out=sums[1:])
            self.sums.append(sums)

    def of(self, at: np.ndarray, width: int) -> np.ndarray:
        name = np.zeros(len(at), np.uint64)
        for sums, field in zip(self.sums, self.fields, strict=True):
            x = _folded(sums[at + width] - sums[at])
            x *= _powers(field, self.size)[2][at]
            _folded(x)
            np.subtract(x, PRIME, out=x, where=x >= PRIME)
            name = (name << HALF) | x
        name ^= name >> np.uint64(29)
        return name * np.uint64(0xBF58476D1CE4E5B9)


def segments(batches, length: int, extra: tuple[str, ...] = ()):
    """(raw, starts, bases, sizes, last, rows, batch): texts of a slice, or a segment of one long text with an overlap.

    starts: in raw; bases: in the document, multiples of PERIOD; sizes: bytes at hand; heads: how many positions may start here.
    """
    for batch in slices(batches, "text", SEGMENT):
        raw, at = binary_of(batch.column("text"))
        sizes = np.diff(at)
        if len(batch) == 1 and sizes[0] > SEGMENT:
            for base in range(0, int(sizes[0]), SEGMENT):
                part = raw[base : base + SEGMENT + length - 1]
                yield part, np.array([0]), np.array([base]), np.array([len(part)]), np.array([min(SEGMENT, int(sizes[0]) - base)]), batch
        else:
            yield raw, at[:-1], np.zeros(len(batch), np.int64), sizes, sizes, batch


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: owners [0, 0, 1, 1, 1] and places [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


@lru_cache(maxsize=4)
def _sampled(n: int) -> np.ndarray:
    return (np.arange(-(-n // PERIOD) + 1)[:, None] * PERIOD + np.array(COVER)).ravel()


def cover_positions(seg, length: int):
    """(places in raw, first names, second names, and none that ask for no answer) of the cover sample; a second name of 0: less than ``length`` bytes follow."""
    raw, starts, _, sizes, heads, _ = seg
    width = length - PERIOD + 1
    s = _sampled(SEGMENT)
    counts = np.searchsorted(s, np.minimum(sizes - width, heads - 1), side="right")
    owner, k = spread(np.maximum(counts, 0))
    at = starts[owner] + s[k]
    p = Prefix(raw, 0)
    a, b = p.of(at, width), np.zeros(len(at), np.uint64)
    room = s[k] + length <= sizes[owner]
    b[room] = p.of(at[room], length) | np.uint64(1)
    return at, a, b, a[:0], b[:0]


def open_positions(seg, length: int):
    """(places in raw, names, second names) of the suffixes that the cover leaves open, and the names of those that it covers."""
    raw, starts, bases, sizes, heads, batch = seg
    near, covered = np.zeros(len(raw) + 1, np.int32), np.zeros(len(raw) + 1, np.int32)
    for i, (at, full) in enumerate(zip(batch.column("at").to_pylist(), batch.column("full").to_pylist(), strict=True)):
        p = np.frombuffer(at, np.uint32).astype(np.int64) - bases[i]
        f = p[np.frombuffer(full, np.uint8) > 0]
        q = p[(p >= 0) & (p < sizes[i])] + starts[i]
        np.add.at(near, np.maximum(q - PERIOD + 1, starts[i]), 1)
        np.add.at(near, q + 1, -1)
        f = f[(f > -length) & (f < sizes[i])] + starts[i]
        np.add.at(covered, np.maximum(f, starts[i]), 1)
        np.add.at(covered, np.minimum(f + length, starts[i] + sizes[i]), -1)
    near, covered = np.cumsum(near)[:-1] > 0, np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    may = np.zeros(len(raw), bool)
    owner, k = spread(np.maximum(np.minimum(sizes - length + 1, heads), 0))
    may[starts[owner] + k] = True
    at = np.flatnonzero(near & may)
    a, b = Prefix(raw, 0).of(at, length), (Prefix(raw, 1, single=True).of(at, length) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    free = covered[at + length] - covered[at] < length
    return at[free], a[free], b[free], a[~free], b[~free]


BLOCKS = "bucket int, block long, kind int, data binary, keys binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])


def _block(held: list, block: int, buckets: int, turn: int, turns: int):
    """Rows of one block: for each bucket of the turn its entries (names, second names, places), and the block's own table with what it decides alone."""
    keys, bases, begins, at, a, b, size = [], [], [], [], [], [], 0
    for seg_keys, starts, seg_bases, places, x, y, u, v, n in held:
        keys.append(seg_keys)
        bases.append(seg_bases)
        begins.append(starts + size)
        at += [(places + size).astype(np.uint32), np.full(len(u), NONE)]
        a += [x, u]
        b += [y, v]
        size += n
    at, a, b = np.concatenate(at), np.concatenate(a), np.concatenate(b)
    bucket_of = lambda names: ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    if turns > 1:
        mine = bucket_of(a) % turns == turn
        at, a, b = at[mine], a[mine], b[mine]
    order = np.lexsort((at, b, a))
    at, a, b = at[order], a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(fresh) - 1
    many = np.bincount(group, minlength=1)[group] > 1 if len(a) else fresh
    own = many & (at != NONE)
    decided, full = at[own], b[own] != 0
    at, a, b, many = at[fresh], a[fresh], b[fresh], many[fresh]
    at = np.where(many, at | TOP, at).astype(np.uint32)
    bucket = bucket_of(a)
    by = np.lexsort((at == NONE, bucket))
    at, a, b, bucket = at[by], a[by], b[by], bucket[by]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(bucket[i]), block, 0, _packed(a[i:j], b[i:j], at[i:j]), None) for i, j in zip([0, *cuts], [*cuts, len(a)], strict=True) if j > i]
    table = np.concatenate([np.concatenate(keys), np.concatenate(begins)[None].T, np.concatenate(bases)[None].T], axis=1).astype(np.int64)
    rows.append((block % buckets, block, 1, decided.tobytes() + full.astype(np.uint8).tobytes(), table.tobytes()))
    return _table(rows)


def _packed(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> bytes:
    """Entries, those that ask for an answer first; the others have no place."""
    asks = int((at != NONE).sum())
    return np.array([len(a), asks, b.itemsize], np.int64).tobytes() + a.tobytes() + b.tobytes() + at[:asks].tobytes()


def _names(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, asks, wide = np.frombuffer(data, np.int64, 3).tolist()
    at = np.full(n, NONE)
    at[:asks] = np.frombuffer(data, np.uint32, asks, 24 + (8 + wide) * n)
    return np.frombuffer(data, np.uint64, n, 24), np.frombuffer(data, np.uint64 if wide == 8 else np.uint16, n, 24 + 8 * n), at


def repeats(texts: DataFrame, positions, length: int, parts=None, turn: int = 0, turns: int = 1) -> DataFrame:
    """(k1, k2, at binary, full binary): of the positions that ``positions`` names, those whose name occurs elsewhere.

    Of ``turns`` turns, each of which shuffles its share of the buckets, the turn ``turn``.

    ``parts`` cuts slices of texts into what ``positions`` reads at once (``segments`` if none is given).

    at: offsets as 32-bit integers; full: 1 where both names occur together elsewhere.
    """
    n = partitions(texts.sparkSession)
    buckets = 4 * n

    def send(batches):
        from pyspark import TaskContext

        block, held, count = TaskContext.get().partitionId() << 24, [], 0
        for seg in (parts or segments)(batches, length):
            raw, starts, bases, _, _, batch = seg[:6]
            at, a, b, told, told_b = positions(seg, length)
            if not len(at) + len(told):
                continue
            keys = np.stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()], axis=1)
            held.append((keys, starts, bases, at, a, b, told, told_b, len(raw)))
            count += len(at) + len(told)
            if count >= BLOCK or sum(h[8] for h in held) > 1 << 30:
                yield _block(held, block, buckets, turn, turns)
                block, held, count = block + 1, [], 0
        if held:
            yield _block(held, block, buckets, turn, turns)

    def search(batches):
        def done(held):
            names = [_names(d) for _, d in held]
            a, b, at = (np.concatenate([x[i] for x in names]) for i in range(3))
            block = np.repeat(np.arange(len(held)), [len(x[0]) for x in names])
            order = np.lexsort((b, a))
            asks = at[order] != NONE
            weight = np.where(asks & ((at[order] & TOP) > 0), 2, 1)
            out = []
            for other in (None, b[order]):
                fresh = np.ones(len(a), bool)
                fresh[1:] = a[order][1:] != a[order][:-1]
                if other is not None:
                    fresh[1:] |= other[1:] != other[:-1]
                g = np.cumsum(fresh) - 1
                out.append((np.bincount(g, weights=weight, minlength=1)[g] > 1) & asks)
            hit = order[out[0]]
            full = out[1][out[0]] & (b[hit] != 0)
            hit_block, hit_at = block[hit], at[hit] & ~TOP
            by = np.argsort(hit_block, kind="stable")
            cuts = np.flatnonzero(np.diff(hit_block[by])) + 1
            return [
                (0, held[hit_block[by[i]]][0], 0, hit_at[by[i:j]].tobytes() + full[by[i:j]].astype(np.uint8).tobytes(), None)
                for i, j in zip([0, *cuts], [*cuts, len(by)], strict=True)
                if j > i
            ]

        held = []
        for _, first, piece in by_key(batches, ("bucket",)):
            if first and held:
                if rows := done(held):
                    yield _table(rows)
                held = []
            kinds = piece.column("kind").to_pylist()
            own = [i for i, k in enumerate(kinds) if k]
            if own:
                yield piece.take(pa.array(own))
            blocks, data = piece.column("block").to_pylist(), piece.column("data")
            held += [(blocks[i], data[i].as_py()) for i, k in enumerate(kinds) if not k]
        if held and (rows := done(held)):
            yield _table(rows)

    def gather(batches):
        def done(data: list[bytes], table: bytes):
            t = np.frombuffer(table, np.int64).reshape(-1, 4)
            sizes = [len(d) // 5 for d in data]
            at = np.concatenate([np.frombuffer(d, np.uint32, n) for d, n in zip(data, sizes, strict=True)]).astype(np.int64)
            full = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for d, n in zip(data, sizes, strict=True)])
            order = np.lexsort((full, at))
            at, full = at[order], full[order]
            last = np.ones(len(at), bool)
            last[:-1] = at[1:] != at[:-1]
            at, full = at[last], full[last]
            seg = np.searchsorted(t[:, 2], at, side="right") - 1
            offset = (at - t[seg, 2] + t[seg, 3]).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(seg)) + 1
            rows = [(t[seg[i], 0], t[seg[i], 1], offset[i:j].tobytes(), full[i:j].tobytes()) for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True) if j > i]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["k1", "k2", "at", "full"])

        data, table = [], None
        for _, first, piece in by_key(batches, ("block",)):
            if first and table is not None:
                yield from done(data, table)
                data, table = [], None
            for d, k in zip(piece.column("data").to_pylist(), piece.column("keys").to_pylist(), strict=True):
                data.append(d)
                table = k if k is not None else table
        if table is not None:
            yield from done(data, table)

    sent = texts.mapInArrow(released(send), BLOCKS)
    found = dealt(sent, ["bucket"], n=n).mapInArrow(released(search), BLOCKS)
    return dealt(found, ["block"], n=n).mapInArrow(released(gather), "k1 long, k2 long, at binary, full binary")


def _merged(marks: DataFrame) -> DataFrame:
    """One row for each document; a very long text has marks from several blocks."""
    return marks.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("at", "full"))).alias("m")).select(
        F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.aggregate("m", F.lit(b""), lambda x, y: F.concat(x, y["at"])).alias("at"), F.aggregate("m", F.lit(b""), lambda x, y: F.concat(x, y["full"])).alias("full")
    )


def removed(size: int, at: np.ndarray, length: int) -> np.ndarray:
    """[(start, end)] of the maximal runs covered by ``length`` bytes from each of ``at``."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    at = np.sort(at)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > at[:-1] + length
    starts = at[new]
    ends = np.append(at[:-1][new[1:]], at[-1]) + length
    return np.stack([starts, np.minimum(ends, size)], axis=1)


def whole_characters(raw: bytes, spans: np.ndarray) -> bytes:
    """What stays of ``raw``; a character that only loses a part of its bytes stays whole."""
    gone = np.zeros(len(raw), bool)
    for a, b in spans.tolist():
        gone[a:b] = True
    b = np.frombuffer(raw, np.uint8)
    head = np.flatnonzero((b & 0xC0) != 0x80)
    if len(head):
        keep_any = np.maximum.reduceat(~gone, head)
        gone = ~np.repeat(keep_any, np.diff(np.append(head, len(b))))
    return b[~gone].tobytes()


def marked(texts: DataFrame, length: int, first, second, parts=None, turns: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, text, at, full, more, more_full), and the tables behind it: the texts that share a sample, with the starts that repeat (where full).

    The second step goes in ``turns`` turns, for the sake of the disk: each names its positions anew and sorts its share of them.
    """
    marks = written(repeats(texts, first, length, parts))
    sharing = written(texts.join(_merged(marks).hint("merge"), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).drop("m1", "m2"))
    dropped(marks)
    late = [written(repeats(sharing, second, length, parts, turn, turns).where(F.octet_length("at") > 0)) for turn in range(turns)]
    extra = _merged(reduce(DataFrame.unionByName, late)).select("m1", "m2", F.col("at").alias("more"), F.col("full").alias("more_full"))
    return sharing.join(extra.hint("merge"), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left").select("k1", "k2", "text", "at", "full", "more", "more_full"), [sharing, *late]


def _full(at: bytes, full: bytes, more: bytes | None, more_full: bytes | None) -> np.ndarray:
    """The starts that repeat."""
    return np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64)[np.frombuffer(y, np.uint8) > 0] for x, y in ((at, full), (more, more_full)) if x is not None])


SPANS = "s1 long, s2 long, spans binary, n_removed long, n_spans long, sha string"


def _spans(marks: DataFrame, spans_of) -> DataFrame:
    """SPANS: where ``spans_of`` (text, starts that repeat) finds any; sha is the SHA-256 of what stays."""

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            raw, at = binary_of(batch.column("text"))
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("k1", "k2", "at", "full", "more", "more_full")]
            for i, (k1, k2, *found) in enumerate(zip(*cols, strict=True)):
                own = raw[at[i] : at[i + 1]]
                spans = spans_of(own, _full(*found)).astype(np.int64)
                if len(spans):
                    rows.append((k1, k2, spans.tobytes(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(own, spans)).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SPANS.split(", ")])

    return marks.mapInArrow(released(run), SPANS)


def without(raw: np.ndarray, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """The maximal runs of [(start, end)]."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def byte_spans(texts: DataFrame, length: int) -> DataFrame:
    """SPANS, written, of the bytes that a repeated string of ``length`` bytes covers."""
    marks, behind = marked(texts, length, cover_positions, open_positions, turns=2)
    found = written(_spans(marks, lambda raw, at: removed(len(raw), at, length)).dropDuplicates(["s1", "s2"]))
    for table in behind:
        dropped(table)
    return found


# ---- passages of words


def word_edges(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words; a text begins at each of ``starts``."""
    ink = ~((raw == 32) | (raw - np.uint8(9) < 5))
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    heads = starts[starts < len(raw)]
    first[heads] = ink[heads]
    tails = heads[heads > 0] - 1
    last[tails] = ink[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_parts(words: int):
    """Like segments(), and the words of each: (starts, ends, text, place in the text, how many may begin a window here)."""

    def run(batches, length: int):
        for batch in slices(batches, "text", SEGMENT):
            raw, at = binary_of(batch.column("text"))
            if len(batch) > 1 or len(raw) <= 2 * SEGMENT:
                ws, we = word_edges(raw, at[:-1])
                text = np.searchsorted(at[1:], ws, side="right")
                place = np.arange(len(ws)) - np.searchsorted(text, text, side="left")
                yield raw, at[:-1], np.zeros(len(batch), np.int64), np.diff(at), np.diff(at), batch, ws, we, text, place, len(ws)
                continue
            base, done = 0, 0
            while base < len(raw):  # a long text: as many bytes as a segment has, and the words that its last windows need
                size = SEGMENT
                while True:
                    size = min(2 * size, len(raw) - base)
                    ws, we = word_edges(raw[base : base + size], np.zeros(1, np.int64))
                    heads = int(np.searchsorted(ws, SEGMENT)) if base + size < len(raw) else len(ws)
                    if base + size == len(raw) or 0 < heads < len(ws) - words:
                        break
                yield raw[base : base + size], np.zeros(1, np.int64), np.array([base]), np.array([size]), np.array([size]), batch, ws, we, np.zeros(len(ws), np.int64), done + np.arange(len(ws)), heads
                done += heads
                base = base + int(ws[heads]) if heads < len(ws) else len(raw)

    return run


def _windows(text: np.ndarray, n: int) -> np.ndarray:
    """Which words begin a window of ``n`` words of their text."""
    ok = np.zeros(len(text), bool)
    if len(text) >= n:
        ok[: len(text) - n + 1] = text[n - 1 :] == text[: len(text) - n + 1]
    return ok


def word_cover(words: int):
    def positions(seg, _):
        raw, ws, we, text, place, heads = seg[0], *seg[6:]
        none = np.zeros(0, np.uint64)
        width = words - WORD_PERIOD + 1
        w = np.flatnonzero(np.isin(place[:heads] % WORD_PERIOD, WORD_COVER) & _windows(text, width)[:heads])
        if not len(w):
            return w, none, none, none, none
        p = Prefix(Prefix(raw, 0).of(ws, we - ws), 1)
        a, b = p.of(w, width), np.zeros(len(w), np.uint64)
        whole = _windows(text, words)[w]
        b[whole] = p.of(w[whole], words) | np.uint64(1)
        return ws[w], a, b, none, none

    return positions


def word_open(words: int):
    def positions(seg, _):
        raw, starts, bases, batch, ws, we, text, place, heads = seg[0], seg[1], seg[2], seg[5], *seg[6:]
        near = np.zeros(len(ws) + 1, np.int32)
        for i, at in enumerate(batch.column("at").to_pylist()):
            own = np.frombuffer(at, np.uint32).astype(np.int64) - bases[i] + starts[i]
            k = np.searchsorted(ws, own)
            k = k[(own >= 0) & (k < len(ws))]
            k = k[text[k] == i]
            np.add.at(near, np.maximum(k - WORD_PERIOD + 1, 0), 1)
            np.add.at(near, k + 1, -1)
        w = np.flatnonzero(((np.cumsum(near)[:-1] > 0) & _windows(text, words))[:heads])
        none = np.zeros(0, np.uint64)
        if not len(w):
            return w, none, none.astype(np.uint16), none, none.astype(np.uint16)
        a, b = (Prefix(Prefix(raw, k).of(ws, we - ws), 1 - k).of(w, words) for k in (0, 1))
        return ws[w], a, (b >> np.uint64(48)).astype(np.uint16) | np.uint16(1), none, none.astype(np.uint16)

    return positions


def word_spans(texts: DataFrame, words: int) -> DataFrame:
    """SPANS, written, of the bytes that a repeated window of ``words`` words covers."""
    marks, behind = marked(texts, 0, word_cover(words), word_open(words), word_parts(words))

    def spans_of(raw, at):
        ws, we = word_edges(raw, np.zeros(1, np.int64))
        k = np.searchsorted(ws, np.unique(at))
        return merged_spans(np.stack([ws[k], we[k + words - 1]], axis=1))

    found = written(_spans(marks, spans_of).dropDuplicates(["s1", "s2"]))
    for table in behind:
        dropped(table)
    return found


# ---- results


def _keyed(docs: DataFrame) -> DataFrame:
    """With k1 and k2, by which a text is found again: rows of one doc_id and text share their results."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k2": F.xxhash64("text")})


def _with(keyed: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    return keyed.join(found.select("s1", "s2", *columns).hint("merge"), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").drop("s1", "s2")


def suffix_dedup(docs: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_bytes, passages) for every row of ``docs``.

    The first columns are of strings of ``length`` bytes; passage_bytes and passages count the bytes and the maximal runs that
    repeated windows of ``words`` words cover.
    """
    keyed = _keyed(only(docs, "doc_id", "text"))
    texts = keyed.select("k1", "k2", "text")
    cut = byte_spans(texts, length)
    told = word_spans(texts, words).select("s1", "s2", F.col("n_removed").alias("passage_bytes"), F.col("n_spans").alias("passages"))
    text = F.coalesce("text", F.lit(""))
    base = keyed.select("doc_id", "k1", "k2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return _with(_with(base, cut, "n_removed", "n_spans", "sha"), told, "passage_bytes", "passages").select(
        "doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"), zero("passage_bytes"), zero("passages")
    )


def without_repeats(docs: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """The rows of ``docs``, all columns, their text without what repeats: strings of ``length`` bytes, windows of ``words`` words.

    A character that would lose only a part of its bytes stays. A null text stays null. A row of which nothing but white
    space stays goes, unless it had nothing else before.
    """
    columns = docs.columns
    named = docs.toDF(*(f"c{i}_{x}" for i, x in enumerate(columns)))  # whatever the columns' names, keys don't clash
    text, doc_id = (f"c{columns.index(x)}_{x}" for x in ("text", "doc_id"))
    keyed = named.withColumns({"k1": F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), "k2": F.xxhash64(text)})
    texts = keyed.select("k1", "k2", F.col(text).alias("text"))
    spans = byte_spans(texts, length).select("s1", "s2", "spans").unionByName(word_spans(texts, words).select("s1", "s2", "spans"))
    spans = spans.groupBy("s1", "s2").agg(F.sort_array(F.collect_list("spans")).alias("x")).select("s1", "s2", F.aggregate("x", F.lit(b""), lambda x, y: F.concat(x, y)).alias("spans"))
    both, names = _with(keyed, spans, "spans").drop("k1", "k2"), named.columns

    def cut(batches):
        for batch in slices(batches, text, 8 << 20):
            found, own, stays = batch.column("spans"), batch.column(text), np.ones(len(batch), bool)
            if found.null_count < len(batch):
                new = own.to_pylist()
                for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    spans, raw = merged_spans(np.frombuffer(found[i].as_py(), np.int64).reshape(-1, 2)), new[i].encode()
                    rest = whole_characters(raw, spans)
                    new[i], stays[i] = rest.decode("utf-8", "replace"), bool(rest.strip() or not raw.strip())
                own = pa.array(new, own.type)
            yield pa.RecordBatch.from_arrays([own if c == text else batch.column(c) for c in names], names).filter(pa.array(stays))

    return both.mapInArrow(released(cut), named.schema).toDF(*columns)


def digest(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs)


#: All strings of 400 bytes and all windows of 51 words by their MD5, their runs as islands of starts.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw FROM documents),
s AS (SELECT rid, raw, unnest(range(greatest(0, octet_length(raw) - 399))) AS i FROM d),
h AS (SELECT rid, i, md5(raw[i + 1 : i + 400]) AS h FROM s),
hits AS (SELECT rid, i FROM h SEMI JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
islands AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 400, true)::INT AS fresh FROM hits)),
spans AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM islands GROUP BY rid, k),
cut AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
edges AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT rid, max(b), 9223372036854775807 FROM spans GROUP BY rid),
kept AS (SELECT rid, sha256(unhex(string_agg(hex(CASE WHEN b = 9223372036854775807 THEN raw[a + 1 :] WHEN b > a THEN raw[a + 1 : b] ELSE ''::BLOB END), '' ORDER BY a))) AS kept_sha256 FROM edges JOIN d USING (rid) GROUP BY rid),
lists AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS gaps, strlen(regexp_extract(text, '^[\x20\x09-\x0D]*')) AS lead FROM d),
w AS (SELECT rid, lead, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word, unnest(list_slice(gaps, CASE WHEN lead > 0 THEN 2 ELSE 1 END, len(gaps)) || CASE WHEN len(words) > len(gaps) - (lead > 0)::INT THEN [''] ELSE [] END) AS gap FROM lists WHERE len(words) > 0),
placed AS (SELECT rid, k, lead + sum(strlen(word) + strlen(gap)) OVER (PARTITION BY rid ORDER BY k) - strlen(word) - strlen(gap) AS a, strlen(word) AS n FROM w),
windows AS (SELECT rid, unnest(range(1, len(words) - 49)) AS k, words FROM lists WHERE len(words) > 50),
named AS (SELECT rid, k, md5(array_to_string(words[k : k + 50], ' ')) AS h FROM windows),
said AS (SELECT n.rid, x.a, y.a + y.n AS b FROM (SELECT rid, k FROM named SEMI JOIN (SELECT h FROM named GROUP BY h HAVING count(*) > 1) USING (h)) n JOIN placed x ON x.rid = n.rid AND x.k = n.k JOIN placed y ON y.rid = n.rid AND y.k = n.k + 50),
runs AS (SELECT rid, a, b, sum(fresh) OVER (PARTITION BY rid ORDER BY a) AS k FROM (SELECT *, coalesce(a > lag(b) OVER (PARTITION BY rid ORDER BY a), true)::INT AS fresh FROM said)),
told AS (SELECT rid, sum(n)::BIGINT AS passage_bytes, count(*) AS passages FROM (SELECT rid, max(b) - min(a) AS n FROM runs GROUP BY rid, k) GROUP BY rid)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept_sha256, sha256(raw)) AS kept_sha256,
  coalesce(passage_bytes, 0)::BIGINT AS passage_bytes, coalesce(passages, 0)::BIGINT AS passages
FROM d LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN told USING (rid)
"""
