"""Content hashes: SHA-256 as native expressions over a content column, and by path on the executors, BLAKE3 among them."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncsift.schema import TICKS_AT_EPOCH, WINDOW

#: Fixed values of the published BLAKE3 algorithm: initial words and the permutation of message words between rounds.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
PIECE = 1 << 18  # bytes that are read at a time: 256 chunks, a whole subtree
RANGE = 1 << 26  # bytes of a file that are one task's: a whole subtree, too
SIDE = 1 << 11  # blocks that are compressed side by side: their words fit a core's cache
HELD = 1 << 22  # bytes of small contents that are hashed side by side


def windows(content: Column, size: Column, window: int = WINDOW) -> Column:
    """What a partial hash is of: the whole if it has at most two windows, else its first and last window."""
    ends = F.concat(F.substring(content, 1, window), F.substr(content, (size - window + 1).cast("int"), F.lit(window)))
    return F.when(size <= 2 * window, content).otherwise(ends)


def partial_hash(content: Column, size: Column, window: int = WINDOW) -> Column:
    return F.sha2(windows(content, size, window), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def partial_bytes(size: Column, window: int = WINDOW) -> Column:
    return F.least(size, F.lit(2 * window))


def _orders() -> list[list[int]]:
    """For each round the message words in the order that _compressed reads them: four columns' first and second words, then four diagonals'."""
    words, out = list(range(16)), []
    for _ in range(7):
        out.append([words[i] for i in (0, 2, 4, 6, 1, 3, 5, 7, 8, 10, 12, 14, 9, 11, 13, 15)])
        words = [words[i] for i in PERMUTATION]
    return out


ORDERS = _orders()


def _turned(x: np.ndarray, k: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint32(k), out=spare)
    np.left_shift(x, np.uint32(32 - k), out=x)
    np.bitwise_or(x, spare, out=x)


def _compressed(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression function over many blocks at once, a column for each: 8 rows of chaining words and 16 of message words.

    The state is four arrays of four rows, so that a step mixes four columns of the state of all blocks by one array operation.
    """
    n = cv.shape[1]
    a, b, c, d = cv[:4].copy(), cv[4:].copy(), np.empty((4, n), np.uint32), np.empty((4, n), np.uint32)
    c[:] = np.array(IV[:4], np.uint32)[:, None]
    d[0], d[1], d[2], d[3] = counter & 0xFFFFFFFF, counter >> 32, size, flags
    spare = np.empty((4, n), np.uint32)
    for order in ORDERS:
        m = block[order]
        for half in (0, 8):
            if half:  # diagonals as columns
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            for at, p, q in ((half, 16, 12), (half + 4, 8, 7)):
                a += b
                a += m[at : at + 4]
                d ^= a
                _turned(d, p, spare)
                c += d
                b ^= c
                _turned(b, q, spare)
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
    return np.concatenate([a ^ c, b ^ d])


def _chunk_nodes(padded: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The chaining values (n, 8) of chunks, rows of 1024 bytes of which ``sizes`` count; ``alone``: the chunk is all there is."""
    out = np.empty((len(sizes), 8), np.uint32)
    blocks = np.maximum(1, -(-sizes // 64))
    order = np.argsort(-blocks, kind="stable")  # chunks that have a block of a number come first
    for at in range(0, len(order), SIDE):
        own = order[at : at + SIDE]
        words = np.ascontiguousarray(padded[own].view("<u4").astype(np.uint32, copy=False).reshape(len(own), 16, 16).transpose(1, 2, 0))
        last, size, number, root = blocks[own], sizes[own], numbers[own], ROOT * alone[own]
        cv = np.repeat(np.array(IV, np.uint32)[:, None], len(own), axis=1)
        for i in range(int(last[0])):
            k = int(np.searchsorted(-last, -i, side="left"))
            ends = last[:k] - 1 == i
            flags = START * (i == 0) + END * ends + root[:k] * ends
            cv[:, :k] = _compressed(cv[:, :k], words[i, :, :k], number[:k], np.clip(size[:k] - 64 * i, 0, 64), flags)
        out[own] = cv.T
    return out


def _joined(nodes: np.ndarray, counts: np.ndarray, root: np.ndarray) -> np.ndarray:
    """One node for each of several runs of ``counts`` nodes of one height, the last of a run perhaps lower; ``root``: it is the root.

    Left subtrees hold the largest power of two of chunks, so pairing neighbours level by level builds the same tree; the
    last node of an odd number goes up as it is. The runs go up side by side.
    """
    counts, root = np.asarray(counts, np.int64), np.asarray(root, bool)
    while (counts > 1).any():
        pairs, up = counts // 2, -(-counts // 2)
        begin, place = np.cumsum(counts) - counts, np.cumsum(up) - up
        within = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left, to = np.repeat(begin, pairs) + 2 * within, np.repeat(place, pairs) + within
        flags = PARENT + ROOT * np.repeat(root & (counts == 2), pairs)
        above = np.empty((int(up.sum()), 8), np.uint32)
        for at in range(0, len(left), SIDE):
            own = left[at : at + SIDE]
            n = len(own)
            cv = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
            found = _compressed(cv, np.concatenate([nodes[own].T, nodes[own + 1].T]), np.zeros(n, np.int64), np.full(n, 64), flags[at : at + SIDE])
            above[to[at : at + SIDE]] = found.T
        odd = counts % 2 == 1
        above[(place + up - 1)[odd]] = nodes[(begin + counts - 1)[odd]]
        nodes, counts = above, up
    return nodes


def _nodes(pieces: list[bytes], firsts: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The node over each piece, whose first chunk has the number ``firsts``; the chunks of all pieces are compressed side by side."""
    lengths = np.array([len(x) for x in pieces], np.int64)
    counts = np.maximum(1, -(-lengths // 1024))
    begin = np.cumsum(counts) - counts
    padded = np.zeros((int(counts.sum()), 1024), np.uint8)
    flat = padded.reshape(-1)
    for x, at, n in zip(pieces, (begin * 1024).tolist(), lengths.tolist(), strict=True):
        flat[at : at + n] = np.frombuffer(x, np.uint8)
    sizes = np.full(len(padded), 1024)
    sizes[begin + counts - 1] = lengths - 1024 * (counts - 1)
    within = np.arange(len(padded)) - np.repeat(begin, counts)
    chunks = _chunk_nodes(padded, sizes, np.repeat(firsts, counts) + within, np.repeat(root & (counts == 1), counts))
    return _joined(chunks, counts, root)


def _node(data: bytes, first: int, root: bool) -> np.ndarray:
    """The node over some chunks, ``first`` the number of the first."""
    return _nodes([data], np.array([first]), np.array([root]))


def _up(two: np.ndarray, root: bool) -> np.ndarray:
    """The parent of two nodes."""
    return _joined(two, [2], [root])


def nodes_of(pieces: list[bytes], starts: list[int], root: list[bool]) -> list[bytes]:
    """BLAKE3's nodes over many pieces; HELD bytes of small ones, or a PIECE of a large one, are held as chunks at a time."""
    out: list[bytes] = []
    some: list[int] = []
    held = 0

    def done() -> None:
        found = _nodes([pieces[i] for i in some], np.array([starts[i] // 1024 for i in some], np.int64), np.array([root[i] for i in some], bool))
        out.extend(row.tobytes() for row in found.astype("<u4"))
        some.clear()

    for i, piece in enumerate(pieces):
        if len(piece) > PIECE or held + len(piece) > HELD or len(some) >= HELD // 1024:
            if some:
                done()
            held = 0
        if len(piece) > PIECE:
            h = Blake3(starts[i] // 1024)
            for at in range(0, len(piece), PIECE):
                h.update(piece[at : at + PIECE])
            out.append(h.node(root[i]))
            continue
        some.append(i)
        held += len(piece)
    if some:
        done()
    return out


class Blake3:
    """BLAKE3 of bytes that come in pieces, or its node over a range of them; holds PIECE bytes and a node for each height.

    ``first`` is the number of the first chunk: a range has to begin at a multiple of its length, a power of two of chunks.
    """

    def __init__(self, first: int = 0):
        self.first, self.pieces, self.held, self.waiting = first, 0, bytearray(), []

    def update(self, data: bytes) -> None:
        self.held += data
        while len(self.held) > PIECE:  # the last piece waits: it may be the root's
            now = _node(bytes(self.held[:PIECE]), self.first + self.pieces * (PIECE // 1024), False)
            del self.held[:PIECE]
            self.pieces += 1
            full = self.pieces
            while full % 2 == 0:
                now, full = _up(np.concatenate([self.waiting.pop(), now]), False), full // 2
            self.waiting.append(now)

    def node(self, root: bool = True) -> bytes:
        now = _node(bytes(self.held), self.first + self.pieces * (PIECE // 1024), root and not self.waiting)
        for i, left in enumerate(self.waiting[::-1]):
            now = _up(np.concatenate([left, now]), root and i == len(self.waiting) - 1)
        return now[0].astype("<u4").tobytes()

    def hexdigest(self) -> str:
        return self.node().hex()


def blake3(data: bytes) -> str:
    """The 256-bit BLAKE3 hash in lowercase hex."""
    return nodes_of([data], [0], [True])[0].hex()


def blake3_root(nodes: list[bytes]) -> str:
    """The hash from the nodes of a file's ranges in order: a single one is the root itself."""
    return blake3_roots([nodes])[0]


def blake3_roots(files: list[list[bytes]]) -> list[str]:
    """blake3_root of many files, whose trees go up side by side."""
    if not files:
        return []
    nodes = np.frombuffer(b"".join(n for nodes in files for n in nodes), "<u4").astype(np.uint32).reshape(-1, 8)
    return [row.tobytes().hex() for row in _joined(nodes, [len(nodes) for nodes in files], np.ones(len(files), bool)).astype("<u4")]


def hasher(algorithm: str):
    return Blake3() if algorithm == "blake3" else hashlib.new(algorithm)


# ---- files by path

STATE = T.StructType([T.StructField("size", T.LongType()), T.StructField("mtime_ticks", T.LongType()), T.StructField("file_id", T.StringType())])
READ = T.StructType([T.StructField("hash", T.StringType()), T.StructField("error", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("before", STATE), T.StructField("after", STATE)])
NODE = T.StructType([T.StructField("node", T.BinaryType()), *READ.fields[1:]])


def _state(f) -> tuple[int, int, str]:
    s = os.fstat(f.fileno())
    return s.st_size, s.st_mtime_ns // 100 + TICKS_AT_EPOCH, str(s.st_ino)


def _feed(f, h, start: int, n: int) -> int:
    """Feeds n bytes from ``start``, at most PIECE at a time; how many there were."""
    f.seek(start)
    got = 0
    while got < n:
        data = f.read(min(PIECE, n - got))
        if not data:
            break
        h.update(data)
        got += len(data)
    return got


def _read(path: str, h, spans: list[tuple[int, int]], guarded: bool, marked: bool) -> tuple:
    """(error, bytes read, state before, state after) of feeding spans (start, length) of a file to ``h``; the file's state brackets the read."""
    got, before, after = 0, None, None
    try:
        if marked and guarded:
            raise OSError(f"{path}: a placeholder is never opened")
        with open(path, "rb", buffering=0) as f:
            before = _state(f)
            for start, n in spans:
                found = _feed(f, h, start, n)
                got += found
                if found < n:
                    raise OSError(f"{path}: {found} bytes at {start} where {n} were listed")
            after = _state(f)
    except OSError as e:
        return str(e), got, before, after
    return None, got, before, after


def path_hasher(window: int | None = WINDOW, algorithm: str = "sha256", guarded: bool = True):
    """A function (path, size, placeholder) -> READ that reads files on the executors; ``window`` None: whole files.

    Files are read in pieces of at most PIECE bytes, so a file may be larger than an executor's memory. The file's size, time and id
    are taken from the open file before and after the read. A file that can't be read, is shorter than listed or is a placeholder
    gets an error and no hash; the bytes that were read are counted in any case. It isn't deterministic to the optimiser, which
    would otherwise evaluate it twice below a filter on its result. ``guarded`` False opens placeholders, for tests of the gate.
    """

    @F.pandas_udf(READ)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, sizes, marked in batches:
            rows = []
            for path, size, online_only in zip(paths, sizes, marked, strict=True):
                h, size = hasher(algorithm), int(size)
                spans = [(0, size)] if window is None or size <= 2 * window else [(0, window), (size - window, window)]
                told = _read(path, h, spans, guarded, bool(online_only))
                rows.append((None if told[0] else h.hexdigest(), *told))
            yield pd.DataFrame(rows, columns=READ.names).astype({"bytes": "int64"})

    return run.asNondeterministic()


def range_hasher(range_bytes: int = RANGE, guarded: bool = True):
    """A function (path, size, placeholder, number) -> NODE: BLAKE3's node over one range of a file, which any task may compute."""
    if range_bytes < PIECE or range_bytes & (range_bytes - 1):
        raise ValueError(f"a range is a power of two of at least {PIECE} bytes, not {range_bytes}")

    @F.pandas_udf(NODE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for path, size, online_only, number in zip(*columns, strict=True):
                size, start = int(size), int(number) * range_bytes
                h = Blake3(start // 1024)
                told = _read(path, h, [(start, min(range_bytes, size - start))], guarded, bool(online_only))
                rows.append((None if told[0] else h.node(root=size <= range_bytes), *told))
            yield pd.DataFrame(rows, columns=NODE.names).astype({"bytes": "int64"})

    return run.asNondeterministic()


@F.pandas_udf(T.StringType())
def root_of(nodes: pd.Series) -> pd.Series:
    """blake3_root of an array<binary> column of nodes in order; null stays null."""
    found = iter(blake3_roots([[bytes(n) for n in x] for x in nodes if x is not None]))
    return pd.Series([None if x is None else next(found) for x in nodes], dtype=object)


def tree_hashed(files: DataFrame, range_bytes: int = RANGE, guarded: bool = True) -> DataFrame:
    """(path, hash, error, bytes, before, after): each file's BLAKE3 from the nodes of its ranges; ``files`` has path, size and is_placeholder.

    Ranges, not files, are dealt to tasks, so a large file is many tasks' work; its nodes, 32 bytes for each range, meet by path.
    ``before`` and ``after`` are the least and the largest state that any of the reads saw, equal if the file never changed.
    """
    ranges = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes)).cast("int") - 1)
    dealt = files.select("path", "size", "is_placeholder", F.explode(ranges).alias("number")).repartition("path", "number")
    read = dealt.withColumn("r", range_hasher(range_bytes, guarded)("path", "size", "is_placeholder", "number"))
    per = read.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("number", "r.node"))).alias("nodes"), F.min("r.error").alias("error"), F.sum("r.bytes").alias("bytes"),
        F.least(F.min("r.before"), F.min("r.after")).alias("before"), F.greatest(F.max("r.before"), F.max("r.after")).alias("after"),
    )
    return per.select("path", root_of(F.when(F.col("error").isNull(), F.col("nodes.node"))).alias("hash"), "error", "bytes", "before", "after")


@F.pandas_udf(T.BinaryType())
def node_of(piece: pd.Series, start: pd.Series, whole: pd.Series) -> pd.Series:
    """BLAKE3's node over a piece of a content that begins at byte ``start``; ``whole``: there is no other piece."""
    return pd.Series(nodes_of([bytes(x) for x in piece], start.tolist(), whole.tolist()), dtype=object)


def content_tree_hashed(rows: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(path, ranges int, hash): BLAKE3 of a content column (path, size, content), its pieces dealt to tasks; a power of two from 1024."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(range_bytes).cast("long"))
    pieces = F.transform(starts, lambda at: F.struct(at.alias("start"), F.substr("content", (at + 1).cast("int"), F.lit(range_bytes)).alias("piece")))
    dealt = rows.select("path", F.size(starts).alias("ranges"), F.explode(pieces).alias("e")).repartition("path", "e.start")
    nodes = dealt.select("path", "ranges", "e.start", node_of("e.piece", "e.start", F.col("ranges") == 1).alias("node"))
    per = nodes.groupBy("path", "ranges").agg(F.sort_array(F.collect_list(F.struct("start", "node"))).alias("nodes"))
    return per.select("path", "ranges", root_of("nodes.node").alias("hash"))


@F.pandas_udf(T.StringType())
def blake3_of(content: pd.Series) -> pd.Series:
    """BLAKE3 of a content column."""
    held = [bytes(x) for x in content if x is not None]
    found = iter(nodes_of(held, [0] * len(held), [True] * len(held)))
    return pd.Series([None if x is None else next(found).hex() for x in content], dtype=object)
