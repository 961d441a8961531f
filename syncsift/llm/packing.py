"""Hierarchical multi-length packing of token ids into sequences of several context sizes, none over ``window`` ids.

Each document's ids (a public tokenizer's, then the end id 1) are routed by length: whole windows at once, and the rest
to the tier of its length, the smallest of the context sizes (the powers of two from ``shortest`` to ``window``) that
holds it. A pool of rests is packed as it fills, from the longest tier to the shortest: the longest rest opens a sequence
of its tier's size, and the gap is filled with the longest rests of shorter tiers that fit; when none fits, the shortest
is cut to fill the gap exactly, and what is left of it is routed anew. So every sequence of every tier is full. What a
task has left at its end, less than one sequence of a tier, becomes sequences at powers of two, which need no padding. The
sequences of a tier are dealt to step groups of equally many tokens, in serpentine order of their attention cost (sum of
squared piece lengths), so that steps take like times.

Packing runs where the documents are read: no text or id is shuffled, a hot source or a group of copies changes nothing,
a task holds one slice of texts and one bounded pool, and a task that is run again on the same rows gives the same
rows. Ids are looked up by white-space separated chunk in a bounded cache: the tokenizer's rules never join what white
space separates. Chunks that the cache lacks are encoded together, those of plain Latin letters by the same ranked merges
in another public library (the word end is a byte of its own there), all others by the tokenizer itself.

Defined results: a null or empty text is the end id alone; a null doc_id is kept; rows that repeat a doc_id are packed
as documents of their own; ties of length go by the order of reading; an empty table gives no rows; other columns are
ignored, whatever their names; a text longer than ``window`` is cut at its multiples.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from syncsift.llm.common import arrow, binary_of, only, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
END = np.array([1], "<u4").tobytes()
#: Where these occur a text's case is left to the tokenizer: before special tokens and before combining marks.
CASED = (b"<|", b"\xcc", b"\xcd")
MARK = "\x01"  # ends a word, in place of the tokenizer's word end
#: The tokenizer's pieces of a chunk (fixed values), and the line break that separates chunks.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n"
#: What only the tokenizer itself encodes: special tokens, controls, and letters that normalisation may change.
OTHER = r"<\||[^\x21-\x7e\xa1-\u012f\u0131-\u017f\u2013-\u2026]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordMerges:
    """Ids of plain chunks by the tokenizer's merges, ranked by the id that they make."""

    def __init__(self, tokenizer_path: str):
        import regex
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        mark, ranks = MARK.encode(), {}
        for word, i in vocabulary.items():
            end = word.endswith("</w>") and len(word) > 4
            own = bytes(map(byte_of.__getitem__, word[:-4] if end else word)) + (mark if end else b"")
            if mark not in own[: -1 if end else None]:
                ranks[own] = i
        self.line = ranks[b"\n" + mark]
        ranks[mark] = max(ranks.values()) + 1  # always merged with the byte before it
        self.encode = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces, self.other = regex.compile(PIECES).findall, regex.compile(OTHER).search

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks in which ``other`` finds nothing."""
        if not chunks:
            return []
        ids = np.array(self.encode(MARK.join(self.pieces("\n".join(chunks).lower() + "\n")) + MARK), "<u4")
        ends = np.flatnonzero(ids == self.line)
        data, stops = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in stops)], stops, strict=False)]


class ChunkIds:
    """Ids of texts, as little-endian 32-bit bytes, chunk by chunk of what white space separates."""

    def __init__(self, tokenizer_path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.most, self.known = Tokenizer.from_file(tokenizer_path), WordMerges(tokenizer_path), most, {}

    def learn(self, chunks: set[bytes]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, chunks
        plain, other = [], []
        for chunk in new:
            (other if self.merges.other(chunk.decode()) else plain).append(chunk)
        for a in range(0, len(plain), 50_000):
            some = plain[a : a + 50_000]
            self.known.update(zip(some, self.merges.of([x.decode() for x in some]), strict=True))
        for a in range(0, len(other), 5_000):
            some = other[a : a + 5_000]
            for chunk, e in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(e.ids, "<u4").tobytes()

    def of(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if any(x in t for x in CASED) else t.lower()).split() for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) + END for chunks in split]


class Packer:
    """Packs the ids of documents; gives back rows of closed sequences."""

    def __init__(self, window: int, shortest: int, first_id: int, pool_tokens: int, group_tokens: int):
        self.window, self.shortest, self.next, self.limit, self.group_tokens = window, shortest, first_id, pool_tokens, group_tokens
        self.pool, self.tokens, self.count, self.rows, self.next_group = [], 0, 0, [], first_id

    def tier(self, n: int) -> int:
        return max(self.shortest, 1 << (n - 1).bit_length())

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        for k in range(n // self.window):
            self.close([(doc_id, k * self.window, ids[4 * k * self.window : 4 * (k + 1) * self.window], n)])
        if n % self.window:
            a = n - n % self.window
            self.pool.append((n - a, -self.count, doc_id, a, ids[4 * a :], n))
            self.tokens += n - a
            self.count += 1
        if self.tokens >= self.limit:
            self.pack()

    def close(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) // 4 for p in pieces)
        cost = sum((len(p[2]) // 4) ** 2 for p in pieces)
        out = []
        for doc_id, start, ids, n in pieces:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset, total))
            offset += len(ids) // 4
        self.rows.append((total, cost, out))
        self.next += 1

    def pack(self) -> None:
        """Closes sequences until less is left than the tier of the longest rest needs."""
        pool = sorted(self.pool, key=lambda p: p[:2])
        while pool and self.tokens >= (size := self.tier(pool[-1][0])):
            gap, pieces = size, []
            self.tokens -= size
            while gap:
                k = bisect.bisect_left(pool, (gap + 1,), key=lambda p: p[:1]) - 1
                n, _, doc_id, start, ids, whole = pool.pop(max(k, 0))
                pieces.append((doc_id, start, ids[: 4 * gap], whole))
                if n > gap:  # only longer ones are left: the shortest is cut
                    bisect.insort(pool, (n - gap, -self.count, doc_id, start + gap, ids[4 * gap :], whole), key=lambda p: p[:2])
                    self.count += 1
                gap -= min(n, gap)
            self.close(pieces)
        self.pool = pool

    def finish(self) -> None:
        self.pack()
        self.tail(self.pool)
        self.pool, self.tokens = [], 0

    def tail(self, pool: list[tuple]) -> None:
        """Less than a sequence of a tier is left: sequences at its powers of two, from the largest."""
        left = sum(p[0] for p in pool)
        queue = [p[2:] for p in pool]  # from its end
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                gap, pieces = 1 << bit, []
                while gap:
                    doc_id, start, ids, n = queue.pop()
                    take = min(gap, len(ids) // 4)
                    pieces.append((doc_id, start, ids[: 4 * take], n))
                    if 4 * take < len(ids):
                        queue.append((doc_id, start + take, ids[4 * take :], n))
                    gap -= take
                self.close(pieces)

    def taken(self) -> pa.RecordBatch | None:
        """The rows so far; step groups hold sequences of one tier."""
        if not self.rows:
            return None
        of, by_size = {}, {}
        for i, (total, cost, _) in enumerate(self.rows):
            by_size.setdefault(total, []).append((-cost, i))
        for total, own in sorted(by_size.items()):
            groups = -(-len(own) * total // self.group_tokens)
            for k, (_, i) in enumerate(sorted(own)):
                turn, at = divmod(k, groups)
                of[i] = self.next_group + (at if turn % 2 == 0 else groups - 1 - at)
            self.next_group += groups
        flat = [(*row, of[i]) for i, (_, _, rows) in enumerate(self.rows) for row in rows]
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], names)


def packed(batches: Iterator[pa.RecordBatch], ids_of: Callable[[list[bytes]], list[bytes]], packer: Packer) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw, at = binary_of(batch.column("text"))
        data, at = raw.tobytes(), at.tolist()
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of([data[a:b] for a, b in zip(at, at[1:], strict=False)]), strict=True):
            packer.add(doc_id, ids)
        if (found := packer.taken()) is not None:
            yield found
    packer.finish()
    if (found := packer.taken()) is not None:
        yield found


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = 2048, shortest: int = 256, pool_tokens: int = 1 << 19, group: int = 32) -> DataFrame:
    """A row for each piece: SCHEMA. tier is the length of its sequence, step_group the step that its sequence is dealt to.

    ``window`` and ``shortest`` are powers of two; a step group has the tokens of ``group`` windows at most.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        yield from packed(batches, ChunkIds(path).of, Packer(window, shortest, TaskContext.get().partitionId() << 40, pool_tokens, group * window))

    return arrow(run, only(docs, "doc_id", "text"), SCHEMA)
