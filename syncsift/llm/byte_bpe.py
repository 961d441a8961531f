"""Byte-level BPE encoding and decoding: words fold in column expressions, with a public rank file.

A text is cut by the public pattern; each distinct word is a fold of ranked merges over its bytes, by higher-order
functions. The rank of a merge is the id of what it makes, so the literal rank map goes from a pair of ids to an id: row
a of the map lies displaced in one array, whose places hold their row's a beside the id. The pairs of single bytes have
an array of their own. One fold step finds the least rank of a word's neighbouring pairs, merges its leftmost place and
looks up the two new pairs. Words of more than ``long_word`` bytes merge all places of the least rank in a step, as a
string replacement: a word then needs as many steps as it has different merges, not as many as merges.

Everything is done where the texts are read, and nothing is shuffled, broadcast or collected: Spark cuts the texts, an Arrow
pass numbers the words, expressions fold the bytes of those that are new in a slice of documents, and a second Arrow pass puts the
ids in the numbers' places. A word that is a piece of the rank file has its id for a number, as in the public library; of the
other words each is folded once for a task, or once for each ``held_words`` distinct words of a very large task, which then
begins anew. So a task's memory is bounded, and a lost task is simply run again. To fold a word once for the whole table
instead, the numbered texts have to meet the folded words by a shuffle, which took 2.1 times the input's size of disk.

Decoding is a column expression over the ids: it looks up each id's bytes in a literal array and concatenates them.

Defined results: a null or empty text has no tokens; a null doc_id is kept; rows that repeat a doc_id are encoded one by
one; an empty table gives no rows; other columns are ignored, whatever their names; a very long text is one row of a slice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructType

from syncsift.llm.common import binary_of, only, released

BASE = 65_536
SLOTS = 1 << 19
BITS = 17  # of an id
NONE = 1 << BITS  # the rank of no merge
SEPARATOR = "\x1f"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def pieces_of(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * (1 + max(i for i, _ in pairs))
    for i, piece in pairs:
        out[i] = piece
    return out


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, owners, made, of_bytes): the pair (a, b) merges to made[starts[a] + b] if owners[starts[a] + b] is a.

    of_bytes[256 * x + y] is what the bytes x and y merge to, or NONE.
    """
    pieces = pieces_of(path)
    ids = {p: i for i, p in enumerate(pieces) if p}
    rows = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    a, b, i = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    order = np.argsort(a, kind="stable")
    edges = np.searchsorted(a[order], np.arange(len(pieces) + 1))
    starts, owners, made = np.zeros(len(pieces), np.int32), np.full(SLOTS, -1, np.int32), np.zeros(SLOTS, np.int32)
    rng = np.random.default_rng(1)
    for x in np.argsort(-(edges[1:] - edges[:-1]), kind="stable"):
        own = order[edges[x] : edges[x + 1]]
        if not len(own):
            break
        while True:
            start = int(rng.integers(SLOTS - len(pieces)))
            if (owners[start + b[own]] < 0).all():
                break
        starts[x], owners[start + b[own]], made[start + b[own]] = start, x, i[own]
    of_bytes = np.array([ids.get(bytes([x, y]), NONE) for x in range(256) for y in range(256)])
    return starts, owners, made, of_bytes


def _ints(values, kind: str = "int") -> Column:
    """A literal array; constant folding parses it once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(path: str) -> Column:
    """A struct of all that lookups read, so that a plan holds it once: with_literals() binds it to a name."""
    starts, owners, made, of_bytes = pair_table(path)
    pieces = pieces_of(path)
    single = {p: i for i, p in enumerate(pieces) if len(p) == 1}
    own = np.array([single[bytes([b])] for b in range(256)])
    return F.struct(
        _ints(starts).alias("starts"),
        _ints(owners).alias("owners"),
        _ints(made).alias("made"),
        _ints(of_bytes << BITS | np.repeat(own, 256), "bigint").alias("of_bytes"),
        _ints(own).alias("bytes"),
        F.split(F.lit(SEPARATOR.join(chr(BASE + i) for i in range(len(pieces)))), SEPARATOR).alias("chars"),
    )


def with_literals(table: Column, body) -> Column:
    return _let(table, lambda t: body(Folds(t)))


class Folds:
    """Expressions over the bound literals of one rank file."""

    def __init__(self, table: Column):
        self.starts, self.owners, self.made, self.of_bytes, self.bytes, self.chars = (table[x] for x in ("starts", "owners", "made", "of_bytes", "bytes", "chars"))

    def rank(self, a: Column, b: Column) -> Column:
        """The id that a pair of ids merges to, or null."""
        at = F.get(self.starts, a) + b
        return F.when(F.get(self.owners, at) == a, F.get(self.made, at))

    def of_each_byte(self, word: Column, body) -> Column:
        """``body`` of each byte's value and the next one's, which is null at the end."""
        return F.transform(word, lambda x, i: body(x, F.get(word, i + 1)))

    def folded(self, word: Column) -> Column:
        """The ids of a word, an array of its bytes' values. The state has one number for each id: below it the id, above it the rank of the pair it begins.

        Equal least numbers are the same pair, so the first of them is the leftmost place of the least rank.
        """
        lone = lambda i: F.lit(NONE << BITS).bitwiseOR(i)
        id_of = lambda x: x.bitwiseAND(F.lit(NONE - 1)).cast("int")
        begun = lambda a, b: F.shiftleft(F.coalesce(self.rank(a, b), F.lit(NONE)).cast("long"), BITS).bitwiseOR(a.cast("long"))
        byte = lambda x, y: F.coalesce(F.get(self.of_bytes, x * 256 + y), lone(F.get(self.bytes, x).cast("long")))
        start = self.of_each_byte(word, byte)

        def merge(s: Column, m: Column, at: Column) -> Column:  # at, from 1: the place of m, whose pair is made into an id
            made = F.shiftright(m, BITS).cast("int")
            new = _let(F.get(s, at + 1), lambda after: F.when(after.isNull(), lone(made.cast("long"))).otherwise(begun(made, id_of(after))))
            gone = F.lit(-1).cast("long")
            put = lambda x, i: F.when((i > at) | (i < at - 2), x).when(i == at - 1, new).when(i == at, gone).otherwise(begun(id_of(x), made))
            return F.filter(F.transform(s, put), lambda x: x >= 0)

        def step(s: Column, _: Column) -> Column:
            found = lambda m: _let(F.array_position(s, m).cast("int"), lambda at: merge(s, m, at))
            return _let(F.array_min(s), lambda m: F.when(m < NONE << BITS, found(m)).otherwise(s))

        return F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(word) - 1)), start, step), id_of)

    def ids(self, chars: Column) -> Column:
        return F.transform(F.filter(F.split(chars, ""), lambda c: c != ""), lambda c: F.ascii(c) - BASE)

    def folded_long(self, word: Column, most_steps: int) -> Column:
        """The same for long words: a step replaces each place of the least pair, from the left, until none is left.

        Ids are characters here. A step uses up one rank, so there are no more steps than ids, nor than bytes.
        """
        one = lambda i: F.get(self.chars, i)
        start = F.array_join(self.of_each_byte(word, lambda x, _: one(F.get(self.bytes, x))), "")
        state = lambda text, more: F.struct(text.alias("text"), more.alias("more"))

        def step(s: Column, _: Column) -> Column:
            def best(ids: Column) -> Column:
                pair = lambda x, y: F.struct(self.rank(x, y).alias("m"), x.alias("a"), y.alias("b"))
                pairs = F.filter(F.transform(F.slice(ids, 1, F.size(ids) - 1), lambda x, i: pair(x, F.get(ids, i + 1))), lambda p: p["m"].isNotNull())
                merged = lambda p: state(F.replace(s["text"], F.concat(one(p["a"]), one(p["b"])), one(p["m"])), F.lit(True))
                return _let(F.array_min(pairs), lambda p: F.when(p.isNotNull(), merged(p)).otherwise(state(s["text"], F.lit(False))))

            return F.when(~s["more"] | (F.char_length(s["text"]) < 2), s).otherwise(_let(self.ids(s["text"]), best))

        return self.ids(F.aggregate(F.sequence(F.lit(1), F.least(F.size(word), F.lit(most_steps))), state(start, F.lit(True)), step)["text"])


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern; its white space is that of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def encode_word(folds: Folds, word: Column, long_word: int, most_steps: int) -> Column:
    n = F.size(word)
    return F.when(n <= long_word, folds.folded(word)).otherwise(folds.folded_long(word, most_steps))


def _number(path: str, held_words: int, piece_bytes: int, row_words: int = 1 << 14):
    """(doc_id, words) to (doc_id, codes), after rows with the bytes of the words that are new; the first of them says whether numbers begin anew."""
    names, of_bytes = ["doc_id", "codes", "anew", "words"], pa.list_(pa.list_(pa.int32()))

    def listed(words: list[str]) -> pa.Array:
        raw = [w.encode() for w in words]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))
        return pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids, new = pieces_of(path), {}, []
        for i, piece in enumerate(pieces):
            try:
                ids[piece.decode()] = i
            except UnicodeDecodeError:  # a part of a character is no word
                continue

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                code = ids.get(word)
                if code is None:
                    code = len(pieces) + self.rest
                    self.rest += 1
                    new.append(word)
                self[word] = code
                return code

        def begun() -> Numbers:
            numbers = Numbers()
            numbers.rest = 0
            return numbers

        numbers, anew = begun(), True
        for batch in batches:
            words = batch.column("words")
            ends = words.offsets.to_numpy()
            bytes_at = binary_of(words.values)[1][ends]
            start = 0
            while start < len(batch):
                end = min(max(start + 1, int(np.searchsorted(bytes_at, bytes_at[start] + piece_bytes, side="right")) - 1), len(batch))
                found = words.values.slice(int(ends[start]), int(ends[end] - ends[start])).dictionary_encode()
                code_of = np.fromiter(map(numbers.__getitem__, found.dictionary.to_pylist()), np.int32, len(found.dictionary))
                for a in range(0, len(new), row_words) if new else (0,) if anew else ():
                    row = [pa.nulls(1, batch.schema.field("doc_id").type), pa.nulls(1, pa.binary()), pa.array([anew]), listed(new[a : a + row_words])]
                    yield pa.RecordBatch.from_arrays(row, names)
                    anew = False
                new.clear()
                codes = code_of[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int32)
                cuts = pa.py_buffer(((ends[start : end + 1] - ends[start]) * 4).astype(np.int32))
                own = [batch.column("doc_id").slice(start, end - start), pa.BinaryArray.from_buffers(pa.binary(), end - start, [None, cuts, pa.py_buffer(codes)]), pa.nulls(end - start, pa.bool_()), pa.nulls(end - start, of_bytes)]
                yield pa.RecordBatch.from_arrays(own, names)
                start = end
                if numbers.rest > held_words:
                    numbers, anew = begun(), True

    return released(run)


def _filled(path: str, most_ids: int = 1 << 18):
    """Numbers to ids: (doc_id, ids, ids_bytes) of the rows with codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(pieces_of(path))
        parts, lengths, flat = [], [], None
        for batch in batches:
            told = np.flatnonzero(batch.column("words").is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([-1, *told.tolist()], [*told.tolist(), len(batch)], strict=True):
                if a >= 0:
                    if batch.column("anew")[a].as_py():
                        parts, lengths = [np.arange(known, dtype=np.int32)], [np.ones(known, np.int64)]
                    ids, flat = batch.column("words").slice(a, 1).flatten(), None
                    parts.append(ids.flatten().to_numpy().astype(np.int32, copy=False))
                    lengths.append(ids.value_lengths().to_numpy().astype(np.int64))
                rows = batch.slice(a + 1, b - a - 1)
                if len(rows) and flat is None:
                    flat, size = np.concatenate(parts), np.concatenate(lengths)
                    begin = np.cumsum(size) - size
                    parts, lengths = [flat], [size]
                start = 0
                while start < len(rows):
                    raw, n = [], 0
                    while start + len(raw) < len(rows) and (not raw or n < most_ids // 2):
                        raw.append(np.frombuffer(rows.column("codes")[start + len(raw)].as_py(), np.int32))
                        n += len(raw[-1])
                    codes = np.concatenate(raw)
                    own = size[codes]
                    ends = np.cumsum(own)
                    out = flat[np.repeat(begin[codes] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<i4")
                    at = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum([len(x) for x in raw])]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").slice(start, len(raw)), pa.ListArray.from_arrays(pa.array(at), pa.array(out)), pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(at * 4), pa.py_buffer(out)])],
                        ["doc_id", "ids", "ids_bytes"],
                    )
                    start += len(raw)

    return released(run)


def decoded(ids: Column, ranks_path: str | None = None) -> Column:
    """The bytes of an array of ids, concatenated."""
    pieces = [piece.decode("iso-8859-1") for piece in pieces_of(ranks_path or default_ranks())]
    separator = chr(BASE)  # no byte
    of_id = F.split(F.lit(separator.join(pieces)), separator)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(of_id, i)), ""), "ISO-8859-1")


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, long_word: int = 256, held_words: int = 1 << 19, piece_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, ids array<int>, ids_bytes of four little-endian bytes each) for every row of ``docs``."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    doc_id, most = docs.schema["doc_id"].dataType, len(pieces_of(path))
    numbered = StructType().add("doc_id", doc_id).add("codes", BinaryType()).add("anew", BooleanType()).add("words", ArrayType(ArrayType(IntegerType())))
    done = StructType().add("doc_id", doc_id).add("ids", ArrayType(IntegerType())).add("ids_bytes", BinaryType())
    texts = only(docs, "doc_id", "text").select("doc_id", words_of(F.col("text"), pattern).alias("words"))
    folded = with_literals(literals(path), lambda f: F.transform("words", lambda w: encode_word(f, w, long_word, most))).alias("words")
    return texts.mapInArrow(_number(path, held_words, piece_bytes), numbered).select("doc_id", "codes", "anew", folded).mapInArrow(_filled(path), done)


def digest(docs: DataFrame) -> DataFrame:
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
