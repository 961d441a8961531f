"""Versions side by side: line regions of text, CSV and Markdown, the first difference of binary content.

Alignment is inherently sequential, so it runs in Arrow-batched functions, one pair of texts at a time; choosing the
comparison, and the binary one, are column expressions. A region is (kind, left_start, left_count, right_start, right_count).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EQUAL, ADDED, REMOVED, CHANGED = "Equal", "Added", "Removed", "Changed"
REGION = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(f, T.LongType()) for f in ("left_start", "left_count", "right_start", "right_count"))])
TEXT_EXTENSIONS = ("txt", "log", "ini", "cfg", "conf")


def comparator(left_path: Column) -> Column:
    """markdown, csv, text or binary, by the left file's extension."""
    name = F.substring_index(left_path, "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return F.when(ext == "md", "markdown").when(ext == "csv", "csv").when(ext.isin(*TEXT_EXTENSIONS), "text").otherwise("binary")


def lines_of(text: str | None) -> list[str]:
    """Lines without a byte-order mark and with CRLF as LF; a final line end makes no further line."""
    text = (text or "").removeprefix("﻿").replace("\r\n", "\n")
    if not text:
        return []
    return text.removesuffix("\n").split("\n")


def decode(content: bytes) -> str:
    """UTF-8, or UTF-16 if it begins with its byte-order mark."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    return content.decode("utf-8", "replace")


SMALL = 512  # lines of a side whose masks are all made at once
MASK_BYTES = 32 << 20  # of masks of a larger side that are kept


class _Masks:
    """Where each value stands in a long list, as the bits of an integer: made when asked for, a bounded number is kept."""

    def __init__(self, b: list[int]):
        values = np.array(b)
        self.order = np.argsort(values, kind="stable")
        self.values, self.starts = np.unique(values[self.order], return_index=True)
        self.ends, self.at, self.size = np.append(self.starts[1:], len(b)), {int(v): i for i, v in enumerate(self.values)}, len(b)
        self.kept: dict[int, int] = {}

    def get(self, x: int) -> int | None:
        if x in self.kept:
            return self.kept[x]
        i = self.at.get(x)
        if i is None:
            return None
        places = self.order[self.starts[i] : self.ends[i]]
        if len(places) == 1:
            return 1 << int(places[0])
        bits = np.zeros(self.size, np.uint8)
        bits[places] = 1
        mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(self.kept) * self.size < 8 * MASK_BYTES:
            self.kept[x] = mask
        return mask


def _steps(a: list[int], b: list[int]) -> int:
    """Bit j is set where the longest common subsequence of ``a`` with the first j + 1 of ``b`` is longer than with the first j.

    The known bit-parallel recurrence: one addition takes a line of ``a`` past all of ``b``.
    """
    full = (1 << len(b)) - 1
    if len(b) <= SMALL:
        masks: dict[int, int] = {}
        for j, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << j
    else:
        masks = _Masks(b)
    v, get = full, masks.get
    for n, x in enumerate(a):
        if mask := get(x):
            u = v & mask
            v = (v + u) | (v ^ u)
            if n % 1024 == 0:
                v &= full  # carries past the end
    return ~v & full


def _cut(a: list[int], al: int, mid: int, ar: int, b: list[int]) -> int:
    """The first place at which ``b`` may be cut so that the halves of ``a`` have the longest subsequences together."""
    n, ahead, back = len(b), _steps(a[al:mid], b), _steps(a[mid:ar][::-1], b[::-1])
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little").astype(np.int64)
    return int(np.argmax(np.concatenate([[0], np.cumsum(bits(ahead) - bits(back)[::-1])])))


def matches(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a longest common subsequence, in linear space by halving the left side.

    Of several best cuts of the right side the first is taken, and a single line meets its first equal: that fixes
    which of several longest subsequences is meant. Time is the product of the lines over the bits of a word.
    """
    known: dict[str, int] = {}
    a, b = ([known.setdefault(x, len(known)) for x in side] for side in (left, right))
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ar, bl, br = todo.pop()
        if al == ar or bl == br:
            continue
        if ar - al == 1 or br - bl == 1:
            try:
                found.append((al, b.index(a[al], bl, br)) if ar - al == 1 else (a.index(b[bl], al, ar), bl))
            except ValueError:  # not there
                pass
            continue
        mid = (al + ar) // 2
        cut = bl + _cut(a, al, mid, ar, b[bl:br])
        todo += [(mid, ar, cut, br), (al, mid, bl, cut)]
    return found


def regions(left: list[str], right: list[str]) -> list[tuple[str, int, int, int, int]]:
    """A partition of both sides: runs of equal lines, and between them pairs of changed lines, then what one side has more."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    pairs = matches(left, right)
    for k, (x, y) in enumerate([*pairs, (len(left), len(right))]):
        gone, new = x - i, y - j
        both = min(gone, new)
        if both:
            out.append((CHANGED, i, both, j, both))
        if gone > both:
            out.append((REMOVED, i + both, gone - both, j + both, 0))
        if new > both:
            out.append((ADDED, i + both, 0, j + both, new - both))
        if k < len(pairs):
            if out and not gone and not new:  # goes on with the run of equal lines before
                _, a, n, b, _ = out.pop()
                out.append((EQUAL, a, n + 1, b, n + 1))
            else:
                out.append((EQUAL, x, 1, y, 1))
        i, j = x + 1, y + 1
    return out


def delimiter(lines: list[str]) -> str:
    """The most frequent of comma, semicolon and tab outside quotes in the first line that isn't empty."""
    first = next((x for x in lines if x), "")
    bare = "".join(first.replace('""', "").split('"')[::2])
    return max(",;\t", key=bare.count)


def cells(line: str, by: str) -> list[str]:
    """The fields of one line: quotes at a field's start enclose it, doubled quotes inside stand for one."""
    out, text, inside, quoted, i = [], "", False, False, 0
    while i < len(line):
        ch = line[i]
        if inside:
            if ch == '"' and line[i + 1 : i + 2] == '"':
                text, i = text + ch, i + 1
            elif ch == '"':
                inside = False
            else:
                text += ch
        elif ch == by:
            out.append(text)
            text, quoted = "", False
        elif ch == '"' and not text and not quoted:
            inside = quoted = True
        else:
            text += ch
        i += 1
    return [*out, text]


def csv_regions(left: list[str], right: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Changed regions whose paired lines have the same cells are equal; other delimiters on both sides change everything."""
    a, b = delimiter(left), delimiter(right)
    if a != b:
        return [(CHANGED, 0, len(left), 0, len(right))] if left or right else []
    out = []
    for kind, i, n, j, m in regions(left, right):
        same = kind == CHANGED and all(cells(x, a) == cells(y, a) for x, y in zip(left[i : i + n], right[j : j + m], strict=False))
        out.append((EQUAL if same else kind, i, n, j, m))
    return out


def headings(lines: list[str]) -> dict[int, str]:
    """Lines that are headings of one to six # outside fences; a fence that stays open hides the rest."""
    found, fenced = {}, False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            level = len(line) - len(line.lstrip("#"))
            if 1 <= level <= 6 and line[level : level + 1] in ("", " ", "\t"):
                found[i] = line
    return found


def markdown_regions(left: list[str], right: list[str]) -> list[tuple[str, int, int, int, int]]:
    """A region that isn't equal and whose sides have different headings is changed as a whole."""
    a, b = headings(left), headings(right)
    out = []
    for kind, i, n, j, m in regions(left, right):
        if kind != EQUAL and {a[x] for x in range(i, i + n) if x in a} != {b[x] for x in range(j, j + m) if x in b}:
            kind = CHANGED
        out.append((kind, i, n, j, m))
    return out


BY_KIND = {"text": regions, "csv": csv_regions, "markdown": markdown_regions}


@F.pandas_udf(T.ArrayType(REGION))
def _line_regions(kind: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    found = [BY_KIND[k](lines_of(x), lines_of(y)) for k, x, y in zip(kind, left, right, strict=True)]
    return pd.Series([[dict(zip(REGION.names, r, strict=True)) for r in rows] for rows in found])


def line_regions(kind: Column, left: Column, right: Column) -> Column:
    """Regions of two texts; ``kind`` is text, csv or markdown."""
    return _line_regions(kind, left, right)


@F.pandas_udf(T.ArrayType(REGION))
def _content_regions(kind: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    text = lambda c: "" if c is None else decode(bytes(c))
    found = [BY_KIND[k](lines_of(text(x)), lines_of(text(y))) for k, x, y in zip(kind, left, right, strict=True)]
    return pd.Series([[dict(zip(REGION.names, r, strict=True)) for r in rows] for rows in found])


def content_regions(kind: Column, left: Column, right: Column) -> Column:
    """Regions of two files' contents, in UTF-8 or marked UTF-16."""
    return _content_regions(kind, left, right)


class DiffRegions:
    """Rows of REGION for one pair of texts."""

    def eval(self, kind: str, left: str, right: str):
        yield from BY_KIND[kind](lines_of(left), lines_of(right))


def register(spark: SparkSession) -> None:
    """The table function ``diff_regions(kind, left, right)``, for SQL: ``FROM pairs, LATERAL diff_regions('text', l, r)``."""
    spark.udtf.register("diff_regions", F.udtf(DiffRegions, returnType=REGION))


def binary_region(left: Column, right: Column) -> Column:
    """A region of the first differing byte, or of the whole surplus of one side; null if the contents are equal.

    The offset is found by halving with native comparisons of prefixes, so large values need no function of ours.
    """
    n, m = F.octet_length(left), F.octet_length(right)
    low = F.least(n, m)
    steps = F.sequence(F.lit(1), F.lit(32))
    start = F.struct(F.lit(0).alias("lo"), low.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substr(left, s["lo"] + 1, mid - s["lo"]) == F.substr(right, s["lo"] + 1, mid - s["lo"])
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    common = F.aggregate(steps, start, halve)["lo"].cast("long")

    def region(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), common.alias("left_start"), a.cast("long").alias("left_count"), common.alias("right_start"), b.cast("long").alias("right_count"))

    return (
        F.when(common < low, region(CHANGED, F.lit(1), F.lit(1)))
        .when(n > m, region(REMOVED, n - m, F.lit(0)))
        .when(m > n, region(ADDED, F.lit(0), m - n))
    )
