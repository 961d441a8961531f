"""Online-only files: bits, kinds, and the gate that keeps their content unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attribute bits, in the order in which one kind is chosen from several.
BITS = (("offline", 0x1000), ("recall_on_open", 0x40000), ("recall_on_data_access", 0x400000), ("reparse_point", 0x400))
#: The order in which a report lists kinds.
LISTED = ("reparse_point", "recall_on_data_access", "recall_on_open", "offline")
_BIT = dict(BITS)


def has_bit(attributes: Column, kind: str) -> Column:
    return attributes.bitwiseAND(F.lit(_BIT[kind])) != 0


def is_placeholder(attributes: Column, kind: Column) -> Column:
    return kind.isNotNull() | (attributes.bitwiseAND(F.lit(sum(_BIT.values()))) != 0)


def classify(attributes: Column, kind: Column) -> Column:
    """The kind that the source marked, else by the first bit set; null for an ordinary file."""
    by_bit = F.coalesce(*(F.when(has_bit(attributes, name), F.lit(name)) for name, _ in BITS))
    return F.coalesce(kind, by_bit)


def kinds(attributes: Column, kind: Column) -> Column:
    """All kinds of a file, each once, in the report's order."""
    found = F.array(*(F.when(has_bit(attributes, name) | F.coalesce(kind == name, F.lit(False)), F.lit(name)) for name in LISTED))
    return F.filter(found, lambda x: x.isNotNull())


def split(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose content may be read, placeholders)."""
    marked = is_placeholder(F.col("attributes"), F.col("placeholder_kind"))
    return inventory.where(~marked), inventory.where(marked)


def records(inventory: DataFrame) -> DataFrame:
    """(path, kinds, size_bytes) of the placeholders."""
    return split(inventory)[1].select("path", kinds(F.col("attributes"), F.col("placeholder_kind")).alias("kinds"), F.col("size").alias("size_bytes"))
