"""A scan's identity from its content: the same classified tree has the same id, whenever it was scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncsift.operators.verdicts import KEY


def _joined(*fields: Column) -> Column:
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.concat(*(x for t in texts for x in (F.octet_length(t).cast("string"), F.lit(":"), t)))


def _folded(digests: DataFrame, keys: list[str], levels: tuple[int, ...]) -> DataFrame:
    """(keys, d): the digests ``d`` of each key as one, in levels by their first hex digits, so no row holds more than the digests of one beginning."""
    for digits in (*levels, 0):
        begin = F.substring("d", 1, digits) if digits else F.lit("")
        one = F.concat(F.min(begin), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n").cast("binary"), 256))
        digests = digests.groupBy(*keys, begin.alias("p_")).agg(one.alias("d")).drop("p_")
    return digests


def scan_fingerprint(members: DataFrame) -> DataFrame:
    """(operation_id): 16 hex digits over all groups, identical and conflicting ones with their hashes.

    Each member is digested where it is. A group's members are digested in two levels by the first hex digits of their own
    digests, and the groups in three: neither a group of very many files nor the scan is one row.
    """
    line = _joined(F.col("path"), F.col("size"), F.col("mtime_ticks"), F.col("volume_id"), F.col("file_id"), F.when(F.col("verdict").isin("identical_duplicate", "real_conflict"), F.col("full")))
    each = members.select(*KEY, "verdict", F.sha2(line.cast("binary"), 256).alias("d"))
    tag = F.when(F.col("verdict") == "identical_duplicate", "i").when(F.col("verdict") == "real_conflict", "r").otherwise("g")
    groups = _folded(each, [*KEY, "verdict"], (3,))
    level = _folded(groups.select(F.sha2(_joined(tag, F.col("base"), F.col("size"), F.col("d")).cast("binary"), 256).alias("d")), [], (4, 2))
    return level.select(F.substring(F.sha2(F.col("d").cast("binary"), 256), 1, 16).alias("operation_id"))
