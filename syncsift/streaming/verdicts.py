"""Verdicts that follow a stream of changes: one group's state for each (base, size), and a log of the verdicts that changed.

An event says that a file with given hashes has come to a group (by = 1) or has left it (by = -1); ``events`` makes them from two
hashed inventories. A group's state is how many members hold each hash, not who they are, so a group of very many
equal files is a few numbers. ``follow`` writes a row to the log whenever a group's verdict, hash or number of members changes; a
null verdict withdraws the one before. ``latest`` is the table of verdicts after the last batch, the same as a scan of all files.

Whole hashes may come later than partial ones: a group whose partial hashes meet is ``undecided`` until all its members have a
whole hash, which the files' next events bring. Defined results: a batch that is run again changes nothing; a hash that
leaves more often than it came counts as none; groups that have been empty keep a state of a few bytes, for the order of their log.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HASHED = ("base", "size", "partial", "full", "error")
EVENTS = "base string, size long, partial string, full string, error string, by int"
LOG = "base string, size long, members long, verdict string, hash string, version long"
STATE = "members long, errors long, partials string, fulls string, told string, version long"


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """EVENTS from two hashed inventories (path and HASHED): what changed leaves as it was and comes as it is. One shuffle on the path."""
    named = lambda df, x: df.select("path", F.struct(*HASHED).alias(x))
    both = named(before, "b").join(named(after, "a"), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    gone, come = (F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("e"), F.lit(by).alias("by"))) for x, by in (("b", -1), ("a", 1)))
    return both.select(F.explode(F.filter(F.array(gone, come), lambda x: x.isNotNull())).alias("x")).select("x.e.*", "x.by")


def verdict(members: int, errors: int, partials: Counter, fulls: Counter) -> tuple[str | None, str | None]:
    """The truth table over a group's counts: (verdict, hash of an identical group)."""
    if members < 2:
        return None, None
    if errors:
        return "unresolved", None
    if len(partials) == members:
        return "eliminated_l2", None
    if sum(fulls.values()) < members:
        return "undecided", None
    return ("identical_duplicate", next(iter(fulls))) if len(fulls) == 1 else ("real_conflict", None)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    members, errors, partials, fulls, told, version = state.get if state.exists else (0, 0, "{}", "{}", "", 0)
    partials, fulls = Counter(json.loads(partials)), Counter(json.loads(fulls))
    for f in frames:
        by = f["by"].astype(int)
        members, errors = members + int(by.sum()), errors + int(by[f["error"].notna()].sum())
        for counts, name in ((partials, "partial"), (fulls, "full")):
            for value, n in by.groupby(f[name]).sum().items():
                counts[value] += int(n)
    partials, fulls = +partials, +fulls
    found = [max(0, members) if members > 1 else 0, *verdict(members, errors, partials, fulls)]
    now = json.dumps(found)
    changed = now != told and not (told == "" and found[1] is None)
    state.update((members, errors, json.dumps(partials), json.dumps(fulls), now if changed else told, version + changed))
    if changed:
        yield pd.DataFrame([(*key, *found, version + 1)], columns=["base", "size", "members", "verdict", "hash", "version"])


def follow(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to the log in ``out`` what the streamed EVENTS change; runs until all that has arrived is done."""
    log = changes.groupBy("base", "size").applyInPandasWithState(_step, LOG, STATE, "append", GroupStateTimeout.NoTimeout)
    return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(base, size, members, verdict, hash) after the last batch."""
    log = spark.read.schema(LOG).parquet(out)
    last = log.groupBy("base", "size").agg(F.max_by(F.struct("members", "verdict", "hash"), "version").alias("e"))
    return last.select("base", "size", "e.*").where("verdict IS NOT NULL")
