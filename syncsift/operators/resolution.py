"""Which member of a group stays. Input rows: a group key, path, size, mtime_ticks; output: the same with ``kept`` and ``reason``.

The member that stays is the least by an order of columns: an aggregate joined back, not a window, since one group may hold
very many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncsift.functions import names
from syncsift.operators.verdicts import KEY

Keys = tuple[str, ...]


def newest() -> list[Column]:
    """The newest, then the largest, then the first path is the least."""
    return [(-F.col("mtime_ticks")).alias("a"), (-F.col("size")).alias("b"), F.col("path").alias("path")]


def largest() -> list[Column]:
    return [(-F.col("size")).alias("a"), (-F.col("mtime_ticks")).alias("b"), F.col("path").alias("path")]


def _failing(bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(F.lit(True))


def _plan(rows: DataFrame, order: list[Column], reason: str, keys: Keys) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("best_"), F.count("*").alias("n_"))
    best = best.where(_failing(F.col("n_") < 2, "a plan needs a group of two members at least")).select(*keys, F.col("best_.path").alias("best_"))
    kept = rows.join(best, list(keys)).withColumn("kept", F.col("path") == F.col("best_")).drop("best_")
    return kept.withColumn("reason", F.when(~F.col("kept"), F.lit(reason)))


def keep_newest(rows: DataFrame, keys: Keys = KEY) -> DataFrame:
    return _plan(rows, newest(), "keep-newest", keys)


def keep_largest(rows: DataFrame, keys: Keys = KEY) -> DataFrame:
    return _plan(rows, largest(), "keep-largest", keys)


def keep_machine(rows: DataFrame, machine: str, keys: Keys = KEY, strict: bool = True, first_path: bool = False) -> DataFrame:
    """The version of one machine stays: the newest of those whose name has its mark, or the first by path (``first_path``).

    A group without one raises if ``strict``; otherwise it is left out.
    """
    mine = names.basename(F.col("path")).contains(f"-DESKTOP-{machine}")
    groups = rows.groupBy(*keys).agg(F.bool_or(mine).alias("has_"))
    good = _failing(~F.col("has_"), f"no version of machine {machine} in a group") if strict else F.col("has_")
    marked = rows.join(groups.where(good).select(*keys), list(keys))
    order = [F.col("path").alias("path")] if first_path else newest()
    return _plan(marked, [(~mine).alias("other"), *order], f"keep-machine:{machine}", keys)


def keep_manual(rows: DataFrame, choices: DataFrame, keys: Keys = KEY) -> DataFrame:
    """``choices`` has (key, chosen): the path that stays; a chosen path outside its group raises."""
    chosen = rows.join(choices, list(keys))
    groups = chosen.groupBy(*keys).agg(F.bool_or(F.col("path") == F.col("chosen")).alias("there_"))
    checked = chosen.join(groups.where(_failing(~F.col("there_"), "the chosen path isn't in its group")).select(*keys), list(keys))
    return _plan(checked, [(F.col("path") != F.col("chosen")).alias("other"), F.col("path").alias("path")], "keep-manual", keys).drop("chosen")


def sacrifices(plan: DataFrame) -> DataFrame:
    return plan.where("not kept")
