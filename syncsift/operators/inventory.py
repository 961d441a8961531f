"""From raw rows of a source to the ordered inventory: mark placeholders, leave out the reserved folder, refuse repeats and depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncsift.functions import names, placeholders
from syncsift.schema import MAX_DEPTH, RESERVED

SIDECAR = ".placeholder-meta.json"


def in_reserved(path: Column, root: str, reserved: str = RESERVED) -> Column:
    return path.startswith(f"{root.rstrip('/')}/{reserved}/")


def identity() -> tuple[Column, Column]:
    """(volume, file) of a row; a row without a file id has the identity of its path."""
    known = F.col("file_id").isNotNull() & (F.col("file_id") != "")
    return F.when(known, F.col("volume_id")), F.when(known, F.col("file_id")).otherwise(names.path_identity(F.col("path")))


@dataclass
class Inventory:
    """files: what a scan works on; errors: (path, message); counts: one row of files_enumerated, files_placeholder, files_excluded, files_rejected."""

    files: DataFrame
    errors: DataFrame
    counts: DataFrame


def judged(rows: DataFrame, root: str, max_depth: int = MAX_DEPTH, reserved: str = RESERVED) -> DataFrame:
    """Each row with its ``fate``: excluded, repeated, too_deep or kept; the order of the rules decides.

    A row refused for its depth still holds its identity, so identities are ranked before.
    """
    seen = rows.withColumn("placeholder_kind", placeholders.classify(F.col("attributes"), F.col("placeholder_kind")))
    seen = seen.withColumn("is_placeholder", placeholders.is_placeholder(F.col("attributes"), F.col("placeholder_kind")))
    seen = seen.withColumn("excluded_", in_reserved(F.col("path"), root, reserved))
    # The first path of an identity stays, a later one is a loop or a second link. Rows that aren't excluded sort first.
    rank = F.row_number().over(Window.partitionBy(*identity()).orderBy("excluded_", "path"))
    fate = F.when(F.col("excluded_"), "excluded").when(rank > 1, "repeated").when(names.depth(F.col("path"), root) > max_depth, "too_deep").otherwise("kept")
    return seen.withColumn("fate", fate).drop("excluded_")


def order(rows: DataFrame, root: str, max_depth: int = MAX_DEPTH, reserved: str = RESERVED) -> Inventory:
    if "error" in rows.columns:
        broken = rows.where(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
        rows = rows.where(F.col("error").isNull())
    else:
        broken = rows.where("false").select("path", F.lit("").alias("message"))
    all_rows = judged(rows, root, max_depth, reserved)
    message = F.when(F.col("fate") == "repeated", "identity already seen: a loop or a second link").otherwise(F.lit(f"deeper than {max_depth} levels"))
    errors = broken.unionByName(all_rows.where(F.col("fate").isin("repeated", "too_deep")).select("path", message.alias("message")))
    return Inventory(all_rows.where("fate = 'kept'").drop("fate"), errors, counted(all_rows))


def counted(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.agg(
        F.count_if(F.col("fate") == "kept").alias("files_enumerated"),
        F.count_if((F.col("fate") == "kept") & F.col("is_placeholder")).alias("files_placeholder"),
        F.count_if(F.col("fate") == "excluded").alias("files_excluded"),
        F.count_if(F.col("fate").isin("repeated", "too_deep")).alias("files_rejected"),
    )


def with_sidecars(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows without sidecar files; a file with a sidecar is a placeholder of the kind that the sidecar names.

    contents: (path, content) of sidecars. An unknown or broken kind is reparse_point.
    """
    known = [k for k, _ in placeholders.BITS]
    told = contents.where(F.col("path").endswith(SIDECAR)).select(
        F.expr(f"substring(path, 1, char_length(path) - {len(SIDECAR)})").alias("of_path"), F.get_json_object(F.col("content").cast("string"), "$.kind").alias("kind")
    )
    told = told.groupBy("of_path").agg(F.min("kind").alias("kind"))
    joined = rows.where(~F.col("path").endswith(SIDECAR)).join(told, F.col("path") == F.col("of_path"), "left")
    kind = F.when(F.col("of_path").isNotNull(), F.when(F.col("kind").isin(known), F.col("kind")).otherwise("reparse_point")).otherwise(F.col("placeholder_kind"))
    return joined.withColumn("placeholder_kind", kind).drop("of_path", "kind")


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, mtime_ticks, file_id) of inventory rows, for ``stability``."""
    return files.select("path", "size", "mtime_ticks", "file_id")


def snapshot_by_path(files: DataFrame) -> DataFrame:
    """The same where a volume has no file ids: a file is its path."""
    return files.select("path", "size", "mtime_ticks", F.col("path").alias("file_id"))


def divergence(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """The first of size, mtime and file id that differs between two states, as a reason; null if none does. A null on either side differs from nothing."""
    labels = (("size", "size"), ("mtime", "mtime_ticks"), ("file_id", "file_id"))
    say = lambda label, x, y: F.concat(F.lit(f"{label} diverged: pre="), x.cast("string"), F.lit(", post="), y.cast("string"))
    return F.coalesce(*(F.when(before[c] != after[c], say(label, before[c], after[c])) for label, c in labels))


def state(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("size", "mtime_ticks", "file_id")}


def listed() -> dict[str, Column]:
    """The state of an inventory row; an empty file id is none."""
    return state() | {"file_id": F.nullif(F.col("file_id"), F.lit(""))}


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, reason): the first of size, mtime and file id that differs between two snapshots makes a file unstable."""
    b, a = before.alias("b"), after.alias("a")
    reason = F.when(F.col("a.path").isNull(), F.lit("gone")).otherwise(divergence(state("b."), state("a.")))
    out = b.join(a, F.col("b.path") == F.col("a.path"), "left").select(F.col("b.path").alias("path"), reason.alias("reason"))
    return out.select("path", F.when(F.col("reason").isNull(), "Stable").otherwise("Unstable").alias("status"), "reason")
