"""The cascade: candidate groups by (base name, size), partial hashes, full hashes, one verdict for each group.

No shuffle carries content, and no content is hashed before its group asks for it. Where content is a column, the keys of the
members wanted become a bit array of bounded size, and the scan hashes the rows that it marks; where files are read by
path, only members of candidate groups are, behind the group filter. A group of very many members is a partial aggregate
on each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncsift.functions import hashing, names, placeholders
from syncsift.operators import inventory
from syncsift.schema import WINDOW
from syncsift.tables import written

KEY = ("base", "size")
MOST_BITS = 24  # of the bit array that marks members: two megabytes


def with_base(files: DataFrame) -> DataFrame:
    return files.withColumn("base", names.normalize_base_name(names.basename(F.col("path"))))


def grouped_rows(files: DataFrame) -> DataFrame:
    """Readable files whose (base, size) has at least two members, with ``members``; the folder plays no part.

    The count is an aggregate joined back, not a window: one (base, size) may hold very many files.
    """
    keyed = with_base(placeholders.split(files)[0])
    counts = keyed.groupBy(*KEY).agg(F.count("*").alias("members")).where("members >= 2")
    return keyed.join(counts, list(KEY))


def candidate_groups(files: DataFrame) -> DataFrame:
    """(base, size, members array<path>), by (base, size); paths in byte order."""
    keyed = with_base(placeholders.split(files)[0])
    return keyed.groupBy(*KEY).agg(F.sort_array(F.collect_list("path")).alias("members")).where(F.size("members") >= 2)


def marker(keys: DataFrame, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A condition on a key: true for every key in the one column of ``keys``, and for some others.

    The bit array has 16 bits for each key, 2^most_bits at most; its words come to the driver and become a literal. With
    more keys than that it lets more others pass, up to all of them: that costs hashes, never a result.
    """
    key, top = F.col(keys.columns[0]), 1 << most_bits
    hashed = F.pmod(F.xxhash64(key), F.lit(top))
    placed = keys.select(F.shiftright(hashed, 6).cast("int").alias("word"), hashed.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = placed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    # As many bits as the keys ask for: the words of a smaller array are those of the largest one laid over each other.
    n = sum((r["bits"] & ((1 << 64) - 1)).bit_count() for r in found)
    bits = min(most_bits, max(10, math.ceil(math.log2(16 * n + 1))))
    words = np.zeros(1 << max(0, bits - 6), np.int64)
    for r in found:
        words[r["word"] % len(words)] |= r["bits"]
    table = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    word, bit = (lambda k: F.shiftright(at(k), 6).cast("int")), (lambda k: at(k).bitwiseAND(F.lit(63)).cast("int"))
    return lambda k: F.call_function("getbit", F.get(table, word(k)), bit(k)) == 1


Contents = DataFrame | Callable[[DataFrame], DataFrame]


def _marked(rows: Contents, wanted: DataFrame) -> DataFrame:
    """The content rows of the paths ``wanted``, and some others; a function reads where they lie."""
    found = rows(wanted) if callable(rows) else rows
    return found.where(marker(wanted.select("path"))(F.col("path")))


def partial_content(candidates: DataFrame, rows: Contents, window: int = WINDOW, blake3: bool = False) -> DataFrame:
    """``candidates`` with partial, read_error and bytes_partial, written: the first stage of hashed_content."""
    c = F.col("content")
    error = F.when(c.isNull(), "no content").when(F.octet_length(c) < F.col("size"), "shorter than listed")
    windows = hashing.windows(c, F.col("size"), window)
    found = hashing.blake3_of(windows) if blake3 else hashing.partial_hash(c, F.col("size"), window)
    known = with_known(candidates)
    first = _marked(rows, known.where("known_partial IS NULL")).select("path", found.alias("found"), error.alias("found_error"), F.octet_length(windows).cast("long").alias("bytes_partial"))
    told = F.col("read_error") if "read_error" in candidates.columns else F.lit(None).cast("string")
    wanted = F.col("known_partial").isNull()
    missing = F.when(F.col("found").isNull() & wanted, "no content")
    staged = known.join(first, "path", "left").withColumn("read_error", F.coalesce(told, F.when(wanted, F.col("found_error")), missing))
    staged = staged.withColumn("bytes_partial", F.when(wanted, F.col("bytes_partial")))  # others were read by chance, and are no member's
    return written(staged.withColumn("partial", F.coalesce("known_partial", "found")).drop("found", "found_error"))


def hashed_content(candidates: DataFrame, rows: Contents, window: int = WINDOW, blake3: bool = False) -> DataFrame:
    """``candidates`` with partial, full and read_error, staged, from ``rows`` (path, size, content), or a function that reads those of some paths.

    Partial hashes are of the members of candidate groups, full ones of members of groups whose partial hashes meet and
    that no error leaves open; both are made where the content is read. An absent or short content is an error, and so is
    what ``candidates`` name in a read_error column of theirs.
    """
    staged = partial_content(candidates, rows, window, blake3)
    c = F.col("content")
    go_on = staged.join(going_on(staged), list(KEY), "left_semi").where("known_full IS NULL").select("path")
    whole = hashing.blake3_of(c) if blake3 else hashing.full_hash(c)
    second = _marked(rows, go_on).select("path", whole.alias("found"), F.octet_length(c).cast("long").alias("bytes_full")).join(go_on, "path", "left_semi")
    return after_full(staged, second)


def with_known(candidates: DataFrame) -> DataFrame:
    """With known_partial and known_full, hashes of a cache, null where there is none."""
    return candidates.withColumns({c: F.lit(None).cast("string") for c in ("known_partial", "known_full") if c not in candidates.columns})


def going_on(staged: DataFrame) -> DataFrame:
    """(base, size) of the groups whose whole files are compared: some partial hashes meet, and none is missing."""
    per = staged.groupBy(*KEY).agg((F.count_distinct("partial") < F.count("*")).alias("meets"), F.bool_or(F.col("read_error").isNotNull()).alias("broken"))
    return per.where("meets and not broken").select(*KEY)


def after_full(staged: DataFrame, second: DataFrame) -> DataFrame:
    """Full hashes for the groups that go on, from a cache or from ``second`` (path, found, bytes_full).

    A full hash that a cache knows stays with its file, in ``cached_full``, whether the group goes on or not.
    """
    on = staged.join(going_on(staged).withColumn("goes_on", F.lit(True)), list(KEY), "left").join(second, "path", "left")
    full = F.when(F.col("goes_on"), F.coalesce("known_full", "found"))
    return on.withColumns({"full": full, "cached_full": F.coalesce("known_full", "found")}).drop("goes_on", "found", "known_partial", "known_full")


def hashed_paths(candidates: DataFrame, window: int = WINDOW, algorithm: str = "sha256", guarded: bool = True, range_bytes: int = hashing.RANGE) -> DataFrame:
    """As hashed_content, reading files by path on the executors; both stages are written, so that each file is read once.

    Each read is bracketed: a file whose size, time or id isn't that of the listing, before and after the read, is unstable, which is
    an error, and its hash isn't taken. Whole files are read in pieces; with BLAKE3 their ranges are tasks of their own.
    """
    read = hashing.path_hasher(window, algorithm, guarded)
    known = with_known(candidates)
    todo = with_read(known.where("known_partial IS NULL").withColumn("r", read("path", "size", "is_placeholder")), "partial", "read_error")
    done = known.where("known_partial IS NOT NULL").withColumns({"partial": F.col("known_partial"), "read_error": F.lit(None).cast("string"), "bytes_partial": F.lit(None).cast("long")})
    staged = written(todo.unionByName(done))
    go_on = staged.join(going_on(staged), list(KEY), "left_semi").where("known_full IS NULL").select("path", "size", "mtime_ticks", "file_id", "is_placeholder")
    if algorithm == "blake3":
        told = hashing.tree_hashed(go_on, range_bytes, guarded).select("path", F.struct("hash", "error", "bytes", "before", "after").alias("r"))
        second = go_on.join(told, "path")
    else:
        second = go_on.withColumn("r", hashing.path_hasher(None, algorithm, guarded)("path", "size", "is_placeholder"))
    second = written(with_read(second, "found", "full_error").select("path", "found", "full_error", F.col("bytes_full")))
    return after_full(staged, second)


def with_read(files: DataFrame, name: str, error: str) -> DataFrame:
    """A READ ``r`` as columns: the hash unless the file is unstable, the error, and bytes_partial or bytes_full."""
    unstable = F.coalesce(inventory.divergence(inventory.listed(), inventory.state("r.before.")), inventory.divergence(inventory.state("r.before."), inventory.state("r.after.")))
    why = F.coalesce(F.col("r.error"), unstable)
    out = files.withColumns({error: why, ("bytes_partial" if error == "read_error" else "bytes_full"): F.col("r.bytes")})
    return out.withColumn(name, F.when(F.col(error).isNull(), F.col("r.hash"))).drop("r")


def verdict(members: Column, partials: Column, partial_errors: Column, fulls: Column, full_errors: Column) -> Column:
    """The truth table over a group's aggregates."""
    return (
        F.when(partial_errors > 0, "unresolved")
        .when(partials == members, "eliminated_l2")
        .when(full_errors > 0, "unresolved")
        .when(fulls == 1, "identical_duplicate")
        .otherwise("real_conflict")
    )


def verdicts(hashed: DataFrame) -> DataFrame:
    """(base, size, members, verdict, hash): one row per candidate group; hash is that of an identical group.

    ``hashed`` has a row for each member of a group, with partial, full and read_error (of the partial read), and perhaps full_error.
    """
    full_error = F.col("full_error") if "full_error" in hashed.columns else F.lit(None)
    per = hashed.groupBy(*KEY).agg(
        F.count("*").alias("members"),
        F.count_distinct("partial").alias("dp"),
        F.count_if(F.col("read_error").isNotNull()).alias("pe"),
        F.count_distinct("full").alias("df"),
        F.count_if(full_error.isNotNull()).alias("fe"),
        F.min("full").alias("least_full"),
    )
    v = verdict(F.col("members"), F.col("dp"), F.col("pe"), F.col("df"), F.col("fe"))
    return per.select(*KEY, "members", v.alias("verdict"), F.when(v == "identical_duplicate", F.col("least_full")).alias("hash"))


def judged_members(hashed: DataFrame) -> DataFrame:
    """Each member with its group's verdict."""
    return hashed.join(verdicts(hashed).select(*KEY, "members", "verdict", "hash").withColumnRenamed("members", "group_members"), list(KEY))


def identical_duplicates(members: DataFrame) -> DataFrame:
    """(hash, size, files, kept_path) from judged_members."""
    found = members.where("verdict = 'identical_duplicate'").groupBy(*KEY, "hash").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return found.select("hash", "base", "size", "files", F.col("files")[0].alias("kept_path"))


def real_conflicts(members: DataFrame) -> DataFrame:
    """(base, size, files array<struct<path, hash>>) from judged_members."""
    return members.where("verdict = 'real_conflict'").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("path", F.col("full").alias("hash")))).alias("files"))


def unresolved_groups(members: DataFrame) -> DataFrame:
    """(base, size, files array<struct<path, reason>>): the members that could not be verified."""
    reason = F.coalesce("read_error", "full_error") if "full_error" in members.columns else F.col("read_error")
    bad = members.where("verdict = 'unresolved'").where(reason.isNotNull())
    return bad.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("path", reason.alias("reason")))).alias("files"))


def telemetry(counts: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counters, from decision tables alone: a task that runs again reads a file twice but counts once.

    files_skipped is the readable files in no candidate group, so the counters' invariants hold. A member counts as hashed
    where its hash decided, from a cache or not. Bytes are those that the reads themselves counted, also of members whose
    group stays open, and of reads that failed; what was read of a placeholder has its own counter.
    """
    full = F.col("verdict").isin("identical_duplicate", "real_conflict")
    both = F.coalesce("bytes_partial", F.lit(0)) + F.coalesce("bytes_full", F.lit(0))
    of_placeholders = F.sum(F.when(F.col("is_placeholder"), both)) if "is_placeholder" in members.columns else F.lit(0)
    sums = members.agg(
        F.count("*").alias("files_partial_hashed"),
        F.count_if(full).alias("files_full_hashed"),
        F.coalesce(F.sum("bytes_partial"), F.lit(0)).alias("bytes_read_partial"),
        F.coalesce(F.sum("bytes_full"), F.lit(0)).alias("bytes_read_full"),
        F.coalesce(of_placeholders, F.lit(0)).cast("long").alias("placeholder_bytes_read"),
    )
    both = merge_telemetry(counts.drop("files_rejected").unionByName(sums, allowMissingColumns=True))  # one row of two
    return both.select(
        "files_enumerated",
        "files_placeholder",
        "files_excluded",
        (F.col("files_enumerated") - F.col("files_placeholder") - F.col("files_partial_hashed")).alias("files_skipped"),
        "files_partial_hashed",
        "files_full_hashed",
        (F.col("bytes_read_partial") + F.col("bytes_read_full")).alias("bytes_read"),
        "bytes_read_partial",
        "bytes_read_full",
        "placeholder_bytes_read",
    )


def gated(t: DataFrame) -> DataFrame:
    """Telemetry that raises if any byte of a placeholder was read."""
    broken = F.when(F.col("placeholder_bytes_read") != 0, F.raise_error(F.lit("placeholder content was read")))
    return t.withColumn("placeholder_bytes_read", F.coalesce(broken.cast("long"), F.col("placeholder_bytes_read")))


def merge_telemetry(parts: DataFrame) -> DataFrame:
    """The sum of several telemetry rows, counter by counter."""
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in parts.columns))


def telemetry_violations(t: DataFrame, *keys: str) -> DataFrame:
    """(keys, violation): a message for each invariant that a telemetry row breaks."""
    rules = [
        ("files_enumerated <> files_placeholder + files_skipped + files_partial_hashed", "files_enumerated is not the sum of placeholders, skipped and partially hashed"),
        ("files_full_hashed > files_partial_hashed", "files_full_hashed exceeds files_partial_hashed"),
        ("bytes_read <> bytes_read_partial + bytes_read_full", "bytes_read is not the sum of its parts"),
        ("placeholder_bytes_read <> 0", "placeholder content was read"),
    ]
    return t.select(*keys, F.explode(F.filter(F.array(*(F.when(F.expr(r), F.lit(m)) for r, m in rules)), lambda x: x.isNotNull())).alias("violation"))


def conflict_bytes(members: DataFrame) -> DataFrame:
    """(base, size, files, total_bytes, spare_bytes) of each real conflict: what its versions hold, and what all but one hold."""
    n = F.count("*")
    return members.where("verdict = 'real_conflict'").groupBy(*KEY).agg(n.alias("files"), (n * F.col("size")).alias("total_bytes"), ((n - 1) * F.col("size")).alias("spare_bytes"))


def conflict_versions(members: DataFrame) -> DataFrame:
    """Members of real conflicts with ``suggested``: the newest, then largest, then first path is the version to keep."""
    found = members.where("verdict = 'real_conflict'")
    best = found.groupBy(*KEY).agg(F.min(F.struct((-F.col("mtime_ticks")).alias("a"), F.col("path").alias("path"))).alias("best_"))  # sizes are equal in a group
    return found.join(best.select(*KEY, F.col("best_.path").alias("best_")), list(KEY)).withColumn("suggested", F.col("path") == F.col("best_")).drop("best_")


def summary(telemetry_row: DataFrame, members: DataFrame) -> DataFrame:
    """The five figures of a scan: files, redundant copies, conflicts, placeholders, recoverable bytes (and those of duplicates alone)."""
    groups = members.select(*KEY, "verdict", "group_members").distinct()
    spare = F.when(F.col("verdict").isin("identical_duplicate", "real_conflict"), (F.col("group_members") - 1) * F.col("size")).otherwise(0)
    sums = groups.agg(
        F.coalesce(F.sum(F.when(F.col("verdict") == "identical_duplicate", F.col("group_members") - 1)), F.lit(0)).alias("identical_duplicates"),
        F.count_if(F.col("verdict") == "real_conflict").alias("real_conflicts"),
        F.coalesce(F.sum(spare), F.lit(0)).alias("recoverable_bytes"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "identical_duplicate", spare)), F.lit(0)).alias("recoverable_duplicate_bytes"),
    )
    told = telemetry_row.select(F.col("files_enumerated").alias("files_found"), F.col("files_placeholder").alias("placeholders_ignored"))
    return merge_telemetry(told.unionByName(sums, allowMissingColumns=True))
