"""The registered queries over the driver's tables, and the SQL that says the same.

Each query applies an operator to the inventory derived from ``documents`` (sources/derived.py); the SQL begins with that
module's common table expressions and restates the operator on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.functions import hashing, names, placeholders
from syncsift.plans import scan as scans
from syncsift.operators import cache, cachetable, compare, fingerprint, inventory, quarantine, report, reportlines, resolution, verdicts
from syncsift.sources import content, derived
from syncsift.streaming import incremental
from syncsift.streaming import verdicts as follow
from syncsift.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
ROOT, WINDOW = derived.ROOT, derived.WINDOW
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = derived.SQL + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- what the queries start from


@dataclass
class _Scan:
    """What a scan of the derived inventory decides, each table made once: judged rows (metadata) and members with verdicts."""

    judged: DataFrame
    hashed: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.judged.where("fate = 'kept'").drop("fate")

    @property
    def members(self) -> DataFrame:
        return verdicts.judged_members(self.hashed)

    @property
    def decidable(self) -> DataFrame:
        return self.members.where("verdict in ('identical_duplicate', 'real_conflict')")

    @property
    def telemetry(self) -> DataFrame:
        return verdicts.telemetry(inventory.counted(self.judged), self.members)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.judged(derived.inventory(spark, sf_dir).drop("content", "text"), ROOT)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("fate = 'kept'").drop("fate")


def _candidates(judged: DataFrame) -> DataFrame:
    broken = F.when(F.col("doc_id") % 17 == 4, "simulated")
    return written(verdicts.grouped_rows(judged.where("fate = 'kept'").drop("fate").withColumn("read_error", broken)).drop("members"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.inventory(spark, sf_dir).select("path", "size", "content")


def _scan(spark: SparkSession, sf_dir: str) -> _Scan:
    judged = written(_judged(spark, sf_dir))
    return _Scan(judged, written(verdicts.hashed_content(_candidates(judged), _contents(spark, sf_dir), WINDOW)))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).hashed


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).members


def _decidable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).decidable


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.counted(_judged(spark, sf_dir))


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).telemetry


# ---- inventory and names


@query("SELECT doc_id, path, fate, kind AS placeholder_kind FROM judged")
def l0_inventory(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "path", "fate", "placeholder_kind")


@query("SELECT fate, count(*)::BIGINT AS n FROM judged GROUP BY fate")
def inventory_fates(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("fate").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (fate = 'kept') AS files_enumerated, count(*) FILTER (fate = 'kept' AND kind IS NOT NULL) AS files_placeholder, count(*) FILTER (fate = 'excluded') AS files_excluded, count(*) FILTER (fate IN ('repeated', 'too_deep')) AS files_rejected FROM judged")
def reserved_exclusion(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("SELECT path, 'identity already seen: a loop or a second link' AS message FROM judged WHERE fate = 'repeated'")
def inode_dedup(spark, sf_dir):
    return inventory.order(derived.inventory(spark, sf_dir), ROOT).errors.where(F.col("message").startswith("identity"))


@query("SELECT path, depth::INT AS depth FROM marked")
def path_depth(spark, sf_dir):
    return derived.inventory(spark, sf_dir).select("path", names.depth(F.col("path"), ROOT).alias("depth"))


@query("SELECT path, 'deeper than 16 levels' AS message FROM judged WHERE fate = 'too_deep'")
def depth_reject(spark, sf_dir):
    return inventory.order(derived.inventory(spark, sf_dir), ROOT).errors.where(F.col("message").startswith("deeper"))


@query("SELECT doc_id, kind, kind IS NOT NULL AS is_placeholder FROM marked")
def placeholder_classify(spark, sf_dir):
    a, k = F.col("attributes"), F.col("placeholder_kind")
    return derived.inventory(spark, sf_dir).select("doc_id", placeholders.classify(a, k).alias("kind"), placeholders.is_placeholder(a, k).alias("is_placeholder"))


@query("SELECT path, array_to_string([x FOR x IN [CASE WHEN attributes & 1024 <> 0 OR kind = 'reparse_point' THEN 'reparse_point' END, CASE WHEN attributes & 4194304 <> 0 OR kind = 'recall_on_data_access' THEN 'recall_on_data_access' END, CASE WHEN attributes & 262144 <> 0 OR kind = 'recall_on_open' THEN 'recall_on_open' END, CASE WHEN attributes & 4096 <> 0 OR kind = 'offline' THEN 'offline' END] IF x IS NOT NULL], ',') AS kinds, size AS size_bytes FROM files WHERE is_placeholder")
def placeholder_kinds(spark, sf_dir):
    return placeholders.records(_files(spark, sf_dir)).select("path", F.array_join("kinds", ",").alias("kinds"), "size_bytes")


@query("SELECT is_placeholder, count(*) AS n, sum(size)::BIGINT AS total FROM files GROUP BY 1")
def placeholder_gate(spark, sf_dir):
    safe, held = placeholders.split(_files(spark, sf_dir))
    both = safe.select("is_placeholder", "size").unionByName(held.select("is_placeholder", "size"))
    return both.groupBy("is_placeholder").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("""SELECT m.path, CASE WHEN m.doc_id % 5 = 0 THEN CASE WHEN m.doc_id % 4 = 0 THEN 'offline' ELSE 'reparse_point' END ELSE m.placeholder_kind END AS placeholder_kind FROM marked m""")
def sidecar_join(spark, sf_dir):
    files = derived.inventory(spark, sf_dir)
    content = F.when(F.col("doc_id") % 4 == 0, '{"kind": "offline"}').when(F.col("doc_id") % 4 == 1, '{"kind": "other"}').otherwise("{broken")
    side = files.where("doc_id % 5 = 0").select(F.concat("path", F.lit(inventory.SIDECAR)).alias("path"), content.alias("content"))
    rows = files.select("path", "placeholder_kind").unionByName(side.select("path", F.lit(None).cast("string").alias("placeholder_kind")))
    return inventory.with_sidecars(rows, side).select("path", "placeholder_kind")


@query("SELECT doc_id, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, ' \\(conflicted copy\\)(\\.[^.]*)$', '\\1'), '-DESKTOP-[0-9A-Za-z]{6,12}(\\.[^.]*)$', '\\1'), ' \\(1\\)(\\.[^.]*)$', '\\1'), ' \\(2\\)(\\.[^.]*)$', '\\1'), '\\.sb-[0-9a-f]{1,32}(\\.[^.]*)$', '\\1') AS base FROM marked")
def normalize_names(spark, sf_dir):
    rows = derived.inventory(spark, sf_dir).withColumn("name", names.basename(F.col("path")))
    return rows.select("doc_id", "name", names.normalize_base_name(F.col("name")).alias("base"))


_ODD = {0: "/x", 1: "‮", 2: " ", 3: ".", 4: "/con.txt", 5: "/../y", 6: ""}
_ODD_SQL = "substr(path, 2) || ['/x', chr(8238), ' ', '.', '/con.txt', '/../y', ''][doc_id % 7 + 1]"


def _odd_names(spark, sf_dir):
    tail = F.element_at(F.array(*(F.lit(_ODD[k]) for k in range(7))), (F.col("doc_id") % 7).cast("int") + 1)
    return derived.inventory(spark, sf_dir).select("doc_id", F.concat(F.expr("substring(path, 2)"), tail).alias("name"))


_STEMS = "'CON', 'PRN', 'AUX', 'NUL', " + ", ".join(f"'{port}{n}'" for port in ("COM", "LPT") for n in range(1, 10))
#: Whether ``n`` is a safe relative path: each component for itself, then the extension.
_VALID = f"""(n <> '' AND NOT regexp_matches(n, '[\\x00-\\x1f\\x7f]') AND len(list_filter(string_split(n, '/'), lambda x: x IN ('', '.', '..') OR right(x, 1) IN ('.', ' ') OR upper(split_part(x, '.', 1)) IN ({_STEMS}))) = 0
 AND (NOT contains(string_split(n, '/')[-1], '.') OR length(string_split(string_split(n, '/')[-1], '.')[-1]) <= 255))"""


@query(f"SELECT doc_id, len(list_filter(string_split(name, ''), lambda c: unicode(c) IN (8206, 8207, 1564) OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8294 AND 8297)) > 0 AS bidi FROM (SELECT doc_id, {_ODD_SQL} AS name FROM inv)")
def bidi_flag(spark, sf_dir):
    return _odd_names(spark, sf_dir).select("doc_id", names.has_bidi(F.col("name")).alias("bidi"))


@query(f"SELECT doc_id, {_VALID} AS valid FROM (SELECT doc_id, replace({_ODD_SQL}, chr(92), '/') AS n FROM inv)")
def valid_name(spark, sf_dir):
    return _odd_names(spark, sf_dir).select("doc_id", names.is_valid_name(F.col("name")).alias("valid"))


@query(f"SELECT doc_id, CASE WHEN {_VALID} THEN n END AS canonical FROM (SELECT doc_id, {_ODD_SQL} AS n FROM inv)")
def canonical_names(spark, sf_dir):
    rows = _odd_names(spark, sf_dir).withColumn("name", F.translate("name", "/", "\\"))
    return rows.select("doc_id", names.canonical_name(F.col("name")).alias("canonical"))


_COPY_SUFFIXES = (" (conflicted copy)", "-DESKTOP-HOST77", " (1)", " (2)", "~", ".sb-0f3c")


def _pass_sql(n: str) -> str:
    """One pass of the rules over names with one extension."""
    for pattern, to in (
        (r" \(conflicted copy\)(\.[^.]*)$", r"\1"), (r"-DESKTOP-[0-9A-Za-z]{6,12}(\.[^.]*)$", r"\1"), (r" \(1\)(\.[^.]*)$", r"\1"), (r" \(2\)(\.[^.]*)$", r"\1"),
        (r"^(.+)~$", r"\1"), (r"^~\$(.+)$", r"\1"), (r"^(.+)\.sb-[0-9a-f]{1,32}(\.[^.]*)$", r"\1\2"),
    ):
        n = f"regexp_replace({n}, '{pattern}', '{to}')"
    return n


_VARIANT_SQL = "(CASE WHEN doc_id % 5 = 1 THEN '~$' ELSE '' END || 'file' || doc_id || {0}[doc_id % 6 + 1] || {0}[doc_id // 6 % 6 + 1] || '.txt' || CASE WHEN doc_id % 4 = 1 THEN '~' ELSE '' END)".format("[" + ", ".join(f"'{x}'" for x in _COPY_SUFFIXES) + "]")


@query(f"SELECT doc_id, n AS name, {_pass_sql(_pass_sql(_pass_sql('n')))} AS base FROM (SELECT doc_id, {_VARIANT_SQL} AS n FROM inv)")
def normalize_variants(spark, sf_dir):
    """Two suffixes at a time, backup tildes and lock prefixes; three passes undo them all."""
    i, suffixes = F.col("doc_id"), F.array(*map(F.lit, _COPY_SUFFIXES))
    one = lambda k: F.element_at(suffixes, (k % 6).cast("int") + 1)
    name = F.concat(F.when(i % 5 == 1, "~$").otherwise(""), F.lit("file"), i.cast("string"), one(i), one(F.floor(i / 6)), F.lit(".txt"), F.when(i % 4 == 1, "~").otherwise(""))
    return derived.inventory(spark, sf_dir).select("doc_id", name.alias("name")).withColumn("base", names.normalize_base_name(F.col("name")))


@query(f"SELECT doc_id, starts_with(path, '{ROOT}/src1/') AS inside, CASE WHEN starts_with(path, '{ROOT}/') THEN substr(path, {len(ROOT) + 2}) ELSE path END AS relative FROM inv")
def path_containment(spark, sf_dir):
    return derived.inventory(spark, sf_dir).select("doc_id", names.contained(F.col("path"), f"{ROOT}/src1").alias("inside"), names.relative(F.col("path"), ROOT).alias("relative"))


@query("SELECT doc_id, 'path:' || sha256(lower(path)) AS identity, substr(sha256(path), 1, 16) AS path_hash FROM inv")
def path_identities(spark, sf_dir):
    return derived.inventory(spark, sf_dir).select("doc_id", names.path_identity(F.col("path")).alias("identity"), names.hash_path(F.col("path")).alias("path_hash"))


@query("SELECT doc_id, strftime(make_timestamp((mtime_ticks - 621355968000000000) // 10), '%Y-%m-%dT%H:%M:%S.%gZ') AS mtime FROM inv")
def format_timestamps(spark, sf_dir):
    return derived.inventory(spark, sf_dir).select("doc_id", names.format_ticks(F.col("mtime_ticks")).alias("mtime"))


_BYTES = "n >= 1073741824 THEN rtrim(rtrim(printf('%.2f', round(n::DECIMAL(38,10) / 1073741824, 2)), '0'), '.') || ' GB' WHEN n >= 1048576 THEN rtrim(rtrim(printf('%.2f', round(n::DECIMAL(38,10) / 1048576, 2)), '0'), '.') || ' MB' WHEN n >= 1024 THEN rtrim(rtrim(printf('%.2f', round(n::DECIMAL(38,10) / 1024, 2)), '0'), '.') || ' KB' ELSE n || ' B'"


@query(f"SELECT doc_id, n, CASE WHEN {_BYTES} END AS shown FROM (SELECT doc_id, (size * (1 + doc_id % 5 * 1000003))::BIGINT AS n FROM inv)")
def format_bytes(spark, sf_dir):
    rows = derived.inventory(spark, sf_dir).withColumn("n", F.col("size") * (1 + F.col("doc_id") % 5 * 1_000_003))
    return rows.select("doc_id", "n", names.format_bytes(F.col("n")).alias("shown"))


# ---- groups, hashes, verdicts


@query("SELECT base, size, count(*)::INT AS members, string_agg(path, '|' ORDER BY path) AS paths FROM readable GROUP BY base, size HAVING count(*) >= 2")
def candidate_groups(spark, sf_dir):
    return verdicts.candidate_groups(_files(spark, sf_dir)).select("base", "size", F.size("members").alias("members"), F.array_join("members", "|").alias("paths"))


@query("SELECT path, partial FROM members")
def partial_hash(spark, sf_dir):
    return verdicts.partial_content(_candidates(_judged(spark, sf_dir)), _contents(spark, sf_dir), WINDOW).select("path", "partial")


@query("SELECT path, full_hash FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict')")
def full_hash_survivors(spark, sf_dir):
    return _decidable(spark, sf_dir).select("path", F.col("full").alias("full_hash"))


@query("SELECT base, size, members, verdict FROM verdicts", name="verdicts")
def _verdicts(spark, sf_dir):
    return verdicts.verdicts(_hashed(spark, sf_dir)).select("base", "size", "members", "verdict")


@query("SELECT base, size, members, verdict FROM verdicts")
def stored_verdicts(spark, sf_dir):
    """Contents from a store that is laid out by groups: only its files that hold members are opened."""
    rows = derived.inventory(spark, sf_dir).drop("text")
    held = content.store(rows, f"{shared_dir(spark)}/syncsift/store-{uuid.uuid4().hex}", parts=16)
    judged = inventory.judged(held.metadata, ROOT)
    return verdicts.verdicts(verdicts.hashed_content(_candidates(judged), held.contents, WINDOW)).select("base", "size", "members", "verdict")


@query("SELECT full_hash AS hash, base, size, string_agg(path, '|' ORDER BY path) AS files, min(path) AS kept_path FROM decided WHERE verdict = 'identical_duplicate' GROUP BY ALL")
def identical_duplicates(spark, sf_dir):
    return verdicts.identical_duplicates(_members(spark, sf_dir)).withColumn("files", F.array_join("files", "|"))


@query("SELECT base, size, string_agg(path || ':' || full_hash, '|' ORDER BY path) AS files FROM decided WHERE verdict = 'real_conflict' GROUP BY base, size")
def real_conflicts(spark, sf_dir):
    return verdicts.real_conflicts(_members(spark, sf_dir)).withColumn("files", F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(":"), f["hash"])), "|"))


@query("SELECT base, size FROM verdicts WHERE verdict = 'eliminated_l2'")
def eliminated_l2(spark, sf_dir):
    return verdicts.verdicts(_hashed(spark, sf_dir)).where("verdict = 'eliminated_l2'").select("base", "size")


@query("SELECT base, size, string_agg(path || ':' || error, '|' ORDER BY path) AS files FROM decided WHERE verdict = 'unresolved' AND error IS NOT NULL GROUP BY base, size")
def unresolved_groups(spark, sf_dir):
    return verdicts.unresolved_groups(_members(spark, sf_dir)).withColumn("files", F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(":"), f["reason"])), "|"))


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN 'no content' WHEN 1 THEN 'shorter than listed' WHEN 3 THEN 'no content' END AS read_error,
 CASE WHEN k IN (2, 4) THEN sha256(CASE WHEN size <= {2 * WINDOW} THEN content ELSE content[1:{WINDOW}] || content[size - {WINDOW - 1}:] END) END AS partial,
 CASE WHEN k = 2 THEN sha256(content) END AS full_hash
 FROM (SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id % 5 = 2 THEN encode('') ELSE content END AS content, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE size END AS size FROM inv WHERE size > 0)""")
def hash_edges(spark, sf_dir):
    """Absent, short and empty content, and rows that are missing; only the group of the empty files goes on to whole files."""
    k = F.col("doc_id") % 5
    rows = derived.inventory(spark, sf_dir).where("size > 0").select("doc_id", "path", F.when(k == 2, 0).otherwise(F.col("size")).alias("size"), "content")
    content = F.when(k == 1, F.expr("substring(content, 1, size - 1)")).when(k == 2, F.lit("").cast("binary")).when(k != 0, F.col("content"))
    candidates = rows.select("doc_id", "path", "size", F.when(k == 2, "empty").when(k == 4, F.col("path")).otherwise("broken").alias("base"))
    found = verdicts.hashed_content(written(candidates), rows.where(k != 3).select("path", "size", content.alias("content")), WINDOW)
    return found.select("doc_id", "read_error", F.when(k.isin(2, 4), F.col("partial")).alias("partial"), F.col("full").alias("full_hash"))


@query("SELECT doc_id, path, greatest(1, (size + 4095) // 4096)::INT AS ranges, true AS equal FROM inv")
def blake3_ranges(spark, sf_dir):
    """The hash from nodes of 4096 bytes, computed apart, against that of the whole content."""
    rows = derived.inventory(spark, sf_dir).select("doc_id", "path", "size", "content")
    whole = rows.select("doc_id", "path", hashing.blake3_of("content").alias("whole"))
    return whole.join(hashing.content_tree_hashed(rows, 4096), "path").select("doc_id", "path", "ranges", (F.col("whole") == F.col("hash")).alias("equal"))


@query("SELECT base, size, members, verdict FROM verdicts", name="streamed_verdicts")
def _streamed_verdicts(spark, sf_dir):
    """The verdicts after three batches of a stream: two thirds of the files come, half of these leave, and all come back with the rest."""
    hashed = written(_hashed(spark, sf_dir).select("doc_id", "path", "base", "size", "partial", "full", F.col("read_error").alias("error")))
    whole = hashed.withColumn("full", F.coalesce("full", "partial"))
    top = f"{shared_dir(spark)}/syncsift/stream-{uuid.uuid4().hex}"
    states = [whole.where("false"), whole.where("doc_id % 3 <> 0"), whole.where("doc_id % 3 = 1"), whole]
    for before, after in zip(states, states[1:], strict=False):
        follow.events(before, after).write.mode("append").parquet(f"{top}/feed")
        follow.follow(spark.readStream.schema(follow.EVENTS).parquet(f"{top}/feed"), f"{top}/log", f"{top}/marks").awaitTermination()
    return follow.latest(spark, f"{top}/log").select("base", "size", "members", "verdict")


# ---- telemetry and figures

_TELEMETRY = f"""t AS (SELECT (SELECT count(*) FROM files) AS files_enumerated, (SELECT count(*) FROM files WHERE is_placeholder) AS files_placeholder, (SELECT count(*) FROM judged WHERE fate = 'excluded') AS files_excluded,
 (SELECT count(*) FROM readable) - (SELECT count(*) FROM members) AS files_skipped, (SELECT count(*) FROM members) AS files_partial_hashed, (SELECT count(*) FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict')) AS files_full_hashed,
 (SELECT coalesce(sum(least(size, {2 * WINDOW})), 0)::BIGINT FROM members) AS bytes_read_partial, (SELECT coalesce(sum(size), 0)::BIGINT FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict')) AS bytes_read_full)"""


@query(f", {_TELEMETRY} SELECT *, bytes_read_partial + bytes_read_full AS bytes_read, 0::BIGINT AS placeholder_bytes_read FROM t")
def scan_telemetry(spark, sf_dir):
    return _telemetry(spark, sf_dir)


@query(f", {_TELEMETRY} SELECT 'files_full_hashed exceeds files_partial_hashed' AS violation FROM t WHERE files_full_hashed > files_partial_hashed")
def telemetry_invariants(spark, sf_dir):
    return verdicts.telemetry_violations(_telemetry(spark, sf_dir))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN n <> p + s + h THEN 'files_enumerated is not the sum of placeholders, skipped and partially hashed' END, CASE WHEN f > h THEN 'files_full_hashed exceeds files_partial_hashed' END,
 CASE WHEN br <> bp + bf THEN 'bytes_read is not the sum of its parts' END, CASE WHEN pb <> 0 THEN 'placeholder content was read' END], lambda x: x IS NOT NULL)) AS violation
 FROM (SELECT doc_id, 10 + doc_id % 3 AS n, 2 AS p, 3 AS s, 5 AS h, 4 + doc_id % 4 AS f, 100 + doc_id % 2 AS br, 60 AS bp, 40 AS bf, (doc_id % 5 = 4)::INT AS pb FROM inv)""")
def telemetry_rules(spark, sf_dir):
    """Counters that break the rules singly and together."""
    i = F.col("doc_id")
    told = {
        "files_enumerated": 10 + i % 3, "files_placeholder": F.lit(2), "files_skipped": F.lit(3), "files_partial_hashed": F.lit(5), "files_full_hashed": 4 + i % 4,
        "bytes_read": 100 + i % 2, "bytes_read_partial": F.lit(60), "bytes_read_full": F.lit(40), "placeholder_bytes_read": (i % 5 == 4).cast("int"),
    }
    return verdicts.telemetry_violations(derived.inventory(spark, sf_dir).select("doc_id").withColumns(told), "doc_id")


@query(f", {_TELEMETRY} SELECT 2 * files_enumerated::BIGINT AS files_enumerated, (2 * bytes_read_full)::BIGINT AS bytes_read_full FROM t")
def telemetry_merge(spark, sf_dir):
    t = _telemetry(spark, sf_dir)
    return verdicts.merge_telemetry(t.unionByName(t)).select("files_enumerated", "bytes_read_full")


_SUMMARY = """s AS (SELECT coalesce(sum(CASE WHEN verdict = 'identical_duplicate' THEN members - 1 END), 0)::BIGINT AS identical_duplicates, count(*) FILTER (verdict = 'real_conflict') AS real_conflicts,
 coalesce(sum(CASE WHEN verdict IN ('identical_duplicate', 'real_conflict') THEN (members - 1) * size END), 0)::BIGINT AS recoverable_bytes, coalesce(sum(CASE WHEN verdict = 'identical_duplicate' THEN (members - 1) * size END), 0)::BIGINT AS recoverable_duplicate_bytes FROM verdicts)"""


@query(f", {_SUMMARY} SELECT (SELECT count(*) FROM files) AS files_found, (SELECT count(*) FROM files WHERE is_placeholder) AS placeholders_ignored, s.* FROM s")
def summary_metrics(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    return verdicts.summary(scan.telemetry, scan.members)


@query(f", {_SUMMARY} SELECT recoverable_bytes, CASE WHEN {_BYTES.replace('n >=', 'recoverable_bytes >=').replace('(n::', '(recoverable_bytes::').replace('ELSE n ||', 'ELSE recoverable_bytes ||')} END AS shown FROM s")
def recoverable_bytes(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    s = verdicts.summary(scan.telemetry, scan.members)
    return s.select("recoverable_bytes", names.format_bytes(F.col("recoverable_bytes")).alias("shown"))


@query(f", {_TELEMETRY} SELECT (SELECT sum(size)::BIGINT FROM files) AS bytes_listed, bytes_read_partial + bytes_read_full AS bytes_read FROM t")
def bytes_avoided(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    listed = scan.files.agg(F.sum("size").alias("bytes_listed"))
    return verdicts.merge_telemetry(listed.unionByName(scan.telemetry.select("bytes_read"), allowMissingColumns=True))


@query("SELECT base, size, count(*) AS files, sum(size)::BIGINT AS total_bytes, (sum(size) - size)::BIGINT AS spare_bytes FROM decided WHERE verdict = 'real_conflict' GROUP BY base, size")
def conflict_bytes(spark, sf_dir):
    return verdicts.conflict_bytes(_members(spark, sf_dir))


@query("SELECT CASE WHEN bool_or(verdict = 'unresolved') THEN 3 WHEN bool_or(verdict IN ('identical_duplicate', 'real_conflict')) THEN CASE WHEN (SELECT count(*) FROM judged WHERE fate IN ('repeated', 'too_deep')) > 0 THEN 3 ELSE 2 END ELSE 0 END::INT AS code FROM decided")
def scan_exit_code(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    found = scan.members.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("identical_duplicate", "real_conflict", "unresolved"))).first()
    errors = not scan.judged.where("fate in ('repeated', 'too_deep')").isEmpty()
    return spark.createDataFrame([(report.exit_code(bool(found[0] + found[1]), errors, bool(found[2])),)], "code int")


@query("SELECT path, row_number() OVER (PARTITION BY base, size ORDER BY mtime_ticks DESC, size DESC, path) = 1 AS suggested FROM decided WHERE verdict = 'real_conflict'")
def suggested_versions(spark, sf_dir):
    return verdicts.conflict_versions(_members(spark, sf_dir)).select("path", "suggested")


# ---- resolution


def _chosen(order: str, reason: str) -> str:
    return f"SELECT path, rn = 1 AS kept, CASE WHEN rn > 1 THEN '{reason}' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY base, size ORDER BY {order}) AS rn FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict'))"


def _plan(df: DataFrame) -> DataFrame:
    return df.select("path", "kept", "reason")


@query(_chosen("mtime_ticks DESC, size DESC, path", "keep-newest"))
def keep_newest(spark, sf_dir):
    return _plan(resolution.keep_newest(_decidable(spark, sf_dir)))


@query(_chosen("size DESC, mtime_ticks DESC, path", "keep-largest"))
def keep_largest(spark, sf_dir):
    return _plan(resolution.keep_largest(_decidable(spark, sf_dir)))


@query("""SELECT path, rn = 1 AS kept, CASE WHEN rn > 1 THEN 'keep-machine:ABC123' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY base, size ORDER BY contains(name, '-DESKTOP-ABC123') DESC, mtime_ticks DESC, size DESC, path) AS rn, bool_or(contains(name, '-DESKTOP-ABC123')) OVER (PARTITION BY base, size) AS has FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict')) WHERE has""")
def keep_machine(spark, sf_dir):
    return _plan(resolution.keep_machine(_decidable(spark, sf_dir), "ABC123", strict=False))


@query(_chosen("path DESC", "keep-manual"))
def keep_manual(spark, sf_dir):
    rows = _decidable(spark, sf_dir)
    return _plan(resolution.keep_manual(rows, rows.groupBy("base", "size").agg(F.max("path").alias("chosen"))))


@query(f"SELECT path, reason FROM ({_chosen('mtime_ticks DESC, size DESC, path', 'keep-newest')}) WHERE NOT kept")
def sacrifices(spark, sf_dir):
    return resolution.sacrifices(resolution.keep_newest(_decidable(spark, sf_dir))).select("path", "reason")


@query("SELECT base, size, min(path) AS kept_path FROM decided WHERE verdict = 'identical_duplicate' GROUP BY base, size")
def kept_path(spark, sf_dir):
    return verdicts.identical_duplicates(_members(spark, sf_dir)).select("base", "size", "kept_path")


# ---- cache, snapshots, identity

_KEY = "sha256('cache-key-v1|' || strlen(path) || ':' || path || strlen(size::VARCHAR) || ':' || size || strlen(mtime_ticks::VARCHAR) || ':' || mtime_ticks)"


def _cached(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    return cache.lookup(hashed, cache.entries(hashed.where("doc_id % 2 = 0"), 1))


_KNOWN = "CASE WHEN verdict IN ('identical_duplicate', 'real_conflict') THEN full_hash END"


@query(f"SELECT path, {_KEY} AS key_hex, partial AS known_partial, {_KNOWN} AS known_full FROM decided WHERE doc_id % 2 = 0")
def cache_hits(spark, sf_dir):
    return _cached(spark, sf_dir).where("known_partial is not null").select("path", "key_hex", "known_partial", "known_full")


@query("SELECT path FROM members WHERE doc_id % 2 <> 0")
def cache_misses(spark, sf_dir):
    return _cached(spark, sf_dir).where("known_partial is null").select("path")


@query(f"""SELECT count(*) AS members, count(*) FILTER (doc_id % 2 <> 0) AS read_partial, coalesce(sum(least(size, {2 * WINDOW})) FILTER (doc_id % 2 <> 0), 0)::BIGINT AS bytes_read_partial,
 coalesce(sum(size) FILTER (doc_id % 2 <> 0 AND verdict IN ('identical_duplicate', 'real_conflict')), 0)::BIGINT AS bytes_read_full, count(*) FILTER (verdict = 'identical_duplicate') AS identical FROM (
 SELECT d.*, v.verdict FROM grouped d JOIN (SELECT base, size, CASE WHEN count(DISTINCT partial) = count(*) THEN 'eliminated_l2' WHEN count(DISTINCT full_hash) = 1 THEN 'identical_duplicate' ELSE 'real_conflict' END AS verdict FROM members GROUP BY base, size) v USING (base, size))""")
def rescan_cached(spark, sf_dir):
    """A second scan that finds half of the files in the cache, and reads the others."""
    rows = derived.inventory(spark, sf_dir).drop("text")
    first = scans.scan(rows, ROOT, WINDOW)
    again = scans.scan(rows, ROOT, WINDOW, cache=written(first.cache(now=1).join(first.members.where("doc_id % 2 = 0").select(cache.compute_key(F.col("path"), F.col("size"), F.col("mtime_ticks")).alias("key_hex")), "key_hex", "left_semi")))
    told = again.members.agg(F.count("*").alias("members"), F.count_if(F.col("bytes_partial").isNotNull()).alias("read_partial"), F.count_if(F.col("verdict") == "identical_duplicate").alias("identical"))
    return verdicts.merge_telemetry(told.unionByName(again.telemetry.select("bytes_read_partial", "bytes_read_full"), allowMissingColumns=True))


@query("""SELECT count(*) AS members, 0::BIGINT AS bytes_read, count(*) FILTER (verdict = 'identical_duplicate') AS identical FROM (
 SELECT d.*, v.verdict FROM grouped d JOIN (SELECT base, size, CASE WHEN count(DISTINCT partial) = count(*) THEN 'eliminated_l2' WHEN count(DISTINCT full_hash) = 1 THEN 'identical_duplicate' ELSE 'real_conflict' END AS verdict
 FROM members GROUP BY base, size) v USING (base, size) WHERE group_members >= 2)""")
def cache_after_twins_return(spark, sf_dir):
    """Half of the files leave and return: a cache table that three scans share reads nothing for the third."""
    rows = derived.inventory(spark, sf_dir).drop("text")
    known = cachetable.CacheTable(spark, f"{shared_dir(spark)}/syncsift/cache-{uuid.uuid4().hex}", buckets=8)
    known.append(scans.scan(rows, ROOT, WINDOW, cache=known).news(now=1)).compact()
    known.append(scans.scan(rows.where("doc_id % 2 = 0"), ROOT, WINDOW, cache=known).news(now=2))
    again = scans.scan(rows, ROOT, WINDOW, cache=known)
    told = again.members.agg(F.count("*").alias("members"), F.count_if(F.col("verdict") == "identical_duplicate").alias("identical"))
    return verdicts.merge_telemetry(told.unionByName(again.telemetry.select("bytes_read"), allowMissingColumns=True))


@query(f"SELECT {_KEY} AS key_hex, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS last_seen FROM members")
def cache_upsert(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    return cache.upsert(cache.entries(rows, 1), cache.entries(rows.where("doc_id % 2 = 0"), 2)).select("key_hex", "last_seen")


@query("""SELECT path, CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'Unstable' ELSE 'Stable' END AS status, CASE doc_id % 10 WHEN 0 THEN 'size diverged: pre=' || size || ', post=' || (size + 1) WHEN 1 THEN 'mtime diverged: pre=' || mtime_ticks || ', post=' || (mtime_ticks + 5) WHEN 2 THEN 'file_id diverged: pre=' || file_id || ', post=' || file_id || 'x' END AS reason FROM files""")
def stability_check(spark, sf_dir):
    before = _files(spark, sf_dir).select("doc_id", "path", "size", "mtime_ticks", "file_id")
    m = F.col("doc_id") % 10
    after = before.select("path", F.when(m == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(m <= 1, F.col("mtime_ticks") + 5).otherwise(F.col("mtime_ticks")).alias("mtime_ticks"), F.when(m <= 2, F.concat("file_id", F.lit("x"))).otherwise(F.col("file_id")).alias("file_id"))
    return inventory.stability(before, after)


_LEN = "strlen({0}::VARCHAR) || ':' || {0}"


@query("SELECT path, sha256('volume-file-key-v1|' || " + " || ".join(_LEN.format(x) for x in ("volume_id", "file_id", "size", "mtime_ticks")) + " || '6:sha256' || '1:1') AS key FROM files")
def volume_file_key(spark, sf_dir):
    return _files(spark, sf_dir).select("path", cache.volume_file_key(*(F.col(c) for c in ("volume_id", "file_id", "size", "mtime_ticks"))).alias("key"))


def _joined_sql(*fields: str) -> str:
    return " || ".join(f"strlen({x}) || ':' || {x}" for x in (f"coalesce(({f})::VARCHAR, '')" for f in fields))


_FOLD = "substr(d, 1, {0}) || sha256(string_agg(d, chr(10) ORDER BY d)) AS d"


@query(f""", lines AS (SELECT base, size, verdict, sha256({_joined_sql("path", "size", "mtime_ticks", "volume_id", "file_id", _KNOWN)}) AS d FROM decided),
parts AS (SELECT base, size, verdict, {_FOLD.format(3)} FROM lines GROUP BY base, size, verdict, substr(d, 1, 3)),
tagged AS (SELECT base, size, CASE verdict WHEN 'identical_duplicate' THEN 'i' WHEN 'real_conflict' THEN 'r' ELSE 'g' END AS tag, sha256(string_agg(d, chr(10) ORDER BY d)) AS ds FROM parts GROUP BY base, size, verdict),
l0 AS (SELECT sha256({_joined_sql("tag", "base", "size", "ds")}) AS d FROM tagged),
l1 AS (SELECT {_FOLD.format(4)} FROM l0 GROUP BY substr(d, 1, 4)),
l2 AS (SELECT {_FOLD.format(2)} FROM l1 GROUP BY substr(d, 1, 2)),
l3 AS (SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l2)
SELECT substr(sha256(d), 1, 16) AS operation_id FROM l3""")
def scan_fingerprint(spark, sf_dir):
    return fingerprint.scan_fingerprint(_members(spark, sf_dir))


# ---- comparisons


@query("SELECT doc_id, ['markdown', 'csv', 'text', 'text', 'binary'][doc_id % 5 + 1] AS kind FROM inv")
def comparator_route(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".MD", ".csv", ".txt", ".log", ""))), (F.col("doc_id") % 5).cast("int") + 1)
    rows = derived.inventory(spark, sf_dir)
    return rows.select("doc_id", compare.comparator(F.concat(F.regexp_replace("path", r"\.txt$", ""), ext)).alias("kind"))


def _pairs(spark, sf_dir):
    """Each member of a conflict beside the version kept; a row with every later member."""
    rows = verdicts.conflict_versions(_members(spark, sf_dir)).select("base", "size", "path", "doc_id", "suggested")
    texts = derived.inventory(spark, sf_dir).select("doc_id", "text", "content")
    kept = rows.where("suggested").select("base", "size", F.col("path").alias("left_path"), F.col("doc_id").alias("left_id"))
    both = rows.where("not suggested").join(kept, ["base", "size"])
    left = texts.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"), F.col("content").alias("left_content"))
    return both.join(texts, "doc_id").join(left, "left_id")


_PAIRS = """kept AS (SELECT *, row_number() OVER (PARTITION BY base, size ORDER BY mtime_ticks DESC, size DESC, path) AS rn FROM decided WHERE verdict = 'real_conflict'),
pairs AS (SELECT l.path AS left_path, r.path AS path, l.content AS a, r.content AS b FROM kept l JOIN kept r USING (base, size) WHERE l.rn = 1 AND r.rn > 1)"""


@query(f""", {_PAIRS}, bits AS (SELECT left_path, path, list_filter(range(1, octet_length(a) + 1), lambda i: a[i:i] <> b[i:i])[1] - 1 AS first_at FROM pairs)
SELECT left_path, path, 'Changed' AS kind, first_at::BIGINT AS left_start, 1::BIGINT AS left_count FROM bits WHERE first_at IS NOT NULL""")
def binary_first_diff(spark, sf_dir):
    r = compare.binary_region(F.col("left_content"), F.col("content"))
    rows = _pairs(spark, sf_dir).select("left_path", "path", r.alias("r")).where("r is not null")
    return rows.select("left_path", "path", "r.kind", "r.left_start", "r.left_count")


def _turns(spark, sf_dir):
    """Neighbouring turns of conversations, as texts to align."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_text"))
    words = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[ ]", "\n")
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", words(F.col("text")).alias("a"), words(F.col("right_text")).alias("b"))


def _diff(kind: str) -> Query:
    def run(spark, sf_dir):
        rows = _turns(spark, sf_dir).withColumn("r", F.explode(compare.line_regions(F.lit(kind), F.col("a"), F.col("b"))))
        return rows.select("conv_id", "turn", "r.*")

    return run


for _kind in ("text", "csv", "markdown"):
    query(name=f"{_kind}_diff_regions")(_diff(_kind))


_LINES = 24  # of a generated text; edits stand alone, so that each is a region of its own


def _edited(spark, sf_dir, line: str, instead: str, gone: str, more: str) -> DataFrame:
    """(doc_id, a, b): a text of ``line`` (SQL over d and i), and the same edited by the rules that the SQL restates."""
    d = derived.inventory(spark, sf_dir).select("doc_id", F.col("doc_id").alias("d"))
    numbers = f"sequence(1, {_LINES})"
    left = F.expr(f"concat_ws('\n', transform({numbers}, i -> CASE WHEN i % 6 = 3 THEN {gone} ELSE {line} END))")
    kept = f"CASE WHEN i % 6 = 1 AND (d + i) % 2 = 0 THEN array({instead}) WHEN i % 6 = 3 THEN CASE WHEN d % 3 = 0 THEN array() ELSE array({gone}) END WHEN i % 6 = 5 AND d % 2 = 1 THEN array({line}, {more}) ELSE array({line}) END"
    return d.withColumns({"a": left, "b": F.expr(f"concat_ws('\n', flatten(transform({numbers}, i -> {kept})))")})


_EDITS_SQL = f"""edits AS (SELECT doc_id, i, CASE WHEN i % 6 = 1 AND (doc_id + i) % 2 = 0 THEN 'Changed' WHEN i % 6 = 3 AND doc_id % 3 = 0 THEN 'Removed' ELSE 'Equal' END AS kind FROM inv, range(1, {_LINES + 1}) t(i)
 UNION ALL SELECT doc_id, i, 'Added' FROM inv, range(1, {_LINES + 1}) t(i) WHERE i % 6 = 5 AND doc_id % 2 = 1)"""


def _totals_sql(kind: str) -> str:
    return f", {_EDITS_SQL} SELECT doc_id, shown AS kind, count(*) FILTER (kind <> 'Added') AS left_lines, count(*) FILTER (kind <> 'Removed') AS right_lines FROM (SELECT *, {kind} AS shown FROM edits) GROUP BY doc_id, shown"


def _totals(kind: str, rows: DataFrame) -> DataFrame:
    found = rows.select("doc_id", F.explode(compare.line_regions(F.lit(kind), F.col("a"), F.col("b"))).alias("r"))
    return found.groupBy("doc_id", "r.kind").agg(F.sum("r.left_count").alias("left_lines"), F.sum("r.right_count").alias("right_lines"))


@query(_totals_sql("kind"))
def text_diff_totals(spark, sf_dir):
    return _totals("text", _edited(spark, sf_dir, "concat('row ', d, ' ', i)", "concat('new ', i)", "concat('old ', i)", "concat('more ', i)"))


@query(_totals_sql("CASE WHEN kind = 'Changed' AND i % 12 = 1 THEN 'Equal' ELSE kind END"))
def csv_diff_totals(spark, sf_dir):
    """Every other changed line differs in its quotes alone."""
    line = "concat('a', i, ',\"b \"\"q\"\", c\",', d)"
    instead = "CASE WHEN i % 12 = 1 THEN concat('\"a', i, '\",\"b \"\"q\"\", c\",\"', d, '\"') ELSE concat('a', i, ',\"b \"\"q\"\"\",', d) END"
    return _totals("csv", _edited(spark, sf_dir, line, instead, line, "concat('z', i, ',,')"))


@query(_totals_sql("CASE WHEN kind = 'Removed' THEN 'Changed' ELSE kind END"))
def markdown_diff_totals(spark, sf_dir):
    """The lines removed are headings, so their regions change the document's structure."""
    return _totals("markdown", _edited(spark, sf_dir, "concat('text ', d, ' ', i)", "concat('new ', i)", "concat('## part ', i)", "concat('#tag ', i)"))


# ---- report, manifest, increments


@query(f"""SELECT row_number() OVER (ORDER BY path)::INT AS position, path, printf('payload/%04d.dat', row_number() OVER (ORDER BY path)) AS payload, size, full_hash AS hash, 'keep-newest' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY base, size ORDER BY mtime_ticks DESC, size DESC, path) AS rn FROM decided WHERE verdict IN ('identical_duplicate', 'real_conflict')) WHERE rn > 1""")
def quarantine_manifest(spark, sf_dir):
    plan = resolution.sacrifices(resolution.keep_newest(_decidable(spark, sf_dir)))
    return quarantine.plan(plan, ROOT, "demo").select("position", "path", "payload", "size", "hash", "reason")


@query()
def scan_report_json(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    files, members, when = scan.files, scan.members, datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    text = report.report(scan.telemetry, verdicts.candidate_groups(files), verdicts.identical_duplicates(members), verdicts.real_conflicts(members), placeholders.records(files), ROOT, when, when)
    return spark.createDataFrame([(text,)], "report string")


_Q = "'\"' || {0} || '\"'"  # the derived paths have nothing to escape
_REL = f"substr(path, {len(ROOT) + 2})"


def _element_sql(section: int, groups: str, files: str, opening: str, name: str, line: str) -> str:
    """Rows of one list: ``groups`` (base, size, k1, last, hash), ``files`` (base, size, path, full_hash)."""
    g = f"(SELECT *, row_number() OVER (ORDER BY k1 DESC, size DESC) = 1 AS final FROM ({groups}))"
    n = "chr(10)"
    return f"""SELECT {section} AS section, k1, size AS k2, 0 AS kind, '' AS k3, '    {{' || {n} || {opening} || ',' || {n} || '      "{name}": [' AS text FROM {g}
UNION ALL SELECT {section}, k1, size, 1, path, {line} || CASE WHEN path = last THEN '' ELSE ',' END FROM ({files}) f JOIN {g} g USING (base, size)
UNION ALL SELECT {section}, k1, size, 2, '', '      ]' || {n} || '    }}' || CASE WHEN final THEN '' ELSE ',' END FROM {g}"""


def _report_sql() -> str:
    n = "chr(10)"
    size, base = "'      \"size_bytes\": ' || size", f"'      \"normalized_base_name\": ' || {_Q.format('base')} || ',' || {n}"
    path = _Q.format(_REL)
    as_path = f"'        {{' || {n} || '          \"path\": ' || {path} || {n} || '        }}'"
    with_hash = f"'        {{' || {n} || '          \"path\": ' || {path} || ',' || {n} || '          \"hash\": ' || {_Q.format('full_hash')} || {n} || '        }}'"
    judged = lambda v: (f"SELECT base, size, min(path) AS k1, max(path) AS last, min(full_hash) AS hash FROM decided WHERE verdict = '{v}' GROUP BY base, size", f"SELECT base, size, path, full_hash FROM decided WHERE verdict = '{v}'")
    return " UNION ALL ".join((
        _element_sql(0, "SELECT base, size, base AS k1, max(path) AS last, '' AS hash FROM readable GROUP BY base, size HAVING count(*) > 1", "SELECT base, size, path, '' AS full_hash FROM readable", f"{base} || {size}", "members", as_path),
        _element_sql(1, *judged("identical_duplicate"), f"'      \"hash\": ' || {_Q.format('hash')} || ',' || {n} || {size}", "files", f"'        ' || {path}"),
        _element_sql(2, *judged("real_conflict"), f"{base} || {size}", "files", with_hash),
    ))


@query(_report_sql())
def scan_report_lines(spark, sf_dir):
    """The report's rows of text with the keys that order them, but for the frame and the placeholders."""
    scan, when = _scan(spark, sf_dir), datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    rows = reportlines.lines(scan.telemetry, scan.files, scan.members, ROOT, when, when)
    return rows.where("phase = 1 AND section < 3").drop("phase")


def _listed(name: str, order: str, source: str, having: str = "true") -> str:
    groups = f"SELECT base, size, count(*) AS n, min(path) AS first FROM {source} GROUP BY base, size HAVING {having}"
    return f"SELECT '{name}' AS list, (row_number() OVER (ORDER BY {order}) - 1)::INT AS position, size, n::INT AS files, substr(first, {len(ROOT) + 2}) AS first_path FROM ({groups})"


@query(f"""{_listed("groups", "base, size", "readable", "count(*) >= 2")}
UNION ALL {_listed("identical_duplicates", "first", "(SELECT * FROM decided WHERE verdict = 'identical_duplicate')")}
UNION ALL {_listed("real_conflicts", "first", "(SELECT * FROM decided WHERE verdict = 'real_conflict')")}
UNION ALL SELECT 'placeholders', (row_number() OVER (ORDER BY path) - 1)::INT, size, 1, substr(path, {len(ROOT) + 2}) FROM files WHERE is_placeholder""")
def scan_report_lists(spark, sf_dir):
    """The four lists of the JSON report, read back from its text: their order, sizes and first paths."""
    shapes = {
        "groups": "array<struct<size_bytes: long, members: array<struct<path: string>>>>", "identical_duplicates": "array<struct<size_bytes: long, files: array<string>>>",
        "real_conflicts": "array<struct<size_bytes: long, files: array<struct<path: string>>>>", "placeholders": "array<struct<size_bytes: long, path: string>>",
    }
    parsed = scan_report_json(spark, sf_dir).select(F.from_json("report", ", ".join(f"{k} {v}" for k, v in shapes.items())).alias("r"))
    paths = {"groups": F.col("x.members.path"), "identical_duplicates": F.col("x.files"), "real_conflicts": F.col("x.files.path"), "placeholders": F.array("x.path")}
    parts = []
    for name, found in paths.items():
        rows = parsed.select(F.posexplode(f"r.{name}").alias("position", "x"))
        parts.append(rows.select(F.lit(name).alias("list"), "position", F.col("x.size_bytes").alias("size"), F.size(found).alias("files"), found[0].alias("first_path")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT path, 'added' AS change FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT path, 'changed' FROM files WHERE doc_id % 3 = 1 UNION ALL SELECT path, 'removed' FROM files WHERE doc_id % 3 = 2 AND doc_id % 2 = 0")
def rescan_changes(spark, sf_dir):
    files = _files(spark, sf_dir).select("doc_id", "path", "size", "mtime_ticks")
    before = files.where("doc_id % 3 <> 0").drop("doc_id")
    after = files.where("not (doc_id % 3 = 2 and doc_id % 2 = 0)").withColumn("size", F.col("size") + (F.col("doc_id") % 3 == 1).cast("long")).drop("doc_id")
    return incremental.changes(before, after)


@query(f"SELECT path, least(size, {2 * WINDOW})::BIGINT AS partial_bytes FROM readable")
def partial_read_bytes(spark, sf_dir):
    return placeholders.split(_files(spark, sf_dir))[0].select("path", hashing.partial_bytes(F.col("size"), WINDOW).alias("partial_bytes"))
