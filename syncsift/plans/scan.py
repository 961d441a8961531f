"""A whole scan: from an inventory, or a file tree, to its verdict tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.functions import placeholders
from syncsift.operators import cache as hash_cache
from syncsift.operators import inventory, report, reportlines, verdicts
from syncsift.operators.cachetable import CacheTable
from syncsift.schema import MAX_DEPTH, RESERVED, WINDOW
from syncsift.shipping import ship
from syncsift.sources import filetree
from syncsift.sources.content import Store
from syncsift.tables import written

ALGORITHMS = {"sha256": "SHA-256", "blake3": "BLAKE3"}


@dataclass
class Scan:
    root: str
    inventory: inventory.Inventory
    members: DataFrame
    telemetry: DataFrame
    started: datetime
    algorithm: str = "sha256"

    @property
    def groups(self) -> DataFrame:
        return verdicts.candidate_groups(self.inventory.files)

    @property
    def duplicates(self) -> DataFrame:
        return verdicts.identical_duplicates(self.members)

    @property
    def conflicts(self) -> DataFrame:
        return verdicts.real_conflicts(self.members)

    @property
    def unresolved(self) -> DataFrame:
        return verdicts.unresolved_groups(self.members)

    def exit_code(self) -> int:
        found = self.members.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("identical_duplicate", "real_conflict", "unresolved"))).first()
        return report.exit_code(bool(found[0] + found[1]), not self.inventory.errors.isEmpty(), bool(found[2]))

    def json(self, finished: datetime | None = None) -> str:
        return report.report(self.telemetry, self.groups, self.duplicates, self.conflicts, placeholders.records(self.inventory.files), self.root, self.started, finished or datetime.now(timezone.utc), ALGORITHMS.get(self.algorithm, self.algorithm))

    def report_lines(self, finished: datetime | None = None) -> DataFrame:
        """The same report as rows of text, for reportlines.streamed and reportlines.write."""
        return reportlines.lines(self.telemetry, self.inventory.files, self.members, self.root, self.started, finished or datetime.now(timezone.utc), ALGORITHMS.get(self.algorithm, self.algorithm))

    def text_lines(self) -> DataFrame:
        """``text`` as rows, for reportlines.streamed."""
        return reportlines.summary(self.telemetry, self.members, self.root)

    def _entries(self, sound: DataFrame, now: int | None) -> DataFrame:
        sound = sound.where("partial IS NOT NULL AND read_error IS NULL")
        sound = sound.where("full_error IS NULL") if "full_error" in sound.columns else sound  # a file that changed is never remembered
        return hash_cache.entries(sound.withColumn("full", F.col("cached_full")), now if now is not None else int(self.started.timestamp()), self.algorithm)

    def cache(self, before: DataFrame | None = None, now: int | None = None) -> DataFrame:
        """The hash cache after this scan: its hashes, and the entries of ``before`` that it has not seen."""
        fresh = self._entries(self.members, now)
        return hash_cache.upsert(before, fresh) if before is not None else fresh

    def news(self, now: int | None = None) -> DataFrame:
        """The cache entries of the files that this scan read, for CacheTable.append."""
        return self._entries(self.members.where("bytes_partial IS NOT NULL OR bytes_full IS NOT NULL"), now)

    def text(self) -> str:
        return report.text_summary(self.telemetry, self.duplicates, self.conflicts, self.unresolved, self.root)


def scan(rows: DataFrame | Store, root: str, window: int = WINDOW, algorithm: str = "sha256", max_depth: int = MAX_DEPTH, reserved: str = RESERVED, cache: DataFrame | CacheTable | None = None) -> Scan:
    """Scan an inventory; content comes from its content column, from a store, or is read by path where there is neither.

    The inventory, the hashes of each stage and the result are written tables: a lost executor doesn't make a file be read
    again, when it may have changed. With a ``cache`` only files that it doesn't know in their present state are read.
    """
    started = datetime.now(timezone.utc)
    contents = rows.contents if isinstance(rows, Store) else rows.select("path", "size", "content") if "content" in rows.columns else None
    listed = rows.metadata if isinstance(rows, Store) else rows.drop("content")
    inv = inventory.order(listed, root, max_depth, reserved)
    inv.files = written(inv.files)
    candidates = verdicts.grouped_rows(inv.files).drop("members")
    if isinstance(cache, CacheTable):
        candidates = cache.lookup(candidates, algorithm).drop("key_hex")
    elif cache is not None:
        hash_cache.validate(cache)
        candidates = hash_cache.lookup(candidates, cache, algorithm).drop("key_hex")
    candidates = written(candidates)
    if contents is not None:
        if algorithm not in ALGORITHMS:
            raise ValueError(f"a content column is hashed by {' or '.join(ALGORITHMS)}, not {algorithm}")
        hashed = verdicts.hashed_content(candidates, contents, window, algorithm == "blake3")
    else:
        hashed = verdicts.hashed_paths(candidates, window, algorithm)
    members = written(verdicts.judged_members(written(hashed)))
    return Scan(root, inv, members, verdicts.gated(verdicts.telemetry(inv.counts, members)), started, algorithm)


def scan_tree(spark: SparkSession, root: str, **options) -> Scan:
    """Scan a file tree that the executors can read."""
    filetree.register(ship(spark))
    rows = spark.read.format("filetree").load(root)
    return scan(inventory.with_sidecars(rows, filetree.sidecar_contents(spark, rows)), root, **options)
