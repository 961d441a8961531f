"""A deterministic file tree for tests and benchmarks: ``python -m syncsift.generate --root <folder> --files 2000 [--tasks 8]``.

Duplicates share their base name and size, so that scans can find them; conflicts agree in size and in both windows,
or in size alone; placeholders are stubs with a sidecar that names their kind. The same parameters give the same tree, byte by byte.

The tree is a sequence of units, a group or a single file each; what a unit holds comes from its number and the seed alone. So any
task can write any unit, and the tree is the same whether one process writes it or many tasks do (``generate_by_tasks``).
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import random
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from syncsift.functions import placeholders
from syncsift.operators.inventory import SIDECAR
from syncsift.schema import WINDOW
from syncsift.shipping import ship

MTIME = 1_000_000_000  # of every file
COPIES = (" (1)", " (2)", " (conflicted copy)", "-DESKTOP-GEN123", ".sb-0a1b2c")


MADE = ("files", "duplicate_files", "conflict_files", "placeholders", "bytes")


@dataclass
class Tree:
    files: int = 2000  # in all, besides sidecars
    duplicates: int = 80  # groups of two and three equal files in turn
    conflicts: int = 60  # groups of two files of one size; every other one agrees in its windows
    placeholders: int = 90
    depth: int = 5
    seed: int = 7

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 0 or self.depth < 1:
            raise ValueError("numbers must not be negative, and a tree has a level at least")
        if self.lone < 0:
            raise ValueError("the groups and placeholders need more files than there are")

    @property
    def lone(self) -> int:
        return self.files - (2 * self.duplicates + self.duplicates // 2) - 2 * self.conflicts - self.placeholders

    @property
    def units(self) -> int:
        return self.duplicates + self.conflicts + self.placeholders + self.lone


def unit(tree: Tree, number: int) -> Iterator[tuple[str, bytes, str | None]]:
    """(relative path, content, what it counts as) of one unit's files; a sidecar counts as nothing."""
    rng = random.Random(hashlib.blake2b(f"{tree.seed}/{number}".encode(), digest_size=16).digest())
    folder = lambda: "/".join(f"f{rng.randrange(6)}" for _ in range(rng.randint(1, tree.depth)))
    copy = lambda k: "" if k == 0 else rng.choice(COPIES)
    n = number
    if n < tree.duplicates:
        data = rng.randbytes(rng.randint(1, 3 * WINDOW))
        for k in range(2 + n % 2):
            yield f"{folder()}/g{n}-{k}/twin{n:05d}{copy(k)}.bin", data, "duplicate_files"
        return
    n -= tree.duplicates
    if n < tree.conflicts:
        data = bytearray(rng.randbytes(2 * WINDOW + rng.randint(1, WINDOW)))
        for k in range(2):
            data[WINDOW if n % 2 == 0 else 0] ^= 1 + k
            yield f"{folder()}/c{n}-{k}/rift{n:05d}{copy(k)}.bin", bytes(data), "conflict_files"
        return
    n -= tree.conflicts
    if n < tree.placeholders:
        path, kinds = f"{folder()}/cloud{n:05d}.dat", [k for k, _ in placeholders.BITS]
        yield path, b"stub", "placeholders"
        yield path + SIDECAR, json.dumps({"kind": kinds[n % len(kinds)]}).encode(), None
        return
    yield f"{folder()}/lone{n - tree.placeholders:07d}.txt", rng.randbytes(rng.randint(0, 4096)), "files"


def _put(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (MTIME, MTIME))


def _write(root: str, tree: Tree, numbers) -> Counter:
    made: Counter = Counter()
    for number in numbers:
        for path, data, kind in unit(tree, int(number)):
            _put(Path(root) / path, data)
            if kind:
                made["files"] += 1
                made["bytes"] += len(data)
                made[kind] += kind != "files"
    return made


def _begin(root: str) -> None:
    top = Path(root)
    if top.exists() and any(top.iterdir()):
        raise ValueError(f"{root} is not empty")
    top.mkdir(parents=True, exist_ok=True)


def generate(root: str, tree: Tree) -> dict[str, int]:
    """Write the tree into an empty or absent folder; the counts of what it holds."""
    _begin(root)
    made = _write(root, tree, range(tree.units))
    return {k: made[k] for k in MADE}


def generate_by_tasks(spark: SparkSession, root: str, tree: Tree, tasks: int) -> dict[str, int]:
    """The same by ``tasks`` tasks, which share the folder. A task that runs again writes the same files again."""
    _begin(root)

    def write(batches):
        for b in batches:
            made = _write(root, tree, b.column("id").to_pylist())
            yield pa.RecordBatch.from_pydict({k: [made[k]] for k in MADE})

    sums = spark.range(0, tree.units, 1, tasks).mapInArrow(write, ", ".join(f"{k} long" for k in MADE)).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in MADE))
    return sums.first().asDict()


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="python -m syncsift.generate")
    parser.add_argument("--root", required=True)
    for name, value in asdict(Tree()).items():
        parser.add_argument(f"--{name}", type=int, default=value)
    parser.add_argument("--tasks", type=int, default=0, help="write by that many tasks of a Spark session")
    told = vars(parser.parse_args(args))
    root, tasks = told.pop("root"), told.pop("tasks")
    try:
        tree = Tree(**told)
        print(json.dumps(generate_by_tasks(ship(SparkSession.builder.appName("generate").getOrCreate()), root, tree, tasks) if tasks else generate(root, tree)))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
