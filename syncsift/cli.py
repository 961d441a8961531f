"""The command line: ``python -m syncsift scan <path> [--json] [--quiet] [--cache <folder>]``.

Exit codes: 0 nothing found, 1 wrong usage or a scan that failed, 2 duplicates or conflicts, 3 the same with files that
could not be read, or groups that could not be decided. Results go to standard output, the message of a 1 to standard error.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from syncsift.operators import reportlines
from syncsift.operators.cachetable import CacheTable
from syncsift.plans.scan import scan_tree

USAGE = "usage: python -m syncsift scan <path> [--json] [--quiet] [--cache <folder>]"


class UsageError(ValueError):
    pass


def parse(args: list[str]) -> tuple[str, bool, bool, str | None]:
    """(path, json, quiet, cache folder)."""
    if args[:1] != ["scan"]:
        raise UsageError(f"unknown command; {USAGE}")
    path, cache, rest = None, None, iter(args[1:])
    for arg in rest:
        if arg == "--cache":
            cache = next(rest, None)
            if cache is None:
                raise UsageError(f"--cache needs a folder; {USAGE}")
        elif arg not in ("--json", "--quiet"):
            if arg.startswith("-") or path is not None:
                raise UsageError(f"unexpected {arg!r}; {USAGE}")
            path = arg
    if path is None:
        raise UsageError(f"a path is needed; {USAGE}")
    if not os.path.isdir(path):
        raise UsageError(f"{path} is not a folder" if os.path.exists(path) else f"{path} does not exist")
    return os.path.realpath(path), "--json" in args, "--quiet" in args, cache


def main(args: list[str], session: Callable[[], SparkSession] | None = None) -> int:
    try:
        path, as_json, quiet, folder = parse(args)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 1
    spark = session() if session else SparkSession.builder.appName("syncsift").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        known = CacheTable(spark, f"file://{os.path.abspath(folder)}") if folder else None
        found = scan_tree(spark, path, cache=known)
        code = found.exit_code()
        if as_json:
            for text in reportlines.streamed(found.report_lines()):
                print(text, end="")
        elif not quiet:
            for text in reportlines.streamed(found.text_lines()):
                print(text, end="")
        if known is not None:
            news = found.news()
            if not news.isEmpty():
                known.append(news)
        return code
    except (OSError, ValueError, RuntimeError, PySparkException, Py4JError) as e:
        print(f"the scan failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
