"""The JSON report as rows of text, sorted and written by tasks: neither a group nor the report is one value anywhere.

Each element of a list is a row for what opens it, one for each of its files and one for what closes it; the rows carry the keys that
order them, so a range partitioning puts them in order, and a group of very many files over several tasks. Whether a
comma follows comes from the last path of a group and the last group of a list. ``write`` makes one file of the sorted
parts; the driver copies streams. The text is that of report.report, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncsift.functions import placeholders
from syncsift.operators import report, verdicts

ORDER = ("section", "phase", "k1", "k2", "kind", "k3")
KEY = list(verdicts.KEY)
NAMES = ("groups", "identical_duplicates", "real_conflicts", "placeholders")


@F.pandas_udf(T.StringType())
def quoted(text: pd.Series) -> pd.Series:
    """JSON strings as the report writes them."""
    return text.map(lambda x: report.dumps(x)[:-1])


@F.pandas_udf(T.StringType())
def _placeholder(path: pd.Series, kinds: pd.Series, size: pd.Series) -> pd.Series:
    one = lambda p, k, n: report.dumps({"path": p, "kinds": list(k), "size_bytes": int(n)})[:-1].replace("\n", "\n    ")
    return pd.Series(["    " + one(p, k, n) for p, k, n in zip(path, kinds, size, strict=True)])


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    clean = F.translate(path, "\\", "/")
    return F.when(clean.startswith(base), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean)


def _list(section: int, groups: DataFrame, files: DataFrame, opening: Column, name: str, line: Column) -> DataFrame:
    """Rows of one list: ``groups`` (KEY, k1, k2, last) and ``files`` (KEY, path), with the columns that ``opening`` and ``line`` ask for."""
    end = groups.agg(F.max(F.struct("k1", "k2")).alias("end")).first()["end"]  # one row
    final = F.lit(False) if end is None else F.struct("k1", "k2") == F.struct(F.lit(end["k1"]), F.lit(end["k2"]).cast("long"))
    row = lambda kind, k3, text: [F.lit(section).alias("section"), F.lit(1).alias("phase"), "k1", "k2", F.lit(kind).alias("kind"), k3.alias("k3"), text.alias("text")]
    head = groups.select(*row(0, F.lit(""), F.concat(F.lit("    {\n"), opening, F.lit(f',\n      "{name}": ['))))
    foot = groups.select(*row(2, F.lit(""), F.concat(F.lit("      ]\n    }"), F.when(final, "").otherwise(","))))
    # A join that tells each file its group's keys: as many rows as files, whatever a group's size.
    body = files.join(groups.select(*KEY, "k1", "k2", "last"), KEY)
    body = body.select(*row(1, F.col("path"), F.concat(line, F.when(F.col("path") == F.col("last"), "").otherwise(","))))
    return head.unionByName(body).unionByName(foot)


def lines(telemetry: DataFrame, files: DataFrame, members: DataFrame, root: str, started: datetime, finished: datetime, algorithm: str = "SHA-256") -> DataFrame:
    """(ORDER, text) of the report of inventory ``files`` and judged ``members``."""
    spark = files.sparkSession
    keyed = verdicts.with_base(placeholders.split(files)[0]).select(*KEY, "path")
    grouped = keyed.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("path").alias("last")).where("n > 1").select(*KEY, F.col("base").alias("k1"), F.col("size").alias("k2"), "last")
    size = F.format_string('      "size_bytes": %d', "k2")
    base = F.concat(F.lit('      "normalized_base_name": '), quoted("base"), F.lit(",\n"))
    path = quoted(relative(F.col("path"), root))
    as_path = F.concat(F.lit('        {\n          "path": '), path, F.lit("\n        }"))
    parts = [_list(0, grouped, keyed, F.concat(base, size), "members", as_path)]
    for section, verdict in ((1, "identical_duplicate"), (2, "real_conflict")):
        mine = members.where(F.col("verdict") == verdict).select(*KEY, "path", "full")
        groups = mine.groupBy(*KEY).agg(F.min("path").alias("k1"), F.max("path").alias("last"), F.min("full").alias("hash")).withColumn("k2", F.col("size"))
        if section == 1:
            parts.append(_list(section, groups, mine, F.concat(F.lit('      "hash": '), quoted("hash"), F.lit(",\n"), size), "files", F.concat(F.lit("        "), path)))
        else:
            line = F.concat(F.lit('        {\n          "path": '), path, F.lit(',\n          "hash": '), quoted("full"), F.lit("\n        }"))
            parts.append(_list(section, groups, mine, F.concat(base, size), "files", line))
    held = placeholders.records(files)
    last = held.agg(F.max("path")).first()[0]
    comma = F.when(F.col("path") == F.lit(last), "").otherwise(",")
    parts.append(
        held.select(F.lit(3).alias("section"), F.lit(1).alias("phase"), F.col("path").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(1).alias("kind"), F.lit("").alias("k3"), F.concat(_placeholder(relative(F.col("path"), root), "kinds", "size_bytes"), comma).alias("text"))
    )
    some = [not p.isEmpty() for p in parts]
    out = spark.createDataFrame(_frame(telemetry, root, started, finished, algorithm, some), "section int, phase int, k1 string, k2 long, kind int, k3 string, text string")
    for p, any_ in zip(parts, some, strict=True):
        out = out.unionByName(p) if any_ else out
    return out


def summary(telemetry: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """(ORDER, text) of report.text_summary: identical groups by their first path, conflicts, and what couldn't be decided, file by file."""
    t = telemetry.first()
    first = f"{t.files_enumerated} files, {t.files_placeholder} placeholders, {t.files_partial_hashed} hashed in part, {t.files_full_hashed} in full"
    out = members.sparkSession.createDataFrame([(-1, 0, "", 0, 0, "", first)], "section int, phase int, k1 string, k2 long, kind int, k3 string, text string")
    reason = F.coalesce("read_error", "full_error") if "full_error" in members.columns else F.col("read_error")
    rows = members.withColumns({"reason": reason, "rel": relative(F.col("path"), root)})
    short = lambda c: F.substring(c, 1, 12)
    kinds = (
        ("identical_duplicate", F.lit(True), F.min("path"), F.concat(F.lit("identical "), short("hash")), F.concat(F.lit("  "), F.col("rel"))),
        ("real_conflict", F.lit(True), F.min("path"), F.concat(F.lit("conflict "), F.col("base")), F.concat(F.lit("  "), short("full"), F.lit(" "), F.col("rel"))),
        ("unresolved", F.col("reason").isNotNull(), F.first("base"), F.concat(F.lit("unresolved "), F.col("base")), F.concat(F.lit("  "), F.col("rel"), F.lit(": "), F.col("reason"))),
    )
    for section, (verdict, told, k1, opening, line) in enumerate(kinds):
        mine = rows.where((F.col("verdict") == verdict) & told)
        groups = mine.groupBy(*KEY).agg(k1.alias("k1"), F.min("hash").alias("hash")).withColumn("k2", F.col("size"))
        row = lambda kind, k3, text: [F.lit(section).alias("section"), F.lit(1).alias("phase"), "k1", "k2", F.lit(kind).alias("kind"), k3.alias("k3"), text.alias("text")]  # noqa: B023, E731
        out = out.unionByName(groups.select(*row(0, F.lit(""), F.concat(opening, F.format_string(" (%d bytes)", "size")))))
        out = out.unionByName(mine.drop("hash").join(groups.select(*KEY, "k1", "k2"), KEY).select(*row(1, F.col("path"), line)))
    return out


def _frame(telemetry: DataFrame, root: str, started: datetime, finished: datetime, algorithm: str, some: list[bool]) -> list[tuple]:
    """The rows around the lists: what stands before them, and each list's brackets."""
    head = report.head(telemetry.first(), root, started, finished, algorithm)
    rows = [(-1, 0, "", 0, 0, "", report.dumps(head)[: -len("\n}\n")] + ",")]
    for k, (name, any_) in enumerate(zip(NAMES, some, strict=True)):
        end = "\n}" if k == 3 else ","
        if any_:
            rows += [(k, 0, "", 0, 0, "", f'  "{name}": ['), (k, 2, "", 0, 0, "", "  ]" + end)]
        else:
            rows.append((k, 0, "", 0, 0, "", f'  "{name}": []' + end))
    return rows


def streamed(rows: DataFrame) -> Iterator[str]:
    """The report's text, a partition at a time."""
    for r in rows.orderBy(*ORDER).select("text").toLocalIterator():
        yield r.text + "\n"


def write(rows: DataFrame, path: str, scratch: str) -> None:
    """The report as one file: tasks write sorted parts into the folder ``scratch``, which are then copied one after the other."""
    rows.orderBy(*ORDER).select("text").write.mode("overwrite").text(scratch)
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, target = at(scratch).getFileSystem(conf), at(path).getFileSystem(conf)
    beside = at(path + ".tmp")
    out = target.create(beside, True)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(scratch)) if s.getPath().getName().startswith("part-"))
    for name in names:
        part = fs.open(at(f"{scratch}/{name}"))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    target.delete(at(path), False)
    target.rename(beside, at(path))
    fs.delete(at(scratch), True)
