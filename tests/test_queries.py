"""The registered queries against their SQL in DuckDB, and the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from syncsift.plans import registry
from syncsift.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def lines(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["l0_inventory", "normalize_names", "normalize_variants", "verdicts", "scan_telemetry", "summary_metrics", "keep_machine", "stability_check", "quarantine_manifest", "rescan_changes", "rescan_cached", "hash_edges", "scan_fingerprint", "csv_diff_totals", "markdown_diff_totals", "scan_report_lists", "stored_verdicts", "streamed_verdicts", "scan_report_lines", "cache_after_twins_return", "blake3_ranges", "partial_hash", "valid_name"])
def test_query(spark, duck, name):
    assert lines(registry.queries()[name](spark, SF).toPandas()) == lines(duck.sql(registry.oracle_sql()[name]).df())


def test_entry_without_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, *a):
        if name == 'corpus_pipeline' or name.startswith('syncsift.llm'): raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'verdicts' in e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not any(k.startswith('op') for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_stream_of_inventories(spark, tmp_path):
    schema = "path string, size long, attributes int, placeholder_kind string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(names):
        spark.createDataFrame([(n, 5, 0x1000 if "z" in n else 0, None) for n in names], schema).write.mode("append").parquet(folder)
        incremental.stream_groups(spark, folder, spark.read.parquet(folder).schema, out, str(tmp_path / "c")).awaitTermination()
        return sorted((r.base, r.members) for r in incremental.latest_groups(spark, out).collect())

    assert incremental.latest_groups(spark, out).count() == 0
    assert arrive([f"/r/{d}/f.txt" for d in "abc"] + ["/r/z.txt", "/r/g.txt"]) == [("f.txt", 3), ("g.txt", 1)]
    assert arrive(["/r/d/f.txt", "/r/h.txt"]) == [("f.txt", 4), ("g.txt", 1), ("h.txt", 1)]
    assert arrive(["/r/e/g.txt"]) == [("f.txt", 4), ("g.txt", 2), ("h.txt", 1)]
    assert len(list((tmp_path / "out").glob("view=*"))) == 2
