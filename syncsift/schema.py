"""The inventory row, and the constants that a stored report or cache depends on."""

from pyspark.sql import types as T

#: One row per file: metadata only, content is optional.
INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime_ticks", T.LongType(), False),  # 100 ns since year 1; a timestamp has microseconds only
        T.StructField("attributes", T.IntegerType(), False),
        T.StructField("volume_id", T.StringType(), False),
        T.StructField("file_id", T.StringType(), False),
        T.StructField("placeholder_kind", T.StringType(), True),
        T.StructField("is_reparse_point", T.BooleanType(), True),
        T.StructField("is_directory", T.BooleanType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

NORMALIZER_VERSION, HASH_VERSION, REPORT_VERSION = 1, 1, 2
WINDOW = 65_536
MAX_DEPTH = 16
#: The folder under the root that holds moved files; scans leave it out.
RESERVED = "_quarantine"
TICKS_AT_EPOCH = 621_355_968_000_000_000
