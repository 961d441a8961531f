"""A fold begins with the bytes that the numbering pass hands on, and a step copies its state in one pass."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from syncsift.llm import byte_bpe


def test_a_fold_takes_bytes_and_a_step_slices_nothing(spark):
    path = byte_bpe.default_ranks()
    ranks = {p: i for i, p in enumerate(byte_bpe.pieces_of(path)) if p}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["a", "é", " Toanorinin", " leéeuxément", "zzzzzzzzz", "  ", "x" * 300, "éêèç" * 20, "日本語のテキスト", "0123456789" * 30]
    rows = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>")
    for long_word in (256, 0):
        ids = byte_bpe.with_literals(byte_bpe.literals(path), lambda f: byte_bpe.encode_word(f, F.col("b"), long_word, len(ranks)))  # noqa: B023
        assert {r.w: r.ids for r in rows.select("w", ids.alias("ids")).collect()} == {w: library._encode_single_piece(w.encode()) for w in words}
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    plan = byte_bpe.encode(docs)._jdf.queryExecution().analyzed().toString()
    fold = plan[plan.index("aggregate(") :]
    assert "substring(" not in plan and "concat(" not in fold.split("replace(")[0]
