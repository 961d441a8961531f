"""Conversation structure repair: the cheapest edits that give each conversation the shape (system? (user assistant)+)?.

A turn may be kept (K, 0), get the role user or assistant (R, 1) or be deleted (D, 2); a turn of empty text may be inserted
anywhere (I, 5). Blank turns and duplicates have to go; a truncated turn that stays adds 5. Of equal costs the edits whose
initials come first in ASCII are taken.

The fold is in Spark SQL: four states (nothing yet; a system turn; a user turn that waits; an answered one), and for each a
struct of cost and edits, null where it can't be reached. ``aggregate`` takes the structs through the sorted turns with
``least``. Two ways into one state differ in a letter before either ends, because each turn's edits end in a K, R or D;
so the least beginning stays least whatever follows. Inserts stand before the turn that follows them.

No conversation has to be one task's: turns are sorted by ranges of (conv_id, turn, role, text) and numbered, ``CHUNK``
consecutive numbers at most are an array, and a chunk is folded from each of the four states, unless it is a conversation's
first. A second fold joins the chunks' structs. Flags come from windows: duplicates first within a chunk, then among the
firsts of chunks, so that a text that all turns repeat is no window of all rows; chunks give their neighbours the last role.
Only ``digest`` brings a conversation's turns into one task, since its hash is of all of them in order; it streams.

Defined results: turns order by number (null first), then role, text; null role, text and ids within the damaged
key count as one space; a null conv_id is a conversation; repeated rows are turns like others (duplicates); a role's
initial is its first character (an empty role has none, and no keep); an empty table gives no rows; long conversations and texts
are taken whole; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from syncsift.llm.common import arrow, by_key, dealt, dropped, only, partitions, written

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
CHUNK_BITS = 8  # turns of a chunk: 256
WAY = "struct<cost:bigint,edits:string>"
WAYS = f"struct<q0:{WAY},q1:{WAY},q2:{WAY},q3:{WAY}>"
LONG_WAY = "struct<cost:bigint,edits:array<string>>"
LONG_WAYS = f"struct<q0:{LONG_WAY},q1:{LONG_WAY},q2:{LONG_WAY},q3:{LONG_WAY}>"

# Within this module edits name the role, too: I and J insert user and assistant, R and S give these roles. The order of letters
# agrees with that of the plain initials, and two edits that differ in the role alone are never compared: the edits before decide the state.
TO_PLAIN = ("JS", "IR")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after the damage that crc32 of ``conv_id:turn`` names."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = only(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumn("kind", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).where("kind <> 0")
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at), written: ``at`` orders a conversation's turns, and at >> CHUNK_BITS names a chunk."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "tie"]  # the last one lets rows that are equal go to several tasks
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return written(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()))


def flagged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, at, chunk, initial, fault) of each numbered turn: blank, duplicate, truncated or null."""
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = turns.select(
        "conv_id", "turn", "at", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.substring("role", 1, 1).alias("initial"), said.alias("said"),
        (F.btrim("text", F.lit(SPACE)) == "").alias("blank"), (~F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1).isin(*ENDS)).alias("cut"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "chunk", "said").orderBy("at")) > 1
    firsts = F.when(F.col("again"), F.col("chunk")).otherwise(-1)
    seen = F.row_number().over(Window.partitionBy("conv_id", "said", firsts).orderBy("at")) > 1
    rows = rows.withColumn("again", again).withColumn("seen", F.col("again") | seen)
    return rows.select("conv_id", "turn", "at", "chunk", "initial", F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated").alias("fault"))


def _ways(q0: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.struct(q0.alias("q0"), q1.alias("q1"), q2.alias("q2"), q3.alias("q3"))


def _then(way: Column, cost: Column | int, edit: str) -> Column:
    """The way with one edit more; null stays null."""
    more = F.struct((way["cost"] + cost).cast("bigint").alias("cost"), F.concat(way["edits"], F.lit(edit)).alias("edits"))
    return F.when(way.isNotNull(), more)


def _inserted(w: Column) -> Column:
    """Each state's least way, inserts allowed: at most one of each role, more would come back to a state at a cost."""
    q2 = F.least(w["q2"], _then(w["q0"], 5, "I"), _then(w["q1"], 5, "I"), _then(w["q3"], 5, "I"))
    return F.transform(F.array(_ways(w["q0"], w["q1"], q2, w["q3"])), lambda x: _ways(x["q0"], x["q1"], x["q2"], F.least(x["q3"], _then(x["q2"], 5, "J"))))[0]


def _step(ways: Column, turn: Column) -> Column:
    """The ways after one turn more."""
    must_go = turn["fault"].isin("blank", "duplicate")
    extra = F.when(turn["fault"] == "truncated", 5).otherwise(0)
    stays = F.coalesce(~must_go, F.lit(True))

    def after(w: Column) -> Column:
        def keep(q: str, initial: str) -> Column:
            return F.when(stays & (turn["initial"] == initial), _then(w[q], extra, "K"))

        def rerole(q: str, letter: str) -> Column:
            return F.when(stays, _then(w[q], extra + 1, letter))

        gone = {q: _then(w[q], 2, "D") for q in ("q0", "q1", "q2", "q3")}
        asked = [f(q, x) for q in ("q0", "q1", "q3") for f, x in ((keep, "u"), (rerole, "R"))]
        return _ways(gone["q0"], F.least(gone["q1"], keep("q0", "s")), F.least(gone["q2"], *asked), F.least(gone["q3"], keep("q2", "a"), rerole("q2", "S")))

    return F.transform(F.array(_inserted(ways)), after)[0]


def _start(state: Column, kind: str, edits: Column) -> Column:
    way = F.struct(F.lit(0).cast("bigint").alias("cost"), edits.alias("edits"))
    return _ways(*(F.when(state == i, way) for i in range(4))).cast(kind)


def chunks(flags: DataFrame) -> DataFrame:
    """(conv_id, chunk, start, ways, and the figures of the chunk): a row for each state that the chunk may begin in."""
    turn = F.struct("at", "initial", "fault")
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    held = flags.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *(fault(x) for x in ("blank", "duplicate", "truncated")))
    pairs = F.transform(F.col("turns"), lambda x, i: F.concat(F.when(i == 0, F.col("before")).otherwise(F.get("turns", i - 1)["initial"]), x["initial"]))
    illegal = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long")  # a first turn has no pair: null
    held = held.withColumn("before", F.lag(F.element_at("turns", -1)["initial"]).over(Window.partitionBy("conv_id").orderBy("chunk")))
    held = held.withColumn("illegal", illegal).withColumn("start", F.explode(F.when(F.col("before").isNull(), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))))
    return held.select("conv_id", "chunk", "start", "blank", "duplicate", "truncated", "illegal", F.aggregate("turns", _start(F.col("start"), WAYS, F.lit("")), _step).alias("ways"))


def _joined(ways: Column, part: Column) -> Column:
    """The ways through one chunk more; ``part.ways`` has the chunk's by the state that it begins in."""

    def to(q: str) -> Column:
        tries = []
        for s in range(4):
            old, new = ways[f"q{s}"], F.get(part["ways"], s)[q]
            more = F.struct((old["cost"] + new["cost"]).alias("cost"), F.concat(old["edits"], F.array(new["edits"])).alias("edits"))
            tries.append(F.when(old.isNotNull() & new.isNotNull(), more))
        return F.least(*tries)

    return _ways(*(to(f"q{s}") for s in range(4)))


def plans(folded: DataFrame) -> DataFrame:
    """(conv_id, cost, edits array, chunks array, and figures): the cheapest edits of each conversation, by chunk, and what follows the last."""
    figures = ("blank", "duplicate", "truncated", "illegal")
    by_start = F.transform(F.array(*map(F.lit, range(4))), lambda s: F.get(F.filter("w", lambda x: x["start"] == s), 0)["ways"])
    part = folded.groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("start", "ways")).alias("w"), *(F.first(f).alias(f) for f in figures))
    part = part.select("conv_id", *figures, F.struct("chunk", by_start.alias("ways")).alias("part"))
    # A chunk's structs are compared by the chunk's number alone, before their ways would be.
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), *(F.sum(f).alias(f) for f in figures))
    ways = F.aggregate("parts", _start(F.lit(0), LONG_WAYS, F.array().cast("array<string>")), _joined)

    def end(q: str, cost: int, edits: str) -> Column:
        w = F.col("ways")[q]
        return F.when(w.isNotNull(), F.struct((w["cost"] + cost).alias("cost"), F.concat(w["edits"], F.array(F.lit(edits))).alias("edits")))

    best = F.least(end("q0", 0, ""), end("q1", 10, "IJ"), end("q2", 5, "J"), end("q3", 0, ""))
    return whole.withColumn("ways", ways).withColumn("best", best).select("conv_id", "best.cost", "best.edits", F.col("parts.chunk").alias("chunks"), *figures)


def edits_of(plan: DataFrame) -> DataFrame:
    """(conv_id, chunk, nth, edits): each turn's edits by its place in the chunk; those after the last turn have the chunk null."""
    by_chunk = plan.select("conv_id", F.posexplode("edits").alias("i", "edits"), "chunks").withColumn("chunk", F.get("chunks", F.col("i")))
    turns = by_chunk.where("chunk IS NOT NULL").select("conv_id", "chunk", F.posexplode(F.regexp_extract_all("edits", F.lit("([IJ]*[DKRS])"), F.lit(1))).alias("nth", "edits"))
    return turns.unionByName(by_chunk.where("chunk IS NULL AND edits <> ''").select("conv_id", "chunk", F.lit(0).alias("nth"), "edits"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired turns) of (conv_id, turn, role, text).

    Plans, written: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit). Repaired: (conv_id, at, nth, role, text, edit), in the order of
    (at, nth); inserted turns have an empty text and the edit I.
    """
    rows = numbered(turns)
    flags = written(flagged(rows))
    plan = written(plans(chunks(flags)))
    gaps = flags.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    told = plan.join(gaps.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    audit = F.translate(F.array_join("edits", ""), *TO_PLAIN)
    told = written(told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit")))
    # A chunk is at most 2^CHUNK_BITS turns, so its edits meet its turns by (conversation, chunk, place).
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("at")) - 1
    places = flags.select("conv_id", "at", "chunk").withColumn("nth", place)
    found = edits_of(plan).withColumnRenamed("conv_id", "of")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    by_turn = written(places.join(found.where("chunk IS NOT NULL").withColumnsRenamed({"chunk": "c", "nth": "n"}), same & (F.col("chunk") == F.col("c")) & (F.col("nth") == F.col("n"))).select("at", "edits"))
    new_role = lambda e: F.when(e.isin("I", "R"), "user").when(e.isin("J", "S"), "assistant")
    letters = lambda e: F.filter(F.split(e, ""), lambda x: x != "")
    last = written(found.where("chunk IS NULL").select(F.col("of").alias("conv_id"), F.lit((1 << 63) - 1).alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "edits"))
    every = rows.join(by_turn.hint("merge"), "at").select("conv_id", "at", "role", "text", "edits").unionByName(last)
    e = F.col("e")
    empty = e.isin("I", "J")
    repaired = every.select("conv_id", "at", "role", "text", F.posexplode(letters(F.col("edits"))).alias("nth", "e")).where("e <> 'D'").select(
        "conv_id", "at", "nth", F.coalesce(new_role(e), F.col("role")).alias("role"), F.when(empty, "").otherwise(F.col("text")).alias("text"), F.translate(e, *TO_PLAIN).alias("edit")
    )
    for table in (flags, plan):
        dropped(table)
    return told, repaired


def hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of each conversation's ``role:text`` lines, streamed."""

    def run(batches):
        ids, out, now = [], [], None

        for (empty, conv), first, piece in by_key(batches, ("none", "conv")):
            if first:
                if now is not None:
                    out.append(now.hexdigest())
                ids.append(None if empty else int(conv))
                now = hashlib.sha256()
            lines = b"\n".join(x.encode("utf-8", "surrogateescape") for x in piece.column("line").to_pylist())
            now.update(lines if first else b"\n" + lines)
            if first and len(ids) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), pa.array(out)], ["conv_id", "repaired_sha256"])
                ids, out = ids[-1:], []
        if now is not None:
            out.append(now.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])

    lines = repaired.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "at", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    return arrow(run, dealt(lines, ["none", "conv"], ["at", "nth"]), "conv_id long, repaired_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conv_id of the undamaged rows."""
    told, repaired = repair(damaged(conversations))
    nothing = hashlib.sha256(b"").hexdigest()
    every = conversations.select("conv_id").distinct()
    a, b = told.withColumnRenamed("conv_id", "a"), hashes(repaired).withColumnRenamed("conv_id", "b")
    out = every.join(a, F.col("conv_id").eqNullSafe(F.col("a")), "left").join(b, F.col("conv_id").eqNullSafe(F.col("b")), "left")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *(F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _oracle() -> str:
    """DuckDB SQL: a recursive query takes four strings, cost in twelve digits and then edits, through the turns."""
    add = lambda way, cost, edit: f"(lpad((left({way}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({way}, 13) || '{edit}')"
    if_ = lambda condition, way: f"CASE WHEN {condition} THEN {way} END"
    users = ", ".join(f"{if_('stays AND ini = ' + repr('u'), add(c, 'extra', 'K'))}, {if_('stays', add(c, 'extra + 1', 'R'))}" for c in ("c0", "c1", "q3"))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM keyed),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN trim(text, {space}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN right(trim(text, {space}), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM n),
r AS (SELECT *, coalesce(fault = 'truncated', false)::INT * 5 AS extra, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stays, lag(ini) OVER (PARTITION BY c ORDER BY pos) || ini AS pair FROM f),
fold AS (SELECT DISTINCT c, 0::BIGINT AS pos, '000000000000' AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM r
  UNION ALL
  SELECT r.c, r.pos, {add("c0", 2, "D")}, least({add("c1", 2, "D")}, {if_("stays AND ini = 's'", add("c0", "extra", "K"))}), least({add("c2", 2, "D")}, {users}),
    least({add("c3", 2, "D")}, {if_("stays AND ini = 'a'", add("c2", "extra", "K"))}, {if_("stays", add("c2", "extra + 1", "S"))})
  FROM (SELECT *, least(q3, {add("c2", 5, "J")}) AS c3 FROM (SELECT c, pos, q0 AS c0, q1 AS c1, q3, least(q2, {add("q0", 5, "I")}, {add("q1", 5, "I")}, {add("q3", 5, "I")}) AS c2 FROM fold)) w
  JOIN r ON r.c = w.c AND r.pos = w.pos + 1),
best AS (SELECT c, least(q0, {add("q1", 10, "IJ")}, {add("q2", 5, "J")}, q3) AS way FROM fold JOIN (SELECT c, max(pos) AS pos FROM r GROUP BY c) USING (c, pos)),
letters AS (SELECT c, unnest(string_split(substr(way, 13), '')) AS e, unnest(range(length(way) - 12)) AS i FROM best WHERE length(way) > 12),
placed AS (SELECT *, sum((e NOT IN ('I', 'J'))::INT) OVER (PARTITION BY c ORDER BY i) AS pos FROM letters),
lines AS (SELECT p.c, p.i, CASE WHEN e IN ('I', 'R') THEN 'user' WHEN e IN ('J', 'S') THEN 'assistant' ELSE role END || ':' || CASE WHEN e IN ('I', 'J') THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN r ON r.c = p.c AND r.pos = p.pos WHERE e <> 'D'),
hashes AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM lines GROUP BY c),
figures AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(way, 12)::BIGINT, 0)::BIGINT AS cost, coalesce(translate(substr(way, 13), 'JS', 'IR'), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best USING (c) LEFT JOIN hashes USING (c)
"""


ORACLE = _oracle()
