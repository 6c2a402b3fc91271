"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Words are dealt in blocks of equal length. Each source gets a whole number of blocks by highest
quotients target / (2 k + 1), each shard of a source gets its whole number the same way. A shard's
documents stand in a seeded order, cut in blocks; its quota selects a run of blocks that begins at a
seeded one and goes on round the end, so that few documents are cut. A quota beyond all blocks of the
shard takes each of them once, and selects from them again for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import cut

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a source are spread over this many parts wherever they meet the table of sources.
SALTS = 64
#: Most equal rows that are dealt as one.
LOT = 1000


def size_of(text: str = "text") -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parts: DataFrame, group: list[str], share: str, seats: str, key: str, spread: int = 256) -> DataFrame:
    """Whole seats for each part of a group by highest quotients share / (2 k + 1), ties by ``key``.

    Adds ``quota``. ``seats`` is the group's number of seats, the same in all its rows. Starts from
    the rounded shares, then gives or takes the few seats that are left by the order of quotients; a
    part can gain or lose ceil(q * n / (2 * seats)) + 1 seats at most, n being the group's parts.
    """
    w = Window.partitionBy(*group)
    base = parts.withColumns({"_total": F.sum(share).over(w), "_n": F.count(F.lit(1)).over(w)})
    ideal = F.when(F.col("_total") > 0, F.col(share) * F.col(seats) / F.col("_total")).otherwise(F.lit(0.0))
    base = base.withColumn("_q", F.floor(ideal + F.lit(0.5)).cast("long"))
    base = base.withColumn("_gap", F.col(seats) - F.sum("_q").over(w))
    reach = F.when(F.col("_total") > 0, F.ceil(F.col("_q") * F.col("_n") / (F.lit(2.0) * F.greatest(F.col(seats), F.lit(1)))) + 1).otherwise(F.lit(0)).cast("long")
    reach = F.when(F.col("_gap") > 0, reach).when(F.col("_gap") < 0, F.least(reach, F.col("_q"))).otherwise(F.lit(0))
    steps = base.withColumn("_j", F.explode_outer(F.when(reach > 0, F.sequence(F.lit(1), reach.cast("int")))))
    # the quotient of the next seat to give, or of the last seat to take
    k = F.when(F.col("_gap") > 0, F.col("_q") + F.col("_j") - 1).otherwise(F.col("_q") - F.col("_j"))
    steps = steps.withColumn("_quotient", F.when(F.col("_j").isNotNull(), F.col(share) / (2 * k + 1)))
    give = Window.partitionBy(*group).orderBy(
        F.when(F.col("_gap") > 0, -F.col("_quotient")).otherwise(F.col("_quotient")).asc_nulls_last(), F.col(key).asc_nulls_last(), "_j"
    )
    steps = steps.withColumn("_rank", F.row_number().over(give))
    moved = F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.abs("_gap")), F.signum("_gap")).otherwise(F.lit(0.0))
    keep = [c for c in parts.columns if c not in group + [key]]
    out = steps.groupBy(*group, key).agg(*[F.first(c).alias(c) for c in keep], (F.first("_q") + F.sum(moved)).cast("long").alias("quota"))
    return out


def targets(sources: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size), one row a source.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``cap`` times the
    source's size and what is over goes to the others by weight until none is above: the level at
    which capped and uncapped targets add up is found by the order of cap / weight.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    t = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    t = t.withColumns({"_cap": F.col("source_size") * F.lit(float(cap)), "_all": F.sum("source_size").over(everything) * F.lit(float(share))})
    by = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(rest)})
    t = t.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    # sources up to the first one whose cap is above the level are full
    t = t.withColumn("_own", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level")))
    t = t.withColumn("_final", F.first("_own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, shard_words: int = 200_000, block_words: int = 64, most_shards: int = 65_536
) -> DataFrame:
    """Takes words from each source near its target.

    Returns doc_id, size, source_size, target, taken (words, repeats counted; at most ``cap`` times size),
    source, content (hash of the text), whole (times that the document is taken whole) and parts (its words
    that are taken once more, as an array of struct start, end); it carries no text. Null text has size 0;
    null is a source of its own; sizes of 0 give targets of 0; equal rows are interchangeable; an empty
    table gives an empty result. ``block_words`` shrinks for small corpora so that there are at least a
    thousand blocks for each source. Shards hold ``shard_words`` or more, where else there were over
    ``most_shards`` of a source, so that one task can sort a source's shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("content"), size_of().alias("size"))
    # equal rows meet before anything is dealt: one that is there a million times makes no shard large
    rows = rows.withColumns({"_absent": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}).groupBy("doc_id", "content", "size", "_absent", "_name").agg(F.count(F.lit(1)).alias("_many"))
    # the texts are read once, for their sizes
    rows = cut(rows)
    totals = rows.groupBy("_absent", "_name").agg(F.sum(F.col("size") * F.col("_many")).alias("source_size"))
    totals = totals.withColumn("source", F.when(~F.col("_absent"), F.col("_name")))
    t = targets(totals.select("source", "source_size"), weights, share, cap)
    every = Window.partitionBy(F.lit(0))
    t = t.withColumns({"_all": F.sum("target").over(every), "_many": F.count(F.lit(1)).over(every), "_zero": F.lit(0)})
    t = t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("_all") / (1000 * F.col("_many"))))).cast("long"))
    t = t.withColumn("seats", F.round(F.col("_all") / F.col("block")).cast("long"))
    t = apportion(t.select("_zero", "source", "source_size", "target", "block", "seats"), ["_zero"], "target", "seats", "source").drop("_zero", "seats")
    t = t.withColumn("shards", F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))).cast("int"))
    salted = t.withColumns({"_absent": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}).drop("source")
    salted = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a lot of equal rows is dealt in parts
    lots = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_many") - 1) / LOT)), lambda k: F.struct(k.alias("k"), F.least(F.lit(LOT).cast("long"), F.col("_many") - k * LOT).alias("n")))
    rows = rows.withColumn("_lot", F.explode(lots))
    place = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "content", "_lot.k")
    rows = rows.select("doc_id", "content", "size", "_absent", "_name", F.col("_lot.n").alias("_n"), place.alias("_order"), F.pmod(F.xxhash64(place, F.lit(1)), F.lit(SALTS)).cast("int").alias("_salt"))
    dealt = rows.join(salted, ["_absent", "_name", "_salt"]).drop("_salt")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(2)), F.col("shards")).cast("int"))
    # quota of each shard, in proportion to its words
    shard = ["_absent", "_name", "_shard"]
    words = dealt.groupBy(*shard).agg(F.sum(F.col("size") * F.col("_n")).alias("_words"), F.first("quota").alias("_seats"))
    quotas = apportion(words, ["_absent", "_name"], "_words", "_seats", "_shard").select(*shard, F.col("quota").alias("_quota"), "_words")
    dealt = dealt.join(quotas, shard).withColumn("_blocks", F.ceil(F.col("_words") / F.col("block")))
    # every block is taken ``whole`` times, and those of a run from a seeded block on once more, round the end
    due = F.least(F.col("_quota"), F.floor(F.col("_blocks") * F.lit(float(cap))))
    some = F.col("_blocks") > 0
    dealt = dealt.withColumns({"whole": F.when(some, F.floor(due / F.col("_blocks"))).otherwise(0).cast("long"), "_first": F.when(some, F.pmod(F.xxhash64(F.lit(seed), "_name", "_shard"), F.col("_blocks"))).otherwise(0)})
    dealt = dealt.withColumn("_last", F.col("_first") + F.when(some, due - F.col("whole") * F.col("_blocks")).otherwise(0))
    along = Window.partitionBy(*shard).orderBy("_order", "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("_begin", F.sum(F.col("size") * F.col("_n")).over(along) - F.col("size") * F.col("_n"))
    dealt = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("_begin", F.col("_begin") + F.col("_i") * F.col("size"))

    def within(first, last):
        """Words of the document in the blocks ``first`` to ``last``."""
        lo = F.greatest(F.lit(0), first * F.col("block") - F.col("_begin"))
        return F.struct(lo.cast("long").alias("start"), F.least(F.col("size"), last * F.col("block") - F.col("_begin")).cast("long").alias("end"))

    parts = F.filter(F.array(within(F.lit(0), F.col("_last") - F.col("_blocks")), within(F.col("_first"), F.least(F.col("_last"), F.col("_blocks")))), lambda p: p["end"] > p["start"])
    dealt = dealt.withColumn("parts", parts)
    taken = F.col("whole") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return dealt.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(~F.col("_absent"), F.col("_name")).alias("source"), "content", "whole", "parts")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs``, with all their columns, as ``mix_sources`` takes them.

    A document taken whole once or twice is there once or twice; of one taken in part, a row with the
    words of its selected blocks, joined by one space. Rows without words are left out. Rows that share
    doc_id and source are told apart by a hash of their text; of those that share it too, one stands for all.
    """
    keys = ["doc_id", "source", "content"]
    taken = mix_sources(docs, **options).filter("taken > 0").groupBy(*keys, "size", "whole", "parts").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    other = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("content"), row.alias("row"), other.alias("other"))
    # one row of each group of copies, chosen before and after the shuffle; how often it is taken is told by ``taken``
    rows = rows.groupBy(*keys).agg(F.min_by("row", "other").alias("row"))
    rows = rows.join(taken.alias("t"), [rows[k].eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("row", "t.whole", "t.parts", "t.n")
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))), " ")
    times = F.concat(F.array_repeat(F.lit(True), (F.col("whole") * F.col("n")).cast("int")), F.array_repeat(F.lit(False), F.when(F.size("parts") > 0, F.col("n")).otherwise(0).cast("int")))
    rows = rows.withColumn("all", F.explode(times))
    return rows.select(*[F.when(F.col("all"), F.col("row")[c]).otherwise(part).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def source_targets(mixed: DataFrame) -> DataFrame:
    """What is fixed for each document, without what its blocks' selection takes."""
    return mixed.select("doc_id", "size", "source_size", "target")


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n FROM w),
l AS (SELECT *, (total - before) / rest AS level FROM o),
f AS (SELECT arg_min(level, n) AS final FROM l WHERE level * w < cap)
SELECT d.doc_id, d.size, l.source_size, CASE WHEN f.final IS NULL THEN l.cap ELSE least(l.cap, f.final * l.w) END AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, f
"""
