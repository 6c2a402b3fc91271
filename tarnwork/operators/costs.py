"""Estimates and limits of cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.workers import kept

# Prices in USD for a million tokens (in, out), multipliers of cached input, reply sizes.
PRICES = {"small": (1.0, 5.0), "large": (5.0, 25.0)}
CACHE_WRITE, CACHE_READ = 1.25, 0.10
CALLS = (("reachability", 400, True), ("exploitability", 400, False), ("adversary", 600, False), ("adjudicator", 500, False))
RUN_LIMIT = 5.0


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def price(model: Column, which: int) -> Column:
    """Price of a model, 0 where it is unknown."""
    known = F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[which])])
    return F.coalesce(F.try_element_at(known, model), F.lit(0.0))


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, read: Column, written: Column) -> Column:
    fresh = F.greatest(F.lit(0), tokens_in - read - written)
    into = fresh + read * F.lit(CACHE_READ) + written * F.lit(CACHE_WRITE)
    return (into * price(model, 0) + tokens_out * price(model, 1)) / F.lit(1e6)


#: Tokens of a finding's one call where nothing is known of its prompt.
FLAT_IN, FLAT_OUT = 3000, 400


def flat_estimate(entries: DataFrame, model: str) -> DataFrame:
    """(calls, input_tokens, output_tokens, cost_usd) of one call for each entry, before any prompt is there."""
    one = call_cost(F.lit(model), F.lit(FLAT_IN), F.lit(FLAT_OUT), F.lit(0), F.lit(0))
    n = entries.agg(F.count(F.lit(1)).alias("calls"))
    return n.select("calls", (F.col("calls") * FLAT_IN).alias("input_tokens"), (F.col("calls") * FLAT_OUT).alias("output_tokens"), (F.col("calls") * one).alias("cost_usd"))


def four_calls(bundles: DataFrame) -> DataFrame:
    """Four calls for each bundle (id, model, shared_tokens, own_tokens): the shared part is written to the cache once and read thrice."""
    calls = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("out"), F.lit(w).alias("writes")) for r, n, w in CALLS])
    rows = bundles.withColumn("c", F.explode(calls))
    written, read = (F.when(F.col("c.writes") == w, F.col("shared_tokens")).otherwise(F.lit(0)) for w in (True, False))
    cost = call_cost(F.col("model"), F.col("shared_tokens") + F.col("own_tokens"), F.col("c.out"), read, written)
    return rows.select("id", "model", F.col("c.role").alias("role"), (F.col("shared_tokens") + F.col("own_tokens")).alias("input_tokens"), F.col("c.out").alias("output_tokens"), cost.alias("cost_usd"))


def budget_cut(rows: DataFrame, group: list[str], order: list[str], limit: float = RUN_LIMIT, spent: str = "cost") -> DataFrame:
    """Adds ``allowed``: false from the first row of a group on whose estimate would pass the limit; reaching it is allowed.

    ``spent`` names what earlier calls did cost, where that is known: it adds up in place of their estimates.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(spent).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_ok", (before + F.col("cost")) <= limit)
    return rows.withColumn("allowed", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_ok")


def budget_run(rows: DataFrame, order: list[str], limit: float = RUN_LIMIT, spent: str = "cost", group: tuple = (), partitions: int | None = None) -> DataFrame:
    """``budget_cut`` of runs of any length: adds ``allowed`` and ``spent_before``; no task holds a whole run.

    ``order`` tells a run's rows apart. Rows are dealt to ranges of (group, order); what a range spends is added up first, and
    carried to the later ranges of its run; where a range stops, the later ones are stopped too. Money adds up in whole billionths, so
    that a sum doesn't depend on how it was added; a null cost is nothing.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, money = ["_range", *group], lambda c: F.coalesce(F.col(c).cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)"))
    placed = kept(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()))
    ranges = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of a run
    carried = placed.groupBy(*keys).agg(F.sum(money(spent)).alias("_spent")).select(*keys, F.coalesce(F.sum("_spent").over(ranges), F.lit(0)).alias("_carried"))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.col("_carried") + F.coalesce(F.sum(money(spent)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = placed.join(carried, keys).withColumn("spent_before", before)
    run = run.withColumn("_ok", F.col("spent_before") + money("cost") <= F.lit(limit).cast("decimal(28,9)"))
    stopped = run.groupBy(*keys).agg(F.bool_and("_ok").alias("_ok")).select(*keys, F.coalesce(F.bool_and("_ok").over(ranges), F.lit(True)).alias("_open"))
    run = run.withColumn("_ok", F.bool_and("_ok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(stopped, keys)
    return run.withColumns({"allowed": F.col("_ok") & F.col("_open"), "spent_before": F.col("spent_before").cast("double")}).drop("_range", "_carried", "_ok", "_open")
