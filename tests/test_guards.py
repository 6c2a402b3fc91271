"""Budgets of long runs, kept replies, and counts of rows by stage."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import canonical
from tarnwork.operators import cache, costs, ledger


def loop(rows, limit):
    """allowed and spent_before of one run's rows (cost, paid) in order."""
    spent, going, out = Decimal(0), True, []
    for cost, paid in rows:
        going = going and spent + Decimal(str(cost or 0)) <= Decimal(str(limit))
        out.append((going, float(spent)))
        spent += Decimal(str(paid or 0))
    return out


@pytest.mark.parametrize("limit", [0.0, 3.7, 25.0, 1e6])
def test_one_long_run(spark, limit):
    rng = random.Random(3)
    rows = [(i, round(rng.random(), 4) if i % 50 else 20.0, rng.choice([None, round(rng.random() / 3, 5)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, cost double, paid double").repartition(7)
    out = costs.budget_run(df, ["i"], limit, "paid", partitions=9).orderBy("i").collect()
    assert [(r.allowed, r.spent_before) for r in out] == loop([r[1:] for r in rows], limit)
    assert costs.budget_run(df, ["i"], limit, "paid", partitions=9).columns == ["i", "cost", "paid", "spent_before", "allowed"]


def test_runs_of_all_lengths(spark):
    rng = random.Random(4)
    rows = [(g, i, float(rng.randrange(1, 9)), float(rng.randrange(9))) for g, n in enumerate((1, 2, 900, 3, 40, 1, 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, cost double, paid double").repartition(5)
    got = costs.budget_run(df, ["i"], 120.0, "paid", ("g",), 16).orderBy("g", "i").collect()
    want = [x for g in range(7) for x in loop([r[2:] for r in rows if r[0] == g], 120.0)]
    assert [(r.allowed, r.spent_before) for r in got] == want
    assert len({r.allowed for r in got}) == 2


def test_no_task_holds_a_run(spark):
    df = spark.range(10_000).select(F.col("id"), F.lit(1.0).alias("cost"))
    placed = df.repartitionByRange(10, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 10 and max(r["count"] for r in placed) < 2500
    assert costs.budget_run(df, ["id"], 5000.0, partitions=10).filter("allowed").count() == 5000


ROWS = [(1, ("b", [("x", None), ("y", 2)]), {"k": 1, "a": 2}), (2, ("b", []), None), (3, None, {})]


def test_keys_do_not_depend_on_the_order_of_columns(spark):
    a = spark.createDataFrame(ROWS, "id int, bundle struct<name:string,spans:array<struct<path:string,line:int>>>, m map<string,int>")
    b = a.select("m", F.col("id"), F.when(F.col("bundle").isNotNull(), F.struct(F.transform("bundle.spans", lambda s: F.struct(s["line"].alias("line"), s["path"].alias("path"))).alias("spans"), F.col("bundle.name").alias("name"))).alias("bundle"))
    b = b.withColumn("m", F.when(F.col("m").isNotNull(), F.map_from_entries(F.reverse(F.map_entries("m")))))
    key = lambda df, **k: {r.id: r.cache_key for r in cache.keyed(df, ["id", "bundle", "m"], **({"models": ["a", "b"], "temperature": 0.0, "prompts": {"p": "1", "q": "2"}, "version": "1"} | k)).collect()}
    one = key(a)
    assert key(b) == one and len(set(one.values())) == 3
    assert key(a, prompts={"q": "2", "p": "1"}) == one
    for other in ({"models": ["b", "a"]}, {"temperature": 0.5}, {"prompts": {"p": "1", "q": "3"}}, {"version": "2"}):
        assert not set(key(a, **other).values()) & set(one.values())


def test_a_second_run_asks_nothing(spark, tmp_path):
    asked = []

    def ask(rows):
        asked.append(rows.count())
        return rows.select("cache_key", F.concat(F.lit("reply to "), F.col("q")).alias("reply"))

    store = cache.ReplyCache(spark, str(tmp_path / "replies"), "reply string")
    request = lambda qs: cache.keyed(spark.createDataFrame([(q, k) for k, q in enumerate(qs)], "q string, place int"), ["q"], ["m"], 0.0, {}, "1")
    first = store.answer(request(["a", "b", "a"]), ask)
    assert sorted((r.q, r.reply) for r in first.collect()) == [("a", "reply to a"), ("a", "reply to a"), ("b", "reply to b")]
    assert store.answer(request(["b", "a"]), ask).filter("reply IS NULL").count() == 0
    store.answer(request(["b", "c"]), ask)
    assert asked == [2, 0, 1] and store.rows().count() == 3

    def fails(rows):
        return rows.select("cache_key", F.raise_error(F.lit("no")).cast("string").alias("reply"))

    with pytest.raises(Exception):
        store.answer(request(["d"]), fails)
    assert store.rows().count() == 3 and store.unseen(request(["d", "c"])).count() == 1
    # a request that two runs have answered has one reply
    store.rows().limit(1).withColumn("reply", F.lit("later")).write.mode("append").parquet(store.folder)
    assert store.rows().count() == 3


def test_the_stage_that_loses_a_row_is_named(spark):
    rows = spark.createDataFrame([(f"p{k % 3}", k % 2, k) for k in range(100)], "path string, run_index int, result_index int")
    runs = (("0", F.col("run_index") == 0), ("1", F.col("run_index") == 1))

    def through(*stages):
        book, df = ledger.Ledger(["path", "run_index", "result_index"]), rows
        df = book.watch(df, "read", runs)
        for name, f in stages:
            df = book.watch(f(df), name, runs)
        df.write.format("noop").mode("overwrite").save()
        return book.check()

    same = ("same", lambda d: d.withColumn("x", F.lit(1)).repartition(3))
    assert through(same, same) == {"read": 100, "same": 100}
    with pytest.raises(ledger.Lost, match="^drops: run 0 has 49 rows, 50 before"):
        through(same, ("drops", lambda d: d.filter("result_index <> 4")), same)
    with pytest.raises(ledger.Lost, match="^swaps: as many rows"):
        through(("swaps", lambda d: d.withColumn("result_index", F.when(F.col("result_index") == 4, 6).otherwise(F.col("result_index")))), same)
    with pytest.raises(ledger.Lost, match="^moves: run 0"):
        through(("moves", lambda d: d.withColumn("run_index", F.when(F.col("result_index") == 4, 1).otherwise(F.col("run_index")))))


def test_deep_documents_are_invalid(spark):
    deep = "[" * 5000 + "]" * 5000
    df = spark.createDataFrame([("a", deep), ("b", "[1]")], "id string, raw string")
    assert {r.id: r.kind for r in canonical.flatten_documents(df).collect()} in ({"a": "invalid", "b": "number"}, {"a": "invalid", "b": "length"})
