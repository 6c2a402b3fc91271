"""The bounded sample that the quality model is fitted on."""

from pyspark.sql import functions as F

from tarnwork.llm import quality

GOOD = "The committee met on Tuesday and agreed to repair the old bridge before winter. "


def drawn(docs, labels, rows=100, tokens=10**6):
    got = quality.draw_sample(docs, labels, rows, tokens, 5, quality.BITS).orderBy("turn", "doc_id", "grade", "content").collect()
    return [(r.doc_id, r.content) for r in got], sum(r.tokens for r in got)


def test_sample_is_bounded_whatever_repeats(spark):
    # one doc_id holds most rows: once the same text, once many texts
    same = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit(GOOD).alias("text"))
    many = spark.range(300).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit(GOOD), F.col("id").cast("string")).alias("text"))
    rest = spark.range(10, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit(GOOD), F.lit("again "), F.col("id").cast("string")).alias("text"))
    docs = same.unionByName(many).unionByName(rest).unionByName(spark.createDataFrame([(None, GOOD), (41, None), (42, "")], "doc_id long, text string"))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    every, tokens = drawn(docs, labels, 1000)
    assert len(every) == 1 + 300 + 30 + 2 and len(set(every)) == len(every)
    for rows in (1, 7, 50):
        assert drawn(docs, labels, rows)[0] == drawn(docs.repartition(5), labels, rows)[0] and len(drawn(docs, labels, rows)[0]) <= rows
    # by tokens: what comes first by hash, up to the bound
    some, held = drawn(docs, labels, 1000, tokens // 2)
    assert held <= tokens // 2 and some == every[: len(some)] and len(some) > 100


def test_a_text_of_many_tokens_takes_no_others_place(spark):
    long = " ".join(f"{GOOD} w{i}" for i in range(3000))
    docs = spark.createDataFrame([(i, long if i % 3 == 0 else f"{GOOD}{i}" if i % 3 == 1 else "%% && ## $$ !! ??") for i in range(60)], "doc_id long, text string")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 < 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    ids, held = drawn(docs, labels, 1000, 100_000)
    assert {i for i, _ in ids} == {i for i in range(60) if i % 3} and held <= 100_000
    model = quality.train(docs, labels, max_tokens=100_000)
    assert model is not None and quality.train(docs.limit(0), labels) is None
    # what wasn't drawn is graded all the same
    assert quality.grade_documents(docs, labels).filter("keep").count() == 40
