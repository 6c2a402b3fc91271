"""All four kinds of secrets are counted, as in SQL."""

import duckdb

from tarnwork.plans.queries import ORACLE_SQL, QUERIES

PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"


def test_four_kinds(spark, tmp_path):
    rows = [(1, f"{PEM}\nx {PEM}"), (2, "db postgres://u:p4ss@host/db and 'amqp://a:b@c' http://a.b/c"), (3, "AKIA" + "A1" * 8), (4, "plain"), (5, ".".join(["eyJabcdefghij"] * 3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLE_SQL["secret_hits_all"])
    got = sorted(tuple(r) for r in QUERIES["secret_hits_all"](spark, str(tmp_path)).select(*want.columns).collect())
    assert got == sorted(want.fetchall()) == [(1, 2, 0, 0, 0), (2, 0, 0, 0, 2), (3, 0, 1, 0, 0), (4, 0, 0, 0, 0), (5, 0, 0, 1, 0)]
