"""The walk up the callers over all targets and all calls, against plain loops."""

import os
import random
from collections import defaultdict

import pytest

from tarnwork.operators import callers
from tarnwork.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def direct(functions, edges):
    """Callers (path, start, id, name) of each target id, in order."""
    at = {i: (p, s, i, n) for i, p, s, n in functions}
    of = defaultdict(list)
    for c, callee in edges:
        if c in at and at[c][3] != callee:
            of[callee].append(at[c])
    return {i: sorted(x for x in of[n] if x[2] != i) for i, _, _, n in functions}, of


def walk(functions, edges):
    one, of = direct(functions, edges)
    out = []
    for t, found in one.items():
        if not 0 < len(found) <= 50:
            continue
        rows = [((1, 0, p, s), i) for p, s, i, _ in found]
        for k, (_, _, _, name) in enumerate(found[:19], 1):
            rows += [((2, k, p, s), i) for p, s, i, _ in of[name] if i != t]
        best = {}
        for o, i in rows:
            best[i] = min(best.get(i, o), o)
        order = sorted((o, i) for i, o in best.items())
        out += [(t, i, o[0], r, len(order) > 20) for r, (o, i) in enumerate(order[:20], 1)]
    return sorted(out)


@pytest.mark.parametrize("calls", [60, 400, 3000])
def test_walk_and_refusal(spark, calls):
    rng = random.Random(calls)
    functions = [(i, f"p{rng.randrange(9)}", i, f"n{min(rng.randrange(40), rng.randrange(40))}") for i in range(200)]
    edges = sorted({(rng.randrange(210), f"n{min(rng.randrange(45), rng.randrange(45))}") for _ in range(calls)})
    f = spark.createDataFrame(functions, "id long, path string, start long, name string")
    t, e = f.selectExpr("id AS target", "name"), spark.createDataFrame(edges, "caller_id long, callee string")
    assert sorted(tuple(r) for r in callers.caller_walk(t, f, e).collect()) == walk(functions, edges)
    assert sorted(tuple(r) for r in callers.refused(t, f, e).collect()) == [(i, len(x), len(x) > 50) for i, x in sorted(direct(functions, edges)[0].items())]


def test_every_part_is_a_target_and_every_lineitem_a_call(spark):
    parts = [(r.p_partkey, r.p_brand, r.p_partkey, f"n{r.p_partkey}") for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    most = max(p[0] for p in parts)
    called = lambda r: f"n{1 + (r.l_orderkey % most) % (1 + (r.l_orderkey * 7919 + r.l_linenumber * 104729) % most)}"
    edges = {(r.l_partkey, called(r)) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber").collect()}
    got = sorted(tuple(r) for r in QUERIES["caller_refusal_all"](spark, SF).collect())
    assert got == [(i, len(x), len(x) > 50) for i, x in sorted(direct(parts, edges)[0].items())] and len(got) == len(parts)
    walks = walk(parts, edges)
    assert {w[2] for w in walks} == {1, 2} and {w[4] for w in walks} == {False, True}
    assert sorted(tuple(r) for r in QUERIES["two_hop_callers_all"](spark, SF).collect()) == walks


def test_a_walk_makes_no_more_rows_than_it_can_use(spark, monkeypatch):
    leaves, parents, targets = 300, 5, 60
    functions = [(i, f"p{i % 7}", i, f"f{i}") for i in range(leaves + parents + targets)]
    edges = [(k, f"f{leaves + j}") for k in range(leaves) for j in range(parents)] + [(leaves + j, f"f{leaves + parents + t}") for j in range(parents) for t in range(targets)]
    f = spark.createDataFrame(functions, "id long, path string, start long, name string")
    dealt, repartition = [], type(f).repartition
    monkeypatch.setattr(type(f), "repartition", lambda self, *a: dealt.append(self) or repartition(self, *a))
    got = callers.caller_walk(f.selectExpr("id AS target", "name"), f, spark.createDataFrame(edges, "caller_id long, callee string"))
    assert sorted(tuple(r) for r in got.collect()) == walk(functions, edges)
    assert len(dealt) == 1 and dealt[0].count() <= targets * (parents + callers.SPANS + 2)
