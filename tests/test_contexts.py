"""Bundles over made-up projects against a plain version that goes through them finding by finding."""

import os
import random
from collections import deque

import pandas as pd
import pytest

from tarnwork.functions import redact
from tarnwork.operators import bundles, callers
from tarnwork.plans import queries
from tarnwork.sources import pysource

KEY = "AKIA" + "ABCD1234EFGH5678"
DECORATORS = ["@app.route('/a')\n", "@task.task()\n@other\n", "@plain\n", ""]


def project(seed, n_files=6, n_names=18, per_file=12):
    """Files of functions that call each other, some nested, some decorated, some with secrets."""
    rng = random.Random(seed)
    name = lambda: f"f{min(rng.randrange(n_names), rng.randrange(n_names))}"
    files = []
    for k in range(n_files):
        out = ["import os\nfrom a import b as c, d\n"]
        for _ in range(per_file):
            body = []
            for _ in range(rng.randrange(5)):
                body.append(rng.choice([f"{name()}(x, {name()}(y))", f"z.{name()}(i for i in x)", f"{name()}((i for i in x))", "quote(x)", f"k = '{KEY}'", "eval(x)" if rng.random() < 0.2 else "é = 1", f"\n    def {name()}(q):\n        return {name()}(q)"]))
            out.append(f"{rng.choice(DECORATORS)}def {name()}(x=1):\n    " + "\n    ".join([*body, "return x"]) + "\n")
        files.append((f"{rng.choice(['src', 'lib', 'vendor'])}/m{k}.py", "\n".join(out)))
    return [(p, t, not p.startswith("vendor")) for p, t in sorted(files)]


def plain(findings, files):
    by_path = {}
    for path, text, searched in files:
        rows = pysource.symbols_of(path, text)
        by_path[path] = ([r for r in rows if r["kind"] == "function"], sorted((r for r in rows if r["kind"] == "call"), key=lambda r: (r["start_byte"], -r["end_byte"])), [r["text"] for r in rows if r["kind"] == "import"], searched)
    key = lambda f: (f["path"], f["start_byte"])

    def around(path, line):
        some = [f for f in by_path[path][0] if f["start_line"] <= line <= f["end_line"]]
        return min(some, key=lambda f: (f["end_line"] - f["start_line"], f["start_byte"]), default=None)

    def calling(name):
        found = {}
        for path, (_, calls, _, searched) in by_path.items():
            for c in calls if searched else []:
                f = around(path, c["start_line"]) if c["name"] == name else None
                if f and f["name"] != name:
                    found.setdefault(key(f), (f, c["start_line"]))
        return [found[k] for k in sorted(found)]

    def define(name):
        return next((f for _, (fs, _, _, searched) in sorted(by_path.items()) if searched for f in fs if f["name"] == name), None)

    show = lambda f: (f["path"], f["start_line"], f["end_line"], redact._redacted(f["text"], 1)["redacted"], f["name"])
    secrets = lambda f: [(s["kind"], s["length"], s["entropy_class"], s["line"], f["path"]) for s in redact._redacted(f["text"], f["start_line"])["secrets"]]
    out = {}
    for i, path, line in findings:
        if path not in by_path:
            out[i] = None
            continue
        own = around(path, line)
        if own is None:
            out[i] = {"imports": by_path[path][2], "reasons": [bundles.UNRESOLVED]}
            continue
        reasons, gone = set(), secrets(own)
        inside = [c for c in by_path[path][1] if own["body_start_byte"] <= c["start_byte"] and c["end_byte"] <= own["end_byte"]]
        if any(c["name"] in callers.DYNAMIC_CALLEES for c in inside):
            reasons.add(bundles.DYNAMIC)
        defined = [d for d in map(define, dict.fromkeys(c["name"] for c in inside)) if d]
        checked = [(c, None if c["name"] in callers.TRUSTED_NAMES else define(c["name"])) for c in inside]
        checked = [(c, d) for c, d in checked if d or c["name"] in callers.TRUSTED_NAMES]
        gone += [s for d in defined for s in secrets(d)] + [s for _, d in checked if d for s in secrets(d)]
        direct = [x for x in calling(own["name"]) if key(x[0]) != key(own)]
        visited, sites, stop = {key(own)}, [], None
        if len(direct) > 50:
            reasons.add(bundles.REFUSED)
        else:
            queue = deque((f, at, 1) for f, at in direct)
            while queue:
                f, at, hop = queue[0]
                if key(f) in visited:
                    queue.popleft()
                    continue
                if len(sites) == 20:
                    stop = (own["name"], f["path"], len(queue) + 1, 0)
                    reasons.add(bundles.TRUNCATED)
                    break
                queue.popleft()
                visited.add(key(f))
                sites.append((f, at, hop))
                if hop == 1 and len(sites) < 20:
                    queue.extend((g, a, 2) for g, a in calling(f["name"]) if key(g) not in visited)
        gone += [s for f, _, _ in sites for s in secrets(f)]
        kind = lambda f: next((k for d in f["decorators"] for needle, k in callers.ENTRYPOINTS if needle in d), None)
        entry = next((f for f, _, _ in sites if kind(f)), own if kind(own) else None)
        out[i] = {
            "imports": by_path[path][2], "own": show(own), "callers": [(show(f), at, hop) for f, at, hop in sites], "stop": stop, "refused": len(direct) if len(direct) > 50 else None, "defined": [show(d) for d in defined],
            "checked": [(c["name"], c["start_line"], d and show(d)) for c, d in checked], "redactions": gone, "entry": (kind(entry), show(entry)) if entry else None, "reasons": sorted(reasons), "back": len(sites) if entry else 0,
        }
    return out


def told(r):
    show = lambda s: s and (s.path, s.start_line, s.end_line, s.source, s.symbol)
    if bundles.UNREADABLE in r.reasons:
        return None
    if r.enclosing_function is None:
        return {"imports": r.imports, "reasons": r.reasons}
    search = r.caller_search
    return {
        "imports": r.imports, "own": show(r.enclosing_function), "callers": [(show(c.caller), c.call_line, c.hops_from_finding) for c in r.callers], "stop": tuple(search.truncated_at[0]) if search.truncated else None, "refused": search.direct_caller_count,
        "defined": [show(d) for d in r.called_definitions], "checked": [(s.name, s.location.line, show(s.definition)) for s in r.sanitizers], "redactions": [(s.kind, s.length, s.entropy_class, s.line, s.path) for s in r.redactions],
        "entry": (r.reachability.entrypoint_kind, show(r.reachability.entrypoint)) if r.reachability.externally_reachable else None, "reasons": r.reasons, "back": len(r.reachability.path_from_entrypoint),
    }


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"n_names": 60}), (3, {"n_files": 12, "n_names": 30}), (4, {"n_names": 6, "per_file": 30})])
def test_bundles_of_made_up_projects(spark, seed, options):
    files = project(seed, **options)
    rng = random.Random(seed)
    findings = [(k, rng.choice(files)[0] if k % 20 else "gone.py", rng.randrange(1, 90)) for k in range(120)]
    df = spark.createDataFrame(files, "path string, text string, project boolean").repartition(4)
    got = {r.id: told(r) for r in bundles.build(spark.createDataFrame(findings, "id int, uri string, line int"), df, pysource.symbols(df).cache()).collect()}
    want = plain(findings, files)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == want[i], i
    whole = [w for w in want.values() if w and "own" in w]
    assert any(w["callers"] for w in whole) and any(w["redactions"] for w in whole)


def test_routes_are_paths(spark):
    files = project(3, n_files=12, n_names=30)
    df = spark.createDataFrame(files, "path string, text string, project boolean")
    s = pysource.symbols(df).cache()
    inside = callers.containing(pysource.calls(s), pysource.functions(s).withColumn("function_id", bundles.function_id("path", "start_byte")), "start_line")
    edges = {(r.caller_id, r.callee) for r in bundles.edges_of(inside).collect()}
    names = {f"{r.path}#{r.start_byte}": r.name for r in pysource.functions(s).collect()}
    findings = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate((p, n) for p, _, _ in files for n in range(1, 60, 3))], "id int, uri string, line int")
    routes = [r.route for r in bundles.build(findings, df, s).collect() if r.route]
    assert {len(r) for r in routes} == {1, 2, 3}
    assert all((a, names[b]) in edges for r in routes for a, b in zip(r, r[1:]))


def test_a_source_goes_to_each_target_once(spark, monkeypatch):
    text = "def g(x):\n    return x\n\ndef f(x):\n" + "    g(x)\n" * 30 + "    return x\n"
    files = spark.createDataFrame([(f"src/m{k}.py", text) for k in range(3)], "path string, text string")
    findings = spark.createDataFrame([(k, f"src/m{k}.py", 6) for k in range(3)], "id long, uri string, line int")
    dealt, repartition = [], type(files).repartition
    monkeypatch.setattr(type(files), "repartition", lambda self, *a: (dealt.append(self) if "span" in self.columns else None) or repartition(self, *a))
    rows = bundles.build(findings, files, pysource.symbols(files)).collect()
    assert [len(r.sanitizers) for r in rows] == [30] * 3 and all(s.definition.symbol == "g" for r in rows for s in r.sanitizers)
    # each target's own source and that of the first g, which it shows 31 times
    assert len(dealt) == 1 and dealt[0].count() == 6


def test_symbols_are_handed_on_in_bounded_frames(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", "f()\n")], "path string, text string")
    parsers = []
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, parse, schema: parsers.append(parse))
    pysource.symbols(files)
    batch = pd.DataFrame({"path": [f"m{k}.py" for k in range(300)], "text": ["f(1)\n" * 99] * 300})
    frames = [len(f) for f in parsers[0](iter([batch, batch]))]
    assert sum(frames) == 600 * 100 and max(frames) <= 10_000


def test_bundles_are_made_part_after_part(spark, monkeypatch):
    files = project(2, n_files=4, n_names=30)
    findings = [(k, files[k % 4][0] if k % 9 else [None, "gone.py"][k % 2], k) for k in range(1, 90)]
    df, found = spark.createDataFrame(files, "path string, text string, project boolean"), spark.createDataFrame(findings, "id int, uri string, line int")
    symbols = pysource.symbols(df).cache()
    whole = bundles.build(found, df, symbols).collect()
    moved, repartition = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (moved.append(self) if "span" in self.columns else None) or repartition(self, *a))
    rows = bundles.built(found, df, symbols, lambda b: b.select("id", "callers", "redactions", "called_definitions", "reasons", "route"), most=60).collect()
    sizes = [m.count() for m in moved]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2
    assert {r.id: tuple(r) for r in rows} == {r.id: (r.id, r.callers, r.redactions, r.called_definitions, r.reasons, r.route) for r in whole}
    assert len(rows) == len(findings)


def test_files_of_finding_bundles_are_dealt_to_the_parser_alone(spark, monkeypatch):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    dealt, deal = [], queries.dealt
    monkeypatch.setattr(queries, "dealt", lambda files: dealt.append(files) or deal(files))
    rows = queries.QUERIES["finding_bundles"](spark, sf)
    assert len(dealt) == 1 and rows.count() == spark.read.parquet(f"{sf}/part.parquet").count()
    # what comes back is read from written tables: no plan holds the search and the bundles at once
    assert all("/written-" in f for f in rows.inputFiles())
