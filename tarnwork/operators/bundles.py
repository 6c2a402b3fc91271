"""What is known of a finding's surroundings, one row a finding, by joins over the symbol tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions import paths, redact, render
from tarnwork.functions.workers import written
from tarnwork.operators import callers, prefilter, verdicts
from tarnwork.sources import pysource

UNRESOLVED, DYNAMIC, TRUNCATED, REFUSED, NO_ENTRY = "enclosing-function-unresolved", "dynamic-dispatch", "caller-search-truncated", "caller-search-refused", "no-entrypoint-found"
OUTSIDE, UNREADABLE = "path-traversal-refused", "file-unreadable"
#: Fixed value: what a bundle notes of a refused search.
NOTE = "reached the direct-caller refuse threshold; entrypoint search did not run further"
HOPS = 2
#: Sections of a bundle, in the order in which their redactions are listed.
_OWN, _DEFINED, _CALLED, _CALLER = range(4)
#: Sources, counted once for each target that shows them, that are moved to their targets at a time: some 0.7 GB of shuffle.
SOURCES = 4_000_000


def function_id(path: str, start_byte: str) -> Column:
    return F.concat(F.col(path), F.lit("#"), F.col(start_byte).cast("string"))


def places(functions: DataFrame) -> DataFrame:
    """Where functions are, without their texts: what calls are joined to."""
    return functions.select("path", "name", "start_line", "end_line", "start_byte", "end_byte", "body_start_byte", "function_id")


def edges_of(inside: DataFrame) -> DataFrame:
    """(caller_id, callee, call_line), one for each pair: calls under their innermost function by line, the first call's line."""
    inner = inside.groupBy("path", "start_byte", "end_byte", "name", "start_line").agg(callers.innermost("f.function_id").alias("caller_id"))
    return inner.groupBy("caller_id", F.col("name").alias("callee")).agg(F.min_by("start_line", F.struct("start_byte", -F.col("end_byte"))).alias("call_line"))


def body_calls(inside: DataFrame) -> DataFrame:
    """(target, callee, line, at): every call in a function's body, those of functions defined there too, by bytes."""
    held = inside.filter((F.col("start_byte") >= F.col("f.body_start_byte")) & (F.col("end_byte") <= F.col("f.end_byte")))
    # of calls that start together the outer one comes first
    return held.select(F.col("f.function_id").alias("target"), F.col("name").alias("callee"), F.col("start_line").alias("line"), F.struct("start_byte", (-F.col("end_byte")).alias("before")).alias("at"))


def spans_of(functions: DataFrame) -> DataFrame:
    """(function_id, span, secrets, kind): each function's source, secrets replaced, and its kind of entrypoint."""
    rows = functions.withColumn("r", redact.redact("text", F.col("start_line")))
    span = F.struct("path", "start_line", "end_line", F.col("r.redacted").alias("source"), F.col("name").alias("symbol"), F.lit("python").alias("language"))
    return rows.select("function_id", span.alias("span"), redact.located(F.col("r.secrets"), F.col("path")).alias("secrets"), callers.entrypoint_kind(F.col("decorators")).alias("kind"))


def contexts(targets: DataFrame, functions: DataFrame, calls: DataFrame, searched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each target function(target, name) its callees' names and its search for callers, a row each; the sources that it shows,
    a row for each source, with all places that show it.

    ``functions`` with function_id, ``calls`` and ``searched``(path), the files where callers and definitions are looked for.
    """
    inside = callers.containing(calls, places(functions), "start_line")
    project = places(functions).join(searched, "path", "left_semi")
    edges = edges_of(inside.join(searched, "path", "left_semi"))
    graph = project.select(F.col("function_id").alias("id"), "path", F.col("start_byte").alias("start"), "name")
    # each of these is far smaller than the plan that makes it
    visits, state = callers.search(targets, graph, edges)
    state = written(state)
    called = written(body_calls(inside).join(targets.select("target"), "target", "left_semi"))
    first = project.groupBy(F.col("name").alias("callee")).agg(F.min_by("function_id", F.struct("path", "start_byte")).alias("function_id"))
    resolved = called.join(first, "callee", "left")
    no_int, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def section(rows: DataFrame, k: int, order: Column, **columns: Column) -> DataFrame:
        filled = {"function_id": F.col("function_id"), "name": no_text, "line": no_int, "hop": no_int, "parent": no_text} | columns
        return rows.select("target", F.lit(k).alias("section"), order.alias("order"), *[c.alias(n) for n, c in filled.items()])

    zero, never = F.lit(0), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    at = F.struct(F.col("at.start_byte").alias("a"), F.col("at.before").alias("b"))
    once = resolved.filter("function_id IS NOT NULL").groupBy("target", "callee", "function_id").agg(F.min("at").alias("at"))
    safe = F.col("callee").isin(*callers.TRUSTED_NAMES)
    checked = resolved.filter(safe | F.col("function_id").isNotNull())
    rows = section(targets, _OWN, never, function_id=F.col("target"))
    rows = rows.unionByName(section(once, _DEFINED, at))
    rows = rows.unionByName(section(checked, _CALLED, at, function_id=F.when(~safe, F.col("function_id")), name=F.col("callee"), line=F.col("line")))
    rows = rows.unionByName(section(visits, _CALLER, F.struct(F.col("rank").alias("a"), zero.alias("b")), function_id=F.col("id"), line=F.col("call_line"), hop=F.col("hop"), parent=F.col("parent")))
    # a source goes to each target once, however many places show it there; places without a source are dealt by their
    # targets, so that they don't all meet in one task
    rows = rows.withColumn("_dealt", F.coalesce("function_id", "target")).repartition("_dealt")
    place = F.struct("section", "order", "name", "line", "hop", "parent")
    rows = rows.groupBy("_dealt", "function_id", "target").agg(F.collect_list(place).alias("places"))
    spans = spans_of(functions).withColumnRenamed("function_id", "_dealt")
    of_source = lambda name: F.when(F.col("function_id").isNotNull(), F.col(name)).alias(name)
    # by source here, so that a written source takes little room however many targets show it
    sources = written(rows.join(spans, "_dealt", "left").select("target", "function_id", "places", *[of_source(c) for c in ("kind", "span", "secrets")]))
    callees = called.groupBy("target").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    return targets.join(callees, "target", "left").join(state, "target", "left"), sources


def _parts(sources: DataFrame) -> DataFrame:
    """(target, parts): the spans that each target shows, by section."""
    shown = sources.repartition("target").groupBy("target").agg(F.collect_list(F.struct("function_id", "places", "kind", "span", "secrets")).alias("shown"))
    part = lambda s, p: F.struct(p["section"].alias("section"), p["order"].alias("order"), s["function_id"].alias("function_id"), *[p[c].alias(c) for c in ("name", "line", "hop", "parent")], *[s[c].alias(c) for c in ("kind", "span", "secrets")])
    parts = F.array_sort(F.flatten(F.transform("shown", lambda s: F.transform(s["places"], lambda p: part(s, p)))), _by_place)
    return shown.select("target", parts.alias("parts"))


def _by_place(x: Column, y: Column) -> Column:
    key = lambda p: F.struct(p["section"], p["order"])
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def build(findings: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bundles of findings(id, uri, line, and rule_id and message where they are there); no finding is dropped.

    ``files``(path, text) are those that were read, with null text where that failed; ``project`` (boolean, true where absent)
    tells which are searched for callers and definitions, ``refusal`` (string, null where absent) why one wasn't opened.
    ``symbols`` are their symbols (see ``pysource.symbols``), read several times: pass a written or kept table.

    A finding without uri, with a refused path, with a file that wasn't read or without a function around its line (a missing
    line is the first one) gets what is known up to there. Otherwise its bundle holds the function's source, callers,
    definitions of what it calls, calls that may sanitise (every call counts), where it can be reached from, redactions of all
    sources in the order of these (a source that is shown twice is redacted twice), completeness and its reasons.
    ``path_from_entrypoint`` lists all callers, last visited first; ``route`` is a true path of function ids.
    """
    return _bundles(*_gathered(findings, files, symbols))


def built(findings: DataFrame, files: DataFrame, symbols: DataFrame, finish: Callable[[DataFrame], DataFrame], most: int = SOURCES) -> DataFrame:
    """What ``finish`` makes of the bundles that ``build`` gives, row by row, as a written table.

    Bundles are made and finished part after part, a part being targets that show some ``most`` sources, so that disk holds
    the sources of one part's bundles at a time instead of all.
    """
    rows, sources = _gathered(findings, files, symbols)
    rows, n = written(rows), max(1, -(-sources.count() // most))
    # a finding without a target shows no source: its path deals it
    of_part = lambda table, by, k: table.filter(F.pmod(F.xxhash64(by), F.lit(n)) == k) if n > 1 else table
    parts = [written(finish(_bundles(of_part(rows, F.coalesce("target", "path"), k), of_part(sources, F.col("target"), k)))) for k in range(n)]
    return reduce(DataFrame.unionAll, parts)


def _gathered(findings: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with all that is known of them but sources; the sources that their functions show."""
    for name, default in (("project", F.lit(True)), ("refusal", F.lit(None).cast("string"))):
        files = files if name in files.columns else files.withColumn(name, default)
    f = pysource.functions(symbols).withColumn("function_id", function_id("path", "start_byte"))
    carried = [c for c in ("rule_id", "message") if c in findings.columns]
    rows = findings.select("id", *carried, "uri", F.coalesce(F.when(F.col("line") > 0, F.col("line")), F.lit(1)).alias("line"))
    rows = rows.withColumn("path", F.when(F.col("uri") != "", paths.normal_uri(F.col("uri"))))
    read = files.select("path", "project", "refusal", F.col("text").isNotNull().alias("_read"), prefilter.head_of(F.col("text")).alias("_head"))
    rows = rows.join(read, "path", "left")
    outside = F.coalesce("refusal", paths.refusal(F.col("path")))
    rows = rows.withColumn("_exit", F.when(F.coalesce("uri", F.lit("")) == "", "no-uri").when(outside.isNotNull(), OUTSIDE).when(~F.coalesce("_read", F.lit(False)), UNREADABLE))
    points = rows.filter("_exit IS NULL").select("path", "line").distinct()
    here = callers.containing(points, f.select("path", "name", "start_line", "end_line", "start_byte", "function_id"))
    here = here.groupBy("path", "line").agg(callers.innermost().alias("f")).select("path", "line", F.col("f.function_id").alias("target"), F.col("f.name").alias("name"))
    here = written(here)
    rows = rows.join(here.select("path", "line", "target"), ["path", "line"], "left")
    known, sources = contexts(here.select("target", "name").distinct(), f, pysource.calls(symbols), files.filter("project").select("path"))
    listed = pysource.imports(symbols).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "start_byte", "text"))).alias("_imports"))
    rows = rows.join(listed, "path", "left").join(known, "target", "left")
    # a file is classified by its head too, where it was read
    class_ = F.when(F.col("_exit").isNull(), prefilter.classify(F.col("path"), F.col("_head"))["file_class"]).when(F.col("_exit") == UNREADABLE, prefilter.classify(F.col("path"))["file_class"]).otherwise("UNKNOWN")
    return rows.withColumn("file_class", class_).drop("project", "refusal", "_read", "_head"), sources


def _bundles(rows: DataFrame, sources: DataFrame) -> DataFrame:
    carried = [c for c in ("rule_id", "message") if c in rows.columns]
    # what is small first: the sources come last
    rows = rows.join(_parts(sources), "target", "left")
    of = lambda k: F.filter("parts", lambda p: p["section"] == k)
    none = lambda values: F.coalesce(values, F.array())
    visited = of(_CALLER)
    site = lambda p: F.struct(p["span"].alias("caller"), p["line"].alias("call_line"), p["hop"].alias("hops_from_finding"))
    own = F.get(of(_OWN), F.lit(0))
    entry = F.get(F.filter(visited, lambda p: p["kind"] != "UNKNOWN"), F.lit(0))
    kind = F.coalesce(entry["kind"], own["kind"], F.lit("UNKNOWN"))
    from_caller = entry["kind"].isNotNull()
    sites = none(F.transform(visited, site))
    route = F.when(from_caller, F.array_compact(F.array(entry["function_id"], F.when(entry["hop"] == 2, entry["parent"]), F.col("target")))).when(kind != "UNKNOWN", F.array("target"))
    reachable = F.when(kind != "UNKNOWN", F.lit(True))
    no = F.lit(None).cast("string")
    found, refused, truncated = F.col("target").isNotNull(), F.coalesce("refused", F.lit(False)), F.coalesce("truncated", F.lit(False))
    reasons = F.array(
        F.when(~found, UNRESOLVED).otherwise(no), F.when(F.col("_exit").isin(OUTSIDE, UNREADABLE), F.col("_exit")).otherwise(no),
        F.when(callers.dynamic_dispatch(F.col("callees")), DYNAMIC).otherwise(no), F.when(refused, REFUSED).otherwise(no), F.when(truncated, TRUNCATED).otherwise(no),
    )
    stop = F.struct(F.col("name").alias("symbol"), F.col("stop_path").alias("path"), (F.col("left") + 1).cast("int").alias("callers_found"), F.lit(0).alias("callers_kept"))
    search = F.struct(
        F.lit(HOPS).alias("hop_limit"), F.lit(callers.SPANS).alias("span_budget"), F.coalesce("spans_used", F.lit(0)).alias("spans_used"), refused.alias("refused"),
        F.when(refused, F.col("direct_callers")).alias("direct_caller_count"), truncated.alias("truncated"), F.when(truncated, F.array(stop)).otherwise(F.array()).alias("truncated_at"),
    )
    sanitizer = lambda p: F.struct(p["name"].alias("name"), F.struct(F.col("path").alias("path"), p["line"].alias("line")).alias("location"), p["span"].alias("definition"), F.lit(True).alias("confirmed"))
    return rows.select(
        "id", *carried, "uri", "path", "line", "file_class",
        none(F.when(F.col("_exit").isNull(), F.transform("_imports", lambda i: i["text"]))).alias("imports"),
        own["span"].alias("enclosing_function"), sites.alias("callers"), search.alias("caller_search"),
        none(F.transform(of(_DEFINED), lambda p: p["span"])).alias("called_definitions"), none(F.transform(of(_CALLED), sanitizer)).alias("sanitizers"),
        F.struct(
            kind.alias("entrypoint_kind"), F.when(from_caller, entry["span"]).when(kind != "UNKNOWN", own["span"]).alias("entrypoint"),
            F.when(kind != "UNKNOWN", F.reverse(sites)).otherwise(F.array()).alias("path_from_entrypoint"), reachable.alias("externally_reachable"), F.when(refused, F.array(F.lit(NOTE))).otherwise(F.array()).alias("notes"),
        ).alias("reachability"),
        none(route).alias("route"),
        none(F.flatten(F.transform(F.filter("parts", lambda p: p["secrets"].isNotNull()), lambda p: p["secrets"]))).alias("redactions"),
        F.array_sort(F.array_compact(reasons)).alias("reasons"),
        verdicts.completeness(F.array_compact(reasons), reachable).alias("completeness"),
    )


def all_spans() -> Column:
    """Every source of a bundle, as often as it is shown: definitions, callers, the function, its entrypoint, the path from
    there, sanitizers' definitions."""
    caller = lambda c: c["caller"]
    one = lambda span: F.array_compact(F.array(span))
    reach = F.col("reachability")
    return F.concat(
        "called_definitions", F.transform("callers", caller), one(F.col("enclosing_function")), one(reach["entrypoint"]), F.transform(reach["path_from_entrypoint"], caller),
        F.array_compact(F.transform("sanitizers", lambda s: s["definition"])),
    )


def prompts(bundles: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(id, role, prompt): each role's template filled in from each bundle, its sources as quoted blocks only.

    Templates name the fields of ``render.bundle_fields``; what the bundles don't have reads as there is said.
    """
    spans = F.transform(all_spans(), lambda s: redact.untrusted_block(s["path"], s["start_line"], s["end_line"], s["source"]))
    search, reach = F.col("caller_search"), F.col("reachability")
    flat = bundles.withColumns({
        "spans": spans, "externally_reachable": reach["externally_reachable"], "entrypoint_kind": reach["entrypoint_kind"], "refused": search["refused"], "truncated": search["truncated"],
        "direct_callers": search["direct_caller_count"], "trusted_callees": F.transform("sanitizers", lambda s: s["name"]),
    })
    fields = render.bundle_fields(flat.columns) | {"direct_caller_count": F.coalesce(F.col("direct_callers").cast("string"), F.lit("None"))}
    texts = F.array(*[F.struct(F.lit(role).alias("role"), render.substitute(template, fields).alias("prompt")) for role, template in templates.items()])
    return flat.select("id", F.explode(texts).alias("t")).select("id", "t.*")


def stratum(file_class: Column, path: Column, checkout: Column, reasons: Column) -> Column:
    """Why a finding can't be judged, first reason first; triable if none."""
    has = lambda r: F.array_contains(reasons, r)
    out = F.when(path.isNull(), "no-location").when(~F.lower(path).endswith(".py"), "non-python").when(~checkout, "no-checkout")
    out = out.when(~file_class.isin("SOURCE", "UNKNOWN"), F.concat(F.lower(file_class), F.lit("-class")))
    for r in (UNRESOLVED, DYNAMIC, REFUSED, TRUNCATED):
        out = out.when(has(r), r)
    return out.otherwise("triable")


def histograms(bundles: DataFrame) -> DataFrame:
    """(what, value, n): counts of completeness levels and of reasons."""
    levels = bundles.groupBy(F.lit("completeness").alias("what"), F.col("completeness").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    why = bundles.select(F.explode("reasons").alias("value")).groupBy(F.lit("reason").alias("what"), "value").agg(F.count(F.lit(1)).alias("n"))
    return levels.unionByName(why)
