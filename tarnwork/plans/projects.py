"""A project of Python files made from customers and orders, and queries of what is known of findings in it.

Every customer is a function, in files of forty, every order a call: of another customer's function, now and then of
``getattr`` or ``quote``. Segments give decorators, balances below nought secrets. The callees lean to small keys, so
that functions have from no callers to more than a search allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.workers import importable, written
from tarnwork.operators import bundles, callers
from tarnwork.sources import pysource

_PATH = "'src/m' || CAST(floor(c_custkey / 40) AS BIGINT) || '.py'"
_DECORATOR = "CASE c_mktsegment WHEN 'BUILDING' THEN '@app.route(\"/b\")' WHEN 'MACHINERY' THEN '@celery.task()' END"
_KEY = "CASE WHEN c_acctbal < 0 THEN 'AKIA' || upper(substr(md5(c_name), 1, 16)) END"
_CALLEE = "CASE WHEN o_orderkey % 40 = 0 THEN 'getattr' WHEN o_orderkey % 23 = 0 THEN 'quote' ELSE 'f' || CAST(1 + (o_orderkey % most) % (1 + (o_orderkey * 7919 + 13) % most) AS BIGINT) END"
_ARGUMENTS = "CASE WHEN o_orderkey % 40 = 0 THEN '(q, \"a\")' ELSE '(q)' END"


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt to as many tasks as a shuffle has: parsing takes far longer than reading."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def sources(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the files, and (id, uri, line) of a finding for each customer."""
    importable(spark)
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    most = c.agg(F.max("c_custkey").alias("most"))
    calls = o.join(F.broadcast(most)).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(f"'    ' || {_CALLEE} || {_ARGUMENTS}").alias("call"))
    calls = calls.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "call"))), lambda x: x["call"]).alias("calls"))
    f = c.join(calls, "c_custkey", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    key, decorator = F.expr(f"'    key = \"' || {_KEY} || '\"'"), F.expr(_DECORATOR)
    text = F.array_compact(F.concat(F.array(decorator, F.expr("'def f' || c_custkey || '(q):'"), key), "calls", F.array(F.lit("    return q"), F.lit(""))))
    f = f.select("c_custkey", F.expr(_PATH).alias("path"), text.alias("lines"))
    head = F.array(F.lit("import os"), F.expr("'from lib.m' || min(c_custkey) || ' import x as y'"), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", "lines")))
    files = f.groupBy("path").agg(F.concat(head, F.flatten(F.transform(rows, lambda x: x["lines"]))).alias("_all"), F.transform(rows, lambda x: F.struct(x["c_custkey"].alias("id"), F.size(x["lines"]).alias("n"))).alias("_n"))
    # both tables come from one that is written: the orders are gathered once
    files = written(files.select("path", F.array_join("_all", "\n").alias("text"), "_n"))
    placed = files.select("path", F.posexplode("_n").alias("at", "x"), "_n")
    start = F.lit(4) + F.aggregate(F.slice("_n", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + x["n"])
    uri = F.expr("CASE x.id % 11 WHEN 1 THEN '../' || path WHEN 2 THEN 'src/gone.py' WHEN 4 THEN './' || path WHEN 0 THEN NULL ELSE path END")
    line = F.when(F.col("x.id") % 11 == 3, F.lit(1)).otherwise(start + F.col("x.id") % (F.col("x.n") - 1))
    return files.select("path", "text"), placed.select(F.col("x.id").alias("id"), uri.alias("uri"), line.cast("int").alias("line"))


_PROJECT = f"""
m AS (SELECT max(c_custkey) AS most FROM customer),
c AS (SELECT c_custkey AS id, {_PATH} AS path, {_DECORATOR} AS decorator, {_KEY} AS secret FROM customer),
o AS (SELECT o_custkey AS id, {_CALLEE} AS callee, {_ARGUMENTS} AS arguments, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders, m),
b AS (SELECT id, count(*) AS n, string_agg('    ' || callee || arguments, chr(10) ORDER BY n) AS calls FROM o GROUP BY id),
ent AS (SELECT id, -sum(k / 20.0::DOUBLE * log2(k / 20.0::DOUBLE)) AS bits FROM (SELECT id, ch, count(*) AS k FROM (SELECT id, unnest(string_split(secret, '')) AS ch FROM c WHERE secret IS NOT NULL) WHERE ch <> '' GROUP BY id, ch) GROUP BY id),
f AS (SELECT c.id, 'f' || c.id AS name, path, decorator, CASE WHEN bits IS NOT NULL THEN CASE WHEN round(bits, 12) < 3 THEN 'LOW' WHEN round(bits, 12) < 4 THEN 'MEDIUM' ELSE 'HIGH' END END AS entropy,
      (decorator IS NOT NULL)::INT + 1 AS head, (secret IS NOT NULL)::INT AS kept, coalesce(b.n, 0) AS n, calls FROM c LEFT JOIN b ON c.id = b.id LEFT JOIN ent ON c.id = ent.id),
g AS (SELECT *, 4 + coalesce(sum(head + kept + n + 2) OVER (PARTITION BY path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
      concat_ws(chr(10), decorator, 'def ' || name || '(q):', '    key = "<<REDACTED:kind=aws_access_key,len=20,entropy=' || lower(entropy) || '>>"', calls, '    return q') AS source FROM f),
fn AS (SELECT *, start + head + kept + n AS stop, CASE WHEN entropy IS NOT NULL THEN 'AWS_ACCESS_KEY:20:' || entropy || ':' || path || ':' || (start + head) END AS gone,
       CASE WHEN decorator LIKE '@app%' THEN 'HTTP_HANDLER' WHEN decorator LIKE '@celery%' THEN 'QUEUE_CONSUMER' END AS kind,
       '<<<UNTRUSTED SOURCE path=' || path || ' lines=' || start || '-' || (start + head + kept + n) || '>>>' || chr(10) || source || chr(10) || '<<<END UNTRUSTED SOURCE>>>' AS block FROM g),
call AS (SELECT o.id, callee, n_ AS n, fn.start + head + kept + n_ - 1 AS line FROM (SELECT id, callee, n AS n_ FROM o) o JOIN fn ON o.id = fn.id),
cl AS (SELECT a.id AS caller, d.id AS callee, min(a.line) AS line, any_value(s.path) AS path FROM call a JOIN fn d ON a.callee = d.name JOIN fn s ON a.id = s.id WHERE a.id <> d.id GROUP BY a.id, d.id),
dir AS (SELECT fn.id AS target, count(cl.caller) AS direct FROM fn LEFT JOIN cl ON fn.id = cl.callee GROUP BY fn.id),
h1 AS (SELECT callee AS target, caller, line, cl.path, row_number() OVER (PARTITION BY callee ORDER BY cl.path, caller) AS rk FROM cl JOIN dir ON callee = dir.target WHERE direct <= 50),
h2 AS (SELECT h1.target, h1.rk AS prank, h1.caller AS parent, cl.caller, cl.line, cl.path FROM h1 JOIN cl ON h1.caller = cl.callee LEFT JOIN h1 v ON v.target = h1.target AND v.caller = cl.caller
       WHERE h1.rk <= 19 AND cl.caller <> h1.target AND coalesce(v.rk > h1.rk, true)),
fr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hop, prank, path, caller) AS pos, count(*) OVER (PARTITION BY target) AS total
       FROM (SELECT target, 1 AS hop, 0 AS prank, target AS parent, caller, line, path FROM h1 UNION ALL SELECT target, 2, prank, parent, caller, line, path FROM h2)),
nw AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target, caller ORDER BY pos) AS again FROM fr) WHERE again = 1),
vi AS (SELECT nw.*, fn.source, fn.kind, fn.gone, fn.name, fn.block FROM nw JOIN fn ON nw.caller = fn.id WHERE rank <= 20),
sto AS (SELECT target, path AS stop_path, total - pos + 2 AS callers_found FROM nw WHERE rank = 21)
"""
_BUNDLES = (
    _PROJECT
    + """,
vl AS (SELECT target, string_agg(name || ':' || hop || ':' || line, ',' ORDER BY rank) AS callers, string_agg(source, chr(0) ORDER BY rank) AS sources, count(*) AS spans_used, string_agg(gone, ',' ORDER BY rank) AS gone,
       arg_min(kind, rank) FILTER (WHERE kind IS NOT NULL) AS kind, arg_min(name, rank) FILTER (WHERE kind IS NOT NULL) AS entry, arg_min(hop, rank) FILTER (WHERE kind IS NOT NULL) AS hop, arg_min(parent, rank) FILTER (WHERE kind IS NOT NULL) AS parent,
       string_agg(block, chr(10) || chr(10) ORDER BY rank) AS blocks, string_agg(block, chr(10) || chr(10) ORDER BY rank DESC) AS back, arg_min(block, rank) FILTER (WHERE kind IS NOT NULL) AS entry_block FROM vi GROUP BY target),
df AS (SELECT id, string_agg(source, chr(0) ORDER BY n) AS sources, string_agg(gone, ',' ORDER BY n) AS gone, string_agg(block, chr(10) || chr(10) ORDER BY n) AS blocks FROM (SELECT a.id, d.source, d.gone, d.block, min(a.n) AS n FROM call a JOIN fn d ON a.callee = d.name GROUP BY a.id, d.id, d.source, d.gone, d.block) GROUP BY id),
sn AS (SELECT a.id, string_agg(callee || '@' || line || CASE WHEN d.id IS NULL THEN '' ELSE '+' END, ',' ORDER BY a.n) FILTER (WHERE d.id IS NOT NULL OR callee = 'quote') AS sanitizers,
       string_agg(d.gone, ',' ORDER BY a.n) AS gone, bool_or(callee = 'getattr') AS dynamic,
       string_agg(callee, ',' ORDER BY a.n) FILTER (WHERE d.id IS NOT NULL OR callee = 'quote') AS names, string_agg(d.block, chr(10) || chr(10) ORDER BY a.n) AS blocks FROM call a LEFT JOIN fn d ON a.callee = d.name GROUP BY a.id),
hd AS (SELECT path, min(id) AS least FROM c GROUP BY path),
x AS (SELECT fn.id, fn.id % 11 AS k, fn.id % 11 NOT IN (0, 1, 2, 3) AS whole, fn.name, fn.source, fn.kind AS own_kind, fn.gone AS own_gone, vl.callers, vl.sources, vl.spans_used, vl.gone AS vl_gone, vl.kind AS vl_kind, vl.entry, vl.hop, dir.direct, sto.stop_path, sto.callers_found, df.sources AS defined, df.gone AS defined_gone, sn.sanitizers, sn.gone AS called_gone, coalesce(sn.dynamic, false) AS dynamic, hd.least,
      coalesce(vl.kind, fn.kind) AS reach, sn.names, concat_ws(chr(10) || chr(10), df.blocks, vl.blocks, fn.block, CASE WHEN vl.kind IS NOT NULL THEN entry_block WHEN fn.kind IS NOT NULL THEN fn.block END, CASE WHEN coalesce(vl.kind, fn.kind) IS NOT NULL THEN vl.back END, sn.blocks) AS block FROM fn JOIN dir ON fn.id = dir.target LEFT JOIN vl ON fn.id = vl.target LEFT JOIN sto ON fn.id = sto.target LEFT JOIN df ON fn.id = df.id LEFT JOIN sn ON fn.id = sn.id JOIN hd ON fn.path = hd.path)
"""
)

_REASONS = """CASE k WHEN 0 THEN 'enclosing-function-unresolved' WHEN 1 THEN 'enclosing-function-unresolved,path-traversal-refused' WHEN 2 THEN 'enclosing-function-unresolved,file-unreadable' WHEN 3 THEN 'enclosing-function-unresolved'
    ELSE concat_ws(',', CASE WHEN direct > 50 THEN 'caller-search-refused' END, CASE WHEN stop_path IS NOT NULL THEN 'caller-search-truncated' END, CASE WHEN dynamic THEN 'dynamic-dispatch' END) END"""
_LEVEL = """CASE WHEN NOT whole OR dynamic OR direct > 50 AND reach IS NULL THEN 'INSUFFICIENT' WHEN direct > 50 OR stop_path IS NOT NULL THEN 'PARTIAL' ELSE 'COMPLETE' END"""

SQL = f"""WITH {_BUNDLES}
SELECT id, CASE WHEN k IN (0, 1, 2) THEN '' ELSE 'import os|from lib.m' || least || ' import x as y' END AS imports, CASE WHEN whole THEN md5(source) END AS enclosing_md5,
  CASE WHEN whole THEN coalesce(callers, '') ELSE '' END AS callers, md5(CASE WHEN whole THEN coalesce(sources, '') ELSE '' END) AS callers_md5, whole AND direct > 50 AS refused, CASE WHEN whole AND direct > 50 THEN direct END AS direct_caller_count,
  CASE WHEN whole THEN coalesce(spans_used, 0) ELSE 0 END AS spans_used, CASE WHEN whole AND stop_path IS NOT NULL THEN name || ':' || stop_path || ':' || callers_found END AS truncated_at,
  md5(CASE WHEN whole THEN coalesce(defined, '') ELSE '' END) AS definitions_md5, CASE WHEN whole THEN coalesce(sanitizers, '') ELSE '' END AS sanitizers,
  CASE WHEN whole THEN coalesce(reach, 'UNKNOWN') ELSE 'UNKNOWN' END AS entrypoint_kind, CASE WHEN whole THEN CASE WHEN vl_kind IS NOT NULL THEN entry WHEN own_kind IS NOT NULL THEN name END END AS entrypoint,
  CASE WHEN whole AND reach IS NOT NULL THEN coalesce(spans_used, 0) ELSE 0 END AS n_path,
  CASE WHEN whole THEN CASE WHEN vl_kind IS NOT NULL THEN CASE WHEN hop = 2 THEN 3 ELSE 2 END WHEN own_kind IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END AS n_route,
  CASE WHEN whole THEN concat_ws(',', own_gone, defined_gone, called_gone, vl_gone) ELSE '' END AS redactions,
  {_REASONS} AS reasons,
  {_LEVEL} AS completeness
FROM x"""

_TEMPLATE = "{rule_id}|{message}|{file_class}|{completeness}|{completeness_reasons}|{externally_reachable}|{entrypoint_kind}|{caller_search_refused}|{caller_search_truncated}|{direct_caller_count}|{sanitizers}|{imports}|{context_block}|{data_flow}|{{}}"
SQL_PROMPTS = f"""WITH {_BUNDLES},
t AS (SELECT id, 'r' || (id % 3) || '|r' || (id % 3) || CASE WHEN k IN (0, 1, 2) THEN '|UNKNOWN|' ELSE '|SOURCE|' END || {_LEVEL} || '|' || coalesce(nullif({_REASONS}, ''), 'none') || '|' || CASE WHEN whole AND reach IS NOT NULL THEN 'True' ELSE 'None' END || '|' || CASE WHEN whole THEN coalesce(reach, 'UNKNOWN') ELSE 'UNKNOWN' END
      || '|' || CASE WHEN whole AND direct > 50 THEN 'True' ELSE 'False' END || '|' || CASE WHEN whole AND stop_path IS NOT NULL THEN 'True' ELSE 'False' END || '|' || CASE WHEN whole AND direct > 50 THEN CAST(direct AS VARCHAR) ELSE 'None' END
      || '|' || CASE WHEN whole THEN coalesce(names, 'none-confirmed') ELSE 'none-confirmed' END || '|' || CASE WHEN k IN (0, 1, 2) THEN 'none' ELSE 'import os,from lib.m' || least || ' import x as y' END
      || '|' || CASE WHEN whole THEN block ELSE '(no spans retrieved)' END || '|(none provided)|{{}}' AS prompt FROM x)
SELECT id, role, md5(role || ':' || prompt) AS prompt_md5 FROM t, (VALUES ('analyst'), ('adversary')) r(role)"""


def prompts_of_bundles(spark, sf_dir: str) -> DataFrame:
    files, findings = sources(spark, sf_dir)
    b = bundles.build(findings.withColumn("rule_id", F.concat(F.lit("r"), F.col("id") % 3)), files, written(pysource.symbols(dealt(files))))
    return bundles.prompts(b, {role: f"{role}:{_TEMPLATE}" for role in ("analyst", "adversary")}).select("id", "role", F.md5("prompt").alias("prompt_md5"))


#: Visits of every function's search, with the caller that led to each.
SQL_WALKS = f"""WITH {_PROJECT}
SELECT vi.target, CAST(rank AS INT) AS rank, vi.name AS caller, CAST(hop AS INT) AS hop, CAST(vi.line AS INT) AS call_line, 'f' || parent AS called FROM vi"""


def caller_routes(spark, sf_dir: str) -> DataFrame:
    """(target, rank, caller, hop, call_line, called) of all functions of the project, not of those that findings lie in alone."""
    files, _ = sources(spark, sf_dir)
    symbols = written(pysource.symbols(dealt(files)))
    f = bundles.places(pysource.functions(symbols).withColumn("function_id", bundles.function_id("path", "start_byte")))
    graph = f.select(F.col("function_id").alias("id"), "path", F.col("start_byte").alias("start"), "name")
    edges = bundles.edges_of(callers.containing(pysource.calls(symbols), f, "start_line"))
    visits, _ = callers.search(graph.select(F.col("id").alias("target"), "name"), graph, edges)
    name = lambda k, new: graph.select(F.col("id").alias(k), F.col("name").alias(new))
    out = visits.join(name("id", "caller"), "id").join(name("parent", "called"), "parent").join(name("target", "_target"), "target")
    return out.select(F.substring("_target", 2, 20).cast("long").alias("target"), "rank", "caller", "hop", "call_line", "called")


def context_bundles(spark, sf_dir: str) -> DataFrame:
    files, findings = sources(spark, sf_dir)
    return bundles.built(findings, files, written(pysource.symbols(dealt(files))), digests)


def digests(b: DataFrame) -> DataFrame:
    """Every field of a bundle, its sources as digests."""
    joined = lambda values, by=",": F.array_join(values, by)
    found = lambda r: F.concat_ws(":", r["kind"], r["length"].cast("string"), r["entropy_class"], r["path"], r["line"].cast("string"))
    search, reach = F.col("caller_search"), F.col("reachability")
    stop = F.get(search["truncated_at"], F.lit(0))
    return b.select(
        "id", joined("imports", "|").alias("imports"), F.md5("enclosing_function.source").alias("enclosing_md5"),
        joined(F.transform("callers", lambda c: F.concat_ws(":", c["caller"]["symbol"], c["hops_from_finding"].cast("string"), c["call_line"].cast("string")))).alias("callers"),
        F.md5(joined(F.transform("callers", lambda c: c["caller"]["source"]), "\0")).alias("callers_md5"), search["refused"].alias("refused"), search["direct_caller_count"].alias("direct_caller_count"), search["spans_used"].alias("spans_used"),
        F.when(stop.isNotNull(), F.concat_ws(":", stop["symbol"], stop["path"], stop["callers_found"].cast("string"))).alias("truncated_at"),
        F.md5(joined(F.transform("called_definitions", lambda d: d["source"]), "\0")).alias("definitions_md5"),
        joined(F.transform("sanitizers", lambda s: F.concat(s["name"], F.lit("@"), s["location"]["line"].cast("string"), F.when(s["definition"].isNull(), "").otherwise("+")))).alias("sanitizers"),
        reach["entrypoint_kind"].alias("entrypoint_kind"), reach["entrypoint"]["symbol"].alias("entrypoint"), F.size(reach["path_from_entrypoint"]).alias("n_path"), F.size("route").alias("n_route"),
        joined(F.transform("redactions", found)).alias("redactions"), joined("reasons").alias("reasons"), "completeness",
    )
