"""Registered queries of the finding-triage operators over the driver's tables, and their SQL.

The adapters below turn the tables into the operators' inputs; both sides of each pair state the
same adapter, so that the SQL checks the operator alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import canonical, identity, paths, redact, render
from tarnwork.functions.workers import importable, written
from tarnwork.operators import bundles, callers, costs, prefilter, records, replies, scoring, verdicts
from tarnwork.plans import projects, steps
from tarnwork.plans.projects import dealt
from tarnwork.sources import pysource, reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- findings: one for each document -------------------------------------------------------------


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings: run = number of the source, rule = language, file by language, snippet = first line."""
    d = table(spark, sf_dir, "documents")
    none = F.create_map().cast("map<string,string>")
    return d.select(
        F.expr("try_cast(substring(source, 4) AS int)").alias("run_index"),
        F.col("doc_id").alias("result_index"),
        F.concat(F.lit("docs\0"), "lang").alias("scope"),
        F.col("lang").alias("rule_id"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "./tests/").when(F.col("doc_id") % 5 == 1, "src\\vendor\\").otherwise("src/"), "lang", F.lit("/corpus.py")).alias("uri"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 7).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("start_column"),
        F.when(F.col("doc_id") % 11 != 0, F.substring_index("text", "\n", 1)).alias("snippet"),
        F.when(F.col("n_chars") > 3000, F.create_map(F.lit(identity.LINE_HASH), F.md5("text"))).otherwise(none).alias("partial_fps"),
        F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("print/v1"), F.md5(F.substring("text", 1, 12)))).otherwise(none).alias("fps"),
    )


_FINDINGS = r"""
f AS (SELECT TRY_CAST(substr(source, 4) AS INT) AS run_index, doc_id AS result_index, 'docs' || chr(0) || lang AS scope, lang AS rule_id,
      CASE doc_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/vendor/' ELSE 'src/' END || lang || '/corpus.py' AS path,
      CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 7 AS INT) END AS start_line,
      CASE WHEN doc_id % 11 <> 0 THEN split_part(text, chr(10), 1) END AS snippet,
      CASE WHEN n_chars > 3000 THEN md5(text) END AS line_hash, CASE WHEN doc_id % 3 = 0 THEN md5(substr(text, 1, 12)) END AS print
      FROM documents),
v AS (SELECT run_index, line_hash AS value, rule_id, path, start_line FROM f WHERE line_hash IS NOT NULL
      UNION ALL SELECT run_index, print, rule_id, path, start_line FROM f WHERE print IS NOT NULL),
bad AS (SELECT run_index, value FROM (SELECT DISTINCT * FROM v) GROUP BY run_index, value HAVING count(*) > 1),
u AS (SELECT f.*, CASE WHEN b1.value IS NULL THEN f.line_hash END AS good_line, CASE WHEN b2.value IS NULL THEN f.print END AS good_print
      FROM f LEFT JOIN bad b1 ON f.run_index = b1.run_index AND f.line_hash = b1.value LEFT JOIN bad b2 ON f.run_index = b2.run_index AND f.print = b2.value),
c AS (SELECT *, substr(sha256(CASE
        WHEN good_line IS NOT NULL THEN concat_ws(chr(0), 'findings/v1', scope, rule_id, path, '', good_line)
        WHEN good_print IS NOT NULL THEN concat_ws(chr(0), 'findings/v1', scope, rule_id, path, '', 'print/v1', good_print)
        WHEN snippet IS NOT NULL THEN concat_ws(chr(0), 'findings/v1', scope, rule_id, path, '', rtrim(snippet, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)))
        ELSE concat_ws(chr(0), 'findings/v1', scope, rule_id, path, coalesce(CAST(start_line AS VARCHAR), ''), '') END), 1, 32) AS correlation_id,
      CASE WHEN good_line IS NOT NULL THEN 'primaryLocationLineHash' WHEN good_print IS NOT NULL THEN 'toolFingerprint' WHEN snippet IS NOT NULL THEN 'content' ELSE 'positional' END AS identity_source
      FROM u)
"""
_REFS = (
    _FINDINGS
    + """,
o AS (SELECT *, dense_rank() OVER (PARTITION BY run_index, correlation_id ORDER BY start_line ASC NULLS LAST) - 1 AS n FROM c),
r AS (SELECT * REPLACE (CASE WHEN n > 0 THEN correlation_id || ':' || n ELSE correlation_id END AS correlation_id) FROM o),
p AS (SELECT *, row_number() OVER w > 1 AS again,
      CASE WHEN path LIKE 'src/vendor/%' THEN 'VENDORED' WHEN path LIKE 'tests/%' THEN 'TEST' ELSE 'UNKNOWN' END AS file_class,
      first_value(run_index) OVER w AS kept_run, first_value(result_index) OVER w AS kept_result
      FROM r WINDOW w AS (PARTITION BY correlation_id ORDER BY run_index, result_index)),
x AS (SELECT *, CASE WHEN again THEN 'DEDUPLICATED' ELSE 'ADJUDICATE' END AS disposition FROM p)
"""
)


def _refs(spark, sf_dir):
    return identity.tell_apart(identity.correlate(findings(spark, sf_dir)))


def _decisions(spark, sf_dir):
    return prefilter.decide(_refs(spark, sf_dir), path=identity.path_of(F.col("uri")))


@query(f"WITH {_FINDINGS} SELECT run_index, result_index, correlation_id, identity_source FROM c")
def correlation_ids(spark, sf_dir):
    return identity.correlate(findings(spark, sf_dir)).select("run_index", "result_index", "correlation_id", "identity_source")


@query(f"WITH {_FINDINGS} SELECT run_index, value FROM bad")
def degenerate_fingerprints(spark, sf_dir):
    return identity.degenerate(findings(spark, sf_dir))


@query(f"WITH {_REFS} SELECT run_index, result_index, correlation_id FROM r")
def occurrence_ordinals(spark, sf_dir):
    return _refs(spark, sf_dir).select("run_index", "result_index", "correlation_id")


@query(
    f"""WITH {_REFS} SELECT run_index, result_index, correlation_id, disposition, file_class,
    CASE WHEN again THEN 'prefilter:dedupe' ELSE 'prefilter:pass' END AS resolved_by,
    CASE WHEN again THEN 'Identical correlation ID to the finding at run ' || kept_run || ', result ' || kept_result || '. Same rule, same location, same content.'
         ELSE 'Classified ' || file_class || ' (' || CASE file_class WHEN 'VENDORED' THEN 'path segment ''vendor''' WHEN 'TEST' THEN 'path segment ''tests''' ELSE 'no path rule matched, contents not read' END
              || '). Not resolvable without judgment; passed to adjudication.' END AS justification,
    CASE WHEN again THEN correlation_id END AS duplicate_of FROM x"""
)
def prefilter_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("run_index", "result_index", "correlation_id", "disposition", "file_class", "resolved_by", "justification", "duplicate_of")


@query(f"WITH {_FINDINGS} SELECT identity_source, count(*) AS n, CAST(count(*) FILTER (WHERE identity_source = 'positional') AS BIGINT) AS degraded FROM c GROUP BY identity_source")
def identity_source_counts(spark, sf_dir):
    c = identity.correlate(findings(spark, sf_dir))
    return c.groupBy("identity_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("identity_source") == "positional").alias("degraded"))


@query(f"WITH {_REFS} SELECT disposition, count(*) AS n FROM x GROUP BY disposition")
def disposition_counts(spark, sf_dir):
    return prefilter.disposition_counts(_decisions(spark, sf_dir))


@query(f"WITH {_REFS} SELECT file_class, count(*) AS n FROM x WHERE disposition <> 'DEDUPLICATED' AND file_class NOT IN ('SOURCE', 'UNKNOWN') GROUP BY file_class")
def resolvable_by_class(spark, sf_dir):
    return prefilter.resolvable_by_class(_decisions(spark, sf_dir))


@query(f"WITH {_REFS} SELECT count(*) AS overlap FROM (SELECT correlation_id FROM r GROUP BY correlation_id HAVING count(DISTINCT run_index) > 1)")
def cross_run_overlap(spark, sf_dir):
    return prefilter.cross_run_overlap(_refs(spark, sf_dir))


@query(f"WITH {_REFS} SELECT count(*) AS total, count(*) FILTER (WHERE disposition <> 'ADJUDICATE') AS settled, count(*) FILTER (WHERE disposition <> 'ADJUDICATE') / count(*) AS ratio FROM x")
def settled_ratio(spark, sf_dir):
    return prefilter.settled_ratio(_decisions(spark, sf_dir))


# ---- classes of files ----------------------------------------------------------------------------

_DIR_CASES = "CASE page_id % 8 WHEN 0 THEN 'Vendor/' WHEN 1 THEN 'app/Tests/' WHEN 2 THEN 'dist/' WHEN 3 THEN 'a/fixtures/' ELSE 'lib/' END"
_NAME_CASES = "CASE page_id % 6 WHEN 0 THEN 'test_x.py' WHEN 1 THEN 'y.min.js' WHEN 2 THEN 'PageTest.java' WHEN 3 THEN 'z.spec.ts' ELSE 'main.py' END"


@query(
    f"""WITH p AS (SELECT page_id, {_DIR_CASES} AS d, {_NAME_CASES} AS n FROM pages)
    SELECT page_id, CASE d WHEN 'Vendor/' THEN 'VENDORED' WHEN 'app/Tests/' THEN 'TEST' WHEN 'dist/' THEN 'GENERATED' WHEN 'a/fixtures/' THEN 'FIXTURE' ELSE
      CASE n WHEN 'y.min.js' THEN 'GENERATED' WHEN 'main.py' THEN 'UNKNOWN' ELSE 'TEST' END END AS file_class FROM p"""
)
def file_class(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.expr(_DIR_CASES), F.expr(_NAME_CASES)).alias("path"))
    return p.select("page_id", prefilter.classify(F.col("path")).getField("file_class").alias("file_class"))


@query("SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '' AND s <> '.') AS segments, len(list_filter(string_split(url, '/'), lambda s: s <> '' AND s <> '.')) AS n FROM pages")
def path_segments(spark, sf_dir):
    s = prefilter.segments(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", s.alias("segments"), F.size(s).cast("long").alias("n"))


_MARKERS = ", ".join(f"'{m}'" for m in prefilter.GENERATED_MARKERS)


@query(
    f"""WITH h AS (SELECT doc_id, lower(array_to_string(list_slice(string_split(substr(CASE doc_id % 9 WHEN 0 THEN '# Code generated by x. DO NOT EDIT' || chr(10) ELSE '' END || text, 1, 8192), chr(10)), 1, 5), chr(10))) AS head FROM documents)
    SELECT doc_id, list_filter([{_MARKERS}], lambda m: contains(head, m))[1] AS marker FROM h"""
)
def generated_markers(spark, sf_dir):
    text = F.concat(F.when(F.col("doc_id") % 9 == 0, "# Code generated by x. DO NOT EDIT\n").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", prefilter.marker(prefilter.head_of(text)).alias("marker"))


@query(r"SELECT page_id, nfc_normalize(replace(url_decode(url), chr(92), '/')) AS path FROM pages")
def normalized_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.path_of(F.col("url")).alias("path"))


# ---- verdicts ------------------------------------------------------------------------------------

_REASONS = "CASE event_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['dynamic-dispatch'] WHEN 2 THEN ['caller-search-refused'] WHEN 3 THEN ['caller-search-truncated'] WHEN 4 THEN ['caller-search-refused', 'x'] ELSE ['enclosing-function-unresolved', 'x'] END"


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'INSUFFICIENT' WHEN 5 THEN 'INSUFFICIENT' WHEN 3 THEN 'PARTIAL'
    ELSE CASE WHEN event_id % 4 < 2 THEN 'INSUFFICIENT' ELSE 'PARTIAL' END END AS completeness FROM events"""
)
def completeness_policy(spark, sf_dir):
    reasons = F.expr(_REASONS.replace("[]", "cast(array() as array<string>)").replace("['", "array('").replace("']", "')"))
    reach = F.when(F.col("event_id") % 4 == 2, F.lit(True)).when(F.col("event_id") % 4 == 3, F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", verdicts.completeness(reasons, reach).alias("completeness"))


def _adjudications(spark, sf_dir):
    """Lineitems as adjudications."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("verdict"), (F.lit(0.8) + F.col("l_discount")).alias("confidence"),
        F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((k % 3 != 0).alias("rebutted"))).alias("open_objections"), (F.col("l_quantity") % 6).cast("int").alias("objection_count"),
        F.when(F.col("l_suppkey") % 4 == 0, "COMPLETE").when(F.col("l_suppkey") % 4 == 1, "PARTIAL").when(F.col("l_suppkey") % 4 == 2, "INSUFFICIENT").alias("completeness"),
    )


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS verdict, CAST(0.8 AS DOUBLE) + l_discount AS confidence, l_linenumber AS carried,
      CAST(floor(l_linenumber / 3) AS INT) AS unrebutted, CAST(l_quantity % 6 AS INT) AS objection_count, CASE l_suppkey % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'INSUFFICIENT' END AS completeness FROM lineitem),
    g AS (SELECT *, concat_ws('; ', CASE WHEN confidence < 0.85 THEN 'confidence ' || printf('%.2f', confidence) || ' < 0.85' END,
      CASE WHEN unrebutted > 0 THEN unrebutted || ' unrebutted adversary objection(s)' END,
      CASE WHEN objection_count = 0 THEN 'adversary filed zero objections' WHEN carried < objection_count THEN (objection_count - carried) || ' adversary objection(s) dropped before adjudication' END,
      CASE WHEN completeness IS NULL OR completeness = 'INSUFFICIENT' THEN 'context completeness is ' || coalesce(completeness, 'None') END) AS reasons FROM a)
    SELECT l_orderkey, l_linenumber, CASE WHEN verdict = 'FALSE_POSITIVE' AND reasons <> '' THEN 'NEEDS_HUMAN_REVIEW' ELSE verdict END AS verdict,
      CASE WHEN verdict = 'FALSE_POSITIVE' AND reasons <> '' THEN verdict END AS downgraded_from, CASE WHEN verdict = 'FALSE_POSITIVE' AND reasons <> '' THEN reasons END AS downgrade_reason FROM g"""
)
def safety_gate(spark, sf_dir):
    return verdicts.safety_gate(_adjudications(spark, sf_dir)).select("l_orderkey", "l_linenumber", "verdict", "downgraded_from", "downgrade_reason")


@query(
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents),
    r AS (SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id % 1100 AS doc, 1 + c.turn AS line, 1 + c.turn + c.conv_id % 3 AS end_line FROM conversations c)
    SELECT id, coalesce(end_line <= n_lines, false) AS ok FROM r LEFT JOIN n ON r.doc = n.doc_id"""
)
def citation_check(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.size(F.split("text", "\n")).alias("n_lines"))
    ref = F.struct((F.col("conv_id") % 1100).cast("string").alias("path"), (1 + F.col("turn")).alias("line"), (1 + F.col("turn") + F.col("conv_id") % 3).alias("end_line"))
    return verdicts.citations_exist(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array(ref).alias("refs")), files)


@query(
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents)
    SELECT doc_id, CASE WHEN n_lines < doc_id % 12 THEN 'NEEDS_HUMAN_REVIEW' ELSE 'TRUE_POSITIVE' END AS verdict,
      CASE WHEN doc_id % 2 = 0 THEN 'FALSE_POSITIVE' WHEN n_lines < doc_id % 12 THEN 'TRUE_POSITIVE' END AS downgraded_from,
      CASE WHEN n_lines < doc_id % 12 THEN CASE WHEN doc_id % 2 = 0 THEN 'earlier; ' ELSE '' END || 'cited evidence does not exist' WHEN doc_id % 2 = 0 THEN 'earlier' END AS downgrade_reason FROM n"""
)
def citation_override(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("TRUE_POSITIVE").alias("verdict"), F.when(even, "FALSE_POSITIVE").alias("downgraded_from"), F.when(even, "earlier").alias("downgrade_reason"), (F.size(F.split("text", "\n")) >= F.col("doc_id") % 12).alias("ok")
    )
    return verdicts.override_missing(rows).select("doc_id", "verdict", "downgraded_from", "downgrade_reason")


# ---- functions and callers -----------------------------------------------------------------------


@query(
    """WITH f AS (SELECT o_custkey AS path, o_orderkey AS start_byte, CAST(o_orderkey % 50 AS INT) AS start_line, CAST(o_orderkey % 50 + 1 + o_orderkey % 17 AS INT) AS end_line, 'f' || o_orderkey AS name FROM orders),
    p AS (SELECT DISTINCT c_custkey AS path, line FROM customer, range(0, 60, 7) t(line)),
    h AS (SELECT p.path, p.line, f.name, row_number() OVER (PARTITION BY p.path, p.line ORDER BY f.end_line - f.start_line, f.start_byte) AS n FROM p LEFT JOIN f ON p.path = f.path AND p.line BETWEEN f.start_line AND f.end_line)
    SELECT path, line, name FROM h WHERE n = 1"""
)
def enclosing_interval(spark, sf_dir):
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), k.alias("start_byte"), (k % 50).cast("int").alias("start_line"), (k % 50 + 1 + k % 17).cast("int").alias("end_line"), F.concat(F.lit("f"), k.cast("string")).alias("name"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"), F.lit(7).cast("bigint"))).alias("line"))
    return callers.enclosing(p, f).select("path", "line", "name")


@query(
    """WITH d AS (SELECT split_part(p_name, ' ', 1) AS name, p_brand AS path, p_partkey AS start_byte FROM part),
    f AS (SELECT name, path, start_byte, row_number() OVER (PARTITION BY name ORDER BY path, start_byte) AS n FROM d),
    c AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS t, split_part(p_name, ' ', 1) AS name FROM part)
    SELECT c.p_partkey, c.name, f.path AS def_path, f.start_byte AS def_start FROM c LEFT JOIN f ON c.name = f.name AND f.n = 1"""
)
def first_definition(spark, sf_dir):
    word = F.substring_index("p_name", " ", 1).alias("name")
    p = table(spark, sf_dir, "part")
    d = p.select(word, F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_byte"))
    return callers.first_definition(p.select("p_partkey", word), d).select("p_partkey", "name", "def_path", "def_start")


#: The part that a lineitem calls: small keys more often, so that parts have from no callers to more than a search allows.
_CALLED = "'n' || CAST(1 + (l_orderkey % most) % (1 + (l_orderkey * 7919 + l_linenumber * 104729) % most) AS BIGINT)"


def _graph(spark, sf_dir):
    """Targets, functions and calls: every part is a function and a target, every lineitem a call."""
    p, key, items = table(spark, sf_dir, "part"), F.col("p_partkey"), table(spark, sf_dir, "lineitem")
    f = p.select(key.alias("id"), F.col("p_brand").alias("path"), key.alias("start"), F.concat(F.lit("n"), key.cast("string")).alias("name"))
    most = p.agg(F.max("p_partkey").alias("most"))
    e = items.join(F.broadcast(most)).select(F.col("l_partkey").alias("caller_id"), F.expr(_CALLED).alias("callee")).distinct()
    return f.select(F.col("id").alias("target"), "name"), f, e


# every part a target, every lineitem a call; callers are counted by name before any pair is made
_WHOLE_GRAPH = f"""
mo AS (SELECT max(p_partkey) AS most FROM part),
fn AS (SELECT p_partkey AS id, p_brand AS path, p_partkey AS start, 'n' || p_partkey AS name FROM part),
ed AS (SELECT DISTINCT l_partkey AS caller_id, {_CALLED} AS callee FROM lineitem, mo),
cl AS (SELECT ed.caller_id, ed.callee, fn.path, fn.start, fn.name FROM ed JOIN fn ON ed.caller_id = fn.id WHERE fn.name <> ed.callee),
cn AS (SELECT callee, count(*) AS n FROM cl GROUP BY callee),
me AS (SELECT caller_id, callee, count(*) AS n FROM cl GROUP BY caller_id, callee),
tg AS (SELECT fn.id AS target, fn.name, coalesce(cn.n, 0) - coalesce(me.n, 0) AS n FROM fn LEFT JOIN cn ON fn.name = cn.callee LEFT JOIN me ON fn.id = me.caller_id AND fn.name = me.callee)
"""


@query(
    f"""WITH {_WHOLE_GRAPH},
    h1 AS (SELECT tg.target, cl.caller_id, cl.path, cl.start, cl.name, row_number() OVER (PARTITION BY tg.target ORDER BY cl.path, cl.start) AS rk
           FROM tg JOIN cl ON tg.name = cl.callee WHERE tg.n <= 50 AND cl.caller_id <> tg.target),
    h2 AS (SELECT h1.target, cl.caller_id, cl.path, cl.start, h1.rk AS prank FROM h1 JOIN cl ON h1.name = cl.callee WHERE h1.rk <= 19 AND cl.caller_id <> h1.target),
    al AS (SELECT target, caller_id, 1 AS hop, 0 AS prank, path, start FROM h1 UNION ALL SELECT target, caller_id, 2, prank, path, start FROM h2),
    fi AS (SELECT *, row_number() OVER (PARTITION BY target, caller_id ORDER BY hop, prank, path, start) AS k FROM al),
    ra AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hop, prank, path, start) AS rank, count(*) OVER (PARTITION BY target) AS total FROM fi WHERE k = 1)
    SELECT target, caller_id AS id, hop, CAST(rank AS INT) AS rank, total > 20 AS truncated FROM ra WHERE rank <= 20"""
)
def two_hop_callers_all(spark, sf_dir):
    return callers.caller_walk(*_graph(spark, sf_dir))


@query(f"WITH {_WHOLE_GRAPH} SELECT target, n AS direct_callers, n > 50 AS refused FROM tg")
def caller_refusal_all(spark, sf_dir):
    return callers.refused(*_graph(spark, sf_dir))


_DECOS = "CASE event_id % 5 WHEN 0 THEN ['@x', '@app.route(1)'] WHEN 1 THEN ['@click.command', '@b.get('] WHEN 2 THEN [] WHEN 3 THEN ['@celery.task('] ELSE ['@plain'] END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'HTTP_HANDLER' WHEN 1 THEN 'CLI_ARGUMENT' WHEN 3 THEN 'QUEUE_CONSUMER' ELSE 'UNKNOWN' END AS kind FROM events")
def entrypoint_kind(spark, sf_dir):
    decos = F.expr(_DECOS.replace("[]", "cast(array() as array<string>)").replace("['", "array('").replace("']", "')"))
    return table(spark, sf_dir, "events").select("event_id", callers.entrypoint_kind(decos).alias("kind"))


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w IN ('getattr', 'eval', 'the', 'exec'))) > 0 AS dynamic FROM documents")
def dynamic_dispatch(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: F.when(w == "the", "exec").otherwise(w))
    return table(spark, sf_dir, "documents").select("doc_id", callers.dynamic_dispatch(words).alias("dynamic"))


# ---- secrets and untrusted text ------------------------------------------------------------------


@query(
    """SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS aws_access_key, len(regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}')) AS jwt FROM documents"""
)
def secret_hits(spark, sf_dir):
    counts = redact.secret_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k.lower()) for c, (k, _) in zip(counts, redact.PATTERNS) if k in ("AWS_ACCESS_KEY", "JWT")])


_PEM = "PRIVATE KEY-----"
_KEYS = "(?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?"


@query(
    f"""SELECT doc_id, len(regexp_extract_all(text, '(?s)-----BEGIN {_KEYS}{_PEM}.*?-----END {_KEYS}{_PEM}')) AS private_key_pem, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{{16}}')) AS aws_access_key,
    len(regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{{10,}}[.]eyJ[A-Za-z0-9_-]{{10,}}[.][A-Za-z0-9_-]{{10,}}')) AS jwt,
    len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9+.-]*://[^\\x09-\\x0D\\x20:@''"]+:[^\\x09-\\x0D\\x20@''"]+@[^\\x09-\\x0D\\x20''"]+')) AS connection_string FROM documents"""
)
def secret_hits_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k.lower()) for c, (k, _) in zip(redact.secret_counts(F.col("text")), redact.PATTERNS)])


@query(
    """WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{16,200})"', 1)) AS literal FROM documents WHERE NOT contains(text, '''')
      UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{16,200})"|''([^''\\n]{16,200})''', 1)) FROM documents WHERE contains(text, '''')),
    c AS (SELECT doc_id, literal, unnest(string_split(literal, '')) AS ch FROM (SELECT DISTINCT * FROM l) WHERE literal <> ''),
    n AS (SELECT doc_id, literal, ch, count(*) AS k FROM c GROUP BY ALL),
    e AS (SELECT doc_id, literal, round(-sum(k / len(literal) * log2(k / len(literal))), 12) AS bits FROM n GROUP BY doc_id, literal)
    SELECT doc_id, literal, CASE WHEN bits < 3 THEN 'LOW' WHEN bits < 4 THEN 'MEDIUM' ELSE 'HIGH' END AS entropy_class FROM e"""
)
def quoted_literals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(redact.quoted_literals(F.col("text"))).alias("literal")).distinct()
    return d.select("doc_id", "literal", redact.entropy_class(redact.entropy(F.col("literal"))).alias("entropy_class"))


@query()
def redacted_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", redact.redact("text", F.lit(1)).alias("r"))
    return d.select("doc_id", F.md5("r.redacted").alias("redacted_md5"), F.size("r.secrets").alias("n_secrets"))


_SPECIFIC = f"(?s)-----BEGIN {_KEYS}{_PEM}.*?-----END {_KEYS}{_PEM}|AKIA[0-9A-Z]{{16}}|eyJ[A-Za-z0-9_-]{{10,}}[.]eyJ[A-Za-z0-9_-]{{10,}}[.][A-Za-z0-9_-]{{10,}}|[a-zA-Z][a-zA-Z0-9+.-]*://[^\\x09-\\x0D\\x20:@''\"]+:[^\\x09-\\x0D\\x20@''\"]+@[^\\x09-\\x0D\\x20''\"]+"


#: Documents with secrets of every kind at their ends.
_WITH_SECRETS = """text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'k = "AKIA' || upper(substr(md5(text), 1, 16)) || '"' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'u = "db://me:pw' || doc_id || '@host/x" ' ELSE '' END
 || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'g = "' || substr(md5(text), 1, 20) || upper(md5(text)) || '"' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(text) || chr(10) || '-----END RSA PRIVATE KEY-----' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'eyJ' || md5(text) || '.eyJ' || md5(text) || '.' || md5(text) ELSE '' END"""


@query(
    f"""WITH t AS (SELECT doc_id, {_WITH_SECRETS} AS text FROM documents),
    s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SPECIFIC}')) AS m FROM t),
    k AS (SELECT doc_id, CASE WHEN m LIKE '-----BEGIN%' THEN 'PRIVATE_KEY_PEM' WHEN m LIKE 'AKIA%' AND len(m) = 20 THEN 'AWS_ACCESS_KEY' WHEN m LIKE 'eyJ%' AND NOT contains(m, '://') THEN 'JWT' ELSE 'CONNECTION_STRING' END AS kind, m AS value FROM s),
    q AS (SELECT doc_id, unnest(regexp_extract_all(text, '"[^"\\n]{{16,200}}"|''[^''\\n]{{16,200}}''')) AS lit FROM t),
    l AS (SELECT doc_id, substr(lit, 2, len(lit) - 2) AS value, row_number() OVER () AS i FROM q WHERE NOT regexp_matches(lit, '{_SPECIFIC}')),
    c AS (SELECT i, ch, count(*) AS n FROM (SELECT i, unnest(string_split(value, '')) AS ch FROM l) WHERE ch <> '' GROUP BY i, ch),
    h AS (SELECT i FROM l JOIN c USING (i) GROUP BY i HAVING round(-sum(n / len(value) * log2(n / len(value))), 12) >= 4),
    a AS (SELECT doc_id, kind, value FROM k UNION ALL SELECT doc_id, 'GENERIC_HIGH_ENTROPY', value FROM l JOIN h USING (i))
    SELECT doc_id, kind, count(*) AS n, CAST(sum(len(value)) AS BIGINT) AS length FROM a GROUP BY doc_id, kind"""
)
def redacted_kinds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WITH_SECRETS).alias("text"))
    d = d.select("doc_id", F.explode(redact.redact("text", F.lit(1))["secrets"]).alias("s"))
    return d.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("s.length").cast("long").alias("length"))


@query(
    """SELECT doc_id, md5('<<<UNTRUSTED SOURCE path=' || lang || ' lines=1-' || len(string_split(text, chr(10))) || '>>>' || chr(10) || replace(replace(text || '<<<END>>>', '<<<', '< <<'), '>>>', '> >>') || chr(10) || '<<<END UNTRUSTED SOURCE>>>') AS block_md5 FROM documents"""
)
def untrusted_block(spark, sf_dir):
    source = F.concat("text", F.lit("<<<END>>>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.untrusted_block(F.col("lang"), F.lit(1), F.size(F.split("text", "\n")), source)).alias("block_md5"))


# ---- costs ---------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", costs.tokens(F.col("text")).alias("tokens"))


_PRICED = "CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END"
_SQL_CALL = "((greatest(0, i - r - w) + r * 0.1e0 + w * 1.25e0) * CASE model WHEN 'small' THEN 1e0 WHEN 'large' THEN 5e0 ELSE 0e0 END + o * CASE model WHEN 'small' THEN 5e0 WHEN 'large' THEN 25e0 ELSE 0e0 END) / 1e6"


@query(f"WITH c AS (SELECT doc_id, {_PRICED} AS model, n_chars AS i, 400 AS o, n_chars // 2 AS r, n_chars // 8 AS w FROM documents) SELECT doc_id, model, round({_SQL_CALL}, 12) AS cost_usd FROM c")
def call_cost(spark, sf_dir):
    n = F.col("n_chars")
    cost = costs.call_cost(F.expr(_PRICED), n, F.lit(400), F.floor(n / 2), F.floor(n / 8))
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PRICED).alias("model"), F.round(cost, 12).alias("cost_usd"))


_FOUR = f"""
b AS (SELECT doc_id AS id, {_PRICED} AS model, greatest(1, length(text) // 4) AS s, 250 AS own FROM documents),
k AS (SELECT * FROM (VALUES ('reachability', 400, true), ('exploitability', 400, false), ('adversary', 600, false), ('adjudicator', 500, false)) t(role, o, writes)),
c AS (SELECT id, model, role, s + own AS i, o, CASE WHEN writes THEN 0 ELSE s END AS r, CASE WHEN writes THEN s ELSE 0 END AS w FROM b, k),
e AS (SELECT *, {_SQL_CALL} AS cost FROM c)
"""


def _four(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_PRICED).alias("model"), costs.tokens(F.col("text")).alias("shared_tokens"), F.lit(250).alias("own_tokens"))
    return costs.four_calls(b)


@query(f"WITH {_FOUR} SELECT id, role, CAST(i AS BIGINT) AS input_tokens, o AS output_tokens, round(cost, 12) AS cost_usd FROM e")
def four_call_estimate(spark, sf_dir):
    return _four(spark, sf_dir).select("id", "role", F.col("input_tokens").cast("long").alias("input_tokens"), "output_tokens", F.round("cost_usd", 12).alias("cost_usd"))


@query(f"WITH {_FOUR} SELECT model, count(*) AS calls, round(sum(cost), 6) AS cost_usd FROM e GROUP BY model")
def cost_by_model(spark, sf_dir):
    return _four(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(
    """WITH c AS (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS cost FROM conversations),
    b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + cost <= 600 AS ok FROM c)
    SELECT conv_id, turn, min(ok) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS allowed FROM b"""
)
def budget_cut(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("cost"))
    return costs.budget_cut(c, ["conv_id"], ["turn"], 600.0).select("conv_id", "turn", "allowed")


@query(
    """WITH c AS (SELECT conv_id, turn, length(text) / 1000e0 AS cost, length(text) // 3 / 1000e0 AS paid FROM conversations),
    l AS (SELECT round(0.4e0 * sum(length(text) // 3) / 1000, 3) AS most FROM conversations),
    b AS (SELECT conv_id, turn, coalesce(sum(CAST(paid AS DECIMAL(28, 9))) OVER w, 0) AS before, cost, most FROM c, l WINDOW w AS (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT *, before + CAST(cost AS DECIMAL(28, 9)) <= CAST(most AS DECIMAL(28, 9)) AS ok FROM b)
    SELECT conv_id, turn, CAST(before AS DOUBLE) AS spent_before, min(ok) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) AS allowed FROM o"""
)
def budget_of_a_run(spark, sf_dir):
    """All turns as one run, stopped where two fifths of what they cost are spent."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / F.lit(1000.0)).alias("cost"), (F.floor(F.length("text") / 3) / F.lit(1000.0)).alias("paid"))
    most = round(0.4 * (c.agg(F.sum(F.round(F.col("paid") * 1000).cast("long"))).first()[0] or 0) / 1000, 3)
    return costs.budget_run(c, ["conv_id", "turn"], most, "paid").select("conv_id", "turn", "spent_before", "allowed")


# ---- scores --------------------------------------------------------------------------------------

_PROV = "CASE doc_id % 4 WHEN 0 THEN 'CVE_FIX' WHEN 1 THEN 'HAND_LABELED' WHEN 2 THEN 'JULIET' ELSE 'REAL_WORLD' END"
_VERD = "CASE WHEN toxic = 1 THEN 'NEEDS_HUMAN_REVIEW' WHEN doc_id % 5 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END"
_COMP = "CASE doc_id % 7 WHEN 0 THEN 'INSUFFICIENT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN NULL ELSE 'COMPLETE' END"
_PAIRS = f"""
p AS (SELECT doc_id AS id, {_PROV} AS provenance, CASE WHEN quality = 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS ground_truth, {_VERD} AS verdict, {_COMP} AS completeness,
      doc_id % 13 <> 0 AS schema_valid, doc_id / 1000e0 AS cost_usd, CAST(doc_id * 7919 % 1000 AS BIGINT) AS latency_ms, doc_id FROM labels),
q AS (SELECT *, coalesce(completeness IN ('COMPLETE', 'PARTIAL'), false) AS cov FROM p)
"""


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.expr(_PROV).alias("provenance"), F.when(F.col("quality") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("ground_truth"), F.expr(_VERD).alias("verdict"),
        F.expr(_COMP).alias("completeness"), (F.col("doc_id") % 13 != 0).alias("schema_valid"), (F.col("doc_id") / F.lit(1000.0)).alias("cost_usd"), (F.col("doc_id") * 7919 % 1000).alias("latency_ms"),
    )


@query(
    f"""WITH {_PAIRS}, m AS (SELECT provenance, count(*) AS n, avg(CAST(cov AS INT)) AS coverage,
      count(*) FILTER (WHERE cov AND verdict = 'TRUE_POSITIVE' AND ground_truth = 'TRUE_POSITIVE') AS hit, count(*) FILTER (WHERE cov AND verdict = 'TRUE_POSITIVE') AS said, count(*) FILTER (WHERE cov AND ground_truth = 'TRUE_POSITIVE') AS tp,
      count(*) FILTER (WHERE cov AND ground_truth = 'TRUE_POSITIVE' AND verdict = 'FALSE_POSITIVE') AS sup, avg(CAST(verdict = 'NEEDS_HUMAN_REVIEW' AS INT)) AS esc, avg(CAST(NOT schema_valid AS INT)) AS bad, sum(cost_usd) / count(*) AS cost,
      CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95 FROM q GROUP BY provenance)
    SELECT g.provenance, coalesce(n, 0) AS count, coalesce(round(coverage, 9), 1) AS coverage, round(hit / nullif(said, 0), 9) AS precision, round(hit / nullif(tp, 0), 9) AS recall,
      CASE WHEN n IS NULL THEN NULL ELSE round(coalesce(sup / nullif(tp, 0), 0), 9) END AS false_suppression_rate, round(esc, 9) AS escalation_rate, round(bad, 9) AS schema_failure_rate, round(cost, 9) AS cost_per_finding, p95 AS p95_latency_ms
    FROM (VALUES ('OWASP_BENCHMARK'), ('JULIET'), ('CVE_FIX'), ('HAND_LABELED'), ('REAL_WORLD')) g(provenance) LEFT JOIN m ON g.provenance = m.provenance"""
)
def score_by_provenance(spark, sf_dir):
    s = scoring.by_provenance(_pairs(spark, sf_dir))
    return s.select(*[F.round(c, 9).alias(c) if t == "double" and c != "p95_latency_ms" else F.col(c) for c, t in s.dtypes])


@query(f"WITH {_PAIRS} SELECT count(*) AS count, count(*) FILTER (WHERE verdict <> 'FALSE_POSITIVE') AS resisted, round(count(*) FILTER (WHERE verdict <> 'FALSE_POSITIVE') / count(*), 9) AS rate FROM p WHERE ground_truth = 'TRUE_POSITIVE'")
def injection_resistance(spark, sf_dir):
    r = scoring.injection_resistance(_pairs(spark, sf_dir).filter("ground_truth = 'TRUE_POSITIVE'"))
    return r.select("count", "resisted", F.round("rate", 9).alias("rate"))


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE provenance IN ('CVE_FIX', 'HAND_LABELED')) AS private, count(*) FILTER (WHERE provenance IN ('CVE_FIX', 'HAND_LABELED')) < 50 AS thin FROM p")
def holdout(spark, sf_dir):
    return scoring.holdout(_pairs(spark, sf_dir))


@query(
    """WITH e AS (SELECT DISTINCT doc_id AS id FROM documents), o AS (SELECT id, count(*) AS n FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id + 990 FROM labels) GROUP BY id)
    SELECT coalesce(e.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'duplicate' END AS problem FROM e FULL JOIN o ON e.id = o.id WHERE o.id IS NULL OR e.id IS NULL OR o.n > 1"""
)
def strict_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id")).unionByName(labels.select((F.col("doc_id") + 990).alias("id")))
    return scoring.join_report(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), outcomes)


@query("SELECT lang AS value, count(*) AS n, min(doc_id) AS first, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS INT) AS place FROM documents GROUP BY lang")
def most_common_values(spark, sf_dir):
    return reports.most_common(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query(
    """WITH d AS (SELECT *, row_number() OVER (ORDER BY TRY_CAST(substr(source, 4) AS INT) NULLS FIRST, doc_id) AS n FROM documents)
    SELECT TRY_CAST(substr(source, 4) AS INT) AS run_index, doc_id AS result_index, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS entry FROM d WHERE n <= 20"""
)
def context_dump(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"run_index": F.expr("try_cast(substring(source, 4) AS int)"), "result_index": F.col("doc_id")})
    return reports.dump(d, ["doc_id", "lang"]).select("run_index", "result_index", "entry")


@query("SELECT lang AS reason, count(*) AS n FROM documents GROUP BY lang")
def rejected_by_reason(spark, sf_dir):
    return scoring.rejected_by_reason(table(spark, sf_dir, "documents").select(F.col("lang").alias("reason")))


_BUCKET = "CASE WHEN n_chars < 300 THEN 'short' WHEN lang <> 'en' THEN 'other' ELSE 'triable' END"


@query(f"WITH s AS (SELECT source AS repo, {_BUCKET} AS bucket FROM documents) SELECT repo, bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 9) AS share FROM s GROUP BY GROUPING SETS ((repo, bucket), (bucket), ())")
def strata_grouping_sets(spark, sf_dir):
    s = scoring.strata(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.expr(_BUCKET).alias("bucket")))
    return s.withColumn("share", F.round("share", 9))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END AS ground_truth, count(*) AS n, count(DISTINCT (l_partkey % 50, l_suppkey, l_linenumber)) AS sources FROM lineitem GROUP BY 1")
def class_balance(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "FALSE_POSITIVE").otherwise("TRUE_POSITIVE").alias("ground_truth"), (F.col("l_partkey") % 50).alias("rule_id"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"))
    return scoring.class_balance(e)


@query(
    f"""WITH {_PAIRS} SELECT v.verdict, count(p.id) AS n, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_ms
    FROM (VALUES ('TRUE_POSITIVE'), ('FALSE_POSITIVE'), ('NEEDS_HUMAN_REVIEW')) v(verdict) LEFT JOIN p ON p.verdict = v.verdict GROUP BY v.verdict"""
)
def verdict_report_all(spark, sf_dir):
    return scoring.verdict_report(_pairs(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


# ---- text, replies and nested data ---------------------------------------------------------------


def _triaged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.expr("try_cast(substring(source, 4) AS int)").alias("run_index"), F.col("doc_id").alias("result_index"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("rule_id"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("uri"),
        (F.col("doc_id") % 5).cast("int").alias("start_line"), (F.lit(0.5) + F.col("doc_id") % 4 / F.lit(8.0)).alias("confidence"), F.concat(F.lit("because "), "lang").alias("justification"),
        F.when(F.col("doc_id") % 2 == 0, "TRUE_POSITIVE").otherwise("NEEDS_HUMAN_REVIEW").alias("verdict"),
    )


@query(
    """WITH t AS (SELECT TRY_CAST(substr(source, 4) AS INT) AS run_index, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'TRUE_POSITIVE' ELSE 'NEEDS_HUMAN_REVIEW' END AS verdict,
      '- `' || CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'unknown-rule' END || '` at `' || CASE WHEN doc_id % 4 <> 0 THEN source ELSE '(unknown file)' END || ':' || CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 5 AS VARCHAR) ELSE '?' END
      || '` (confidence ' || CASE doc_id % 4 WHEN 0 THEN '0.50' WHEN 1 THEN '0.63' WHEN 2 THEN '0.75' ELSE '0.88' END || ') - because ' || lang AS line FROM documents),
    b AS (SELECT verdict, count(*) AS n, string_agg(line, chr(10) ORDER BY run_index, doc_id) AS lines FROM t GROUP BY verdict)
    SELECT h.position, h.verdict, h.heading || ' (' || coalesce(b.n, 0) || ')' || chr(10) || chr(10) || coalesce(b.lines, '_None._') AS body
    FROM (VALUES (0, 'TRUE_POSITIVE', '## Likely true positives'), (1, 'NEEDS_HUMAN_REVIEW', '## Needs human review'), (2, 'FALSE_POSITIVE', '## Dismissed with justification')) h(position, verdict, heading) LEFT JOIN b ON h.verdict = b.verdict"""
)
def comment_markdown_all(spark, sf_dir):
    return render.comment_sections(_triaged(spark, sf_dir))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props))")
def variant_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return spark.sql("SELECT event_id, key, CAST(value AS STRING) AS value FROM {e}, LATERAL variant_explode(try_parse_json(props))", e=e)


_WRAP = """CASE conv_id % 5 WHEN 0 THEN '{"position": "TRUE_POSITIVE", "confidence": 0.5, "reasoning": "r"}' WHEN 1 THEN '{"position": "FALSE_POSITIVE", "confidence": "0.9", "reasoning": "r"} tail'
 WHEN 2 THEN '{"position": "MAYBE", "confidence": 0.5, "reasoning": "r"}' WHEN 3 THEN '{"position": "FALSE_POSITIVE", "confidence": "0.9", "reasoning": "r"}' ELSE text END"""


@query(
    """SELECT conv_id, turn, conv_id % 5 IN (0, 3) AS valid, CASE conv_id % 5 WHEN 0 THEN 'TRUE_POSITIVE' WHEN 3 THEN 'FALSE_POSITIVE' ELSE 'NEEDS_HUMAN_REVIEW' END AS verdict,
    CASE conv_id % 5 WHEN 0 THEN 0.5e0 WHEN 3 THEN 0.9e0 ELSE 0e0 END AS confidence FROM conversations"""
)
def reply_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("parsed", replies.parse_reply(F.expr(_WRAP), F.lit("analyst")))
    return replies.escalate(c).select("conv_id", "turn", F.col("schema_valid").alias("valid"), "verdict", "confidence")


_CITING = """'{"verdict": "' || CASE WHEN conv_id % 2 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END || '", "confidence": 0.9, "justification": "j", "evidence_lines": [{"path": "' || CASE WHEN conv_id % 17 = 0 THEN '../' ELSE '' END || (conv_id % 1100) || '", "line": ' || (1 + turn) || '}], '
 || '"open_objections": [{"claim": "' || role || '", "evidence": [{"path": "./' || (conv_id * 7 % 1050) || '", "line": 1, "end_line": ' || (1 + length(text) % 9) || '}], "rebutted": true, "rebuttal": "r"}, {"claim": "none"}]}'"""


@query(
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents),
    r AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END AS said, CASE WHEN conv_id % 17 <> 0 THEN conv_id % 1100 END AS own, 1 + turn AS line, conv_id * 7 % 1050 AS other, 1 + length(text) % 9 AS last FROM conversations),
    j AS (SELECT r.*, coalesce(a.n_lines >= line, false) AS own_ok, coalesce(b.n_lines >= last, false) AS other_ok FROM r LEFT JOIN n a ON own = a.doc_id LEFT JOIN n b ON other = b.doc_id)
    SELECT id, CASE WHEN own_ok AND other_ok THEN said ELSE 'NEEDS_HUMAN_REVIEW' END AS verdict, CASE WHEN NOT (own_ok AND other_ok) THEN said END AS downgraded_from, CASE WHEN NOT (own_ok AND other_ok) THEN 'cited evidence does not exist' END AS downgrade_reason,
      concat_ws(',', CASE WHEN NOT other_ok THEN 'objection 0' END, CASE WHEN NOT own_ok THEN 'reply' END) AS origins FROM j"""
)
def evidence_of_objections(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.size(F.split("text", "\n")).alias("n_lines"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), replies.parse_reply(F.expr(_CITING), F.lit("adjudicator")).alias("parsed"))
    rows = replies.escalate(c).withColumns({"downgraded_from": F.lit(None).cast("string"), "downgrade_reason": F.lit(None).cast("string")})
    origins = F.array_join(F.transform("invented", lambda i: i["origin"]), ",").alias("origins")
    return verdicts.check_evidence(rows, files).select("id", "verdict", "downgraded_from", "downgrade_reason", origins)


@query("""SELECT doc_id, sha256('["' || doc_id || '","' || lang || '","' || source || '"]') AS key FROM documents""")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", render.cache_key(F.col("doc_id"), F.col("lang"), F.col("source")).alias("key"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY sha256(conv_id || chr(0) || turn), turn) AS INT) AS place FROM conversations")
def seeded_order(spark, sf_dir):
    return render.seeded_order(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(f"WITH {_PAIRS} SELECT id, provenance, ground_truth, 'all-escalate' AS model, 'NEEDS_HUMAN_REVIEW' AS verdict, 0e0 AS confidence, true AS schema_valid, CAST(NULL AS VARCHAR) AS completeness, 0e0 AS cost_usd, CAST(0 AS BIGINT) AS latency_ms FROM p")
def all_escalate(spark, sf_dir):
    return records.all_escalate(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS} SELECT provenance AS run, count(*) FILTER (WHERE verdict = 'TRUE_POSITIVE') AS tp, count(*) FILTER (WHERE verdict = 'FALSE_POSITIVE') AS fp, count(*) FILTER (WHERE verdict = 'NEEDS_HUMAN_REVIEW') AS escalated,
    round(sum(cost_usd), 6) AS spend, count(*) FILTER (WHERE cost_usd > 0) AS calls FROM p GROUP BY provenance""")
def run_tallies(spark, sf_dir):
    return records.tallies(_pairs(spark, sf_dir).withColumn("run", F.col("provenance"))).withColumn("spend", F.round("spend", 6))


_GATE = """CASE conv_id % 3 WHEN 0 THEN '{"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 12, "completion_tokens": 3}}' WHEN 1 THEN '{"choices": [{"message": {"content": "x"}}]}' ELSE 'no json' END"""


@query(
    """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'x' END AS content, CAST(CASE conv_id % 3 WHEN 0 THEN 12 ELSE 0 END AS BIGINT) AS tokens_in,
    CASE conv_id % 3 WHEN 0 THEN round((12 * 5e0 + 3 * 25e0) / 1e6, 12) ELSE 0e0 END AS cost_usd FROM conversations"""
)
def gateway_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("r", records.gateway_reply(F.expr(_GATE)))
    return c.select("conv_id", "turn", "r.content", "r.tokens_in", F.round(records.runtime_cost(F.lit("large"), F.col("r.tokens_in"), F.col("r.tokens_out")), 12).alias("cost_usd"))


@query(
    f"""WITH {_REFS} SELECT run_index, result_index, '{{"correlation_id":"' || correlation_id || '","identity_source":"' || identity_source || '","disposition":"' || disposition || '","resolved_by":"' || CASE WHEN again THEN 'prefilter:dedupe' ELSE 'prefilter:pass' END || '"}}' AS note FROM x"""
)
def annotation_bags(spark, sf_dir):
    d = _decisions(spark, sf_dir).drop("justification")
    return d.select("run_index", "result_index", records.annotation(d).alias("note"))


@query("SELECT page_id, CASE WHEN contains(url, 'example') THEN 'example' WHEN contains(url, '/') THEN 'other' END AS repo FROM pages")
def first_matching_repo(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", records.first_match(p, [("example", "example"), ("/", "other")], "url").alias("repo"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'no-location' WHEN doc_id % 6 = 1 THEN 'non-python' WHEN doc_id % 6 = 2 THEN 'no-checkout' WHEN doc_id % 6 = 3 THEN 'test-class' WHEN doc_id % 6 = 4 THEN 'dynamic-dispatch' ELSE 'triable' END AS stratum FROM documents")
def strata_of_findings(spark, sf_dir):
    k = F.col("doc_id") % 6
    path = F.when(k == 1, "a.js").when(k != 0, "a.PY")
    reasons = F.when(k == 4, F.array(F.lit("caller-search-truncated"), F.lit("dynamic-dispatch"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", bundles.stratum(F.when(k == 3, "TEST").otherwise("SOURCE"), path, k != 2, reasons).alias("stratum"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'path leaves its root' WHEN 1 THEN 'absolute path' WHEN 2 THEN 'drive-qualified path' END AS refusal FROM pages")
def path_refusals(spark, sf_dir):
    k = F.col("page_id") % 4
    p = F.when(k == 0, "a/../../b").when(k == 1, "/etc/x").when(k == 2, "C:/x").otherwise("a/./b/../c.py")
    return table(spark, sf_dir, "pages").select("page_id", paths.refusal(p).alias("refusal"))


@query(
    """WITH e AS (SELECT event_id AS id, props <> regexp_replace(props, '[0-9]', '7', 'g') AS other FROM events)
    SELECT CAST(id AS VARCHAR) AS id, '/props/k' AS pointer, 'changed' AS change FROM e WHERE id % 2 = 0 AND other UNION ALL SELECT CAST(id AS VARCHAR), unnest(['/tags/#', '/tags/0', '/tags/1']), 'lost' FROM e WHERE id % 5 = 0
    UNION ALL SELECT CAST(id AS VARCHAR), '/tags/#', 'changed' FROM e WHERE id % 5 <> 0 AND id % 3 = 0 UNION ALL SELECT CAST(id AS VARCHAR), '/tags/2', 'added' FROM e WHERE id % 5 <> 0 AND id % 3 = 0 UNION ALL SELECT CAST(id AS VARCHAR), '/new', 'added' FROM e WHERE id % 7 = 0"""
)
def document_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props")
    before = e.select("id", F.expr("""'{"props": ' || props || ', "tags": ["a", ' || id % 4 || ']}'""").alias("raw"))
    after = F.expr("""'{' || CASE WHEN id % 5 = 0 THEN '' WHEN id % 3 = 0 THEN '"tags": ["a", ' || id % 4 || '.0, null], ' ELSE '"tags": ["a", ' || id % 4 || '], ' END || CASE WHEN id % 7 = 0 THEN '"new": {}, ' ELSE '' END
      || '"props": ' || CASE WHEN id % 2 = 0 THEN regexp_replace(props, '[0-9]', '7') ELSE props END || '}'""")
    return canonical.difference(before, e.select("id", after.alias("raw")))


@query(f"WITH {_PAIRS} SELECT count(*) AS total, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM p")
def run_report_all(spark, sf_dir):
    r = reports.run_report(_pairs(spark, sf_dir), {"model": "none"})
    return r.select(F.get_json_object("report", "$.total").cast("long").alias("total"), F.get_json_object("report", "$.latency_ms").cast("long").alias("latency_ms"))


@query(
    f"""WITH {_REFS} SELECT run_index, result_index, CASE WHEN disposition = 'ADJUDICATE' AND result_index % 3 = 0 THEN 'triage:budget-exhausted' WHEN again THEN 'prefilter:dedupe' ELSE 'prefilter:pass' END AS resolved_by,
    disposition = 'ADJUDICATE' AND result_index % 3 = 0 AS exhausted FROM x"""
)
def budget_exhausted(spark, sf_dir):
    """Every third finding that was to be judged has no verdict."""
    d = records.mark_exhausted(_decisions(spark, sf_dir).withColumn("verdict", F.when(F.col("result_index") % 3 != 0, "TRUE_POSITIVE")))
    return d.select("run_index", "result_index", "resolved_by", (F.col("justification") == records.EXHAUSTED_WHY).alias("exhausted"))


@query(
    f"""WITH {_PAIRS}, k AS (SELECT lower(v) AS key, CAST(count(p.id) AS DOUBLE) AS value FROM (VALUES ('TRUE_POSITIVE'), ('FALSE_POSITIVE'), ('NEEDS_HUMAN_REVIEW')) t(v) LEFT JOIN p ON p.verdict = v GROUP BY v
      UNION ALL SELECT 'total', count(*) FROM p UNION ALL SELECT 'latency_ms', sum(latency_ms) FROM p UNION ALL SELECT 'cost_usd', round(sum(cost_usd), 6) FROM p) SELECT * FROM k"""
)
def report_outputs(spark, sf_dir):
    out = reports.outputs(reports.run_report(_pairs(spark, sf_dir), {"model": "none"}))
    return out.select("key", F.round(F.col("value").cast("double"), 6).alias("value"))


_MARKED = f"CASE WHEN conv_id % 7 = 3 THEN '{reports.MARKER} ' || text ELSE text END"


@query(
    f"""WITH c AS (SELECT role AS key, conv_id * 100 + turn AS id, {_MARKED} AS text FROM conversations), f AS (SELECT min(id) AS id FROM c WHERE key = 'user' AND starts_with(text, '{reports.MARKER}'))
    SELECT key, c.id, md5(CASE WHEN key = 'user' AND c.id = f.id THEN '{reports.MARKER} new' ELSE text END) AS text_md5 FROM c, f UNION ALL SELECT 'user', (SELECT max(id) + 1 FROM c), md5('{reports.MARKER} new') FROM f WHERE id IS NULL"""
)
def comments_upserted(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.expr(_MARKED).alias("text"))
    return reports.upsert(c, "user", f"{reports.MARKER} new").select("key", "id", F.md5("text").alias("text_md5"))


# ---- Python source: two functions for each part --------------------------------------------------


def _sources(spark, sf_dir):
    key, group = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 5).cast("string")
    text = F.concat(F.lit("@app.route('/x')\ndef f"), key, F.lit("(q):\n    return g"), group, F.lit("(q)\n\ndef g"), group, F.lit("(q):\n    return eval(q)\n"))
    return table(spark, sf_dir, "part").select(key.alias("path"), text.alias("text"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS path, 'f' || p_partkey AS name, CAST(1 AS INT) AS start_line, CAST(3 AS INT) AS end_line, ['@app.route(''/x'')'] AS decorators FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'g' || (p_partkey % 5), 5, 6, [] FROM part"""
)
def python_functions(spark, sf_dir):
    return pysource.functions(pysource.symbols(dealt(_sources(spark, sf_dir)))).select("path", "name", "start_line", "end_line", "decorators")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'g' || (p_partkey % 5) AS name, CAST(3 AS INT) AS start_line FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'eval', 6 FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'route', 1 FROM part")
def python_calls(spark, sf_dir):
    return pysource.calls(pysource.symbols(dealt(_sources(spark, sf_dir)))).select("path", "name", "start_line")


@query(
    """SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_partkey WHEN p_partkey % 3 <> 0 THEN 'g' || (p_partkey % 5) END AS enclosing,
    CASE WHEN p_partkey % 2 = 0 THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS completeness,
    CASE WHEN p_partkey % 2 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'enclosing-function-unresolved'
      WHEN (SELECT count(*) FROM part b WHERE b.p_partkey % 5 = a.p_partkey % 5) > 50 THEN 'caller-search-refused,dynamic-dispatch' WHEN (SELECT count(*) FROM part b WHERE b.p_partkey % 5 = a.p_partkey % 5) > 20 THEN 'caller-search-truncated,dynamic-dispatch' ELSE 'dynamic-dispatch' END AS reasons
    FROM part a"""
)
def finding_bundles(spark, sf_dir):
    s = written(pysource.symbols(dealt(_sources(spark, sf_dir))))
    line = F.when(F.col("p_partkey") % 2 == 0, 3).when(F.col("p_partkey") % 3 == 0, 4).otherwise(6)
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("uri"), line.alias("line"))
    told = lambda b: b.select("id", "path", F.col("enclosing_function.symbol").alias("enclosing"), "completeness", F.array_join("reasons", ",").alias("reasons"))
    return bundles.built(found, _sources(spark, sf_dir), s, told)


query(projects.SQL)(projects.context_bundles)
query(projects.SQL_WALKS)(projects.caller_routes)
query(projects.SQL_PROMPTS)(projects.prompts_of_bundles)
QUERIES |= steps.QUERIES
ORACLE_SQL |= steps.ORACLE_SQL
