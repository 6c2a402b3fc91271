"""Registered queries of logs, records and texts, each over whole tables; see ``queries`` for the adapters' rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions import paths
from tarnwork.functions.workers import importable, kept
from tarnwork.operators import bundles, costs, prefilter, records, replies, snapshots
from tarnwork.sources import reports, scanlogs, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scanner logs: one for a hundred documents, a run for each language, a result for each document ----

_LOG = "'logs/' || CAST(floor(doc_id / 100) AS BIGINT) || '.sarif'"
_RESULT = """'{"ruleId": "' || lang || '", "message": {"text": "' || source || '"}' || CASE WHEN doc_id % 4 <> 0 THEN ', "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/' || source || '.py"}'
 || CASE WHEN doc_id % 3 <> 0 THEN ', "region": {"startLine": ' || n_chars || ', "snippet": {"text": "' || md5(text) || '"}}' ELSE '' END || '}}]' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ', "partialFingerprints": {"h/v1": "' || md5(text) || '"}' ELSE '' END
 || CASE WHEN doc_id % 6 = 0 THEN ', "suppressions": [{"kind": "inSource"}]' ELSE '' END || CASE WHEN doc_id % 10 = 9 THEN ', "level": null' ELSE '' END || '}'"""
_RUN = """'{"tool": {"driver": {"name": "' || lang || '"}}, "automationDetails": {"id": "' || lang || '/x"}, "results": [' || results || ']}'"""
#: Of thirteen logs one isn't JSON, one is of another version, one has a run without a tool.
_WHOLE = """CASE k % 13 WHEN 3 THEN '{"version": "2.1.0", "runs": [' WHEN 5 THEN '{"version": "2.0.0", "runs": [' || runs || ']}' WHEN 7 THEN '{"version": "2.1.0", "runs": [{}, ' || runs || ']}' ELSE '{"version": "2.1.0", "runs": [' || runs || ']}' END"""
_LOGS = f"""
r AS (SELECT {_LOG} AS path, CAST(floor(doc_id / 100) AS BIGINT) AS k, lang, string_agg({_RESULT}, ', ' ORDER BY doc_id) AS results FROM documents GROUP BY ALL),
l AS (SELECT path, k, string_agg({_RUN}, ', ' ORDER BY lang) AS runs, count(*) AS n_runs FROM r GROUP BY path, k),
t AS (SELECT path, k, n_runs, {_WHOLE} AS raw FROM l),
d AS (SELECT *, {_LOG} AS path, dense_rank() OVER (PARTITION BY floor(doc_id / 100) ORDER BY lang) - 1 AS run_index, row_number() OVER (PARTITION BY floor(doc_id / 100), lang ORDER BY doc_id) - 1 AS result_index FROM documents
      WHERE CAST(floor(doc_id / 100) AS BIGINT) % 13 NOT IN (3, 5, 7))
"""


def _logs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumns({"path": F.expr(_LOG), "k": F.expr("CAST(floor(doc_id / 100) AS BIGINT)"), "result": F.expr(_RESULT)})
    joined = lambda value, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value]), ", ")
    runs = d.groupBy("path", "k", "lang").agg(joined("result", "doc_id").alias("results")).withColumn("run", F.expr(_RUN))
    return runs.groupBy("path", "k").agg(joined("run", "lang").alias("runs")).select("path", F.expr(_WHOLE).cast("binary").alias("content"))


@query(
    f"""WITH {_LOGS} SELECT path, CAST(run_index AS INT) AS run_index, CAST(result_index AS INT) AS result_index, lang AS tool_name, lang || chr(0) || lang || '/x' AS scope, lang AS rule_id, source AS message,
    CASE WHEN doc_id % 4 <> 0 THEN 'src/' || source || '.py' END AS uri, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN CAST(n_chars AS INT) END AS start_line, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN md5(text) END AS snippet,
    CASE WHEN doc_id % 5 = 0 THEN md5(text) END AS print, CAST((doc_id % 6 = 0) AS INT) AS n_suppressions FROM d"""
)
def logs_flattened(spark, sf_dir):
    rows = scanlogs.flatten(scanlogs.parse_logs(_logs(spark, sf_dir)))
    return rows.select("path", "run_index", "result_index", "tool_name", "scope", "rule_id", "message", "uri", "start_line", "snippet", F.try_element_at("partial_fps", F.lit("h/v1")).alias("print"), "n_suppressions")


@query(f"WITH {_LOGS} SELECT path, k % 13 NOT IN (3, 5, 7) AS ok, CASE k % 13 WHEN 3 THEN 'unreadable: JSONDecodeError' WHEN 5 THEN 'version is not 2.1.0' WHEN 7 THEN 'runs[0] has no tool' END AS error FROM t")
def logs_refused(spark, sf_dir):
    return scanlogs.parse_logs(_logs(spark, sf_dir)).select("path", "ok", "error")


@query(f"WITH {_LOGS} SELECT path, sha256(raw) AS sha256, strlen(raw) AS bytes, CASE k % 13 WHEN 3 THEN 0 ELSE n_runs + CAST(k % 13 = 7 AS INT) END AS runs, CASE k % 13 WHEN 3 THEN 0 ELSE (SELECT count(*) FROM documents WHERE floor(doc_id / 100) = k) END AS results FROM t")
def log_manifest(spark, sf_dir):
    return reports.manifest(_logs(spark, sf_dir)).select("path", "sha256", F.col("bytes").cast("long").alias("bytes"), F.col("runs").cast("long").alias("runs"), F.col("results").cast("long").alias("results"))


@query(
    f"""WITH {_LOGS}, n AS (SELECT path, run_index, count(*) AS results, count(*) FILTER (WHERE doc_id % 2 = 0) AS noted, CAST(sum(CAST(doc_id % 6 = 0 AS INT) + CAST(doc_id % 4 = 0 AS INT)) AS BIGINT) AS suppressions, CAST(0 AS BIGINT) AS lost FROM d GROUP BY ALL)
    SELECT path, CAST(run_index AS INT) AS run_index, results, noted, suppressions, lost FROM n"""
)
def logs_annotated(spark, sf_dir):
    """Logs with notes on every second result, read again: results, notes and suppressions of each run, and what got lost."""
    logs = kept(scanlogs.parse_logs(_logs(spark, sf_dir)))
    before = scanlogs.flatten(logs)
    d = table(spark, sf_dir, "documents").select(F.expr(_LOG).alias("path"), "lang", "doc_id")
    # a result's place by its position in its log, its document by the order of both
    place = before.withColumn("_n", F.row_number().over(_by("path", "run_index", "result_index"))).select("path", "run_index", "result_index", "_n")
    order = d.withColumn("_n", F.row_number().over(_by("path", "lang", "doc_id"))).select("path", "doc_id", "_n")
    notes = place.join(order, ["path", "_n"]).filter("doc_id % 2 = 0")
    notes = notes.select("path", "run_index", "result_index", F.concat(F.lit('{"doc":'), F.col("doc_id"), F.lit("}")).alias("note"), F.when(F.col("doc_id") % 4 == 0, "FALSE_POSITIVE").otherwise("TRUE_POSITIVE").alias("verdict"), F.lit("j").alias("justification"))
    written = scanlogs.annotate(logs, notes)
    again = kept(scanlogs.parse_logs(written.select("path", F.col("raw").cast("binary").alias("content"))))
    after = scanlogs.flatten(again)
    bags = again.select("path", F.posexplode(F.try_variant_get(F.parse_json("raw"), "$.runs", "array<variant>")).alias("run_index", "run"))
    bags = bags.select("path", "run_index", F.size(F.filter(F.try_variant_get("run", "$.results", "array<variant>"), lambda r: F.try_variant_get(r, "$.properties['findings/v1'].doc", "long").isNotNull())).cast("long").alias("noted"))
    counts = after.groupBy("path", "run_index").agg(F.count(F.lit(1)).alias("results"), F.sum("n_suppressions").alias("suppressions"))
    lost = scanlogs.lost(before, after).groupBy("path", "run_index").agg(F.count(F.lit(1)).alias("lost"))
    out = counts.join(bags, ["path", "run_index"]).join(lost, ["path", "run_index"], "left")
    return out.select("path", "run_index", "results", "noted", "suppressions", F.coalesce("lost", F.lit(0).cast("long")).alias("lost"))


def _by(part: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)


# ---- paths ---------------------------------------------------------------------------------------

_URI = """CASE page_id % 7 WHEN 0 THEN '.' || chr(92) || replace(url, '/', chr(92)) WHEN 1 THEN 'file:///C:/a%20b/' || page_id || '.py' WHEN 2 THEN '././src/caf%65%CC%81/' || page_id WHEN 3 THEN '  src/' || page_id || '.py ' WHEN 4 THEN 'FILE://host/srv/x%2Fy/' || page_id || '.py'
 WHEN 5 THEN 'a/' || CASE WHEN page_id % 2 = 0 THEN '../../' ELSE 'b/../' END || page_id || '.py' ELSE url END"""
_NORMAL = f"""
u AS (SELECT page_id, trim({_URI}) AS uri FROM pages),
p AS (SELECT page_id, CASE WHEN lower(uri) LIKE 'file:%' THEN url_decode(regexp_replace(regexp_replace(uri, '^[Ff][Ii][Ll][Ee]:(//[^/]*)?', ''), '[?#].*$', '')) ELSE url_decode(uri) END AS p, lower(uri) LIKE 'file:%' AS filed FROM u),
n AS (SELECT page_id, nfc_normalize(regexp_replace(replace(CASE WHEN filed AND regexp_matches(p, '^/.:') THEN substr(p, 2) ELSE p END, chr(92), '/'), '^([.]/)+', '')) AS path FROM p)
"""


@query(f"WITH {_NORMAL} SELECT page_id, path FROM n")
def normal_uris(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.normal_uri(F.expr(_URI)).alias("path"))


@query(
    f"""WITH {_NORMAL}, s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS s FROM n),
    d AS (SELECT page_id, path, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: CASE x WHEN '..' THEN -1 ELSE 1 END))) AS depths FROM s)
    SELECT page_id, CASE WHEN trim(path) IN ('', '.', '..') THEN 'empty path' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive-qualified path' WHEN path LIKE '/%' THEN 'absolute path' WHEN len(list_filter(depths, lambda x: x < 0)) > 0 THEN 'path leaves its root' END AS refusal FROM d"""
)
def uri_refusals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.refusal(paths.normal_uri(F.expr(_URI))).alias("refusal"))


_LISTS = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("VENDORED", prefilter.VENDOR_DIRS), ("FIXTURE", prefilter.FIXTURE_DIRS), ("GENERATED", prefilter.GENERATED_DIRS), ("TEST", prefilter.TEST_DIRS))}
_EVERY_DIR = [*prefilter.VENDOR_DIRS, *prefilter.FIXTURE_DIRS, *prefilter.GENERATED_DIRS, *prefilter.TEST_DIRS, "src", "lib", "app", "."]
_EVERY_NAME = ["x" + s for s in prefilter.GENERATED_SUFFIXES] + ["main.py", "test_a.py", "b_test.go", "c.spec.ts", "DTest.java", ".hidden", "conftest.py", "Testing.py", "noending"]
_PICK = lambda values, k: f"element_at(array({', '.join(repr(v) for v in values)}), CAST(1 + l_orderkey * {k} % {len(values)} AS INT))"
_TREE = f"concat('a', l_linenumber, '/', {_PICK(_EVERY_DIR, 7919)}, '/', upper({_PICK(_EVERY_DIR, 104729)}), '/', {_PICK(_EVERY_NAME, 31)})"
_TREE_SQL = _TREE.replace("element_at(array(", "list_extract([").replace("), CAST(", "], CAST(")


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, list_filter(string_split({_TREE_SQL}, '/'), lambda x: x NOT IN ('', '.')) AS s FROM lineitem),
    p AS (SELECT l_orderkey, l_linenumber, list_transform(s[1:len(s) - 1], lambda x: lower(x)) AS dirs, s[len(s)] AS name FROM t),
    n AS (SELECT *, CASE WHEN name LIKE '.%' THEN '' WHEN regexp_matches(name, '.[.][^.]+$') THEN regexp_replace(name, '[.][^.]+$', '') ELSE name END AS stem FROM p)
    SELECT l_orderkey, l_linenumber, CASE {" ".join(f"WHEN list_has_any(dirs, [{v}]) THEN '{k}'" for k, v in _LISTS.items())}
      WHEN len(list_filter([{", ".join(f"'{x}'" for x in prefilter.GENERATED_SUFFIXES)}], lambda x: ends_with(lower(name), x))) > 0 THEN 'GENERATED' WHEN regexp_matches(stem, '{prefilter.TEST_STEM}') THEN 'TEST' ELSE 'UNKNOWN' END AS file_class FROM n"""
)
def file_classes_by_rule(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prefilter.classify(F.expr(_TREE))["file_class"].alias("file_class"))


# ---- records -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'n/a' ELSE printf('%.1f%%', l_tax / 3 * 100) END AS share, printf('$%.4f', l_extendedprice / 7) AS money, printf('%.0f ms', l_extendedprice / 3) AS took FROM lineitem")
def figures_as_text(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem")
    share = records.share_text(F.when(F.col("l_quantity") <= 45, F.col("l_tax") / 3))
    return n.select("l_orderkey", "l_linenumber", share.alias("share"), records.money_text(F.col("l_extendedprice") / 7).alias("money"), records.time_text(F.col("l_extendedprice") / 3).alias("took"))


@query("SELECT count(*) AS calls, count(*) * 3000 AS input_tokens, count(*) * 400 AS output_tokens, round(count(*) * (3000 * 5e0 + 400 * 25e0) / 1e6, 6) AS cost_usd FROM labels")
def flat_estimate(spark, sf_dir):
    return costs.flat_estimate(table(spark, sf_dir, "labels"), "large").withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    """WITH f AS (SELECT conv_id AS id, sum(length(text) % 4) AS filed FROM conversations WHERE turn = 0 GROUP BY conv_id),
    j AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'INSUFFICIENT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN NULL ELSE 'COMPLETE' END AS completeness, doc_id % 5 IN (0, 2) AS skip FROM labels)
    SELECT j.id, CAST(coalesce(filed, 0) AS INT) AS objection_count, completeness, skip AS escalated_by_completeness, CASE WHEN skip THEN 'NEEDS_HUMAN_REVIEW' ELSE 'FALSE_POSITIVE' END AS verdict, CASE WHEN skip THEN 0e0 ELSE 1e0 END AS cost_usd FROM j LEFT JOIN f ON j.id = f.id"""
)
def engine_owned_fields(spark, sf_dir):
    """What a reply can't set: number of filed objections and completeness; insufficient context goes to review without a call."""
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("FALSE_POSITIVE").alias("verdict"), F.lit(99).alias("objection_count"), F.lit("COMPLETE").alias("completeness"), F.lit(1.0).alias("cost_usd"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.expr("CASE doc_id % 5 WHEN 0 THEN 'INSUFFICIENT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN NULL ELSE 'COMPLETE' END").alias("completeness"))
    filed = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.lit("adversary").alias("role"), F.expr("filter(sequence(0, 3), x -> x < length(text) % 4)").alias("objections"))
    return replies.short_circuit(records.own_fields(said, filed, known)).select("id", "objection_count", "completeness", "escalated_by_completeness", "verdict", "cost_usd")


_ADVERSARY = """'```json' || chr(10) || '{"position": "TRUE_POSITIVE", "confidence": ' || (turn % 2) || ', "reasoning": "' || role || '", "evidence_lines": [{"path": "' || conv_id || '", "line": ' || (1 + turn) || '}], "unresolved_questions": ["q"], "objections": ['
 || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '{"claim": "' || md5(text) || '", "evidence": [{"path": "x", "line": 1}, {"path": "y", "line": ' || length(text) || '}]}' END || ']}' || chr(10) || '```'"""


@query(
    """SELECT conv_id, turn, 'TRUE_POSITIVE' AS position, CAST(turn % 2 AS DOUBLE) AS confidence, role AS reasoning, conv_id || ':' || (1 + turn) AS cited, 'q' AS questions,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE md5(text) || ' x:1 y:' || length(text) || ' false' END AS objections FROM conversations"""
)
def stored_arguments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("parsed", replies.parse_reply(replies.strip_fence(F.expr(_ADVERSARY)), F.lit("adversary")))
    a = c.select("conv_id", "turn", records.as_argument("adversary", F.col("parsed")).alias("a"))
    at = lambda r: F.concat_ws(":", r["path"], r["line"].cast("string"))
    told = F.transform("a.objections", lambda o: F.concat_ws(" ", o["claim"], F.array_join(F.transform(o["evidence"], at), " "), o["rebutted"].cast("string")))
    return a.select("conv_id", "turn", "a.position", "a.confidence", "a.reasoning", F.array_join(F.transform("a.evidence_lines", at), ",").alias("cited"), F.array_join("a.unresolved_questions", ",").alias("questions"), F.array_join(told, ",").alias("objections"))


_ROW = """CASE doc_id % 9 WHEN 0 THEN '{"id": "' || doc_id || '", "verdict": "TRUE_POSITIVE"}' WHEN 1 THEN '{"id": "", "verdict": "TRUE_POSITIVE"}' WHEN 2 THEN '{"id": "' || doc_id || '", "verdict": "MAYBE"}' WHEN 3 THEN '{"id": "' || doc_id || '", "verdict": "FALSE_POSITIVE", "completeness": "some"}'
 WHEN 4 THEN '{"id": "' || doc_id || '", "verdict": "FALSE_POSITIVE", "schema_valid": 1}' WHEN 5 THEN '{"id": "' || doc_id || '", "verdict": "FALSE_POSITIVE", "cost_usd": true}' WHEN 6 THEN '{"id": "' || doc_id || '", "verdict": "FALSE_POSITIVE", "latency_ms": 1.5}' WHEN 7 THEN '[]'
 ELSE '{"id": "' || doc_id || '", "verdict": "FALSE_POSITIVE", "completeness": "PARTIAL", "schema_valid": false, "cost_usd": ' || doc_id || '.5, "latency_ms": ' || doc_id || '}' END"""


@query(
    """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'id' WHEN 2 THEN 'verdict' WHEN 3 THEN 'completeness' WHEN 4 THEN 'schema_valid' WHEN 5 THEN 'cost_usd' WHEN 6 THEN 'latency_ms' WHEN 7 THEN 'no object' END AS problem,
    CASE WHEN doc_id % 9 = 8 THEN false WHEN doc_id % 9 = 0 THEN true END AS schema_valid, CASE WHEN doc_id % 9 = 8 THEN doc_id + 0.5e0 WHEN doc_id % 9 = 0 THEN 0e0 END AS cost_usd, CASE WHEN doc_id % 9 = 8 THEN doc_id WHEN doc_id % 9 = 0 THEN 0 END AS latency_ms FROM labels"""
)
def run_rows_checked(spark, sf_dir):
    lines = table(spark, sf_dir, "labels").select("doc_id", F.expr(_ROW).alias("value"))
    rows = tables.checked_runs(lines, "doc_id")
    ok = F.col("problem").isNull()
    return rows.select("doc_id", "problem", *[F.when(ok, F.col(c)).alias(c) for c in ("schema_valid", "cost_usd", "latency_ms")])


@query(
    """WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['dynamic-dispatch'] ELSE ['caller-search-truncated', 'dynamic-dispatch'] END AS r FROM labels), c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS value FROM b)
    SELECT 'completeness' AS what, value, count(*) AS n FROM c GROUP BY value UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(r) AS r FROM b) GROUP BY r"""
)
def completeness_histograms(spark, sf_dir):
    reasons = F.expr("CASE doc_id % 3 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('dynamic-dispatch') ELSE array('caller-search-truncated', 'dynamic-dispatch') END")
    b = table(spark, sf_dir, "labels").select(reasons.alias("reasons"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'COMPLETE' ELSE 'INSUFFICIENT' END").alias("completeness"))
    return bundles.histograms(b)


# ---- snapshots of labelled twins: one for each part ----------------------------------------------

_NAME = "'p' || p_partkey || '.py'"
_TP = "'def tp_' || p_size || '(q):' || chr(10) || '    return run(q)  # finding: TP' || chr(10) || 'x = tp_' || p_size || '(\"tp_' || p_size || '\")' || chr(10)"
_FP = "'import os' || chr(10) || 'def fp_' || p_size || '(q):' || chr(10) || '    q = safe(q)' || chr(10) || '    return run(q)  # finding: FP' || chr(10)"


@query(
    f"""WITH t AS (SELECT {_NAME} AS name, p_size, ('0x' || right(sha256({_NAME}), 1))::INT % 2 = 1 AS swap FROM part),
    n AS (SELECT *, CASE WHEN swap THEN 'beta_' ELSE 'alpha_' END AS tp, CASE WHEN swap THEN 'alpha_' ELSE 'beta_' END AS fp FROM t),
    b AS (SELECT *, 'def ' || tp || p_size || '(q):' || chr(10) || '    return run(q)  ' || chr(10) || 'x = ' || tp || p_size || '("tp_' || p_size || '")' AS tp_body, 'import os' || chr(10) || 'def ' || fp || p_size || '(q):' || chr(10) || '    q = safe(q)' || chr(10) || '    return run(q)' AS fp_body FROM n)
    SELECT name, md5(CASE WHEN swap THEN fp_body || chr(10) || chr(10) || tp_body ELSE tp_body || chr(10) || chr(10) || fp_body END) AS body_md5, CAST(CASE WHEN swap THEN 7 ELSE 2 END AS INT) AS tp_line, CAST(CASE WHEN swap THEN 4 ELSE 8 END AS INT) AS fp_line FROM b"""
)
def neutral_snapshots(spark, sf_dir):
    twins = table(spark, sf_dir, "part").select(F.expr(_NAME).alias("name"), F.expr(_TP).alias("tp_code"), F.expr(_FP).alias("fp_code"))
    return snapshots.snapshots(twins).select("name", F.md5("body").alias("body_md5"), "tp_line", "fp_line")
