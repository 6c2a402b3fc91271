"""Scanner logs (SARIF 2.1.0): strict reading, flattening, and lossless annotation.

Each log is one row that keeps its raw text; everything tabular is a projection of it. The emitter
patches the raw document by position, so that what is absent, null or empty stays so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOGS = "path string, ok boolean, error string, raw string"
_REGION = "start_line int, start_column int, end_line int, end_column int"
RESULTS = (
    "path string, run_index int, result_index int, tool_name string, automation_id string, scope string, rule_id string, level string, message string, uri string, "
    f"{_REGION}, snippet string, partial_fps map<string,string>, fps map<string,string>, n_suppressions int, n_flows int"
)
#: Key of the annotation in a result's property bag.
BAG = "findings/v1"


class Refused(ValueError):
    pass


def _one(kind, null: bool = True):
    def check(x, where: str):
        if not (isinstance(x, kind) and not isinstance(x, bool) or (null and x is None)):
            raise Refused(f"{where} is of another type")

    return check


def _whole_number(x, where: str):
    try:
        ok = x is None or (not isinstance(x, bool) and float(x) == int(float(x)))
    except (TypeError, ValueError, OverflowError):
        ok = False
    if not ok:
        raise Refused(f"{where} is no whole number")


def _many(item):
    def check(x, where: str):
        if not isinstance(x, list):
            raise Refused(f"{where} is no array")
        for i, each in enumerate(x):
            item(each, f"{where}[{i}]")

    return check


def _bag(item):
    def check(x, where: str):
        if not isinstance(x, dict):
            raise Refused(f"{where} is no object")
        for k, each in x.items():
            item(each, f"{where}.{k}")

    return check


def _shape(null: bool = False, needs: tuple = (), **fields):
    """An object: the named fields, where they are there, are of their shapes; others are kept as they are."""

    def check(x, where: str):
        if x is None and null:
            return
        if not isinstance(x, dict):
            raise Refused(f"{where} is no object")
        for k in needs:
            if x.get(k) is None:
                raise Refused(f"{where} has no {k}")
        for k, of in fields.items():
            if k in x:
                of(x[k], f"{where}.{k}")

    return check


def _named(*names):
    def check(x, where: str):
        if x not in names:
            raise Refused(f"{where} is none of {', '.join(names)}")

    return check


_TEXT, _ANY = _one(str), lambda x, where: None
_MESSAGE = dict(text=_TEXT, markdown=_TEXT)
_REGION_SHAPE = _shape(True, snippet=_one(dict), **dict.fromkeys(("startLine", "startColumn", "endLine", "endColumn"), _whole_number))
_PLACE = _shape(True, artifactLocation=_shape(True, uri=_TEXT, uriBaseId=_TEXT, index=_whole_number), region=_REGION_SHAPE)
_LOCATION = dict(physicalLocation=_PLACE, message=_shape(True, **_MESSAGE))
_STEP = _shape(location=_shape(True, **_LOCATION), nestingLevel=_whole_number)
_FLOW = _shape(message=_shape(True, **_MESSAGE), threadFlows=_many(_shape(locations=_many(_STEP))))
_NOTE = _shape(justification=_TEXT, guid=_TEXT, kind=_named("inSource", "external"), status=_named("accepted", "underReview", "rejected"))
_RULE = _shape(needs=("id",), id=_TEXT, name=_TEXT, shortDescription=_shape(True, **_MESSAGE), fullDescription=_shape(True, **_MESSAGE))
_COMPONENT = _shape(needs=("name",), name=_TEXT, version=_TEXT, rules=_many(_RULE))
_STRINGS = _bag(_one(str, False))
_RESULT = _shape(
    ruleId=_TEXT, ruleIndex=_whole_number, level=_TEXT, message=_shape(**_MESSAGE), locations=_many(_shape(**_LOCATION)), codeFlows=_many(_FLOW), suppressions=_many(_NOTE), fingerprints=_STRINGS, partialFingerprints=_STRINGS,
    properties=_bag(_ANY),
)
_RUN = _shape(needs=("tool",), tool=_shape(needs=("driver",), driver=_COMPONENT, extensions=_many(_COMPONENT)), results=_many(_RESULT), properties=_bag(_ANY), automationDetails=_shape(True, id=_TEXT))


def check_log(data: bytes) -> tuple[str | None, str | None]:
    """(text, None) of a readable log, (None, what is wrong) of another. The whole file is refused."""
    try:
        text = data.decode("utf-8-sig")
        log = json.loads(text)
        if "\\ud" in text.lower():
            # half of a surrogate pair is no character and can't be written
            json.dumps(log, ensure_ascii=False).encode()
    except (UnicodeError, ValueError, RecursionError) as e:
        return None, f"unreadable: {type(e).__name__}"
    if not isinstance(log, dict):
        return None, "not an object"
    if log.get("version") != "2.1.0":
        return None, "version is not 2.1.0"
    if not isinstance(log.get("runs"), list):
        return None, "runs is missing or no array"
    try:
        _many(_RUN)(log["runs"], "runs")
    except Refused as e:
        return None, str(e)
    return text, None


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under ``path``; refused ones have ok false and the reason.

    Spark's file sources don't list files of no bytes, so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sarif").load(path)
    return parse_logs(files.select("path", "content"))


def parse_logs(files: DataFrame) -> DataFrame:
    """The same of a table (path, content binary), also of a stream."""

    def parse(it: Iterator[pa.RecordBatch]):
        for batch in it:
            got = [check_log(c.as_py() or b"") for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([e is None for _, e in got]), pa.array([e for _, e in got], pa.string()), pa.array([t for t, _ in got], pa.string())], names=["path", "ok", "error", "raw"])

    return files.mapInArrow(parse, LOGS)


def _strings(bag) -> list[tuple[str, str]]:
    return [(k, v) for k, v in bag.items() if isinstance(v, str)] if isinstance(bag, dict) else []


def _whole(x):
    """A checked whole number; null where a column of ints can't hold it."""
    return None if x is None or not -(2**31) <= (n := int(float(x))) < 2**31 else n


def rows_of(path: str, raw: str) -> list[dict]:
    out = []
    for i, run in enumerate(json.loads(raw)["runs"]):
        tool, auto = run["tool"]["driver"]["name"], (run.get("automationDetails") or {}).get("id")
        for j, r in enumerate(run.get("results", [])):
            place = ((r.get("locations") or [{}])[0] or {}).get("physicalLocation") or {}
            region = place.get("region") or {}
            snippet = (region.get("snippet") or {}).get("text")
            out.append(
                {
                    "path": path, "run_index": i, "result_index": j, "tool_name": tool, "automation_id": auto, "scope": f"{tool}\0{auto or ''}", "rule_id": r.get("ruleId"), "level": r.get("level"),
                    "message": (r.get("message") or {}).get("text"), "uri": (place.get("artifactLocation") or {}).get("uri"), "start_line": _whole(region.get("startLine")), "start_column": _whole(region.get("startColumn")),
                    "end_line": _whole(region.get("endLine")), "end_column": _whole(region.get("endColumn")), "snippet": snippet if isinstance(snippet, str) else None, "partial_fps": _strings(r.get("partialFingerprints")),
                    "fps": _strings(r.get("fingerprints")), "n_suppressions": len(r.get("suppressions", [])), "n_flows": len(r.get("codeFlows", [])),
                }
            )
    return out


def flatten(logs: DataFrame) -> DataFrame:
    """One row for each result of the readable logs, by position; runs without results have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(RESULTS))

    def flat(it: Iterator[pa.RecordBatch]):
        for batch in it:
            for path, raw in zip(batch.column("path"), batch.column("raw")):
                yield from pa.Table.from_pylist(rows_of(path.as_py(), raw.as_py()), schema=kinds).to_batches()

    return logs.filter("ok").select("path", "raw").mapInArrow(flat, RESULTS)


def annotate(logs: DataFrame, notes: DataFrame, bag: str = BAG) -> DataFrame:
    """(path, raw): the logs with each result's note in its property bag, and an accepted suppression
    where its verdict is FALSE_POSITIVE. ``notes``: path, run_index, result_index, note (JSON), verdict, justification.

    Results without a note stay as they are; no result is dropped. Keys keep their order; text is
    written with two spaces of indent and a final line feed.
    """
    per = notes.groupBy("path").agg(F.collect_list(F.struct("run_index", "result_index", "note", "verdict", "justification")).alias("notes"))
    joined = logs.filter("ok").select("path", "raw").join(per, "path", "left")

    def write(it: Iterator[pa.RecordBatch]):
        for batch in it:
            out = []
            for raw, found in zip(batch.column("raw"), batch.column("notes")):
                log = json.loads(raw.as_py())
                for n in found.as_py() or []:
                    r = log["runs"][n["run_index"]]["results"][n["result_index"]]
                    r["properties"] = (r.get("properties") or {}) | {bag: json.loads(n["note"])}
                    if n["verdict"] == "FALSE_POSITIVE":
                        r["suppressions"] = r.get("suppressions", []) + [{"kind": "external", "status": "accepted", "justification": n["justification"]}]
                out.append(json.dumps(log, indent=2, ensure_ascii=False) + "\n")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "raw"])

    return joined.mapInArrow(write, "path string, raw string")


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs whose number of results differs between two tables of results; must be empty."""
    n = lambda d, c: d.groupBy("path", "run_index").agg(F.count(F.lit(1)).alias(c))
    return n(before, "a").join(n(after, "b"), ["path", "run_index"], "full_outer").filter("NOT (a <=> b)")


def code_flows(logs: DataFrame) -> DataFrame:
    """Steps of the code flows: path, run_index, result_index, flow, thread, step, uri, line, message."""
    schema = "path string, run_index int, result_index int, flow int, thread int, step int, uri string, line int, message string"
    names = [c.split()[0] for c in schema.split(", ")]

    def steps(it: Iterator[pa.RecordBatch]):
        for batch in it:
            rows = []
            for path, raw in zip(batch.column("path"), batch.column("raw")):
                for i, run in enumerate(json.loads(raw.as_py())["runs"]):
                    for j, r in enumerate(run.get("results", [])):
                        for a, flow in enumerate(r.get("codeFlows", [])):
                            for b, thread in enumerate(flow.get("threadFlows", [])):
                                for c, s in enumerate(thread.get("locations", [])):
                                    loc = s.get("location") or {}
                                    place = loc.get("physicalLocation") or {}
                                    rows.append((path.as_py(), i, j, a, b, c, (place.get("artifactLocation") or {}).get("uri"), _whole((place.get("region") or {}).get("startLine")), (loc.get("message") or {}).get("text")))
            kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return logs.filter("ok").select("path", "raw").mapInArrow(steps, schema)


# What differs between two runs of a scanner over one source, and the base that stands for any root.
_BASE = "file:///src/"
_VOLATILE = (
    ("runs/*/originalUriBaseIds/*/uri", "base"), ("runs/*/artifacts/*/location/uri", "root"),
    ("runs/*/invocations/*/startTimeUtc", "time"), ("runs/*/invocations/*/endTimeUtc", "time"),
)


def _owners(node, path: list[str]) -> list[dict]:
    """The objects that hold a path's last key; * is any element or value."""
    for key in path:
        near = node if isinstance(node, list) else [node]
        node = []
        for x in near:
            if key == "*":
                node += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
            elif isinstance(x, dict) and key in x:
                node.append(x[key])
    return [x for x in node if isinstance(x, dict)]


def scrubbed(text: str, root: str) -> str:
    """A log without what changes from run to run: base addresses, the root before artifacts, times of invocations."""
    log = json.loads(text)
    for path, what in _VOLATILE:
        *way, last = path.split("/")
        for owner in _owners([log], way):
            if what == "time":
                owner.pop(last, None)
            elif what == "base" and last in owner:
                owner[last] = _BASE
            elif what == "root" and isinstance(owner.get(last), str):
                owner[last] = owner[last].replace(root, "").lstrip("/")
    return json.dumps(log, indent=2, ensure_ascii=False) + "\n"
