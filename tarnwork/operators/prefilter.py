"""What can be settled about findings without judgment: repeats and classes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Directory names, endings and markers that decide a file's class.
VENDOR_DIRS = ("node_modules", "vendor", "vendored", "third_party", "thirdparty", "external", "site-packages", "dist-packages", "bower_components", "jspm_packages", "packs", ".venv", "venv", "virtualenv", "eggs", ".eggs", "gems", "godeps", "_vendor")
TEST_DIRS = ("test", "tests", "testing", "spec", "specs", "__tests__", "e2e", "integration_tests")
FIXTURE_DIRS = ("fixtures", "fixture", "testdata", "test_data", "__fixtures__", "golden", "snapshots", "__snapshots__", "mocks", "__mocks__")
GENERATED_DIRS = ("generated", "__generated__", "_generated", "build", "dist", "target", ".next")
TEST_STEM = r"^(test_.+|.+_test|.+\.test|.+\.spec|.+Test|.+Tests|.+TestCase|conftest)$"
GENERATED_SUFFIXES = (".pb.go", ".pb.py", "_pb2.py", "_pb2_grpc.py", ".pb.cc", ".pb.h", ".g.dart", ".g.cs", ".generated.ts", ".generated.js", ".designer.cs", "_generated.go", ".min.js", ".min.css", ".bundle.js")
GENERATED_MARKERS = ("code generated by", "@generated", "do not edit", "auto-generated", "autogenerated", "automatically generated", "generated by the protocol buffer compiler", "this file was generated")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def stem(name: Column) -> Column:
    """Of a dotfile what stands before the first dot (nothing), else the name without its last suffix."""
    return F.when(name.startswith("."), F.substring_index(name, ".", 1)).when(name.rlike(r".\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def _first(values: Column, wanted: tuple) -> Column:
    return F.get(F.filter(values, lambda s: s.isin(*wanted)), F.lit(0))


def _hit(text: Column, needles: tuple, test) -> Column:
    return F.get(F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: test(text, n)), F.lit(0))


def marker(head: Column) -> Column:
    """First marker, in list order, in the lower-cased head of a file; null if none."""
    return _hit(F.lower(head), GENERATED_MARKERS, lambda t, n: F.contains(t, n))


def head_of(text: Column) -> Column:
    """Up to five lines and 8192 characters."""
    return F.substring_index(F.substring(text, 1, 8192), "\n", 5)


def classify(path: Column, head: Column | None = None) -> Column:
    """Struct (file_class, reason, used_content) of a normal path, and of the file's head where it was read."""
    seg = segments(path)
    name = F.get(seg, F.size(seg) - 1)
    dirs = F.transform(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), F.lower)
    made = lambda c, reason, used=False: F.struct(F.lit(c).alias("file_class"), reason.alias("reason"), F.lit(used).alias("used_content"))
    quoted = lambda word, value: F.concat(F.lit(f"{word} '"), value, F.lit("'"))
    out = F.when(F.coalesce(F.size(seg), F.lit(0)) <= 0, made("UNKNOWN", F.lit("empty path")))
    for kind, names in (("VENDORED", VENDOR_DIRS), ("FIXTURE", FIXTURE_DIRS), ("GENERATED", GENERATED_DIRS), ("TEST", TEST_DIRS)):
        hit = _first(dirs, names)
        out = out.when(hit.isNotNull(), made(kind, quoted("path segment", hit)))
    suffix = _hit(F.lower(name), GENERATED_SUFFIXES, lambda t, n: F.endswith(t, n))
    out = out.when(suffix.isNotNull(), made("GENERATED", quoted("filename suffix", suffix)))
    out = out.when(stem(name).rlike(TEST_STEM), made("TEST", quoted("filename", name)))
    if head is None:
        return out.otherwise(made("UNKNOWN", F.lit("no path rule matched, contents not read")))
    found = marker(head)
    out = out.when(F.coalesce(head, F.lit("")) == "", made("UNKNOWN", F.lit("file not readable from the repo root")))
    return out.when(found.isNotNull(), made("GENERATED", quoted("marker", found), True)).otherwise(made("SOURCE", F.lit(""), True))


def decide(refs: DataFrame, resolve_classes: tuple = (), path: Column | None = None, head: Column | None = None) -> DataFrame:
    """Adds disposition, file_class, resolved_by, justification, duplicate_of, used_content; drops no row.

    The first finding of an identity, by log (where there is a path), run and result, is kept; later ones name it.
    """
    w = Window.partitionBy("correlation_id").orderBy(*[c for c in ("path", "run_index", "result_index") if c in refs.columns])
    rows = refs.withColumn("_path", F.col("uri") if path is None else path)
    path = F.col("_path")
    rows = rows.withColumns({"_n": F.row_number().over(w), "_kept": F.first(F.struct("run_index", "result_index")).over(w)})
    known = F.when(F.coalesce(path, F.lit("")) != "", classify(path, head)).otherwise(F.struct(F.lit("UNKNOWN").alias("file_class"), F.lit("finding has no location").alias("reason"), F.lit(False).alias("used_content")))
    rows = rows.withColumn("_class", known)
    again, kind, reason = F.col("_n") > 1, F.col("_class.file_class"), F.col("_class.reason")
    settled = kind.isin(*resolve_classes) if resolve_classes else F.lit(False)
    disposition = F.when(again, "DEDUPLICATED").when(settled, "RESOLVED").otherwise("ADJUDICATE")
    by = F.when(again, F.lit("prefilter:dedupe")).when(settled, F.concat(F.lit("prefilter:"), F.lower(kind))).otherwise(F.lit("prefilter:pass"))
    why = (
        F.when(again, F.format_string("Identical correlation ID to the finding at run %d, result %d. Same rule, same location, same content.", "_kept.run_index", "_kept.result_index"))
        .when(settled, F.concat(F.lit("Classified "), kind, F.lit(" ("), reason, F.lit("), and the caller opted to resolve this class without a model.")))
        .otherwise(F.concat(F.lit("Classified "), kind, F.when(reason != "", F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise(F.lit("")), F.lit(". Not resolvable without judgment; passed to adjudication.")))
    )
    rows = rows.withColumns({"disposition": disposition, "file_class": kind, "resolved_by": by, "justification": why, "duplicate_of": F.when(again, F.col("correlation_id")), "used_content": ~again & F.col("_class.used_content")})
    return rows.drop("_n", "_kept", "_class", "_path")


def by_class(decisions: DataFrame) -> DataFrame:
    """Findings of each class of file, whatever became of them."""
    return decisions.groupBy("file_class").agg(F.count(F.lit(1)).alias("n"))


def disposition_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def resolvable_by_class(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.col("file_class").isin("SOURCE", "UNKNOWN") & (F.col("disposition") != "DEDUPLICATED")).groupBy("file_class").agg(F.count(F.lit(1)).alias("n"))


def cross_run_overlap(refs: DataFrame) -> DataFrame:
    """One row: the number of identities found in two runs or more."""
    pairs = refs.select("correlation_id", F.struct(*[c for c in ("path", "run_index") if c in refs.columns]).alias("run")).distinct().groupBy("correlation_id").agg(F.count(F.lit(1)).alias("runs"))
    return pairs.agg(F.count_if(F.col("runs") > 1).alias("overlap"))


def settled_ratio(decisions: DataFrame) -> DataFrame:
    done = F.count_if(F.col("disposition") != "ADJUDICATE")
    return decisions.agg(F.count(F.lit(1)).alias("total"), done.alias("settled"), F.coalesce(F.try_divide(done, F.count(F.lit(1))), F.lit(0.0)).alias("ratio"))
