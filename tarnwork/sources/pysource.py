"""Symbol tables of source files: functions, calls and imports.

Each language has an extractor, registered with Spark as a table function under its name; Python's is the
standard parser. A statement that doesn't parse is left out with a row that says where; the rest of the file
keeps its symbols.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.workers import importable
from tarnwork.operators.prefilter import classify

SYMBOLS = "path string, kind string, name string, start_line int, end_line int, start_byte int, end_byte int, body_start_byte int, decorators array<string>, module string, names array<string>, text string, parsed boolean"
_COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
#: Bytes of a file that is still read, and files of a project that are looked at.
LARGEST, FILES = 2_000_000, 500
#: Rows of symbols that a task makes before it hands them on.
ROWS = 5_000
#: Statements of a file that are left out before the rest is given up.
BROKEN = 64


class _Text:
    """A file's bytes and its lines as the parser counts them: ended by LF, CR or both."""

    def __init__(self, source: str):
        self.bytes = source.encode(errors="surrogatepass")
        ends = [m.end() for m in re.finditer(rb"\r\n|\r|\n", self.bytes)]
        self.starts = [0, *ends]

    def place(self, line: int, column: int) -> int:
        return min(self.starts[line - 1] + column, len(self.bytes))

    def line_end(self, line: int) -> int:
        start = self.starts[line - 1]
        return start + len(self.bytes[start : self.starts[line] if line < len(self.starts) else None].rstrip(b"\r\n"))

    def cut(self, start: int, end: int) -> str:
        return self.bytes[start:end].decode(errors="replace")


def _parse(text: _Text) -> tuple[ast.Module | None, list[int]]:
    """The tree without its broken lines, and these. A line is first replaced by ``pass``, then by nothing."""
    lines = [text.bytes[a:z] for a, z in zip(text.starts, [*text.starts[1:], len(text.bytes)])]
    broken: dict[int, int] = {}
    for _ in range(BROKEN + 1):
        try:
            return ast.parse(b"".join(lines)), sorted(broken)
        except SyntaxError as e:
            # a header without a body is named in the message, not by the line
            header = re.search(r"on line (\d+)$", e.msg or "") if isinstance(e, IndentationError) else None
            at = int(header[1]) if header else e.lineno or 0
            at = at if 1 <= at <= len(lines) else len(lines)
            while at > 1 and not lines[at - 1].strip():
                at -= 1
        except (ValueError, RecursionError, MemoryError):
            return None, sorted(broken)
        line = lines[at - 1]
        body, end = line.rstrip(b"\r\n"), line[len(line.rstrip(b"\r\n")) :]
        indent = body[: len(body) - len(body.lstrip())]
        lines[at - 1] = (indent + b"pass" if not broken.get(at) and not header else b"") + end
        if broken.get(at, 0) > 1:
            return None, sorted(broken)
        broken[at] = broken.get(at, 0) + 1
    return None, sorted(broken)


def _bare_generator(call: ast.Call) -> bool:
    """Whether the call's parentheses are those of a generator: it has no list of arguments."""
    only = call.args[0] if len(call.args) == 1 and not call.keywords else None
    return isinstance(only, ast.GeneratorExp) and (only.end_lineno, only.end_col_offset) == (call.end_lineno, call.end_col_offset)


def symbols_of(path: str, source: str) -> list[dict]:
    """Symbols of one Python file in order of their places; ``text`` of a function or import is its source."""
    blank = dict.fromkeys(_COLUMNS) | {"path": path, "parsed": True}
    text = _Text(source)
    tree, broken = _parse(text)
    out = [blank | {"kind": "file", "parsed": tree is not None and not broken}]
    for line in broken:
        a, z = text.starts[line - 1], text.line_end(line)
        out.append(blank | {"kind": "error", "start_line": line, "end_line": line, "start_byte": a, "end_byte": z, "parsed": None})
    if tree is None:
        return out
    skipped = set(broken)
    begin = lambda n: text.place(n.lineno, n.col_offset)
    end = lambda n: text.line_end(n.end_lineno) if n.end_lineno in skipped else text.place(n.end_lineno, n.end_col_offset)
    for n in ast.walk(tree):
        span = lambda n=n: {"start_line": n.lineno, "end_line": n.end_lineno, "start_byte": begin(n), "end_byte": end(n)}
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            s = span()
            if n.decorator_list:
                first = n.decorator_list[0]
                s |= {"start_line": first.lineno, "start_byte": text.bytes.rfind(b"@", 0, begin(first))}
            own = {"kind": "function", "name": n.name, "body_start_byte": begin(n.body[0]), "decorators": ["@" + text.cut(begin(d), end(d)) for d in n.decorator_list]}
            out.append(blank | s | own | {"text": text.cut(s["start_byte"], s["end_byte"])})
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name and not _bare_generator(n):
                out.append(blank | span() | {"kind": "call", "name": name})
        elif isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", None) != "__future__":
            module = "." * n.level + (n.module or "") if isinstance(n, ast.ImportFrom) else n.names[0].name
            names = [a.name for a in n.names] if isinstance(n, ast.ImportFrom) else []
            out.append(blank | span() | {"kind": "import", "module": module, "names": names, "text": text.cut(begin(n), end(n))})
    return sorted(out, key=lambda r: (r["start_byte"] or 0, r["kind"]))


#: Extractors by language: ``f(path, text) -> list of rows``, each with the columns of SYMBOLS that it knows.
EXTRACTORS: dict[str, Callable[[str, str], list[dict]]] = {}


def register(spark: SparkSession, language: str, extract: Callable[[str, str], list[dict]]) -> None:
    """Makes an extractor known, here and as the SQL table function ``<language>_symbols(path, text)``."""
    importable(spark)
    EXTRACTORS[language] = extract

    class Symbols:
        def eval(self, path: str, text: str):
            for row in extract(path, text or ""):
                yield tuple(row.get(c) for c in _COLUMNS)

    spark.udtf.register(f"{language}_symbols", F.udtf(Symbols, returnType=SYMBOLS))


EXTRACTORS["python"] = symbols_of


def symbols(files: DataFrame, language: str = "python") -> DataFrame:
    """All symbols of files(path, text), by the language's extractor; files without text have none."""
    importable(files.sparkSession)
    extract = EXTRACTORS[language]

    def parse(it: Iterator[pd.DataFrame]):
        # a batch has up to 10,000 files, each of thousands of symbols
        rows = ([r.get(c) for c in _COLUMNS] for pdf in it for p, t in zip(pdf["path"], pdf["text"]) for r in extract(p, t))
        while some := list(islice(rows, ROWS)):
            yield pd.DataFrame(some, columns=_COLUMNS, dtype=object)

    return files.filter("text IS NOT NULL").select("path", "text").mapInPandas(parse, SYMBOLS)


def listing(spark: SparkSession, root: str, most: int = FILES, glob: str = "*.py") -> DataFrame:
    """(path, length) of a project's files, relative to its root, the first ``most`` by path; no content is read.

    Vendored and generated ones are left out by their paths. Links are listed too: ``checkout`` reads what doesn't lead out.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(top).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    at = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    files = files.select(at.alias("at"), "length").filter(F.col("at").startswith(top)).select(F.substring("at", F.lit(len(top) + 1), F.length("at")).alias("path"), "length")
    return files.filter(~classify(F.col("path")).getField("file_class").isin("VENDORED", "GENERATED")).orderBy("path").limit(most)


def functions(symbols_: DataFrame) -> DataFrame:
    return symbols_.filter("kind = 'function'").select("path", "name", "start_line", "end_line", "start_byte", "end_byte", "body_start_byte", "decorators", "text")


def calls(symbols_: DataFrame) -> DataFrame:
    return symbols_.filter("kind = 'call'").select("path", "name", "start_line", "end_line", "start_byte", "end_byte")


def imports(symbols_: DataFrame) -> DataFrame:
    return symbols_.filter("kind = 'import'").select("path", "text", "start_line", "start_byte", "module", "names")
