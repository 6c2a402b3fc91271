"""Snapshots of labelled twins whose label can't be told from names, comments or order."""

from __future__ import annotations

import hashlib
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The comments that mark the flagged lines, and the prefixes of labelled and neutral names.
MARKERS = ("# finding: TP", "# finding: FP")
LABELLED, NEUTRAL = ("tp_", "fp_"), ("alpha_", "beta_")
SNAPSHOT = "name string, body string, tp_line int, fp_line int, problem string"


def _edited(code: str, marker: str, prefix: str) -> tuple[str, int]:
    """The code without its marker and with its first labelled function under the prefix wherever it is named; the marked line from 0."""
    tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    marked = [t for t in tokens if t.type == tokenize.COMMENT and marker in t.string]
    if not marked:
        raise ValueError(f"no {marker}")
    defined = (b.string for a, b in zip(tokens, tokens[1:]) if a.string == "def" and b.type == tokenize.NAME)
    name = next((n for n in defined if n.startswith(LABELLED)), None)
    lines = code.split("\n")
    # from the end, so that earlier places stay
    for t in reversed(tokens):
        row, (start, end) = t.start[0] - 1, (t.start[1], t.end[1])
        if t.type == tokenize.COMMENT and any(m in t.string for m in MARKERS):
            text = t.string
            for m in MARKERS:
                text = text.replace(m, "")
        elif t.type == tokenize.NAME and t.string == name:
            text = prefix + name[3:]
        else:
            continue
        lines[row] = lines[row][:start] + text + lines[row][end:]
    return "\n".join(lines).rstrip(), marked[0].start[0] - 1


def neutral(name: str, tp_code: str, fp_code: str) -> tuple[str, int, int]:
    """(body, line of the true finding, line of the false one), lines from 1. Which twin comes first goes by the name's hash
    alone, and the first one's function is always alpha, the second one's beta."""
    swap = int(hashlib.sha256(name.encode()).hexdigest()[-1], 16) % 2 == 1
    twins = [(tp_code, MARKERS[0]), (fp_code, MARKERS[1])]
    order = [1, 0] if swap else [0, 1]
    (first, a), (second, b) = (_edited(*twins[k], NEUTRAL[place]) for place, k in enumerate(order))
    at = (a + 1, len(first.splitlines()) + 2 + b)
    return first + "\n\n" + second, at[order.index(0)], at[order.index(1)]


def snapshots(twins: DataFrame) -> DataFrame:
    """(name, body, tp_line, fp_line, problem) of twins(name, tp_code, fp_code); code that can't be read has a problem, no body."""

    def build(it: Iterator[pd.DataFrame]):
        for pdf in it:
            rows = []
            for name, tp, fp in zip(pdf["name"], pdf["tp_code"], pdf["fp_code"]):
                try:
                    rows.append((name, *neutral(name, tp or "", fp or ""), None))
                except (ValueError, SyntaxError, tokenize.TokenError) as e:
                    rows.append((name, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["name", "body", "tp_line", "fp_line", "problem"])
            yield out.astype({"tp_line": "Int32", "fp_line": "Int32"})

    return twins.select("name", "tp_code", "fp_code").mapInPandas(build, SNAPSHOT)


def labelled(built: DataFrame, folder: str = "snapshots") -> DataFrame:
    """Two entries for each snapshot: id, path, line and ground truth; the id doesn't tell the truth either."""
    path = F.concat(F.lit(f"{folder}/"), F.col("name"))
    sides = F.array(F.struct(F.col("tp_line").alias("line"), F.lit("TRUE_POSITIVE").alias("ground_truth")), F.struct(F.col("fp_line").alias("line"), F.lit("FALSE_POSITIVE").alias("ground_truth")))
    rows = built.filter("problem IS NULL").select(path.alias("path"), F.explode(sides).alias("s"))
    return rows.select(F.concat("path", F.lit(":"), F.col("s.line")).alias("id"), "path", "s.line", "s.ground_truth")


def write(built: DataFrame, folder: str) -> None:
    """Writes the snapshots, one file each, and dataset.jsonl's rows beside them; nothing else is in the folder."""
    from tarnwork.sources import logformat

    logformat.register(built.sparkSession)
    good = built.filter("problem IS NULL")
    files = good.select(F.concat(F.lit("snapshots/"), F.col("name")).alias("path"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.concat("body", F.lit("\n")).alias("raw"))
    files.write.format("scanlogs").mode("overwrite").save(folder)
    labelled(built).write.mode("overwrite").json(f"{folder}/dataset")
