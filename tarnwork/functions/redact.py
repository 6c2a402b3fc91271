"""Secret-shaped text: detection, entropy, replacement, and fencing of untrusted text."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns, in order of precedence, and the literals that are judged by entropy.
PATTERNS = (
    ("PRIVATE_KEY_PEM", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----"),
    ("AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("JWT", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("CONNECTION_STRING", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:@'\"]+:[^\s@'\"]+@[^\s'\"]+"),
)
LITERAL = r"\"([^\"\n]{16,200})\"|'([^'\n]{16,200})'"
LOW_BELOW, MEDIUM_BELOW = 3.0, 4.0
_COMPILED, _QUOTED = [(k, re.compile(p)) for k, p in PATTERNS], re.compile(LITERAL)
_SECRET = T.StructType([T.StructField("kind", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("entropy_class", T.StringType()), T.StructField("line", T.IntegerType())])
SECRETS = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("secrets", T.ArrayType(_SECRET))])


def entropy(text: Column) -> Column:
    """Shannon entropy over the characters of a text, in bits."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def entropy_class(bits: Column) -> Column:
    bits = F.round(bits, 12)
    return F.when(bits < LOW_BELOW, "LOW").when(bits < MEDIUM_BELOW, "MEDIUM").otherwise("HIGH")


def secret_counts(text: Column) -> list[Column]:
    """How often each specific pattern is found."""
    return [F.regexp_count(text, F.lit(p)).alias(k.lower()) for k, p in PATTERNS]


def quoted_literals(text: Column) -> Column:
    """Quoted literals of 16 to 200 characters, without their quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def untrusted_block(path: Column, start: Column, end: Column, source: Column) -> Column:
    """The text between markers that it can't forge."""
    safe = F.replace(F.replace(source, F.lit("<<<"), F.lit("< <<")), F.lit(">>>"), F.lit("> >>"))
    head = F.concat(F.lit("<<<UNTRUSTED SOURCE path="), path, F.lit(" lines="), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(">>>"))
    return F.concat(head, F.lit("\n"), safe, F.lit("\n<<<END UNTRUSTED SOURCE>>>"))


def bits_of(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def class_of(text: str) -> str:
    b = round(bits_of(text), 12)
    return "LOW" if b < LOW_BELOW else "MEDIUM" if b < MEDIUM_BELOW else "HIGH"


def _shaped(text: str) -> Iterator[tuple[int, int, str]]:
    """All secret-shaped spans, those of higher precedence first; they may touch each other."""
    for kind, pattern in _COMPILED:
        yield from ((*m.span(), kind) for m in pattern.finditer(text))
    for m in _QUOTED.finditer(text):
        if class_of(m[m.lastindex]) == "HIGH":
            yield *m.span(m.lastindex), "GENERIC_HIGH_ENTROPY"


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start. What touches a span of higher precedence is left out."""
    line: list[tuple[int, int, str]] = []
    for span in _shaped(text):
        # kept spans lie apart on the line, so that only both neighbours can be touched
        at = bisect_left(line, span)
        after, before = line[at : at + 1], line[at - 1 : at] if at else []
        if all(span[1] <= s[0] for s in after) and all(s[1] <= span[0] for s in before):
            line.insert(at, span)
    return line


def _redacted(text: str, first: int) -> dict:
    spans = find_secrets(text)
    breaks = [m.start() for m in re.finditer("\n", text)] if spans else []
    secrets = [{"kind": kind, "length": z - a, "entropy_class": class_of(text[a:z]), "line": first + bisect_left(breaks, a)} for a, z, kind in spans]
    marks = [f"<<REDACTED:kind={s['kind'].lower()},len={s['length']},entropy={s['entropy_class'].lower()}>>" for s in secrets]
    edges = [0, *(x for a, z, _ in spans for x in (a, z)), len(text)]
    clear = [text[a:z] for a, z in zip(edges[::2], edges[1::2])]
    return {"redacted": "".join(x for pair in zip(clear, [*marks, ""]) for x in pair), "secrets": secrets}


@F.pandas_udf(SECRETS)
def redact(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text with secrets replaced by placeholders, and what they were; arguments: text, first line number."""
    for texts, first in parts:
        out = [{"redacted": None, "secrets": []} if text is None else _redacted(text, int(line)) for text, line in zip(texts, first)]
        yield pd.DataFrame(out, columns=["redacted", "secrets"])


def located(secrets: Column, path: Column) -> Column:
    """Secrets with the path of the file that they were found in."""
    return F.transform(secrets, lambda s: s.withField("path", path))
