"""Plain versions of the corpus operators, on lists of rows."""

import hashlib
import re
from collections import Counter

WORD = "[^\x20\x09-\x0d]+"
BLANK = " \t\n\x0b\x0c\r"


def rank(i):
    return 10**30 if i is None else i


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def covered(sequences, n):
    """Per row, the mask of the symbols in windows that an earlier document holds too."""
    least = {}
    for i, s in sequences:
        for q in range(len(s) - n + 1):
            w = tuple(s[q : q + n])
            least[w] = min(least.get(w, 10**31), rank(i))
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        for q in range(len(s) - n + 1):
            if least[tuple(s[q : q + n])] < rank(i):
                gone[q : q + n] = [True] * n
        out.append(gone)
    return out


def phrases(rows):
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    return [(i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (i, w), g in zip(words, covered(words, 13))]


def suffixes(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, b), g in zip(data, covered(data, 50)):
        spans = sum(1 for q in range(len(b)) if g[q] and (q == 0 or not g[q - 1]))
        out.append((i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g) if not y))))
    return out


def lines(rows):
    inked = [(i, [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]) for i, t in rows]
    gone = covered([(i, [x for _, x in s]) for i, s in inked], 2)
    out = []
    for (i, t), (_, s), g in zip(rows, inked, gone):
        seen = set()
        for k, (a, b) in enumerate(zip(s, s[1:])):
            if (a[1], b[1]) in seen:
                g[k] = g[k + 1] = True
            seen.add((a[1], b[1]))
        drop = {p for (p, _), y in zip(s, g) if y}
        out.append((i, len(s), len(drop), sha("\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in drop))))
    return out


def near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, _) in enumerate(rows):
        for j, n in Counter(j for x in sets[k] for j in where[x] if j < k).items():
            if i is not None and rows[j][0] is not None and 100 * n >= 75 * (len(sets[k]) + len(sets[j]) - n):
                a, b = find(i), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i), i is not None and find(i) == i) for (i, _), s in zip(rows, sets)]


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = lambda c: 2 * c - 9 if c > 4 else 2 * c
        return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else twice(int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def personal(rows):
    out = []
    for i, t in rows:
        spans, counts = [], []
        for r, (kind, form) in enumerate(FORMS.items()):
            found = [(m.start(), r, m.end()) for m in re.finditer(form, t or "") if _good(kind, m.group())]
            counts.append(len(found))
            spans += found
        text = ",".join(f"{list(FORMS)[r]}:{a}:{b}" for a, r, b in sorted(spans))
        out.append((i, *counts, sha(text), text, sum(counts)))
    return out


def long_lines(rows, long=13):
    """(doc_id, lines, removed) where single lines of many words count as a run, and ``left``: the texts that stay."""
    return [(i, n, k) for i, n, k, _ in _long(rows, long)]


def left(rows, long=13):
    return [(i, t) for i, _, _, t in _long(rows, long)]


def _long(rows, long):
    split = [[(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for _, t in rows]

    def windows(s):
        for k, (p, x) in enumerate(s):
            if len(re.findall(WORD, x)) >= long:
                yield (x,), [p]
            if k + 1 < len(s):
                yield (x, s[k + 1][1]), [p, s[k + 1][0]]

    first, out = {}, []
    for (i, _), s in zip(rows, split):
        for w, _ in windows(s):
            first[w] = min(first.get(w, 10**31), rank(i))
    for (i, t), s in zip(rows, split):
        drop, mine = set(), set()
        for w, places in windows(s):
            if w in mine or first[w] < rank(i):
                drop.update(places)
            mine.add(w)
        out.append((i, len(s), len(drop), "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in drop)))
    return out
