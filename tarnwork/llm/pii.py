"""Personal data by fixed forms, and by lexical patterns bootstrapped from them, in DataFrame operations only.

Emails, IP addresses, card and phone numbers of the fixed forms are the first seeds. Words around a seed
make patterns: the word before it, the two words before it, and each of these with the word after it. A
pattern's score is the trust of what stands in its slot, summed over the whole corpus, by the number of
all its slots. What stands in the slots of patterns of high score, at a fair share of all its occurrences
(so no common word), is an identifier that the forms have missed; its trust is the mean score of those
slots. All its occurrences are found, and it becomes a seed whose surroundings make new patterns and raise
the scores of old ones. The rounds end when no pattern is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import cut, cut_small

KINDS = ("email", "ip", "card", "phone")
#: The base forms. A match can start only where the run of its first characters does, or where the
#: match before ended; with possessive repeats this gives the same matches in linear time.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a valid match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


#: Matches that are walked over in one piece.
_PIECE = 256


def _let(x: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _walk(text: Column, form: str, item) -> Column:
    """Array of what ``item(start, end, match, gap before, gap after)`` makes of the matches, nulls left out, in order.

    The text between matches, and the matches, give the positions by adding up lengths: within pieces of
    matches, after adding up the pieces, so that the time is in proportion to the matches.
    """
    word = F.lit("")
    kind = item(F.lit(0), F.lit(0), word, word, word)
    none = F.filter(F.array(kind), lambda x: F.lit(False))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        made = item(start, end, x["match"], x["gap"], x["after"])
        return F.struct(end.alias("at"), F.when(made.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(made))).alias("out"))

    def positions(pieces):
        size = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["match"])))
        first = F.aggregate(size, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return _let(first, lambda at: F.flatten(F.transform(pieces, lambda p, i: F.aggregate(p, F.struct(F.get(at, i).alias("at"), none.alias("out")), step, lambda a: a["out"]))))

    def cut_up(both):
        last = F.floor((F.greatest(F.size(both), F.lit(1)) - 1) / _PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(both, k * _PIECE + 1, F.lit(_PIECE)))

    def together(gaps):
        matches = F.regexp_extract_all(text, F.lit(form), F.lit(0))
        return F.transform(matches, lambda m, i: F.struct(m.alias("match"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("after")))

    return _let(_let(_let(F.split(text, form, -1), together), cut_up), positions)


_BLANK = r"[\x20\x09-\x0D]"
_INK = r"[^\x20\x09-\x0D]"
_SIGNS = r"[^\p{L}\p{N}]+"


def _base(text: Column, rank: int) -> Column:
    kind = KINDS[rank]

    def item(start, end, match, gap, after):
        # the words around, where they are whole in the gaps
        two, one = (F.regexp_extract(F.substring(gap, -128, 128), f, 1) for f in (rf"(?:^|{_BLANK})({_INK}{{1,48}}){_BLANK}+{_INK}{{1,48}}{_BLANK}+$", rf"(?:^|{_BLANK})({_INK}{{1,48}}){_BLANK}+$"))
        right = F.regexp_extract(F.substring(after, 1, 64), rf"^[^\p{{L}}\p{{N}}\x20\x09-\x0D]*{_BLANK}+({_INK}{{1,48}})(?:{_BLANK}|$)", 1)
        known = [_word(x).alias(n) for x, n in ((two, "l2"), (one, "l1"), (right, "r1"))]
        return F.when(_valid(kind, match), F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), *known, _word(match).alias("value"), match.rlike(_BLANK).alias("wide")))

    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, _walk(text, FORMS[kind], item))


_BASE = "array<struct<start:int,rank:int,end:int,l2:string,l1:string,r1:string,value:string,wide:boolean>>"


def _word(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), _SIGNS, "")


def _names(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _patterns() -> Column:
    """The patterns (key, right) of a slot, given the words around it; right: the word after it counts."""
    def full(*names):
        return F.coalesce(reduce(Column.__and__, [F.col(n) != "" for n in names]), F.lit(False))

    made = [F.when(full(*names), F.struct(F.xxhash64(F.lit(k), *names).alias("key"), F.lit("r1" in names).alias("right"))) for k, names in enumerate((["l1"], ["l2", "l1"], ["l1", "r1"], ["l2", "l1", "r1"]))]
    return F.explode(F.array_compact(F.array(*made)))


#: Rows up to which a table is sent to all tasks, and words up to which tokens are picked by a list of them; what is
#: larger meets by a shuffle.
SENT, LISTED = 100_000, 5_000


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT else table


def _slots(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Tokens of all texts whose ``column`` (v: the token, l1: the one before) is among the ``words``, by their number
    there (i), with the words around them."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower("text"), rf"{_BLANK}+", " ")), r"[^\p{L}\p{N} ]+", "")
    t = rows.select("doc_id", "content", F.split(plain, " ").alias("v"))
    n, none = F.size("v"), F.array(F.lit(None).cast("string"))
    l1 = F.concat(none, F.slice("v", F.lit(1), n - 1))
    l2 = F.concat(none, none, F.slice("v", F.lit(1), F.greatest(n - 2, F.lit(0))))
    r1 = F.concat(F.slice("v", F.lit(2), n), none)
    every = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), "v", l1.alias("l1"), l2.alias("l2"), r1.alias("r1"))
    words = words.select(F.col(words.columns[0]).alias(column)).distinct()
    listed = [r[0] for r in words.limit(LISTED + 1).collect()]
    few = len(listed) <= LISTED
    if few:
        # picked within the text's array, so that no row is made for the others
        every = F.filter(every, lambda s: s[column].isin(listed)) if listed else F.filter(every, lambda s: F.lit(False))
    t = t.select("doc_id", "content", F.explode(every).alias("s")).select("doc_id", "content", "s.i", "s.v", "s.l1", "s.l2", "s.r1").filter("i IS NOT NULL AND v IS NOT NULL")
    return t if few else t.join(_sent(words), column)


def _in_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """The slots of the patterns (key, l1), with the pattern's key."""
    slots = _slots(rows, "l1", patterns.select("l1"))
    slots = slots.select("doc_id", "content", "i", "v", _patterns().alias("p")).select("doc_id", "content", "i", "v", "p.key")
    return slots.join(_sent(patterns.select("key")), "key")


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.content") == F.col(f"{b}.content"))


def _placed(rows: DataFrame, narrow: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, content, i, v, start, end) of slots, without signs at both ends, where they touch no base span."""
    wanted = slots.select("doc_id", "content", "i", "v").distinct().groupBy("doc_id", "content").agg(F.collect_list(F.struct("i", "v")).alias("wanted"))
    bases = narrow.select("doc_id", "content", "base").dropDuplicates(["doc_id", "content"])
    texts = rows.alias("a").join(wanted.alias("b"), _same_doc("a", "b")).select("a.*", "wanted").dropDuplicates(["doc_id", "content"])
    texts = texts.alias("a").join(bases.alias("b"), _same_doc("a", "b")).select("a.*", "base")

    def bare(start, end, match, gap, after):
        lead, tail = (F.length(F.regexp_extract(match, f, 0)) for f in (rf"^{_SIGNS}", rf"{_SIGNS}$"))
        return F.struct((start + lead).alias("start"), (end - tail).alias("end"))

    texts = texts.select("doc_id", "content", "base", "wanted", _walk(F.col("text"), f"{_INK}+", bare).alias("at"))
    found = texts.select("doc_id", "content", "base", F.explode(F.transform("wanted", lambda w: F.struct(w["i"].alias("i"), w["v"].alias("v"), F.get("at", w["i"]).alias("at")))).alias("w"))
    found = found.select("doc_id", "content", "base", "w.i", "w.v", "w.at.start", "w.at.end").filter("start < end")
    return found.filter(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))).drop("base")


def _edges(seeds: DataFrame) -> DataFrame:
    """(key, l1, right, value, rank, trust, n, wide): how often a seed stands in a pattern's slot, and how often as several tokens."""
    e = seeds.select("l1", "value", "rank", "trust", "wide", _patterns().alias("p")).select("p.*", "l1", "value", "rank", "trust", "wide")
    return e.groupBy("key", "l1", "right", "value", "rank", "trust").agg(F.count(F.lit(1)).alias("n"), F.count_if("wide").alias("wide"))


def _score(edges: DataFrame, least_seeds: int) -> DataFrame:
    """Patterns of enough seeds: key, l1, the trust in their slots, seeds there, slots that no single token fills, the kind of most seeds."""
    p = edges.groupBy("key", "l1", "right", "rank").agg(F.count_distinct("value").alias("seeds"), F.sum(F.col("trust") * F.col("n")).alias("hits"), F.sum("n").alias("n"), F.sum("wide").alias("wide"))
    p = p.groupBy("key", "l1", "right").agg(F.sum("seeds").alias("seeds"), *[F.sum(c).alias(c) for c in ("hits", "n", "wide")], F.max_by("rank", F.struct("seeds", -F.col("rank"))).alias("rank"))
    return p.filter(F.col("seeds") >= least_seeds).select("key", "l1", "hits", "n", F.when(F.col("right"), F.col("wide")).otherwise(0).alias("wide"), "rank")


def _good(patterns: DataFrame, slots: DataFrame, least_score: float) -> DataFrame:
    """The patterns whose score is high, given the number of (some of) their slots."""
    p = patterns.join(slots, "key", "left")
    # what stands there as several tokens is no slot of its own
    every = F.greatest(F.col("n"), F.coalesce("slots", F.lit(0)) + F.col("wide"))
    return p.withColumn("score", F.least(F.lit(1.0), F.col("hits") / every)).filter(F.col("score") >= least_score).drop("slots")


def discover(rows: DataFrame, narrow: DataFrame, least_score: float, least_seeds: int, least_share: float, rounds: int | None) -> DataFrame | None:
    """(doc_id, content, start, end, rank) of what bootstrapped patterns find; None where no pattern is good enough.

    Texts that may hold a base form are a small part of all, and hold all first seeds. What common words do in
    these texts already rules out most patterns and candidates; the whole corpus is read for the others alone.
    """
    first = narrow.select(F.explode("base").alias("s")).select("s.l2", "s.l1", "s.r1", "s.value", "s.rank", F.lit(1.0).alias("trust"), "s.wide")
    edges = cut_small(_edges(first))
    some = rows.filter(F.contains("text", F.lit("@")) | F.col("text").rlike("|".join(HINTS[k] for k in KINDS[1:])))
    number = lambda slots: slots.groupBy("key").agg(F.count(F.lit(1)).alias("slots"))
    done = slots = found = None
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        patterns = cut_small(_score(edges, least_seeds))
        new = patterns if done is None else patterns.join(done, "key", "left_anti")
        new = cut_small(_good(new, number(_in_patterns(some, new)), least_score))
        if not new.isEmpty():
            more = cut(_in_patterns(rows, new))
            slots = more if slots is None else slots.unionByName(more)
            done = new.select("key") if done is None else cut_small(done.unionByName(new.select("key")))
        elif turn == 1:
            break
        good = cut_small(_good(patterns.join(done, "key", "left_semi"), number(slots), least_score))
        open_ = slots.join(good.select("key", "score", "rank"), "key").filter("v <> ''").join(edges.select(F.col("value").alias("v")).distinct(), "v", "left_anti")
        open_ = open_.groupBy("doc_id", "content", "i", "v").agg(F.max(F.struct("score", "rank")).alias("best"))
        gains = open_.groupBy("v").agg(F.avg("best.score").alias("trust"), F.count(F.lit(1)).alias("inside"), F.max_by("best.rank", "best").alias("rank"))
        gains = cut_small(gains)
        fair = lambda g, there: g.join(there.groupBy("v").agg(F.count(F.lit(1)).alias("all")), "v", "left").filter(F.col("inside") >= least_share * F.coalesce("all", F.lit(0))).drop("all")
        if gains.isEmpty():
            break
        gains = cut_small(fair(gains, _slots(some, "v", gains.select("v")).select("v")))
        if gains.isEmpty():
            break
        there = cut(_slots(rows, "v", gains.select("v")))
        trusted = cut_small(fair(gains, there).drop("inside"))
        # one that stands in base spans is part of a seed
        spots = _placed(rows, narrow, there.join(trusted, "v", "left_semi")).join(trusted, "v")
        spots = cut(spots.select("doc_id", "content", "i", "v", "start", "end", "rank", "trust"))
        if spots.isEmpty():
            break
        found = spots if found is None else found.unionByName(spots)
        seeds = there.alias("a").join(spots.alias("b"), _same_doc("a", "b") & (F.col("a.i") == F.col("b.i"))).select("a.l2", "a.l1", "a.r1", F.col("a.v").alias("value"), "b.rank", "b.trust", F.lit(False).alias("wide"))
        edges = cut_small(edges.unionByName(_edges(seeds)))
    return found


def find_personal_data(docs: DataFrame, least_score: float = 0.5, least_seeds: int = 5, least_share: float = 0.2, rounds: int | None = None) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_spans (their number).

    Spans are kind:start:end in code points, by start, then kind. Null text is empty and has none;
    equal rows are searched alike; a null doc_id is returned as it is; an empty table gives an empty
    result; other columns, of any name, don't matter. An added span never touches a base one and bears
    the kind of most of its pattern's seeds. Without ``rounds`` the search goes on until no pattern is added.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text", text)
    rows = rows.withColumn("content", F.xxhash64("text"))
    none = F.array().cast(_BASE)
    base = F.concat(*[F.coalesce(_base(F.col("text"), r), none) for r in range(len(KINDS))])
    narrow = cut(rows.select("doc_id", "content", base.alias("base")))
    found = discover(rows, narrow, least_score, least_seeds, least_share, rounds)
    plain = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    if found is None:
        out, every = narrow, plain
    else:
        added = found.groupBy("doc_id", "content").agg(F.collect_set(F.struct("start", "rank", "end")).alias("added"))
        out = narrow.alias("a").join(added.alias("b"), _same_doc("a", "b"), "left").select("a.doc_id", "base", "added")
        every = F.array_sort(F.concat(plain, F.coalesce("added", F.array().cast(_SPAN))))
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return out.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)], F.sha2(_names(plain), 256).alias("base_sha256"), _names(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def base_forms(found: DataFrame) -> DataFrame:
    """What the fixed forms tell, without what patterns add."""
    return found.drop("spans", "n_spans")


_SQL_FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_SQL_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0",
    "card": """len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INT)
      WHEN CAST(d[len(d) - i] AS INT) > 4 THEN 2 * CAST(d[len(d) - i] AS INT) - 9 ELSE 2 * CAST(d[len(d) - i] AS INT) END)) % 10 = 0""",
    "phone": "len(d) BETWEEN 10 AND 15",
}
_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, {r} AS r, '{k}' AS kind, s, s + len(m) AS e FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
      sum(len(g) + coalesce(len(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) - len(m) AS s FROM (SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g, unnest(list_append(m, NULL)) AS m
      FROM (SELECT doc_id, string_split_regex(t, '{f}') AS g, regexp_extract_all(t, '{f}') AS m FROM d))) WHERE m IS NOT NULL AND {_SQL_VALID[k]}"""
    for r, (k, f) in enumerate(_SQL_FORMS.items())
)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({_PARTS}),
y AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE r = {r}) AS n_{k}" for r, k in enumerate(KINDS))}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r, e) AS names FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(names, '')) AS base_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""
