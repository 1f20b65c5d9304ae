"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over lower-case trigrams
is derived: an OR of ANDs that every text with a match satisfies. The index
holds a posting (trigram, doc_id) for each trigram that some query names.
Postings are intersected per AND, united per OR, and give each document the
rules for which it is a candidate; only these run on its text. A rule without
a mandatory trigram (runs of hexadecimal digits) scans every text.

A match's place is the summed length, in code points, of what stands before
it: the pieces between matches (split) and the matches (regexp_extract_all)
alternate. Null texts are empty; documents whose doc_id is null are candidates
for every rule; repeated rows give repeated results; an empty table none.
Other columns may be present under any name.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.extras import extras_aside
from kgspark.session import written


class Rule(NamedTuple):
    """kind; pattern, valid in Java and RE2; the group whose length counts (0: the match), and the least length."""

    kind: str
    pattern: str
    group: int
    least: int


KEYWORDS = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ with 16 characters or more
)
#: Published token formats, found beside the base kinds.
EXTRA = (
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + EXTRA
#: A class of more characters than this counts as any character.
CLASS_LIMIT = 8
#: Strings followed at once; beyond it, the trigrams so far are all that is asked.
STRINGS_LIMIT = 64
#: Candidates up to this number are broadcast (some 30 MB).
BROADCAST_ROWS = 500_000


def _strings(parsed) -> list[set[str]]:
    """Runs of the sequence, each as the set of lower-case strings it can be; gaps part the runs."""
    runs, now = [], {""}

    def close():
        nonlocal now
        if now != {""}:
            runs.append(now)
        now = {""}

    def extend(options: set[str]):
        nonlocal now
        if len(now) * len(options) > STRINGS_LIMIT:
            close()
        now = {a + b for a in now for b in options}

    for op, arg in parsed:
        if op is sre.LITERAL:
            extend({chr(arg).lower()})
        elif op is sre.IN:
            chars = set()
            for kind, value in arg:
                chars |= {chr(value).lower()} if kind is sre.LITERAL else {chr(c).lower() for c in range(value[0], min(value[1] + 1, value[0] + 99))} if kind is sre.RANGE else set(map(str, range(99)))
            extend(chars) if len(chars) <= CLASS_LIMIT else close()
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            branches = arg[1] if op is sre.BRANCH else [arg[3]]
            inner = [_strings(b) for b in branches]
            options = set().union(*(r[0] if len(r) == 1 else {""} for r in inner))
            # A branch that is one run of strings can be followed through; anything else parts the runs.
            whole = all(len(r) == 1 and _exact(b) for r, b in zip(inner, branches, strict=True))
            if whole:
                extend(options)
            else:
                close()
                runs += inner[0] if len(inner) == 1 else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, item = arg
            inner = _strings(item)
            if low == 0 and high == 1 and len(inner) == 1 and _exact(item):
                extend(inner[0] | {""})
            elif low == high == 1:
                extend(inner[0]) if len(inner) == 1 and _exact(item) else close()
            elif low >= 1 and len(inner) == 1 and _exact(item):
                for _ in range(min(low, 8)):
                    extend(inner[0])
                close()
            else:
                close()
        elif op is not sre.AT:
            close()
    close()
    return runs


def _exact(parsed) -> bool:
    """Whether the parsed sequence is literals, small classes and alternatives of these alone."""
    for op, arg in parsed:
        if op is sre.SUBPATTERN:
            if not _exact(arg[3]):
                return False
        elif op is sre.BRANCH:
            if not all(map(_exact, arg[1])):
                return False
        elif op is sre.IN:
            if len(arg) > CLASS_LIMIT or any(k is not sre.LITERAL for k, _ in arg):
                return False
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            if arg[1] != 1 or not _exact(arg[2]):
                return False
        elif op is not sre.LITERAL:
            return False
    return True


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams that a lower-case text with a match satisfies; None if none is mandatory.

    Of the runs of strings that every match holds in order, the one with the
    longest least string is asked for: one AND per string it can be.
    """
    runs = [r for r in _strings(sre_parser.parse(pattern)) if min(map(len, r)) >= 3]
    if not runs:
        return None
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
    # Every third trigram and the last: they cover the string, and fewer postings are made.
    terms = {frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), len(s) - 3}) for s in best}
    return sorted((t for t in terms if not any(o < t for o in terms)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the trigrams named: distinct (trigram, doc_id), doc_id not null."""
    low = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose query the document's postings satisfy."""
    spark = index.sparkSession
    asked = [(kind, n, t, len(terms)) for kind, query in queries.items() for n, terms in enumerate(query) for t in sorted(terms)]
    if not asked:
        return index.select("doc_id", F.array().cast("array<string>").alias("kinds")).where("false")
    terms = F.broadcast(spark.createDataFrame(asked, "kind string, n int, trigram string, need int"))  # as many rows as the rules have trigrams
    met = index.join(terms, "trigram").groupBy("doc_id", "kind", "n").agg(F.count("*").alias("have"), F.first("need").alias("need"))
    return met.where("have = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, stop>> of the rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    each = F.transform(F.arrays_zip(found.alias("m"), sized.alias("s"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["s"]).alias("sized")))
    none = _no_spans()
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.cast("long").alias("start"), end.cast("long").alias("stop"))
        return F.struct(end.cast("long").alias("at"), F.when(x["sized"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(each, start, step, lambda state: state["out"])
    return F.when(F.regexp_like(text, pattern), spans).otherwise(none)


def _ranked(nth: int):
    """A span with its rule's place; a higher-order function would hand a second parameter the index."""
    return lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["kind"].alias("kind"), s["stop"].alias("stop"))


def scan(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """docs, with null texts empty, and `_spans`: array<struct<start, nth, kind, stop>> by start, then order of the rules."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    index = postings(docs, sorted({t for q in queries.values() for terms in q for t in terms}))
    hits = written(candidates(index, queries).withColumnsRenamed({"doc_id": "_hit_id", "kinds": "_kinds"}), "secret-candidates")
    # Few candidates go to the texts; many meet them in a shuffle.
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    joined = docs.join(hits, F.col("doc_id") == F.col("_hit_id"), "left")
    none = _no_spans()
    found = []
    for nth, rule in enumerate(rules):
        hit = F.lit(True) if rule.kind not in queries else F.coalesce(F.array_contains("_kinds", rule.kind), F.col("doc_id").isNull())
        spans = F.when(hit, _matches(F.col("text"), rule)).otherwise(none)
        found.append(F.transform(spans, _ranked(nth)))
    return joined.withColumn("_spans", F.array_sort(F.concat(*found))).drop("_hit_id", "_kinds")


def digest(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans as kind:start:end."""
    base = [r.kind for r in BASE]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    rows = scan(docs.select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, base), F.sha2(line(F.filter("_spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("_spans")).alias("spans"))


@extras_aside("doc_id", "text", "n_chars")
def redacted(docs: DataFrame, rules: tuple = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret, overlapping ones as one, replaced by `mark`; n_chars, if there, follows the text."""
    rows = scan(docs, rules)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(s: Column, x: Column) -> Column:
        before = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        new = F.concat(s["out"], before, F.lit(mark))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("_spans", state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    rows = rows.withColumn("text", F.when(F.size("_spans") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def _duck_pattern(rule: Rule) -> str:
    return rule.pattern.replace("'", "''")


def oracle() -> str:
    """DuckDB SQL for digest(documents)."""
    parts = []
    for nth, rule in enumerate(RULES):
        p = _duck_pattern(rule)
        parts.append(f"""SELECT doc_id, {nth} AS nth, '{rule.kind}' AS kind, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS s, string_split_regex(t, '{p}') AS g, {rule.least} AS least FROM d WHERE regexp_matches(t, '{p}')""")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({' UNION ALL '.join(parts)}),
        e AS (SELECT doc_id, nth, kind, m, s, g, least, unnest(range(1, len(m) + 1)) AS i FROM f),
        p AS (SELECT doc_id, nth, kind, length(m[i]) AS n, length(s[i]) AS sized, least,
                     list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start FROM e),
        k AS (SELECT doc_id, nth, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS line FROM p WHERE sized >= least),
        a AS (SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
                     string_agg(line, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(line, ',' ORDER BY start, nth) AS spans FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)"""
