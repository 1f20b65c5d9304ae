"""Entity linking: staged matching cascades where the first stage with a hit wins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators.graph import vocabulary
from kgspark.operators.scoring import half_up
from kgspark.session import written

# Terms that weighted() broadcasts; weights of a block of most_similar(), and scores that are held at a time.
HELD, BLOCK, CHUNK = 2**17, 2**19, 2**18

# The order in which a drug's name categories are tried.
NAME_PRIORITY = ["primary", "synonym", "brand", "product", "mixture", "external", "chemical"]
# Words that two arm titles may differ in.
FILLER_WORDS = [
    "(", ".", ")", ":", "+", "/", "cohort", "arm", "group", "phase", "currently", "subjects", "prescriptions", "study", "base", "treatment", "", "mg",
    ",", "-", "then", "dose", "control", "period", "g", "part", "double-blind", "alone", "total", "to", "active", "first", "oral", "only",
    "participants", "follow-up", "open-label", "gel", "patients", "experiments", "kg", "day", "%", "randomized", "intervention", "pill", "followed",
    "by", "mcg", "drug", "of", "er",
]


def first_match(keys: DataFrame, key: str, stages: list[tuple[str, Column]], names: DataFrame, name: str = "name", id: str = "id") -> DataFrame:
    """keys with stage (0-based) and id of the first stage whose candidate is among names; null if none is.

    One join on the exploded candidates, whatever the number of stages. A name
    with several ids gives the least one.
    """
    candidates = F.array(*[F.struct(F.lit(k).alias("stage"), c.alias("candidate")) for k, (_, c) in enumerate(stages)])
    tried = keys.select(key).distinct().select(key, F.explode(candidates).alias("t")).select(key, "t.stage", "t.candidate").where("candidate is not null")
    hits = tried.join(names.select(F.col(name).alias("candidate"), F.col(id).alias("_id")), "candidate")
    best = hits.groupBy(key).agg(F.min(F.struct("stage", "_id")).alias("b")).select(F.col(key).alias("_key"), F.col("b.stage").alias("stage"), F.col("b._id").alias(id))
    return keys.join(best, F.col(key) == F.col("_key"), "left").drop("_key")


def by_priority(names: DataFrame, wanted: DataFrame, priority: list[str] = NAME_PRIORITY) -> DataFrame:
    """(name, category, ids): of the names wanted(name), the ids of the first category that has the name in names(name, category, id)."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("category"))
    hits = names.join(wanted.select("name").distinct(), "name", "left_semi").withColumn("_rank", rank).where("_rank > 0")
    per = hits.groupBy("name", "category", "_rank").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return per.withColumn("_turn", F.row_number().over(W.partitionBy("name").orderBy("_rank"))).where("_turn = 1").select("name", "category", "ids")


def inverse_names(items: DataFrame, id: str, synonyms: str, least: int = 4) -> DataFrame:
    """(name, ids) of all synonyms in lower case with at least `least` characters."""
    names = items.select(F.col(id).alias("id"), F.explode(synonyms).alias("s")).select("id", F.lower(F.trim("s")).alias("name"))
    return names.where(F.length("name") >= least).groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def condition_stages(c: str | Column) -> list[tuple[str, Column]]:
    """A condition's candidates: as it is, cancer as neoplasm, without "Advanced", by the special map; all lower-cased."""
    c = F.col(c) if isinstance(c, str) else c
    neoplasm = F.replace(c, F.lit("Cancer"), F.lit("Neoplasm"))
    plain = F.regexp_replace(T.squeeze(F.replace(neoplasm, F.lit("Advanced"), F.lit(""))), "[,.]$", "")
    key = lambda x: F.lower(F.trim(x))
    return [
        ("exact", key(c)),
        ("neoplasm", F.when(c.contains("Cancer"), key(neoplasm))),
        ("advanced", F.when(neoplasm.contains("Neoplasm") & neoplasm.contains("Advanced"), key(plain))),
        ("special", key(T.rewritten(c, T.SPECIAL_CONDITIONS))),
    ]


def link_conditions(trials: DataFrame, names: DataFrame) -> DataFrame:
    """(trial, ids, complete) from trials(trial, conditions, mesh_terms): all conditions' ids, HEALTHY by pattern.

    A trial with a condition that no stage finds retries with its mesh terms,
    whose misses are ignored.
    """
    look = names.select(F.lower(F.trim("name")).alias("name"), "id")
    each = lambda c: trials.select("trial", F.explode(c).alias("condition"))
    found = first_match(each("conditions"), "condition", condition_stages("condition"), look)
    found = found.withColumn("id", F.coalesce("id", F.when(T.is_healthy(F.col("condition")), F.lit("HEALTHY"))))
    direct = found.groupBy("trial").agg(F.array_sort(F.collect_set("id")).alias("direct"), F.bool_and(F.col("id").isNotNull()).alias("complete"))
    again = first_match(each("mesh_terms"), "condition", condition_stages("condition"), look)
    retried = again.groupBy("trial").agg(F.array_sort(F.collect_set("id")).alias("retried"))
    out = trials.select("trial").join(direct, "trial", "left").join(retried, "trial", "left")
    none = F.array().cast("array<string>")
    ids = F.when(F.col("complete"), F.col("direct")).otherwise(F.coalesce("retried", none))
    return out.select("trial", ids.alias("ids"), F.coalesce("complete", F.lit(False)).alias("complete"))


def consistent_code(mentions: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code): the one code that all of a key's non-empty mentions agree on."""
    codes = mentions.where(F.col(code) != "").groupBy(key).agg(F.min(code).alias("low"), F.max(code).alias("high"))
    return codes.where("low = high").select(key, F.col("low").alias(code))


def flatten_criteria(records: DataFrame) -> DataFrame:
    """One row per criterion term of records(trial, inclusion, exclusion), each a list of sentences with terms and relations.

    Temporal, Value and Negation_cue terms are no criteria; relations hang the
    temporal and value terms' texts on their first term. A negated term counts
    on the other side.
    """
    sides = F.array(F.struct(F.lit(True).alias("inclusion"), F.col("inclusion").alias("sents")), F.struct(F.lit(False).alias("inclusion"), F.col("exclusion").alias("sents")))
    sent = records.select("trial", F.explode(sides).alias("side")).select("trial", "side.inclusion", F.posexplode("side.sents").alias("sent", "s"))
    terms = sent.select("trial", "inclusion", "sent", F.explode("s.terms").alias("t")).select("trial", "inclusion", "sent", "t.*")
    relations = sent.select("trial", "inclusion", "sent", F.explode("s.relations").alias("r")).select("trial", "inclusion", "sent", F.col("r.first").alias("term_id"), F.col("r.third").alias("other"))
    at = ["trial", "inclusion", "sent"]
    others = terms.where(F.col("category").isin("Temporal", "Value")).select(*at, F.col("term_id").alias("other"), F.col("category").alias("kind"), F.col("text").alias("said"))
    hung = relations.join(others, [*at, "other"]).groupBy(*at, "term_id")
    texts = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("said"))))
    hung = hung.agg(texts("Temporal").alias("temporal"), texts("Value").alias("value"))
    kept = terms.where(~F.col("category").isin("Temporal", "Value", "Negation_cue")).join(hung, [*at, "term_id"], "left")
    none = F.array().cast("array<string>")
    side = F.col("inclusion") != F.coalesce("neg", F.lit(False))
    return kept.select("trial", side.alias("inclusion"), "category", F.col("text").alias("orig_term"), F.explode(T.split_alternatives(T.criterion_term(F.col("text")))).alias("term"), F.coalesce("neg", F.lit(False)).alias("negated"), F.coalesce("temporal", none).alias("temporal"), F.coalesce("value", none).alias("value"))


def concept_stages(term: str = "term", rest: str | None = None) -> list[tuple[str, Column]]:
    """A criterion term's candidates; rest: the column of tagging.qualified(), where there is one."""
    relaxed = T.term_relaxations(F.col(term), None if rest is None else F.col(rest))
    return [(name, F.lower(F.trim(F.get(relaxed, F.lit(k))))) for k, name in enumerate(("exact", "no grade", "no non-", "no first word"))]


def back_filled(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """rows(orig_term, term, cui) with cui filled from concepts(term, cui), by the original term and then the term."""
    a = concepts.select(F.col("term").alias("_a"), F.col("cui").alias("_by_orig"))
    b = concepts.select(F.col("term").alias("_b"), F.col("cui").alias("_by_term"))
    joined = rows.join(a, F.col("orig_term") == F.col("_a"), "left").join(b, F.col("term") == F.col("_b"), "left")
    return joined.withColumn("cui", F.coalesce("cui", "_by_orig", "_by_term")).select(*rows.columns)


def _counted(rows: DataFrame, id: str, words: str) -> DataFrame:
    """(id, term, tf): each row's words are sorted and counted where they are; only rows that share their id meet elsewhere."""
    again = written(rows.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(id), "repeated-ids")
    runs = rows.withColumn("_s", F.sort_array(words))
    at = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2)))
    runs = runs.where(F.size("_s") > 0).select(id, "_s", at.alias("_at"))
    each = F.transform("_at", lambda a, k: F.struct(F.get("_s", a - 1).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s") + 1) - a).cast("long").alias("tf")))
    counts = lambda df: df.select(id, F.explode(each).alias("_c")).select(id, "_c.term", "_c.tf")
    merged = counts(runs.join(again, id, "left_semi")).groupBy(id, "term").agg(F.sum("tf").alias("tf"))
    return counts(runs.join(again, id, "left_anti")).unionByName(merged)


def tf_idf_parts(rows: DataFrame, id: str, words: str, max_df: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw(id, term, w), lengths(id, len), idf(term, idf)): tf_idf()'s weights before they are divided by their lengths."""
    n = rows.count()
    counts = written(_counted(rows, id, words), "tf-counts")
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df * n).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = written(idf, "tf-idf")
    return (*_raw(counts, idf, id), idf)


def tf_idf(rows: DataFrame, id: str, words: str, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(weights(id, term, w), idf(term, idf)): smoothed idf = ln((1 + n) / (1 + df)) + 1, unit length; terms in more than max_df of rows left out."""
    raw, lengths, idf = tf_idf_parts(rows, id, words, max_df)
    return raw.join(lengths, id).select(id, "term", (F.col("w") / F.col("len")).alias("w")), idf


def _raw(counts: DataFrame, idf: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """(id, term, w) of tf * idf, and (id, len).

    The HELD most frequent terms are broadcast, so the rows that have them stay
    where they are; only those of the rest are dealt out by term.
    """
    often = F.broadcast(idf.orderBy("idf", "term").limit(HELD))  # HELD rows at most
    raw = counts.join(often, "term").unionByName(counts.join(often, "term", "left_anti").join(idf, "term"))
    raw = raw.select(id, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return raw, raw.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))


def weighted(counts: DataFrame, idf: DataFrame, id: str) -> DataFrame:
    """(id, term, w): tf * idf at unit length per id, from counts(id, term, tf)."""
    raw, lengths = _raw(counts, idf, id)
    return raw.join(lengths, id).select(id, "term", (F.col("w") / F.col("len")).alias("w"))


def most_similar(queries: DataFrame, rows: DataFrame, query: str, id: str, least: float = 0.8, digits: int = 6, lengths: DataFrame | None = None) -> DataFrame:
    """(query, id, score): each query's most similar row by cosine of unit weights, if at least `least`; ties to the least id.

    With lengths(id, len) the rows' weights are yet to be divided by these. Rows' terms that no query has are left out, the others numbered. Blocks of
    BLOCK weights meet each other, sparse products are summed for CHUNK scores
    at a time, and of each pair of blocks a query's best row is left.
    """
    asked = written(queries.select(F.col(query).alias("q"), "term", F.col("w").alias("x")).where("q is not null"), "asked-terms")
    terms = written(vocabulary(asked, "term").select(F.col("value").alias("term"), F.col("id").alias("t")), "asked-numbers")
    held = written(rows.join(terms.select("term"), "term", "left_semi").join(terms, "term").select(F.col(id).alias("i"), "t", F.col("w").alias("y")).where("i is not null"), "met-terms")
    size = held.count()
    if lengths is not None:  # under a term that no query has
        held = held.unionByName(lengths.where(F.col(id).isNotNull()).select(F.col(id).alias("i"), F.lit(-1).cast("long").alias("t"), F.col("len").alias("y")))
    sides, most = [asked.join(terms, "term").select("q", "t", "x"), held], [max(1, -(-n // BLOCK)) for n in (asked.count(), size)]
    most[1] = max(most[1], min(-(-size // 2**14), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = [df.withColumn(f"b{n}", F.pmod(F.xxhash64("qi"[n]), F.lit(most[n]))).withColumn(f"b{1 - n}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most[1 - n] - 1).cast("long")))).groupBy("b0", "b1") for n, df in enumerate(sides)]

    def solve(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": q["q"][:0], "i": r["i"][:0], "score": np.zeros(0)})]
        if len(q) and len(r):
            out += _best_scores(q, r, least, digits)
        return pd.concat(out, ignore_index=True)

    kinds = [df.schema[c].dataType.simpleString() for df, c in zip(sides, "qi", strict=True)]
    best = W.partitionBy("q").orderBy(F.desc("score"), "i")
    scores = dealt[0].cogroup(dealt[1]).applyInPandas(solve, f"q {kinds[0]}, i {kinds[1]}, score double")
    return scores.withColumn("_turn", F.row_number().over(best)).where("_turn = 1").select(F.col("q").alias(query), F.col("i").alias(id), "score")


def _best_scores(q: pd.DataFrame, r: pd.DataFrame, least: float, digits: int):
    """Pieces (q, i, score): of a run of rows r(i, t, y), each query's best by the sum of x * y over shared terms t."""
    names, who = np.unique(q["q"].to_numpy(), return_inverse=True)
    by_term = np.argsort(q["t"].to_numpy(), kind="stable")
    t, x, who = q["t"].to_numpy()[by_term], q["x"].to_numpy()[by_term], who[by_term]
    r = r.sort_values("i", kind="stable")
    ids, row = np.unique(r["i"].to_numpy(), return_inverse=True)
    own = r["t"].to_numpy() < 0
    length = np.ones(len(ids))
    length[row[own]] = r["y"].to_numpy()[own]
    first, n = np.searchsorted(t, r["t"].to_numpy(), "left"), np.searchsorted(t, r["t"].to_numpy(), "right")
    n, y, step = n - first, r["y"].to_numpy(), max(1, CHUNK // len(names))
    for low in range(0, len(ids), step):
        part = slice(np.searchsorted(row, low, "left"), np.searchsorted(row, low + step, "left"))
        times, high = n[part], min(step, len(ids) - low)
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[part], times)  # places of the queries' weights that a row's weight meets
        place = np.repeat(row[part] - low, times) * len(names) + who[each]
        s = np.bincount(place, np.repeat(y[part], times) * x[each], high * len(names)).reshape(high, -1) / length[low : low + high, None]
        i, j = np.nonzero(s >= np.maximum(s.max(0) - 1.001 / 10.0**digits, least - 0.501 / 10.0**digits)[None, :])
        score = half_up(s[i, j], digits)
        order = np.lexsort((i, -score, j))
        order = order[score[order] >= least]
        i, j, score = i[order], j[order], score[order]
        top = np.flatnonzero(np.diff(j, prepend=-1))
        yield pd.DataFrame({"q": names[j[top]], "i": ids[low + i[top]], "score": score[top]})


def phrases(docs: DataFrame, id: str, words: str, min_count: int = 5, threshold: float = 5.0) -> DataFrame:
    """(a, b, score) of collocations: (count(ab) - min_count) / count(a) / count(b) * vocabulary size, above the threshold."""
    at = docs.select(id, F.posexplode(words).alias("pos", "a"))
    pairs = docs.select(F.explode(F.arrays_zip(F.slice(F.col(words), 1, F.size(words) - 1).alias("a"), F.slice(F.col(words), 2, F.size(words)).alias("b"))).alias("x")).select("x.a", "x.b").where("b is not null")
    unigrams = at.groupBy("a").agg(F.count("*").alias("n"))
    bigrams = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    size = unigrams.agg((F.count("*")).alias("v"))
    counted = bigrams.join(unigrams.withColumnRenamed("n", "n_a"), "a").join(unigrams.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    scored = counted.crossJoin(F.broadcast(size)).withColumn("score", (F.col("n_ab") - min_count) / F.col("n_a") / F.col("n_b") * F.col("v"))  # one row
    return scored.where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def uncontained(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows without the names that another name of the same key contains."""
    other = rows.select(F.col(key).alias("_key"), F.col(name).alias("_other")).distinct()
    inside = (F.col(key) == F.col("_key")) & (F.col(name) != F.col("_other")) & F.col("_other").contains(F.col(name))
    return rows.join(other, inside, "left_anti")


def term_map(criteria: DataFrame, names: DataFrame) -> DataFrame:
    """(term, cui) of criteria(seq, term, orig_term, cui, parents): terms as written and cleaned, and the names of concepts and their parents.

    names(cui, name). Of a term met with several concepts the last one counts,
    and an unresolved one counts as null.
    """
    term = criteria.select("seq", F.lit(1).alias("k"), "term", "cui")
    orig = criteria.select("seq", F.lit(2).alias("k"), T.ascii_only(F.col("orig_term")).alias("term"), "cui")
    of = names.select(F.col("cui").alias("_c"), F.col("name").alias("term"))
    own = criteria.join(of, F.col("cui") == F.col("_c")).select("seq", F.lit(0).alias("k"), of["term"].alias("term"), "cui")
    up = criteria.where("cui is not null").select("seq", F.lit(3).alias("k"), F.explode("parents").alias("cui"))
    up = up.join(of, F.col("cui") == F.col("_c")).select("seq", "k", "term", "cui")
    every = term.unionByName(orig).unionByName(own).unionByName(up)
    return every.groupBy("term").agg(F.max_by("cui", F.struct("seq", "k")).alias("cui"))


def matched_share(interventions: DataFrame, names: DataFrame) -> DataFrame:
    """(trial, matched, ambiguous, total, percentage) of drug interventions(trial, key, name, others): each by its first name with an id.

    names(name, id, category). A name that isn't known is tried by its components. One id is
    unambiguous, or one of the first category that has any. Each different name is
    taken apart and looked up once; rows of one trial and key are one intervention.
    """
    base = interventions.select("trial", "key", F.posexplode(F.concat(F.array(F.lower("name")), F.coalesce("others", F.array().cast("array<string>")))).alias("at", "name"))
    each = written(base.select("name").distinct(), "different-names")
    tried = written(each.select("name", F.posexplode(F.concat(F.array("name"), T.normalise_drug_name(F.col("name")))).alias("part", "tried")), "tried-names")
    priority = F.array(*map(F.lit, ["primary", "synonyms", "international_brand_names", "external-identifiers", "product_names", "mixture_names"]))
    wanted = names.join(tried.select(F.col("tried").alias("name")).distinct(), "name", "left_semi").withColumn("_rank", F.array_position(priority, F.col("category"))).where("_rank > 0")
    ids = wanted.groupBy("name", "_rank").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("twice"))
    known = ids.groupBy("name").agg(F.min(F.struct("_rank", "id", "twice")).alias("k")).select(F.col("name").alias("tried"), "k.id", "k.twice")
    of = tried.join(known, "tried").groupBy("name").agg(F.min(F.struct("part", "id", "twice")).alias("b"))
    best = base.join(of, "name", "left").groupBy("trial", "key").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("at", "b.part", "b.id", "b.twice"))).alias("b"))
    out = best.groupBy("trial").agg(F.count("b.id").alias("matched"), F.count_if(F.col("b.twice")).alias("ambiguous"), F.count("*").alias("total"))
    return out.withColumn("percentage", 100.0 * F.col("matched") / F.col("total"))


def join_phrases(docs: DataFrame, id: str, words: str, pairs: DataFrame, by: str = "_") -> DataFrame:
    """docs' (id, words) with each pair (a, b) of neighbours joined, from left to right, a word in one pair at most.

    In a run of neighbouring matches every second one is taken. Applied twice,
    with the pairs found in between, it makes phrases of three and four words.
    """
    at = docs.select(id, F.posexplode(words).alias("pos", "a"))
    order = W.partitionBy(id).orderBy("pos")
    marked = at.withColumn("b", F.lead("a").over(order)).join(pairs.select("a", "b").distinct().withColumn("_hit", F.lit(True)), ["a", "b"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(id, "_run", "_hit").orderBy("pos"))
    taken = runs.withColumn("_take", F.col("_hit") & (nth % 2 == 1))
    kept = taken.withColumn("_gone", F.coalesce(F.lag("_take").over(order), F.lit(False))).where("not _gone")
    one = F.struct("pos", F.when(F.col("_take"), F.concat_ws(by, "a", "b")).otherwise(F.col("a")).alias("w"))
    out = kept.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]).alias(words))  # one document's words
    return docs.select(id).join(out, id, "left").select(id, F.coalesce(words, F.array().cast("array<string>")).alias(words))


def stemmed(rows: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """rows with the Porter stem of a word, the parts around _ each by itself; each distinct word is stemmed once."""
    from kgspark.functions.stemmer import stem_column

    stems = rows.select(F.col(word).alias("_word")).where("_word is not null").distinct().withColumn(out, stem_column(F.col("_word")))
    return rows.join(stems, F.col(word) == F.col("_word"), "left").drop("_word")
