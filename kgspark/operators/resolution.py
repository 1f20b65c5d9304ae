"""Names to ids by a work-list of goals, and interventions to their drugs.

A goal is a name with a code, or without one (an empty code). What it can't
give by itself it asks of other goals: the parts of its code's preferred name, its
name with spaces for hyphens, the two halves of its name. All goals of all rows
are found first, round by round: a round's frontier holds the goals that no
earlier round met, so a name is worked on once, however many rows ask for it.
Then they are closed from the bottom up, until nothing is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators.linking import by_priority
from kgspark.session import written

PLACEBO = "PLACEBO"
# Mentioned names that are no drugs.
STOP_NAMES = [
    "co", "at 10", "at 20", "cr", "placebo", "hypertonic saline", "saline", "normal saline", "eye drops", "eye drop", "nasal spray",
    "corticosteroid", "corticosteroids", "adjuvant", "sodium", "steroid", "steroids", "agonist", "vaccine", "pharmaceuticals",
    "local anesthetic", "local anesthesia", "mesylate", "long acting", "prophylactic",
]
#: A goal's tiers in order of trial.
SINGLE, EXTERNAL, VOCABULARY, PREFERRED, PRECOMPUTED, SEVERAL, WEB, SPACED, HALVES = 1, 2, 3, 4, 5, 6, 9, 7, 8
# Fixed value: names that are looked up in the web's map, such as ab-123.
WEB_NAMES = r"^[a-z]{2,3}-[0-9]+$"
_NONE = "array<string>"


def _clean(name: Column) -> Column:
    return T.rewritten(T.strip_code(name), T.NAME_REWRITES)


def _asked(goals: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, code, kind, child, child_code): the goals that goals(name, code) ask for; kind p, s, a or b."""
    preferred = goals.where("code <> ''").join(parts, "code").select("name", "code", F.lit("p").alias("kind"), F.col("part").alias("child"), F.lit("").alias("child_code"))
    hyphens = goals.where(F.col("name").contains("-"))
    spaced = hyphens.select("name", "code", F.lit("s").alias("kind"), F.replace("name", F.lit("-"), F.lit(" ")).alias("child"), F.col("code").alias("child_code"))
    split = F.split("name", "-")
    two = hyphens.where((F.size(split) == 2) & (F.length(split[0]) > 3) & (F.length(split[1]) > 3))
    half = lambda kind, k: two.select("name", "code", F.lit(kind).alias("kind"), split[k].alias("child"), F.lit("").alias("child_code"))
    every = preferred.unionByName(spaced).unionByName(half("a", 0)).unionByName(half("b", 1))
    return every.withColumn("child", _clean(F.col("child"))).distinct()


def expanded(goals: DataFrame, preferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(goals(name, code, round), asked(name, code, kind, child, child_code)): all goals that these ask for, each in the round that met it first."""
    parts = written(preferred.where("code <> ''").select("code", F.explode(T.alias_parts(F.lower("preferred"))).alias("part")).distinct(), "resolution-parts")
    seen = written(goals.select("name", "code").distinct().withColumn("round", F.lit(0)), "resolution-goals")
    frontier, every, round_ = seen, None, 0
    while True:
        round_ += 1
        asked = written(_asked(frontier.select("name", "code"), parts), "resolution-asked")
        every = asked if every is None else every.unionByName(asked)
        new = asked.select(F.col("child").alias("name"), F.col("child_code").alias("code")).distinct().join(seen, ["name", "code"], "left_anti")
        frontier = written(new.withColumn("round", F.lit(round_)), "resolution-goals")
        if frontier.isEmpty():
            return seen, every
        seen = seen.unionByName(frontier)


def resolve(rows: DataFrame, names: DataFrame, codes: DataFrame, preferred: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """(key, tier, ids, name, round) for rows(key, name, code): what the first tier that resolves gives; null tier and ids if none does.

    1 the name, if it has exactly one id; 2 the code among external ids, 3 in
    the vocabulary's map (codes: code, map, id with map external, vocabulary or
    precomputed); 4 all ids of the parts of the code's preferred name; 5 the
    precomputed map; 6 the name with several ids; 9 the web's map web(name, id),
    of names such as ab-123; 7 the name with spaces for hyphens; 8 both halves
    of a two-part name, each longer than 3, asked without the code. name is
    the one that was looked up, after dosage marks were cut and rewritten names
    replaced; round counts how far below a row's own name the ids were found.
    Names are looked up in names(name, category, id) by the first category that has
    them. A null code is an empty one; a null name resolves by its code alone.
    """
    asked_for = rows.select("key", _clean(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("code", F.lit("")).alias("code"))
    goals, asked = expanded(asked_for, preferred)
    listed = lambda df, *keys: df.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("_ids"))  # noqa: E731  a name's or code's ids
    state = goals.join(by_priority(names, goals).select("name", F.col("ids").alias("own")), "name", "left")
    for kind in ("external", "vocabulary", "precomputed"):
        found = listed(codes.where((F.col("map") == kind) & (F.col("code") != "")), "code").withColumnRenamed("_ids", kind)
        state = state.join(found, "code", "left")
    if web is not None:
        state = state.join(listed(web, F.col("name")).withColumnRenamed("_ids", "_web"), "name", "left")
    hit = lambda c: F.size(F.coalesce(c, F.array().cast(_NONE))) > 0
    at_once = F.when(F.size("own") == 1, F.struct(F.lit(SINGLE).alias("tier"), F.col("own").alias("ids"), F.lit(0).alias("below")))
    for kind, tier in (("external", EXTERNAL), ("vocabulary", VOCABULARY)):
        at_once = at_once.when(hit(F.col(kind)), F.struct(F.lit(tier).alias("tier"), F.col(kind).alias("ids"), F.lit(0).alias("below")))
    web_ids = F.when(F.col("name").rlike(WEB_NAMES), F.col("_web")) if web is not None else F.lit(None).cast(_NONE)
    state = written(state.select("name", "code", "own", "precomputed", web_ids.alias("web"), at_once.alias("found")), "resolution-state")
    closed = state.where("found is not null").select("name", "code", "found")
    open_ = state.where("found is null").drop("found")
    while True:
        child = closed.select(F.col("name").alias("child"), F.col("code").alias("child_code"), F.col("found").alias("got"), F.lit(True).alias("done"))
        told = open_.select("name", "code").join(asked, ["name", "code"]).join(child, ["child", "child_code"], "left")
        of = lambda kind: F.when(F.col("kind") == kind, F.col("got"))
        told = told.groupBy("name", "code").agg(
            F.bool_and(F.coalesce("done", F.lit(False))).alias("ready"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(of("p")["ids"])))).alias("p"),
            *[F.max(of("p")["below"]).alias("p_below")],
            *[F.max(of(kind)).alias(kind) for kind in "sab"],
        )
        met = open_.join(told, ["name", "code"], "left")
        tier = lambda k, ids, below: F.struct(F.lit(k).alias("tier"), ids.alias("ids"), below.cast("int").alias("below"))
        zero = F.lit(0)
        deeper = lambda *c: F.greatest(*c, zero) + 1
        found = (
            F.when(hit(F.col("p")), tier(PREFERRED, F.col("p"), F.coalesce("p_below", zero) + 1))
            .when(hit(F.col("precomputed")), tier(PRECOMPUTED, F.col("precomputed"), zero))
            .when(hit(F.col("own")), tier(SEVERAL, F.col("own"), zero))
            .when(hit(F.col("web")), tier(WEB, F.col("web"), zero))
            .when(hit(F.col("s.ids")), tier(SPACED, F.col("s.ids"), deeper(F.col("s.below"))))
            .when(hit(F.col("a.ids")) & hit(F.col("b.ids")), tier(HALVES, F.array_sort(F.array_union("a.ids", "b.ids")), deeper(F.col("a.below"), F.col("b.below"))))
        )
        met = written(met.select("name", "code", "own", "precomputed", "web", F.coalesce("ready", F.lit(True)).alias("ready"), found.alias("found")), "resolution-round")
        closed = closed.unionByName(met.where("ready").select("name", "code", "found"))
        still = met.where("not ready").drop("ready", "found")
        if still.isEmpty() or met.where("ready").isEmpty():
            break
        open_ = still
    out = asked_for.join(closed, ["name", "code"], "left")
    return out.select("key", F.col("found.tier").alias("tier"), F.col("found.ids").alias("ids"), "name", F.col("found.below").alias("round"))


def _is_cut(full: Column) -> Column:
    return full.contains("+") | full.contains("&") | full.contains(" plus ") | full.contains(" and ")


def link_interventions(interventions: DataFrame, names: DataFrame, codes: DataFrame, preferred: DataFrame, primary: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """(key, ids, incomplete, non_drug) of interventions(key, type, name, other_names, mentions, other_mentions).

    mentions and other_mentions list (text, code) as an extractor found them in
    the name and in the other names; primary(id, name) has each drug's own name.
    The rest is resolve()'s. In this order:

    Placebos: of type Other and without a sign of several, or a drug whose
    names say so: PLACEBO. Of several joined names the others count on, and
    PLACEBO is added in the end. Other types are non-drugs, without ids.
    If all other names resolve, theirs count, unless the name gives fewer; else
    the name's. Else the mentions: in their full form where the names have it, without
    brackets; those inside an other name that resolves give its ids. Without
    any, the other names' parts. Names that aren't in the text, of up to 3
    characters, of STOP_NAMES, or inside another one, don't count. One that
    doesn't resolve makes the intervention incomplete. If one of the ids found is
    the drug whose own name is the intervention's, it alone counts.

    Null lists are empty ones, a null name an empty name.
    """
    strings = lambda c: F.transform(F.coalesce(c, F.array().cast(_NONE)), F.lower)
    said = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<text:string,code:string>>")), lambda m: F.struct(m["text"].alias("text"), F.coalesce(m["code"], F.lit("")).alias("code")))
    base = interventions.select("key", "type", F.lower(F.coalesce("name", F.lit(""))).alias("name"), strings("other_names").alias("others"), said("mentions").alias("mentions"), said("other_mentions").alias("other_mentions"))
    full = F.concat("name", F.lit(" "), F.array_join("others", " "))
    parts = F.filter(F.split(full, r"&|\+| plus | and "), lambda p: ~T.is_placebo(p))
    is_drug, placebo = F.col("type") == "Drug", T.is_placebo(full)
    other_placebo = (F.col("type") == "Other") & T.is_placebo(F.col("name")) & ~_is_cut(F.col("name"))
    all_placebo = is_drug & placebo & (~_is_cut(full) | (F.size(parts) == 0))
    rest = F.when(placebo, F.trim(F.array_join(parts, "+"))).otherwise(full)
    base = written(base.select("*", F.coalesce(other_placebo | all_placebo, F.lit(False)).alias("placebo"), F.coalesce(is_drug, F.lit(False)).alias("is_drug"), F.coalesce(is_drug & placebo, F.lit(False)).alias("partly"), rest.alias("full")), "interventions")
    open_ = base.where("is_drug and not placebo")
    # The name and the other names, without a code.
    plain = open_.select("key", F.explode(F.array_distinct(F.concat(F.array("name"), "others"))).alias("said"))
    by_name = written(resolve(plain.select(F.struct("key", "said").alias("key"), F.col("said").alias("name"), F.lit("").alias("code")), names, codes, preferred, web).select("key.key", "key.said", "ids"), "interventions-names")
    known = by_name.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("said", F.coalesce("ids", F.array().cast(_NONE)).alias("ids")))).alias("known"))  # an intervention's few names
    met = open_.join(known, "key")
    ids_of = lambda n: F.element_at("known", n)
    theirs = F.array_sort(F.array_distinct(F.flatten(F.transform("others", ids_of))))
    own = ids_of(F.col("name"))
    complete = (F.size("others") > 0) & F.forall("others", lambda n: F.size(ids_of(n)) > 0)
    direct = F.when(complete, F.when((F.size(own) > 0) & (F.size(own) < F.size(theirs)), own).otherwise(theirs)).when(F.size(own) > 0, own)
    met = written(met.withColumn("direct", direct), "interventions-direct")
    # The others by what is mentioned in them.
    left = met.where("direct is null")
    every = F.array_join("others", "; ")
    first = F.transform("mentions", lambda m: F.struct(T.complete_code(m["text"], F.col("name")).alias("text"), m["code"].alias("code")))
    inside = lambda m: F.filter("others", lambda n: n.contains(m["text"]) & (F.size(ids_of(n)) > 0))
    given = F.flatten(F.transform(F.flatten(F.transform("other_mentions", inside)), ids_of))
    second = F.transform(F.filter("other_mentions", lambda m: (F.size(inside(m)) == 0) & (m["text"] != "")), lambda m: F.struct(T.complete_code(m["text"], every).alias("text"), m["code"].alias("code")))
    cut = lambda mentions: F.flatten(F.transform(mentions, lambda m: F.transform(T.alias_parts(m["text"]), lambda p: F.struct(p.alias("text"), m["code"].alias("code")))))
    mentioned = cut(F.concat(first, second))
    unnamed = cut(F.transform("others", lambda n: F.struct(n.alias("text"), F.lit("").alias("code"))))
    found = F.when(F.size(mentioned) > 0, mentioned).otherwise(unnamed)
    found = F.transform(F.filter(found, lambda m: F.col("full").contains(m["text"])), lambda m: F.struct(T.interferon(m["text"], F.col("full")).alias("text"), m["code"].alias("code")))
    found = F.array_distinct(F.filter(found, lambda m: (F.length(m["text"]) > 3) & ~m["text"].isin(STOP_NAMES)))
    left = written(left.select("key", "name", given.alias("given"), found.alias("found")), "interventions-mentions")
    whole = F.filter("found", lambda m: ~F.exists("found", lambda o: (o["text"] != m["text"]) & o["text"].contains(m["text"])))
    each = left.select("key", F.explode(whole).alias("m")).select(F.struct("key", "m").alias("key"), F.col("m.text").alias("name"), F.col("m.code").alias("code"))
    through = resolve(each, names, codes, preferred, web).groupBy("key.key").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("through"), F.bool_or(F.col("ids").isNull()).alias("lacks"))
    none = F.array().cast(_NONE)
    left = left.join(through, "key", "left").select("key", "name", F.array_distinct(F.concat("given", F.coalesce("through", none))).alias("ids"), F.coalesce("lacks", F.lit(False)).alias("lacks"))
    same = left.select("key", "name", F.explode("ids").alias("id")).join(primary.select("id", F.lower("name").alias("name")), ["id", "name"]).groupBy("key").agg(F.min("id").alias("override"))
    left = left.join(same, "key", "left").select("key", F.when(F.col("override").isNotNull(), F.array("override")).otherwise(F.col("ids")).alias("by_mention"), (F.col("lacks") & F.col("override").isNull()).alias("incomplete"))
    out = base.select("key", "is_drug", "placebo", "partly").join(met.select("key", "direct"), "key", "left").join(left, "key", "left")
    ids = F.when(F.col("placebo"), F.array(F.lit(PLACEBO))).when(F.col("direct").isNotNull(), F.col("direct")).when(F.col("partly"), F.array_union(F.coalesce("by_mention", none), F.array(F.lit(PLACEBO)))).otherwise(F.coalesce("by_mention", none))
    return out.select("key", F.array_sort(ids).alias("ids"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"), (~F.col("is_drug") & ~F.col("placebo")).alias("non_drug"))
