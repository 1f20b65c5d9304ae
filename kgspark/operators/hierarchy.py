"""Hierarchies by their tree numbers: a dotted number names all its ancestors by its prefixes.

terms: id, tree_numbers (array). A term with several numbers stands in several
places. A walk up takes a number's whole chain in one join on its prefixes, not a join
a level; only where an ancestor has numbers that its descendants lack does it go on from
those, so the rounds are as many as such changes of branch, not as the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators.graph import tree_level
from kgspark.session import written


def prefixes(number: Column) -> Column:
    """All proper prefixes of a dotted number, the shortest first."""
    parts = F.split(number, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))


def numbered(terms: DataFrame) -> DataFrame:
    """(id, number) of terms(id, tree_numbers)."""
    return terms.select("id", F.explode("tree_numbers").alias("number")).where("id is not null and number is not null and number <> ''").distinct()


def ancestors(terms: DataFrame) -> DataFrame:
    """(node, ancestor): the pairs that the closure of the terms' child and parent edges has, worked out by prefixes.

    A chain ends where a number lacks its parent's term: what is above the gap is no ancestor.
    """
    own = written(numbered(terms), "hierarchy-numbers")
    owner = own.select(F.col("id").alias("ancestor"), F.col("number").alias("prefix"))
    # A number's prefixes up to the first that no term has.
    chain = own.select("number", F.posexplode(F.reverse(prefixes(F.col("number")))).alias("at", "prefix"))
    held = chain.join(owner.select("prefix").distinct().withColumn("_held", F.lit(True)), "prefix", "left")
    gap = held.groupBy("number").agg(F.min(F.when(F.col("_held").isNull(), F.col("at"))).alias("gap"))
    chain = held.join(gap, "number").where("gap is null or at < gap").select("number", "prefix")
    up = written(own.join(chain, "number").join(owner, "prefix").select(F.col("id").alias("node"), "ancestor").where("node <> ancestor").distinct(), "hierarchy-up")
    known = fresh = up
    while True:
        step = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("higher"))
        reached = fresh.join(step, "ancestor").select("node", F.col("higher").alias("ancestor")).where("node <> ancestor").distinct()
        fresh = written(reached.join(known, ["node", "ancestor"], "left_anti"), "hierarchy-up")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def cut(sets: DataFrame, terms: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """(key, id) of sets(key, id): ids deeper than level become their ancestors at exactly that level; ids that are no terms pass, such as HEALTHY.

    A term's level is the least depth of its numbers, one without any is as deep
    as can be; above: ancestors(terms).
    """
    of = terms.select("id", tree_level(F.col("tree_numbers")).alias("_level")).groupBy("id").agg(F.min("_level").alias("_level"))
    leveled = sets.select("key", "id").join(of, "id", "left")
    at = above.join(of.where(F.col("_level") == level).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    deep = leveled.where(F.col("_level") > level).join(at, F.col("id") == F.col("node")).select("key", F.col("ancestor").alias("id"))
    return leveled.where(F.coalesce("_level", F.lit(0)) <= level).select("key", "id").unionByName(deep).distinct()


def population(trials: DataFrame, names: DataFrame, associations: DataFrame, terms: DataFrame, level: int = 4, propagate: bool = False) -> DataFrame:
    """(trial, ids, healthy, associated_ids, associations, cut_ids, cut_associated_ids) of trials(trial, terms).

    ids: headings of the terms by lower-cased name; healthy: whether a term is a
    healthy one; associated_ids: those ids that associations(id, value) has
    something of (with propagate: of a descendant, too), and associations its
    values; cut: the ids, and the associated ones, cut at the level. Trials
    without any have empty arrays.
    """
    above = written(ancestors(terms), "population-up")
    values = associations.select("id", "value").where("id is not null").distinct()
    if propagate:
        higher = values.join(above, F.col("id") == F.col("node")).select(F.col("ancestor").alias("id"), "value")
        values = values.unionByName(higher).distinct()
    each = trials.select("trial", F.explode("terms").alias("term"))
    look = names.select(F.lower(F.trim("name")).alias("_name"), "id")
    met = written(each.join(look, F.lower(F.trim("term")) == F.col("_name"), "left").select("trial", "term", "id"), "population")
    found = met.where("id is not null").select(F.col("trial").alias("key"), "id").distinct()
    good = found.join(values.select("id").distinct(), "id", "left_semi").select("key", "id")
    listed = lambda df, name, column="id": df.groupBy("key").agg(F.array_sort(F.collect_set(column)).alias(name))  # noqa: E731  a trial's few ids
    healthy = met.groupBy(F.col("trial").alias("key")).agg(F.bool_or(F.lower("term").rlike(r"healthy\s*(human)?\s*(volunteer(s)?|subject(s)?)?")).alias("healthy"))
    parts = [healthy, listed(found, "ids"), listed(good, "associated_ids"), listed(good.join(values, "id"), "associations", "value"), listed(cut(found, terms, above, level), "cut_ids"), listed(cut(good, terms, above, level), "cut_associated_ids")]
    out = trials.select(F.col("trial").alias("key")).distinct()
    for part in parts:
        out = out.join(part, "key", "left")
    none = F.array().cast("array<string>")
    names_ = ["ids", "associated_ids", "associations", "cut_ids", "cut_associated_ids"]
    columns = {c: F.coalesce(c, none).alias(c) for c in names_}
    return out.select(F.col("key").alias("trial"), columns["ids"], F.coalesce("healthy", F.lit(False)).alias("healthy"), *[columns[c] for c in names_[1:]])
