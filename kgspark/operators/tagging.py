"""Part-of-speech tags by a hidden Markov model: a lexicon with suffix classes, and Viterbi over each sentence as a fold.

The model is learned from a tagged sample, by counts on Spark alone, and kept
as tables: of a word (or of the longest known suffix of an unknown one, up to
SUFFIX letters) the tags that it may have, each with its log chance against the
tag's own; and the log chances of one tag behind another.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = 4
#: What a tag that was never seen behind another counts.
UNSEEN = 0.1
START = "<s>"
# Tags (by their first two letters) of a first word that only qualifies.
QUALIFYING = ["JJ", "DT", "RB"]


class Model(NamedTuple):
    """words and endings: (form, tags: array of (tag, chance)); behind: one row, a map of "tag tag" to its log chance, and the floor for others."""

    words: DataFrame
    endings: DataFrame
    behind: DataFrame


def _form(word: Column) -> Column:
    return F.lower(word)


def _endings(form: Column) -> Column:
    """The word's endings, the longest first, down to the empty one; numbers and words with a mark have a class of their own."""
    kind = F.when(form.rlike("[0-9]"), "#").when(form.rlike(r"[^\p{L}]"), "-").otherwise("")
    return F.transform(F.sequence(F.lit(SUFFIX), F.lit(0), F.lit(-1)), lambda k: F.concat(kind, F.lit(":"), F.when(k > 0, F.right(form, k)).otherwise("")))


def _chances(counts: DataFrame, tags: DataFrame) -> DataFrame:
    """(form, tags): of counts(form, tag, n), by form."""
    total = counts.groupBy(F.col("form").alias("_form")).agg(F.sum("n").alias("_all"))
    share = counts.join(total, F.col("form") == F.col("_form")).join(tags, "tag")
    entry = F.struct("tag", (F.log(F.col("n") / F.col("_all")) - F.col("own")).alias("chance"))
    return share.groupBy("form").agg(F.array_sort(F.collect_list(entry)).alias("tags"))  # a form's few tags


def fit(tagged: DataFrame) -> Model:
    """The model of tagged(sentence, pos, word, tag); rows with nulls are left out."""
    rows = tagged.select("sentence", "pos", _form(F.col("word")).alias("form"), "tag").na.drop()
    n = rows.agg(F.count("*").alias("_n"))
    tags = rows.groupBy("tag").agg(F.count("*").alias("_t")).crossJoin(F.broadcast(n)).select("tag", F.log(F.col("_t") / F.col("_n")).alias("own"))  # one row
    words = _chances(rows.groupBy("form", "tag").agg(F.count("*").alias("n")), tags)
    # Rare words tell how words end; frequent ones are in the lexicon anyway.
    endings = rows.select("form", "tag").distinct().select(F.explode(_endings(F.col("form"))).alias("form"), "tag").groupBy("form", "tag").agg(F.count("*").alias("n"))
    line = F.array_sort(F.collect_list(F.struct("pos", "tag")))
    path = rows.groupBy("sentence").agg(F.concat(F.array(F.lit(START)), F.transform(line, lambda x: x["tag"])).alias("path"))  # one sentence
    pairs = path.select(F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    left = counts.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_all"))
    chance = counts.join(left, F.col("a") == F.col("_a")).select(F.concat_ws(" ", "a", "b").alias("pair"), F.log(F.col("n") / (F.col("_all") + UNSEEN)).alias("chance"), F.log(F.lit(UNSEEN) / (F.col("_all") + UNSEEN)).alias("floor"))
    behind = chance.agg(F.map_from_entries(F.collect_list(F.struct("pair", "chance"))).alias("behind"), F.min("floor").alias("floor"))  # tags x tags at most
    return Model(words, _chances(endings, tags), behind)


def tag(rows: DataFrame, id: str, words: str, model: Model) -> DataFrame:
    """(id, tags): the likeliest tags of each row's array of words; equal chances go to the later tag by name.

    Every different word is looked up once. A word of no known ending has the
    tags of the sample's words at large; an empty sample gives no tags. Null and
    empty arrays have none either; ids are those of one row each.
    """
    at = rows.select(F.col(id).alias("_id"), F.posexplode(words).alias("pos", "word"))
    at = at.withColumn("form", _form(F.coalesce("word", F.lit(""))))
    forms = at.select("form").distinct()
    known = forms.join(model.words, "form", "left")
    unknown = known.where("tags is null").select(F.col("form").alias("_form"), F.posexplode(_endings(F.col("form"))).alias("_rank", "form"))
    longest = unknown.join(model.endings, "form").groupBy("_form").agg(F.min_by("tags", "_rank").alias("_tags"))
    looked = known.join(longest, F.col("form") == F.col("_form"), "left")
    # A word with a mark or number whose class is new falls back on what any word may be.
    any_ = model.endings.where("form = ':'").select(F.col("tags").alias("_any"))
    looked = looked.crossJoin(F.broadcast(any_))  # one row
    looked = looked.select("form", F.coalesce("tags", "_tags", "_any").alias("tags"))
    sentences = at.join(looked, "form", "left").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tags"))), lambda x: x["tags"]).alias("_options"))
    met = sentences.crossJoin(F.broadcast(model.behind))  # one row
    follows = lambda a, b: F.coalesce(F.try_element_at("behind", F.concat_ws(" ", a, b)), F.col("floor"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(START).alias("tag"), F.array().cast("array<string>").alias("path")))

    def step(states: Column, options: Column) -> Column:
        def best(option: Column) -> Column:
            ways = F.transform(states, lambda s: F.struct((s["score"] + follows(s["tag"], option["tag"]) + option["chance"]).alias("score"), option["tag"].alias("tag"), F.concat(s["path"], F.array(option["tag"])).alias("path")))
            return F.array_max(ways)

        return F.transform(options, best)

    found = met.select("_id", F.aggregate("_options", start, step, lambda s: F.array_max(s)["path"]).alias("tags"))
    out = rows.select(F.col(id).alias(id)).join(found, F.col(id).eqNullSafe(F.col("_id")), "left")
    return out.select(id, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def qualified(terms: DataFrame, id: str, term: str, model: Model) -> DataFrame:
    """terms with `rest`: the term without its first word, if that is an adjective, determiner or adverb and another follows; else null."""
    words = F.filter(F.split(F.col(term), r"\s+"), lambda w: w != "")
    tags = tag(terms.select(F.col(id).alias("_row"), words.alias("words")), "_row", "words", model).select("_row", F.substring(F.get("tags", F.lit(0)), 1, 2).alias("_first"))
    met = terms.join(tags, F.col(id).eqNullSafe(F.col("_row")), "left")
    rest = F.when((F.size(words) > 1) & F.col("_first").isin(QUALIFYING), F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
    return met.withColumn("rest", rest).drop("_row", "_first")
