"""Result groups to the arms of their trial, stage by stage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators.linking import FILLER_WORDS

# Titles that are a number of an arm and nothing more.
NUMBERED = r"^(arm|regimen|phase|group|cohort|treatment|panel) (i+|[0-9a-z])( \w)?$"
# Marks that stand as words of their own in a normalised title, and the words that stand for a plus.
MARKS = r"([;@#$%&?!()\[\]{}<>]|[:,](?=[^0-9]|$)|\.(?=\s*$)|\.{2,}|--)"
PLUS = r"(?<=^| )(plus|and|&)(?= |$)"
_NONE = "array<string>"


class _Automaton:
    """The suffix automaton of a text: each state is a set of its parts that end at the same places."""

    def __init__(self, text: str):
        self.next, self.link, self.size, self.first = [{}], [-1], [0], [0]
        last = 0
        for at, c in enumerate(text):
            new = self._state({}, 0, self.size[last] + 1, at + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] != self.size[p] + 1:
                    twin = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = twin
                    q = twin
                self.link[new] = q
            last = new
        self.order = sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)

    def _state(self, to: dict, link: int, size: int, first: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def longest(self, text: str) -> list[int]:
        """Per state, the length of its longest part that the text holds."""
        best, state, n = [0] * len(self.size), 0, 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            best[state] = max(best[state], n)
        for s in self.order:
            up = self.link[s]
            if best[s] and up > 0:
                best[up] = self.size[up]
        return best


def longest_common(texts: list[str]) -> str:
    """The longest part that all texts hold, the first of those in the first text: in time of the texts' length together."""
    if not texts or not all(texts):
        return ""
    automaton = _Automaton(texts[0])
    shared = list(automaton.size)
    for other in texts[1:]:
        shared = [min(a, b) for a, b in zip(shared, automaton.longest(other), strict=True)]
    n, at = max((m, -(automaton.first[s] - m)) for s, m in enumerate(shared))
    return texts[0][-at : -at + n] if n else ""


def common_part(titles: Column) -> Column:
    """longest_common() of an array of texts; nulls count as empty, and an empty array has none."""

    @F.pandas_udf("string")
    def by_batch(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: "" if r is None else longest_common([t or "" for t in r]))

    return by_batch(titles)


def normalised(c: Column) -> Column:
    """Lower-case ASCII words and marks, one space between; plus, and and & are +."""
    low = F.lower(T.ascii_only(F.coalesce(c, F.lit("")), ""))
    spaced = T.squeeze(F.regexp_replace(low, MARKS, " $1 "))
    return F.regexp_replace(spaced, PLUS, "+")


def match_groups(groups: DataFrame, arms: DataFrame) -> DataFrame:
    """(trial, group_id, arm_id, stage) of groups(trial, group_id, title) in arms(trial, arm_id, label): the first stage that fits.

    Arms may also have description, drugs (names), drug_ids, names (of
    interventions), incomplete and non_drug; groups may have mention_ids, the
    drugs that an extractor found in their title.

    0 one group and one label. Then the title is 1 a label, 2 one without spaces
    and hyphens, 3 an arm's description, 4 one without spaces and hyphens; 5 to 8 the same after
    what all titles of the trial share is cut away; 9 a label or description
    with cystic fibrosis as cf. Then one arm after the other, each by all of
    these rules before the next: 11 the title behind its colon is the label, 10 word
    sets that are equal or differ in filler words alone, 11 the label behind its
    colon is the title, 12 (complete drug arms alone) what the title joins by + are the
    arm's drugs, its interventions' names, or what these have in brackets. 13 one
    of title and label is the number of an arm and starts a word of the other. 14
    the mentioned drugs are an arm's.

    Of arms with one label the last counts, in the place of the first. A group
    without a title has stage 0 or none; unmatched groups have nulls.
    """
    defaults = {"description": "string", "drugs": _NONE, "drug_ids": _NONE, "names": _NONE, "incomplete": "boolean", "non_drug": "boolean"}
    full = arms.select("trial", "arm_id", "label", *[F.col(c) if c in arms.columns else F.lit(None).cast(t).alias(c) for c, t in defaults.items()])
    full = full.withColumns({"label": normalised(F.col("label")), "description": F.coalesce("description", F.lit(""))})
    same = W.partitionBy("trial", "label")  # a trial's few arms
    full = full.withColumns({"_at": F.min("arm_id").over(same), "_last": F.max("arm_id").over(same)}).where("arm_id = _last")
    full = full.withColumn("_labels", F.count("*").over(W.partitionBy("trial")))
    titled = groups.select("trial", "group_id", normalised(F.col("title")).alias("title"), (F.col("mention_ids") if "mention_ids" in groups.columns else F.lit(None).cast(_NONE)).alias("mention_ids"))
    stems = titled.groupBy("trial").agg(F.count("*").alias("_groups"), F.array_sort(F.collect_list(F.struct("group_id", "title"))).alias("_titles"))  # a trial's few titles
    stems = stems.select("trial", "_groups", common_part(F.transform("_titles", lambda t: t["title"])).alias("_stem"))
    pairs = titled.join(stems, "trial").join(full, "trial")  # pairs within a trial: a few arms each
    tight = lambda c: F.regexp_replace(c, "[ -]", "")
    title, label, said = F.col("title"), F.col("label"), F.col("description")
    cut = F.when(F.col("_stem") != "", F.replace(title, F.col("_stem"), F.lit(""))).otherwise(title)
    cf = F.replace(title, F.lit("cystic fibrosis"), F.lit("cf"))
    behind = lambda c: F.trim(F.get(F.split(c, ":"), F.lit(1)))
    short = F.trim(F.regexp_replace(F.when(title.contains(":"), behind(title)).otherwise(title), "subjects receiving", ""))
    words = lambda c: F.array_distinct(F.split(c, "[ /+]"))
    differing = F.array_union(F.array_except(words(title), words(label)), F.array_except(words(label), words(title)))
    in_order = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast(_NONE)), lambda x: F.trim(F.lower(x)))))
    joined = in_order(F.split(short, r"\+"))
    bracketed = F.flatten(F.transform(F.coalesce("names", F.array().cast(_NONE)), lambda n: F.regexp_extract_all(F.lower(n), F.lit(r"\(([^)]*)\)"), F.lit(1))))
    drug_arm = ~F.coalesce("incomplete", F.lit(False)) & ~F.coalesce("non_drug", F.lit(False))
    stage = lambda major, minor: F.struct(F.lit(major).alias("major"), F.lit(None).cast("long").alias("arm"), F.lit(minor).alias("stage"))
    custom = lambda minor: F.struct(F.lit(10).alias("major"), F.col("_at").cast("long").alias("arm"), F.lit(minor).alias("stage"))
    fit = (
        F.when((F.col("_groups") == 1) & (F.col("_labels") == 1), stage(0, 0))
        .when(title == "", None)
        .when(title == label, stage(1, 1))
        .when(tight(title) == tight(label), stage(2, 2))
        .when((said != "") & (title == said), stage(3, 3))
        .when((said != "") & (tight(title) == tight(said)), stage(4, 4))
        .when((cut != "") & (cut == label), stage(5, 5))
        .when((tight(cut) != "") & (tight(cut) == tight(label)), stage(6, 6))
        .when((cut != "") & (said != "") & (cut == said), stage(7, 7))
        .when((tight(cut) != "") & (said != "") & (tight(cut) == tight(said)), stage(8, 8))
        .when((cf == label) | ((said != "") & (cf == said)), stage(9, 9))
        .when(short == label, custom(11))
        .when(F.size(F.array_except(differing, F.array(*map(F.lit, FILLER_WORDS)))) == 0, custom(10))
        .when(label.contains(":") & (behind(label) == short), custom(11))
        .when(drug_arm & ((in_order(F.col("drugs")) == joined) | (in_order(F.col("names")) == joined) | (in_order(bracketed) == joined)), custom(12))
        .when((title.rlike(NUMBERED) & label.contains(F.concat(title, F.lit(" ")))) | (label.rlike(NUMBERED) & title.contains(F.concat(label, F.lit(" ")))), F.struct(F.lit(13).alias("major"), F.col("_at").cast("long").alias("arm"), F.lit(13).alias("stage")))
        .when((F.size("mention_ids") > 0) & (F.array_sort(F.array_distinct("mention_ids")) == F.array_sort(F.array_distinct("drug_ids"))), F.struct(F.lit(14).alias("major"), F.col("_at").cast("long").alias("arm"), F.lit(14).alias("stage")))
    )
    # Of one stage's arms the last counts, as of one label's.
    best = W.partitionBy("trial", "group_id").orderBy("fit.major", "fit.arm", F.desc("arm_id"))
    matched = pairs.select("trial", "group_id", "arm_id", fit.alias("fit")).where("fit is not null").withColumn("_turn", F.row_number().over(best)).where("_turn = 1")
    return groups.select("trial", "group_id").join(matched.select("trial", "group_id", "arm_id", F.col("fit.stage").alias("stage")), ["trial", "group_id"], "left")
