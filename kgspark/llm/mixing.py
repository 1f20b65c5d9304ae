"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies each of its documents should
have: a whole number of copies for all, and a fraction left to rounding. The
fractions are rounded in pairs. Of two open documents with sizes a and b and
probabilities x and y, mass moves from one to the other, a * x + b * y kept,
until one of them is 0 or 1; chance picks the direction so that expectations
stay. Blocks of about `block_rows` documents of a source are rounded first;
the one open document of each block goes up a tree of fan-in `fan_in`
until each source has one, which chance closes. A source's words so miss its target by
less than its last open document; larger documents are paired first, which
leaves a small one open.

All chance comes from hashes of (seed, doc_id, text): reruns agree. Documents
without words take no part: no copies. A null source is a source, the last.
Repeated rows are documents of their own. Sources without words have target 0.
Of texts, however long, only the number of words and a hash are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.extras import extras_aside
from kgspark.operators.ordered import running_sums
from kgspark.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 2048
FAN_IN = 64
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, rank, target: shares of share * all words by weight, none above most * its size.

    Resharing what stands above a cap, by weight and again, ends where every
    source has min(weight * level, cap) for one common level. With sources in
    ascending order of cap / weight, the level follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = running_sums(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-ranks").withColumn("rank", F.col("rank").cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    per = running_sums(per, ["full", "rank"], {"capped": F.col("cap"), "behind": F.col("weight")}, "mix-levels")
    whole = per.agg((share * F.sum("source_size")).alias("goal"), F.sum("weight").alias("all_weights"))
    per = per.crossJoin(F.broadcast(whole))  # one row
    # If this source is the first that isn't full, the level is what is left over the weights from here on; for later ones that quotient falls.
    per = per.withColumn("level", (F.col("goal") - F.col("capped")) / (F.col("all_weights") - F.col("behind")))
    level = per.agg(F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).alias("level"))
    per = per.drop("level").crossJoin(F.broadcast(level))  # one row
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap"))
    return per.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of open rows, in order, until at most one is open; columns size, x, u, copies change."""
    size, x, chance = rows["size"].to_numpy(float), rows["x"].to_numpy(float).copy(), rows["u"].to_numpy(float)
    near, held = 1e-9, -1
    for i in range(len(x)):
        if x[i] <= near or x[i] >= 1 - near:
            x[i] = round(x[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, x_i, y = size[held], size[i], x[held], x[i]
        up, down = min(a * (1 - x_i), b * y), min(a * x_i, b * (1 - y))
        mass = up if chance[i] * (up + down) < down else -down
        x_i, y = x_i + mass / a, y - mass / b
        x_i, y = (round(v) if v <= near or v >= 1 - near else v for v in (x_i, y))
        x[held], x[i] = x_i, y
        if 0 < x_i < 1:
            pass
        elif 0 < y < 1:
            held = i
        else:
            held = -1
    return rows.assign(x=x)


def _keyed(docs: DataFrame, id, source, text) -> DataFrame:
    """docs with _id, _source, _size, _hash; rows of equal key are equal to the mix, and _nth numbers them."""
    return docs.withColumns({"_id": F.col(id).cast("long"), "_source": F.col(source).cast("string"), "_size": n_words(F.col(text)), "_hash": F.xxhash64(text)})


def _numbered(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_source", "_hash").orderBy("_size")))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block_rows: int = BLOCK_ROWS, seed: int = 29) -> DataFrame:
    """doc_id, source, text_hash, nth, size, source_size, target, copies of every document; nth numbers rows equal in the first three."""
    sizes = _numbered(_keyed(docs.select("doc_id", "source", "text"), "doc_id", "source", "text").drop("text"))
    sizes = written(sizes.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("text_hash"), F.col("_nth").alias("nth")), "mix-sizes")
    per = targets(sizes, weights, share, most)
    # A source may hold a third of all rows: its line is copied to SALTS salts, and its documents are dealt to them.
    spread = per.select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt")).withColumnRenamed("source", "s")
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "nth"), F.lit(SALTS))
    rows = sizes.withColumn("dealt", salt).join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("dealt") == F.col("salt")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(ratio + 1e-9), F.lit(int(most)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_rows)).cast("long")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "nth"), F.lit(1 << 52)) / float(1 << 52)
    rows = rows.select(
        "doc_id", "source", "text_hash", "nth", "size", "source_size", "target", "rank", base.alias("base"), chance.alias("u"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - base)).otherwise(0.0).alias("x"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash", "nth"), blocks).alias("block"),
    )
    kinds = {"doc_id": "long", "source": "string", "text_hash": "long", "nth": "int", "size": "long", "source_size": "long", "target": "double", "rank": "int", "base": "long", "u": "double", "x": "double", "block": "long"}
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items())

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return _round(pdf.sort_values(["size", "u", "doc_id", "text_hash", "nth"], ascending=[False, True, True, True, True], ignore_index=True))[list(kinds)]

    done = written(rows.groupBy("rank", "block").applyInPandas(first, schema), "mix-blocks")
    is_open = (F.col("x") > 0) & (F.col("x") < 1)
    closed = _residuals(done.where(is_open).select("rank", "block", "size", "x", "u"))
    done = done.join(closed.withColumnRenamed("x", "last"), ["rank", "block"], "left")
    extra = F.when(is_open, F.col("last")).otherwise(F.col("x"))
    words = F.when(F.col("size") > 0, F.col("base") + extra.cast("long")).otherwise(F.lit(0))
    return done.select("doc_id", "source", "text_hash", "nth", "size", "source_size", "target", words.cast("long").alias("copies"))


def _residuals(rows: DataFrame) -> DataFrame:
    """(rank, block, x) with x now 0 or 1: the open document of each block, rounded up a tree of fan-in FAN_IN."""
    rows = written(rows, "mix-open")
    most = rows.agg(F.max("block")).first()[0] or 0
    schema, level, closed = "rank int, block long, size long, x double, u double", 1, []

    def up(last: bool):
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            out = _round(pdf.sort_values(["size", "block"], ascending=[False, True], ignore_index=True)[["rank", "block", "size", "x", "u"]])
            if last:  # the source's last open document: chance closes it
                out["x"] = [float(v if v in (0.0, 1.0) else u < v) for v, u in zip(out["x"], out["u"], strict=True)]
            return out

        return fold

    while True:
        level *= FAN_IN
        last = most < level
        rows = rows.groupBy("rank", F.floor(F.col("block") / level).alias("node")).applyInPandas(up(last), schema)
        rows = written(rows, "mix-open")
        closed.append(rows.where("x = 0 or x = 1").select("rank", "block", "x"))
        if last:
            break
        rows = rows.where("x > 0 and x < 1")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionAll(more)
    return out


@extras_aside("doc_id", "text", "source")
def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row as often as it is taken; columns as they are in docs.

    Texts move once, to meet their copies; only rows that repeat (equal in
    doc_id, source and text) are numbered, and so moved again.
    """
    keyed, key = _keyed(docs, "doc_id", "source", "text"), ["_id", "_source", "_hash"]
    taken = mixed(docs, **how).withColumnsRenamed({"doc_id": "_i", "source": "_s", "text_hash": "_h"})
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h"))
    sums = written(taken.groupBy("_i", "_s", "_h").agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies")).where("_copies > 0"), "mix-taken")
    met = keyed.join(sums.where("_rows = 1"), same).select(*docs.columns, "_copies")
    again = keyed.join(sums.where("_rows > 1").drop("_copies"), same).select(*docs.columns, *key, "_size")
    each = taken.join(sums.where("_rows > 1").select("_i", "_s", "_h").withColumnsRenamed({"_i": "_a", "_s": "_b", "_h": "_c"}), F.col("_i").eqNullSafe(F.col("_a")) & F.col("_s").eqNullSafe(F.col("_b")) & (F.col("_h") == F.col("_c")), "left_semi")
    again = _numbered(again).join(each.where("copies > 0").select("_i", "_s", "_h", "nth", "copies"), same & (F.col("_nth") == F.col("nth"))).select(*docs.columns, F.col("copies").alias("_copies"))
    out = met.unionByName(again)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
