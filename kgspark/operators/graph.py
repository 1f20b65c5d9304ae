"""Graphs as two tables, nodes and edges: assembly, contraction, ontologies, roll-ups and neighbourhoods.

nodes: etype, id, source, name, attrs; edges: src, dst, relation, rel_source,
attrs. Loops write their state to the shared folder each round and stop when
nothing changes; no rows reach the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.components import components
from kgspark.operators.draws import drawn_by
from kgspark.operators.ordered import running_sums
from kgspark.session import written

SAME = "KG-MERGE-SAME"


def last_writer(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: that of the largest seq."""
    turn = W.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys met more than once, with the count: what an add without overwriting would refuse."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_endpoints(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    lacks = lambda end: edges.join(ids, F.col(end) == F.col("_id"), "left_anti")
    return lacks("src").union(lacks("dst")).distinct()


def with_endpoints(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return edges


def without_relations(edges: DataFrame, denied: list[str], relation: str = "relation") -> DataFrame:
    return edges.where(~F.col(relation).isin(denied))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges by their ends alone, relations ignored."""
    return edges.select("src", "dst").distinct()


def neighbour_sets(edges: DataFrame, keys: list[str], dst: str) -> DataFrame:
    """(keys, neighbours): the sorted set of what a node leads to."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set(dst)).alias("neighbours"))


def any_of(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """(keys, flags): whether each holds for any row of a key."""
    return rows.groupBy(*keys).agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])


def frequent(rows: DataFrame, value: str, by: str, least: int) -> DataFrame:
    """rows of the values that at least `least` different `by` have."""
    often = rows.groupBy(value).agg(F.count_distinct(by).alias("_n")).where(F.col("_n") >= least).select(value)
    return rows.join(often, value, "left_semi")


def concept_map(nodes: DataFrame, same: DataFrame, node: str = "id") -> DataFrame:
    """(node, concept) for every node: its component under the equivalences in same(src, dst), itself if alone."""
    found = components(same)
    every = nodes.select(F.col(node).alias("_id")).distinct().join(found, F.col("_id") == F.col("node"), "left")
    return every.select(F.col("_id").alias("node"), F.coalesce("component", "_id").alias("concept"))


def contract(edges: DataFrame, concepts: DataFrame, lists: bool = True) -> DataFrame:
    """Edges between concepts: equivalences go, parallel edges become one with the list of their attributes.

    A pair of concepts with very many parallel edges makes a long list; with
    lists=False there are none, and contracted_attrs() has them row by row.
    """
    grouped = _between_concepts(edges, concepts).groupBy(F.col("src_concept").alias("src"), F.col("dst_concept").alias("dst"), "relation")
    attrs = F.array_sort(F.collect_list("attrs")) if lists and "attrs" in edges.columns else F.array().cast("array<string>")
    return grouped.agg(F.count("*").alias("n"), attrs.alias("attrs"))


def _between_concepts(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    of = lambda end: concepts.select(F.col("node").alias(f"_{end}"), F.col("concept").alias(f"{end}_concept"))
    kept = edges.where(F.col("relation") != SAME)
    return kept.join(of("src"), F.col("src") == F.col("_src")).join(of("dst"), F.col("dst") == F.col("_dst"))


def contracted_attrs(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, relation, attrs) between concepts, one row per parallel edge with attributes."""
    return _between_concepts(edges, concepts).where("attrs is not null").select(F.col("src_concept").alias("src"), F.col("dst_concept").alias("dst"), "relation", "attrs")


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_depth: int = 64) -> DataFrame:
    """(node, ancestor, depth): everything reachable, with the least number of steps; cycles are followed once."""
    step = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null and c <> p").distinct()
    step = written(step, "closure-edges")
    known = written(step.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).alias("depth")), "closure")
    fresh = known
    for _ in range(max_depth):
        reached = fresh.join(step, F.col("ancestor") == F.col("c")).select("node", F.col("p").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
        reached = reached.where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = written(reached.join(known, ["node", "ancestor"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"the closure is deeper than {max_depth}")


def independent_ids(sets: DataFrame, ancestors: DataFrame, keep: str = "general") -> DataFrame:
    """(key, id) without ids that another id of the same key makes redundant: general keeps ancestors, specific descendants.

    Ids are followed upwards alone: a term has few ancestors, but may have very many descendants.
    """
    ids = sets.select(F.col("id").alias("_id")).distinct()
    up = ancestors.select(F.col("node").alias("_node"), F.col("ancestor").alias("_ancestor"))
    up = up.join(ids, F.col("_node") == F.col("_id"), "left_semi").join(ids, F.col("_ancestor") == F.col("_id"), "left_semi")
    climbed = sets.join(up, F.col("id") == F.col("_node"))
    if keep == "general":
        others = sets.select(F.col("key").alias("_key"), F.col("id").alias("_other"))
        redundant = climbed.join(others, (F.col("key") == F.col("_key")) & (F.col("_ancestor") == F.col("_other")), "left_semi").select("key", "id")
    else:
        redundant = climbed.select("key", F.col("_ancestor").alias("id"))
    return sets.join(redundant.distinct(), ["key", "id"], "left_anti")


def tree_level(tree_numbers: Column, most: int = 10) -> Column:
    """The least depth among a term's dotted tree numbers, `most` at most."""
    depths = F.transform(tree_numbers, lambda t: F.size(F.split(t, r"\.")))
    return F.least(F.array_min(depths), F.lit(most))


def tree_parents(terms: DataFrame, id: str = "id", tree: str = "tree_number") -> DataFrame:
    """(child, parent) from tree numbers: the parent's is the child's without its last part."""
    up = F.regexp_extract(tree, r"^(.*)\.[^.]*$", 1)
    child = terms.select(F.col(id).alias("child"), up.alias("up")).where("up <> ''")
    parent = terms.select(F.col(id).alias("parent"), F.col(tree).alias("up"))
    return child.join(parent, "up").select("child", "parent").distinct()


def cut_tree(sets: DataFrame, levels: DataFrame, ancestors: DataFrame, level: int) -> DataFrame:
    """(key, id) with ids deeper than level replaced by their ancestors at exactly that level; ids without a level pass."""
    of = levels.select(F.col("id").alias("_id"), F.col("level").alias("_level"))
    leveled = sets.join(of, F.col("id") == F.col("_id"), "left").drop("_id")
    shallow = leveled.where(F.coalesce(F.col("_level"), F.lit(0)) <= level).select("key", "id")
    at = ancestors.join(of, F.col("ancestor") == F.col("_id")).where(F.col("_level") == level).select(F.col("node").alias("_node"), "ancestor")
    deep = leveled.where(F.col("_level") > level).join(at, F.col("id") == F.col("_node")).select("key", F.col("ancestor").alias("id"))
    return shallow.union(deep).distinct()


def propagate(pairs: DataFrame, ancestors: DataFrame, id: str, value: str) -> DataFrame:
    """(id, value) pairs, given to every ancestor too."""
    up = pairs.join(ancestors.select(F.col("node").alias("_node"), "ancestor"), F.col(id) == F.col("_node")).select(F.col("ancestor").alias(id), value)
    return pairs.select(id, value).union(up).distinct()


def cascade_parents(relations: DataFrame, known: DataFrame) -> DataFrame:
    """(child, parent) from relation rows (rel, parent, child, rela, source, suppress), the first tier that has any.

    Tiers: CHD, then RN, then RQ classified_as of MDR (exactly one row: that
    concept's own parents, taken once; none: isa rows; more: nothing), then RO
    of MTH. Only known concepts count, and none is its own parent.
    """
    names = known.select(F.col("id").alias("_known")).distinct()
    usable = relations.where(F.col("suppress").isin("", "N") & (F.col("parent") != F.col("child")))
    proper = usable.join(names, F.col("parent") == F.col("_known"), "left_semi")
    plain = lambda rel: proper.where(F.col("rel") == rel).select("child", "parent").distinct()
    first_of = lambda better, worse: better.union(worse.join(better.select("child").distinct(), "child", "left_anti"))
    found = first_of(plain("CHD"), plain("RN"))
    classified = usable.where("rel = 'RQ' and rela = 'classified_as' and source = 'MDR'").groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("via"))
    classified = classified.join(found.select("child").distinct(), "child", "left_anti")
    through = classified.where("n = 1").join(found.select(F.col("child").alias("via"), "parent"), "via").where("parent <> child").select("child", "parent")
    isa = proper.where("rel = 'RQ' and rela = 'isa'").select("child", "parent").join(classified.select("child"), "child", "left_anti")
    found = first_of(found, through.union(isa).distinct())
    return first_of(found, proper.where("rel = 'RO' and source = 'MTH'").select("child", "parent").distinct())


def roll_up(mentions: DataFrame, parents: DataFrame, threshold: int | list[int], max_level: int = 2, full_children: bool = False) -> DataFrame:
    """(concept, rolled): each concept with the ancestors that reach `threshold` supporters; of several thresholds (threshold, concept, rolled), in one pass.

    mentions(concept, trial) is pushed to parents max_level times, from
    concepts below the threshold (or from all); then each concept climbs until
    its frontier has the support. If none has it at the last level, the last
    frontier stays.
    """
    asked = [threshold] if isinstance(threshold, int) else sorted(set(threshold))
    each = F.explode(F.array(*[F.lit(t) for t in asked])).alias("threshold")
    up = parents.select(F.col("child").alias("_child"), F.col("parent").alias("_parent")).distinct()
    at = ["threshold", "concept"]
    support = written(mentions.select("concept", "trial").distinct().select(each, "concept", "trial"), "roll-up")
    for _ in range(max_level):
        sizes = support.groupBy(*at).agg(F.count("*").alias("n"))
        small = support if full_children else support.join(sizes.where("n < threshold").select(*at), at, "left_semi")
        pushed = small.join(up, F.col("concept") == F.col("_child")).select("threshold", F.col("_parent").alias("concept"), "trial")
        support = written(support.union(pushed).distinct(), "roll-up")
    enough = support.groupBy(*at).agg(F.count("*").alias("n")).where("n >= threshold").select(F.col("threshold").alias("_t"), F.col("concept").alias("_enough"))
    frontier = mentions.select("concept").distinct().select(each, "concept").withColumn("rolled", F.col("concept"))
    accepted = None
    for level in range(max_level + 1):
        marked = frontier.join(enough, (F.col("rolled") == F.col("_enough")) & (F.col("threshold") == F.col("_t")), "left")
        now = marked.where("_enough is not null").select(*at, "rolled")
        accepted = now if accepted is None else accepted.union(now)
        rest = marked.where("_enough is null").select(*at, "rolled")
        if level == max_level:
            break
        climbed = rest.join(up, F.col("rolled") == F.col("_child"), "left")
        frontier = written(climbed.select(*at, F.coalesce("_parent", "rolled").alias("rolled")).distinct(), "roll-up")
        accepted = written(accepted, "roll-up")
    out = accepted.union(rest.join(accepted.select(*at).distinct(), at, "left_anti")).distinct()
    return out.drop("threshold") if isinstance(threshold, int) else out


def bidirectional(edges: DataFrame, n_relations: int, etype: str = "etype") -> DataFrame:
    """Edges and their reverses, whose type is n_relations higher."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col(etype) + n_relations).alias(etype))
    return edges.select("src", "dst", etype).unionByName(back)


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int, fan_out: int = -1, seed: int = 0) -> DataFrame:
    """(node, hop) within `hops` incoming steps of seeds(node), the least hop each; at most fan_out neighbours a node, by a hash, if not -1."""
    found = written(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "k-hop")
    for hop in range(1, hops + 1):
        edge = found.where(F.col("hop") == hop - 1).join(edges.select("src", "dst").distinct(), F.col("node") == F.col("dst"))
        if fan_out >= 0:
            turn = W.partitionBy("dst").orderBy(F.xxhash64("dst", "src", F.lit(seed)), "src")
            edge = edge.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= fan_out)
        new = edge.select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti").withColumn("hop", F.lit(hop))
        found = written(found.unionByName(new), "k-hop")
    return found


def negatives(triples: DataFrame, n_nodes: int, per_positive: int, seed: int = 0, place=None) -> DataFrame:
    """(h, r, t, i, neg_h, neg_t): half with another head, half with another tail, uniform over all nodes and unfiltered.

    `place` gives the drawn node from the columns h, r, t, i; by default a seeded hash.
    """
    place = place or (lambda h, r, t, i: F.pmod(F.xxhash64(h, r, t, i, F.lit(seed)), F.lit(n_nodes)))
    rows = triples.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
    drawn = place(F.col("h"), F.col("r"), F.col("t"), F.col("i")).cast("long")
    head = F.col("i") < per_positive // 2
    return rows.withColumns({"neg_h": F.when(head, drawn).otherwise(F.col("h")), "neg_t": F.when(head, F.col("t")).otherwise(drawn)})


def divide_edges(triples: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """triples with `supervised`: the edges that int(share * n) draws with replacement hit, of the n edges of each relation; the others pass messages.

    An edge that stands in several rows is supervised in all of them or in none.
    """
    hit = drawn_by(triples.select("h", "r", "t"), F.col("r"), ["h", "r", "t"], F.floor(F.col("n") * share), seed).select("h", "r", "t").distinct()
    hit = hit.select(F.col("h").alias("_h"), F.col("r").alias("_r"), F.col("t").alias("_t"), F.lit(True).alias("_hit"))
    same = F.col("h").eqNullSafe(F.col("_h")) & F.col("r").eqNullSafe(F.col("_r")) & F.col("t").eqNullSafe(F.col("_t"))
    return triples.join(hit, same, "left").withColumn("supervised", F.coalesce("_hit", F.lit(False))).drop("_h", "_r", "_t", "_hit")


def inject_node(edges: DataFrame, node: int, new_edges: DataFrame, n_relations: int, required: list[int], dummy: int = 0) -> DataFrame:
    """Edges (src, dst, etype) with node's own replaced by new_edges and their reverses; each required relation it lacks goes to the dummy."""
    kept = edges.where((F.col("src") != node) & (F.col("dst") != node))
    own = bidirectional(new_edges, n_relations)
    wanted = edges.sparkSession.createDataFrame([(r,) for r in required], "etype int")
    lacking = wanted.join(new_edges.select("etype").distinct(), "etype", "left_anti")
    filler = lacking.select(F.lit(node).cast("long").alias("src"), F.lit(dummy).cast("long").alias("dst"), "etype")
    return kept.select("src", "dst", "etype").unionByName(own).unionByName(bidirectional(filler, n_relations))


def vocabulary(rows: DataFrame, column: str, start: int = 0, seq: str | None = None) -> DataFrame:
    """(value, id): ids from start in ascending order of value, or of a value's least seq (the order in which it was first met)."""
    known = rows.where(F.col(column).isNotNull())
    values = known.select(F.col(column).alias("value")).distinct() if seq is None else known.groupBy(F.col(column).alias("value")).agg(F.min(seq).alias("_seq"))
    return running_sums(values, ["value"] if seq is None else ["_seq", "value"], {"_before": F.lit(1)}, "vocabulary").select("value", (F.col("_before") + start).alias("id"))


def with_ids(rows: DataFrame, column: str, start: int = 0, id: str = "id") -> DataFrame:
    """rows with the id of their value in vocabulary(): the inverse index."""
    ids = vocabulary(rows, column, start).select(F.col("value").alias("_value"), F.col("id").alias(id))
    return rows.join(ids, F.col(column) == F.col("_value"), "left").drop("_value")


def predecessors(trials: DataFrame, check_phase: bool = False, check_drug: bool = False, most: int = 4096) -> DataFrame:
    """(before, id): pairs of different trials of which `before` is a predecessor of `id`.

    trials: id, diseases, countries, start_year, end_year, and phase or drugs
    where asked. The two share a disease and a country, and before's end year is
    at most id's start year; with check_phase id's phase is the next one, with
    check_drug both have the same drugs. A null or zero year makes no pair.

    Of what is shared by more than `most` earlier trials, these are dealt in
    parts, and the later ones are copied to each part; all else meets once. The
    join is by sorting: lists make the rows many more than Spark takes them for,
    and one side would be broadcast.
    """
    keys = ["disease", "country", *(["drugs"] if check_drug else []), *(["phase"] if check_phase else [])]
    rows = trials.withColumns({"disease": F.explode(F.array_distinct("diseases")), "start": F.col("start_year"), "end": F.col("end_year")})
    rows = rows.withColumn("country", F.explode(F.array_distinct("countries")))
    if check_drug:
        rows = rows.withColumn("drugs", F.array_sort("drugs"))
    first = rows.where("end != 0")
    if check_phase:
        first = first.withColumn("phase", F.col("phase") + 1)
    parts = F.ceil(F.count("*") / most).alias("parts")
    often = written(first.groupBy(*keys).agg(parts).where("parts > 1"), "predecessors-often")
    first, second = (side.join(often, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) for side in (first, rows.where("start != 0")))
    first = first.select(*keys, F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("before"), "end")
    second = second.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "start")
    return first.hint("merge").join(second, [*keys, "part"]).where("end <= start and before != id").select("before", "id").distinct()
