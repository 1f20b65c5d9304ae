"""Graph queries: nodes, edges, merging, hierarchies, neighbourhoods and name linking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators import builders, graph, linking, trials
from kgspark.operators.components import components


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tagged(mark: str, column: str):
    return F.concat(F.lit(mark), F.col(column).cast("string"))


def _geo(spark: SparkSession, sf: str) -> DataFrame:
    """(child, parent): customers under nations under regions."""
    customers = _table(spark, sf, "customer").select(_tagged("c", "c_custkey").alias("child"), _tagged("n", "c_nationkey").alias("parent"))
    return customers.unionAll(_table(spark, sf, "nation").select(_tagged("n", "n_nationkey").alias("child"), _tagged("r", "n_regionkey").alias("parent")))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """(key, id): a customer's own nation, and for those with no debt that nation's region too."""
    c, n = _table(spark, sf, "customer"), _table(spark, sf, "nation")
    nations = c.select(F.col("c_custkey").alias("key"), _tagged("n", "c_nationkey").alias("id"))
    both = c.where("c_acctbal >= 0").join(n, c.c_nationkey == n.n_nationkey)
    return nations.unionAll(both.select(F.col("c_custkey").alias("key"), _tagged("r", "n_regionkey").alias("id")))


def _same(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): each part and the one before it of equal brand, type and size."""
    before = F.lag("p_partkey").over(W.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    return _table(spark, sf, "part").select(before.alias("src"), F.col("p_partkey").alias("dst")).where("src is not null")


def kg_node_type_counts(spark, sf):
    t = lambda name, kind, key: _table(spark, sf, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("key"), F.array(F.lit(kind)).alias("etypes"))
    parts = [t("part", "drug", "p_partkey"), t("customer", "disease", "c_custkey"), t("orders", "outcome", "o_orderpriority"), t("supplier", "criterion", "s_suppkey")]
    nodes = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).distinct()
    return trials.type_counts(nodes, nodes.select(F.col("key").alias("arm")).where("false")).select(F.col("etype").alias("type"), F.col("n").alias("n_nodes"))


def kg_missing_endpoint_rejects(spark, sf):
    """Orders of customers in debt, who are no nodes."""
    edges = _table(spark, sf, "orders").select(_tagged("o", "o_orderkey").alias("src"), _tagged("c", "o_custkey").alias("dst"))
    nodes = _table(spark, sf, "orders").select(_tagged("o", "o_orderkey").alias("id")).unionAll(_table(spark, sf, "customer").where("c_acctbal >= 0").select(_tagged("c", "c_custkey")))
    return graph.missing_endpoints(edges, nodes)


def kg_relation_denylist(spark, sf):
    edges = _table(spark, sf, "events").select(F.col("event_type").alias("relation"), F.col("user_id").alias("src"), F.col("event_id").alias("dst"))
    return graph.without_relations(edges, ["click", "view"]).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


def arm_drug_sets(spark, sf):
    sets = graph.neighbour_sets(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")
    return sets.select("l_orderkey", "l_linenumber", F.array_join("neighbours", ",").alias("drugs"))


def arm_flags(spark, sf):
    flagged = graph.any_of(_table(spark, sf, "lineitem"), ["l_orderkey"], {"excluded": F.col("l_returnflag") == "R", "running": F.col("l_linestatus") == "O"})
    arms = graph.neighbour_sets(_table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")
    return flagged.join(arms, "l_orderkey").select("l_orderkey", "excluded", "running", F.size("neighbours").cast("long").alias("n_arms"))


def arm_eligibility_edges(spark, sf):
    relation = F.when(F.col("l_returnflag") == "R", "exclusion").otherwise("inclusion")
    edges = builders.edges_of(_table(spark, sf, "lineitem"), F.col("l_orderkey"), F.col("l_suppkey"), relation, trials.TRIAL)
    return edges.groupBy(F.col("dst").alias("l_suppkey"), "relation").agg(F.count("*").alias("n_trials"))


def components_alias_parts(spark, sf):
    return components(_same(spark, sf))


def contract_multigraph(spark, sf):
    line = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("tests").alias("relation"))
    concepts = graph.concept_map(_table(spark, sf, "part").select(F.col("p_partkey").alias("id")), _same(spark, sf))
    suppliers = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("concept"))
    # Suppliers and parts have keys of their own: parts become -1, -2, .. to share one id space.
    parts = concepts.select((-1 - F.col("node")).alias("node"), (-1 - F.col("concept")).alias("concept"))
    merged = graph.contract(line.withColumn("dst", -1 - F.col("dst")), suppliers.unionAll(parts))
    return merged.select("src", (-1 - F.col("dst")).alias("dst"), "relation", "n")


def closure_geo(spark, sf):
    return graph.closure(_geo(spark, sf))


def filter_general_ids(spark, sf):
    return graph.independent_ids(_places(spark, sf), graph.closure(_geo(spark, sf)), "general")


def filter_specific_ids(spark, sf):
    return graph.independent_ids(_places(spark, sf), graph.closure(_geo(spark, sf)), "specific")


def cut_tree_level(spark, sf):
    geo = _geo(spark, sf)
    levels = geo.select(F.col("child").alias("id")).unionAll(_table(spark, sf, "region").select(_tagged("r", "r_regionkey").alias("id")))
    levels = levels.withColumn("level", F.when(F.col("id").startswith("c"), 3).when(F.col("id").startswith("n"), 2).otherwise(1))
    sets = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), _tagged("c", "o_custkey").alias("id"))
    return graph.cut_tree(sets, levels, graph.closure(geo), 2)


def propagate_to_ancestors(spark, sf):
    pairs = _table(spark, sf, "orders").select(_tagged("c", "o_custkey").alias("id"), F.col("o_orderpriority").alias("value"))
    return graph.propagate(pairs, graph.closure(_geo(spark, sf)), "id", "value").groupBy("id").agg(F.count("*").alias("n_values"))


def fanout_bridge(spark, sf):
    o, c, n = _table(spark, sf, "orders"), _table(spark, sf, "customer"), _table(spark, sf, "nation")
    left = o.select(F.col("o_orderpriority").alias("src"), F.col("o_custkey").alias("code"))
    bridge = c.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("nation"))
    return builders.bridged(left, bridge, n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("dst")), "nation")


def frequency_threshold_network(spark, sf):
    line = _table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    often = graph.frequent(line, "l_partkey", "l_orderkey", 30)
    return often.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"))


def predecessor_pairs(spark, sf):
    """Orders as trials: of one customer and one of two priorities, ended by the year in which the other starts; open orders have not ended."""
    o = _table(spark, sf, "orders")
    year = F.year("o_orderdate")
    rows = o.select(F.col("o_orderkey").alias("id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("diseases"), F.array(F.substring("o_orderpriority", 1, 1)).alias("countries"), year.alias("start_year"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(year + 1).alias("end_year"))
    return graph.predecessors(rows)


def duplicate_keys(spark, sf):
    return graph.duplicates(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def last_writer(spark, sf):
    return graph.last_writer(_table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def bidirectional_edges(spark, sf):
    edges = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_orderkey") % 3).cast("int").alias("etype"))
    return graph.bidirectional(edges, 3)


def khop_two_neighbours(spark, sf):
    edges = _geo(spark, sf).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return graph.k_hop(_table(spark, sf, "region").select(_tagged("r", "r_regionkey").alias("node")), edges, 2)


def negative_samples_modular(spark, sf):
    triples = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("h"), F.col("l_linenumber").cast("long").alias("r"), F.col("l_partkey").alias("t"))
    return graph.negatives(triples, 997, 4, place=lambda h, r, t, i: (h * 31 + r * 17 + t * 7 + i * 101) % 997).select("h", "r", "t", F.col("i").cast("long").alias("i"), "neg_h", "neg_t")


def entity_vocabulary(spark, sf):
    return graph.vocabulary(_table(spark, sf, "part"), "p_name")


def name_priority_match(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, linking.NAME_PRIORITY)), (F.col("p_partkey") % 7 + 1).cast("int"))
    names = _table(spark, sf, "part").select(F.lower("p_brand").alias("name"), kind.alias("category"), F.col("p_partkey").alias("id"))
    found = linking.by_priority(names, names.select("name"))
    return found.select("name", "category", F.array_join("ids", ",").alias("ids"))


MERGED = "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS rep, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS members FROM part"
GEO = "SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
CLOSED = f"geo AS ({GEO}), up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM geo UNION SELECT a.child, b.parent, 2 FROM geo a JOIN geo b ON a.parent = b.child)"
PLACES = "places AS (SELECT c_custkey AS key, 'n' || c_nationkey AS id FROM customer UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0)"
_independent = lambda mine, other: f"WITH {CLOSED}, {PLACES} SELECT key, id FROM places p WHERE NOT EXISTS (SELECT 1 FROM up JOIN places q ON q.key = p.key AND q.id = up.{other} WHERE up.{mine} = p.id)"
ORACLES = {
    "kg_node_type_counts": "SELECT type, count(DISTINCT id) AS n_nodes FROM (SELECT 'drug' AS type, CAST(p_partkey AS VARCHAR) AS id FROM part UNION ALL SELECT 'disease', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'outcome', o_orderpriority FROM orders UNION ALL SELECT 'criterion', CAST(s_suppkey AS VARCHAR) FROM supplier) GROUP BY type",
    "kg_missing_endpoint_rejects": "SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "kg_relation_denylist": "SELECT event_type AS relation, count(*) AS n, count(DISTINCT user_id) AS n_src FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1",
    "arm_drug_sets": "SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 20, '0')) AS drugs FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1, 2",
    "arm_flags": "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS excluded, bool_or(l_linestatus = 'O') AS running, count(DISTINCT l_linenumber) AS n_arms FROM lineitem GROUP BY 1",
    "arm_eligibility_edges": "SELECT l_suppkey, relation, count(*) AS n_trials FROM (SELECT DISTINCT l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'exclusion' ELSE 'inclusion' END AS relation FROM lineitem) GROUP BY 1, 2",
    "components_alias_parts": f"SELECT p_partkey AS node, rep AS component FROM ({MERGED}) WHERE members > 1",
    "contract_multigraph": f"SELECT l_suppkey AS src, rep AS dst, 'tests' AS relation, count(*) AS n FROM lineitem JOIN ({MERGED}) ON l_partkey = p_partkey GROUP BY 1, 2",
    "closure_geo": f"WITH {CLOSED} SELECT node, ancestor, depth FROM up",
    "filter_general_ids": _independent("node", "ancestor"),
    "filter_specific_ids": _independent("ancestor", "node"),
    "cut_tree_level": "SELECT o_orderkey AS key, 'n' || c_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey",
    "propagate_to_ancestors": f"WITH {CLOSED}, p AS (SELECT 'c' || o_custkey AS id, o_orderpriority AS value FROM orders) SELECT id, count(*) AS n_values FROM (SELECT id, value FROM p UNION SELECT ancestor, value FROM p JOIN up ON id = node) GROUP BY id",
    "fanout_bridge": "SELECT DISTINCT o_orderpriority AS src, n_name AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "frequency_threshold_network": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 30) GROUP BY 1",
    "predecessor_pairs": "WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority[1] AS p, year(o_orderdate) AS s, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE year(o_orderdate) + 1 END AS e FROM orders) SELECT DISTINCT a.id AS before, b.id FROM o a JOIN o b ON a.p = b.p AND a.id <> b.id AND abs(a.c - b.c) <= 1 AND a.e <> 0 AND a.e <= b.s",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "last_writer": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "bidirectional_edges": "SELECT o_orderkey AS src, o_custkey AS dst, CAST(o_orderkey % 3 AS INT) AS etype FROM orders UNION ALL SELECT o_custkey, o_orderkey, CAST(o_orderkey % 3 + 3 AS INT) FROM orders",
    "khop_two_neighbours": "SELECT 'r' || r_regionkey AS node, 0 AS hop FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer",
    "negative_samples_modular": "WITH x AS (SELECT l_orderkey AS h, CAST(l_linenumber AS BIGINT) AS r, l_partkey AS t, i, (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + i * 101) % 997 AS d FROM lineitem, range(4) AS g(i)) SELECT h, r, t, i, CASE WHEN i < 2 THEN d ELSE h END AS neg_h, CASE WHEN i < 2 THEN t ELSE d END AS neg_t FROM x",
    "entity_vocabulary": "SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT p_name AS value FROM part)",
    "name_priority_match": "WITH n AS (SELECT lower(p_brand) AS name, p_partkey AS id, p_partkey % 7 AS rank, ['primary', 'synonym', 'brand', 'product', 'mixture', 'external', 'chemical'][p_partkey % 7 + 1] AS category FROM part), b AS (SELECT name, min(rank) AS rank FROM n GROUP BY 1) SELECT name, category, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM n JOIN b USING (name, rank) GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
