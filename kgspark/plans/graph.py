"""Knowledge-graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def kg_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: edge counts by (head, relation, tail) after aliases of a part are merged."""
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    rep = t("part").select("p_partkey", F.min("p_partkey").over(W.partitionBy("p_brand", "p_type", "p_size")).alias("rep"), "p_brand")
    # Lines meet their parts and orders once; an arm is its two numbers until it is counted.
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    joined = line.join(rep.select("p_partkey", "rep"), line.l_partkey == rep.p_partkey, "left").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), line.l_orderkey == F.col("o_orderkey"), "left")
    ends = F.array(
        F.struct(F.lit("arm_tests_drug").alias("relation"), F.lit("drug").alias("tail"), F.col("rep").cast("string").alias("dst")),
        F.struct(F.lit("study-disease").alias("relation"), F.lit("disease").alias("tail"), F.col("o_custkey").cast("string").alias("dst")),
        F.struct(F.lit("primary_outcome").alias("relation"), F.lit("outcome").alias("tail"), F.col("o_orderpriority").alias("dst")),
    )
    tests = joined.select(F.lit("arm").alias("head"), F.struct("l_orderkey", "l_linenumber").alias("src"), F.inline(ends)).where("dst is not null")
    parent = rep.select(F.lit("drug").alias("head"), F.struct(F.col("rep").alias("l_orderkey"), F.lit(0).alias("l_linenumber")).alias("src"), F.lit("has_parent").alias("relation"), F.lit("drug_class").alias("tail"), F.col("p_brand").alias("dst"))
    edges = tests.unionByName(parent).distinct()
    return edges.groupBy("head", "relation", "tail").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


QUERIES = {"kg_edge_counts": kg_edge_counts}
ORACLES = {
    "kg_edge_counts": """
        WITH rep AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS rep, p_brand FROM part),
        edges AS (
          SELECT 'arm' AS head, 'arm_tests_drug' AS relation, 'drug' AS tail, l_orderkey || ':' || l_linenumber AS src, CAST(rep AS VARCHAR) AS dst
          FROM lineitem JOIN rep ON l_partkey = p_partkey
          UNION SELECT 'arm', 'study-disease', 'disease', l_orderkey || ':' || l_linenumber, CAST(o_custkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION SELECT 'arm', 'primary_outcome', 'outcome', l_orderkey || ':' || l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION SELECT 'drug', 'has_parent', 'drug_class', CAST(rep AS VARCHAR), p_brand FROM rep)
        SELECT head, relation, tail, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY ALL""",
}
