import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import builders
from tests.plans_rows import most_rows


@pytest.mark.parametrize("ways", [0, 2, 64])
def test_counts_match_the_pairs(spark, monkeypatch, ways):
    monkeypatch.setattr(builders, "WAYS", ways)
    r = random.Random(5)
    some = lambda n: r.choice([None, *range(n)])
    left = [(some(9), some(3), some(6)) for _ in range(120)]
    right = [(some(6), some(12)) for _ in range(60)]
    want = {}
    for a, b, via in left:
        for via2, end in right:
            if via is not None and via == via2 and end is not None:
                want.setdefault((a, b), set()).add(end)
    frames = spark.createDataFrame(left, "a int, b int, via int"), spark.createDataFrame(right, "via int, e int")
    found = builders.bridged_counts(*frames, ["a", "b"], "via", "e").collect()
    assert {(x.a, x.b): x.n for x in found} == {k: len(v) for k, v in want.items()} and len(found) == len(want)


def _nodes(spark, ids, etype, source):
    return builders.nodes_of(ids.select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name")), etype, source, "id", "name")


def test_phenotype_counts_make_no_edges(spark):
    """Two chemicals of 2,000 drugs each (1,000 in common) meet 300 functions, one unknown."""
    drugs = spark.createDataFrame([("MESH:1", "|".join(map(str, range(2000)))), ("MESH:2", "|".join(map(str, range(1000, 3000)))), ("MESH:3", "")], "chemical_id string, drug_ids string")
    chemical = F.when(F.col("id") % 3 == 0, F.array(F.lit("MESH:1"), F.lit("MESH:2"))).otherwise(F.array(F.lit("MESH:1"), F.lit("MESH:3")))
    seen = spark.range(300).select(F.explode(chemical).alias("chemical_id"), F.col("id").cast("string").alias("phenotype_id"), F.lit("x").alias("phenotype_name"), F.lit("9606").alias("organism_id"), F.lit("affects^binding|affects^folding").alias("actions"))
    found = builders.drug_phenotype_counts(drugs, seen, _nodes(spark, spark.range(299), "FUNCTION", "GO"))
    assert most_rows(found) < 10_000  # 800,000 edges
    assert {(x.dst, x.relation): x.n for x in found.collect()} == {(f"FUNCTION:GO:{k}", "affects"): 2000 if k % 3 else 3000 for k in range(299)}


def test_gene_counts_make_no_edges(spark):
    n = 3000
    mappings = spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 2).alias("diseaseId"), F.lit("MSH").alias("vocabulary"), F.col("id").cast("string").alias("code"))
    genes = spark.range(n).select(F.col("id").cast("string").alias("geneId"), F.concat(F.lit("u"), F.col("id") % 3).alias("diseaseId"))
    found = builders.disease_gene_counts(mappings, genes, _nodes(spark, spark.range(n), "DISEASE", "MESH"), _nodes(spark, spark.range(n // 2), "PROTEIN", "ENTREZ"))
    assert most_rows(found) < 10_000  # 1.5 million edges
    assert {x.src: x.n for x in found.collect()} == {f"DISEASE:MESH:{k}": 500 for k in range(n)}


def test_counts_are_those_of_the_edges(spark):
    r = random.Random(8)
    pick = lambda *xs: r.choice([None, *xs])
    chemicals = [(pick("MESH:1", "2", "MESH:3"), pick("", "a", "a|b", "b||c", "c|d")) for _ in range(12)]
    seen = [(pick("MESH:1", "MESH:2", "3"), pick("1", "2", "9"), "x", r.choice(["9606", "10090"]), pick("R^e|affects^b", "affects^b|affects^c", "")) for _ in range(80)]
    chemicals, seen = spark.createDataFrame(chemicals, "chemical_id string, drug_ids string"), spark.createDataFrame(seen, "chemical_id string, phenotype_id string, phenotype_name string, organism_id string, actions string")
    functions = _nodes(spark, spark.range(1, 3), "FUNCTION", "GO")
    edges = builders.drug_phenotypes(builders.phenotypes(chemicals, seen), functions).groupBy("dst", "relation").count()
    counted = builders.drug_phenotype_counts(chemicals, seen, functions)
    assert sorted(map(tuple, counted.collect()), key=repr) == sorted(map(tuple, edges.collect()), key=repr) != []
    mappings = spark.createDataFrame([(pick("u", "v", "w"), r.choice(["MSH", "OMIM"]), pick("0", "1", "2", "5")) for _ in range(40)], "diseaseId string, vocabulary string, code string")
    genes = spark.createDataFrame([(pick("0", " 1", "1", "7"), pick("u", "v")) for _ in range(30)], "geneId string, diseaseId string")
    nodes = _nodes(spark, spark.range(3), "DISEASE", "MESH"), _nodes(spark, spark.range(3), "PROTEIN", "ENTREZ")
    edges = builders.disease_genes(mappings, genes, *nodes).groupBy("src").count()
    assert sorted(map(tuple, builders.disease_gene_counts(mappings, genes, *nodes).collect())) == sorted(map(tuple, edges.collect())) != []
