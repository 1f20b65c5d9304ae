"""Builders of the knowledge graph from vocabularies: each returns nodes and edges of one kind.

nodes: key, etype, id, source, name; edges: src, dst, relation, rel_source,
attrs (map of strings), between keys. Equivalences are edges of relation
graph.SAME. A builder that needs nodes of another one takes them and leaves
out edges whose end isn't among them; rejected() tells which.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators.graph import SAME, last_writer

# Ends that are reached in more ways than this stand alone, so a class's list of ways is short.
WAYS = 64

# The actions of a drug on a protein that are told apart; all others are `other`.
ACTIONS = ["inhibitor", "substrate", "antagonist", "agonist", "inducer"]
# The id of the placebo, and its name.
PLACEBO = "D#######"


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def key(etype: str, source: str, id: str | Column) -> Column:
    """A node's canonical key."""
    return F.concat(F.lit(f"{etype}:{source}:"), (F.col(id) if isinstance(id, str) else id).cast("string"))


disease_key = lambda id: key("DISEASE", "MESH", id)
drug_key = lambda id: key("DRUG", "DRUGBANK", id)
class_key = lambda id: key("DRUGONT", "CLASSYFIRE", id)
protein_key = lambda id: key("PROTEIN", "ENTREZ", id)
function_key = lambda id: key("FUNCTION", "GO", id)
concept_key = lambda id: key("UMLS", "UMLS", id)
outcome_key = lambda id: key("PRIMARY_OUTCOME", "CUSTOM_VOCAB", id)


def nodes_of(rows: DataFrame, etype: str, source: str, id: str, name: str) -> DataFrame:
    """One node per id; of several names the least."""
    of = rows.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("string").alias("id")).agg(F.min(name).alias("name"))
    return of.select(key(etype, source, "id").alias("key"), F.lit(etype).alias("etype"), "id", F.lit(source).alias("source"), "name")


def edges_of(rows: DataFrame, src: Column, dst: Column, relation: str | Column, source: str, attrs: Column | None = None) -> DataFrame:
    """One edge per (src, dst, relation); of several attrs the largest by their JSON."""
    relation = F.lit(relation) if isinstance(relation, str) else relation
    none = F.create_map().cast("map<string,string>")
    found = rows.select(src.alias("src"), dst.alias("dst"), relation.alias("relation"), F.lit(source).alias("rel_source"), (none if attrs is None else attrs).alias("attrs"))
    found = found.where("src is not null and dst is not null")
    ends = ["src", "dst", "relation", "rel_source"]
    if attrs is None:
        return found.dropDuplicates(ends)
    return found.groupBy(*ends).agg(F.max_by("attrs", F.to_json("attrs")).alias("attrs"))


def merged(*graphs: Graph) -> Graph:
    """All nodes, one per key, and all edges, one per (src, dst, relation, rel_source)."""
    nodes, edges = graphs[0]
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes), edges.unionByName(g.edges)
    return Graph(last_writer(nodes, ["key"], "name"), edges.groupBy("src", "dst", "relation", "rel_source").agg(F.max_by("attrs", F.to_json("attrs")).alias("attrs")))


def present(edges: DataFrame, nodes: DataFrame, end: str = "dst") -> DataFrame:
    """Edges whose end is a node."""
    return edges.join(nodes.select(F.col("key").alias(end)).distinct(), end, "left_semi").select(*edges.columns)


def rejected(edges: DataFrame, nodes: DataFrame, end: str = "dst") -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("key").alias(end)).distinct(), end, "left_anti").select(*edges.columns)


def disease_graph(terms: DataFrame, parents: DataFrame) -> Graph:
    """has_parent between diseases, and HEALTHY as a disease: terms(id, name), parents(child, parent)."""
    healthy = terms.sparkSession.createDataFrame([("HEALTHY", "HEALTHY")], "id string, name string")
    nodes = nodes_of(terms.select("id", "name").unionByName(healthy), "DISEASE", "MESH", "id", "name")
    return Graph(nodes, edges_of(parents, disease_key("child"), disease_key("parent"), "has_parent", "MESH"))


def drug_graph(drugs: DataFrame, classes: DataFrame) -> Graph:
    """Drugs under their classes: drugs(id, name, other_ids, direct_parent, alternative_parents), classes(id, name, parents).

    Other ids that start with DB but not with DBSALT are drugs that are the
    same; parents are named, and met by name among the classes.
    """
    aliases = drugs.select("id", "name", F.explode("other_ids").alias("other")).where(F.startswith("other", F.lit("DB")) & ~F.startswith("other", F.lit("DBSALT")))
    placebo = drugs.sparkSession.createDataFrame([(PLACEBO, "placebo")], "id string, name string")
    every = drugs.select("id", "name").unionByName(aliases.select(F.col("other").alias("id"), "name")).unionByName(placebo)
    nodes = nodes_of(every, "DRUG", "DRUGBANK", "id", "name").unionByName(nodes_of(classes, "DRUGONT", "CLASSYFIRE", "id", "name"))
    up = edges_of(classes.select("id", F.explode("parents").alias("parent")), class_key("id"), class_key("parent"), "is_a", "CLASSYFIRE")
    same = edges_of(aliases, drug_key("id"), drug_key("other"), SAME, "DRUGBANK")
    named = F.array_compact(F.array_union(F.coalesce("alternative_parents", F.array().cast("array<string>")), F.array("direct_parent")))
    under = drugs.select("id", F.explode(named).alias("parent")).join(classes.select(F.col("name").alias("parent"), F.col("id").alias("class")), "parent")
    return Graph(nodes, up.unionByName(same).unionByName(edges_of(under, drug_key("id"), class_key("class"), "has_parent", "DRUGBANK")))


def protein_graph(pairs: DataFrame) -> Graph:
    """Proteins that affect each other: pairs(node_1, node_2, node_1_name, node_2_name)."""
    side = lambda k: pairs.select(F.col(f"node_{k}").alias("id"), F.col(f"node_{k}_name").alias("name"))
    edges = edges_of(pairs, protein_key("node_1"), protein_key("node_2"), "affects", "MULTISCALE_INTERACTOME")
    return Graph(nodes_of(side(1).unionByName(side(2)), "PROTEIN", "ENTREZ", "id", "name"), edges)


def function_graph(terms: DataFrame, namespace: str = "biological_process") -> Graph:
    """Functions of one namespace, obsolete ones apart: readers.ontology()'s terms. Alternate ids are functions that are the same."""
    kept = terms.where((F.col("namespace") == namespace) & ~F.coalesce("obsolete", F.lit(False)))
    inside = terms.where(F.col("namespace") == namespace).select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    up = kept.select("id", F.explode(F.concat(F.col("relations"), F.transform("parents", lambda p: F.struct(F.lit("is_a").alias("relation"), p.alias("target"))))).alias("r")).select("id", "r.relation", "r.target")
    up = up.join(inside, "target")
    other = kept.select("id", "name", F.explode("alt_ids").alias("alt"))
    every = kept.select("id", "name").unionByName(up.select(F.col("target").alias("id"), F.col("target_name").alias("name"))).unionByName(other.select(F.col("alt").alias("id"), "name"))
    edges = edges_of(up, function_key("id"), function_key("target"), F.col("relation"), "GO")
    return Graph(nodes_of(every, "FUNCTION", "GO", "id", "name"), edges.unionByName(edges_of(other, function_key("id"), function_key("alt"), SAME, "GO")))


def protein_functions(rows: DataFrame, proteins: DataFrame) -> DataFrame:
    """Edges of rows(protein_entrez_id, function_id, evidence_code, function_namespace) in the BP namespace, of known proteins."""
    attrs = F.create_map(F.lit("evidence_code"), F.col("evidence_code"))
    edges = edges_of(rows.where("function_namespace = 'BP'"), protein_key("protein_entrez_id"), function_key("function_id"), "affects", "GAF", attrs)
    return present(edges, proteins, "src")


def _phenotype_sides(chemicals: DataFrame, interactions: DataFrame, organism: str) -> tuple[DataFrame, DataFrame]:
    drugs = chemicals.where("drug_ids <> ''").select(F.substring_index("chemical_id", ":", -1).alias("chemical"), F.explode(F.split("drug_ids", r"\|")).alias("drug_id"))
    actions = F.array_distinct(F.transform(F.split("actions", r"\|"), lambda a: F.substring_index(a, "^", 1)))
    seen = interactions.where(F.col("organism_id") == organism).select(F.substring_index("chemical_id", ":", -1).alias("chemical"), "phenotype_id", "phenotype_name", F.explode(actions).alias("relation"))
    return drugs, seen


def phenotypes(chemicals: DataFrame, interactions: DataFrame, organism: str = "9606") -> DataFrame:
    """(drug_id, phenotype_id, phenotype_name, relation) from chemicals(chemical_id, drug_ids with |) and interactions(chemical_id, phenotype_id, phenotype_name, organism_id, actions).

    A chemical's id loses its vocabulary's prefix; an interaction is what stands before ^.
    """
    drugs, seen = _phenotype_sides(chemicals, interactions, organism)
    return seen.join(drugs, "chemical").select("drug_id", "phenotype_id", "phenotype_name", "relation")


def drug_phenotypes(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges of phenotypes(), whose relation comes from the data, to known functions."""
    return present(edges_of(rows, drug_key("drug_id"), function_key("phenotype_id"), F.col("relation"), "CTD"), functions)


def drug_phenotype_counts(chemicals: DataFrame, interactions: DataFrame, functions: DataFrame, organism: str = "9606") -> DataFrame:
    """(dst, relation, n): the edges of drug_phenotypes() by function and relation, counted without making them."""
    drugs, seen = _phenotype_sides(chemicals, interactions, organism)
    known = present(seen.select(function_key("phenotype_id").alias("dst"), "relation", "chemical"), functions)
    return bridged_counts(known, drugs, ["dst", "relation"], "chemical", "drug_id")


def drug_targets(drugs: DataFrame, gene_of: DataFrame, organism: str = "9606") -> DataFrame:
    """(drug_id, accession, protein_entrez_id, type, action) of drugs(id, targets(type, actions, accessions(id, organism_id))), with gene_of(accession, gene)."""
    each = drugs.select(F.col("id").alias("drug_id"), F.explode("targets").alias("t")).select("drug_id", "t.type", F.array_join(F.coalesce("t.actions", F.array().cast("array<string>")), ",").alias("action"), F.explode("t.accessions").alias("p"))
    human = each.where(F.col("p.organism_id") == organism).select("drug_id", "type", "action", F.col("p.id").alias("accession"))
    return human.join(gene_of, "accession").select("drug_id", "accession", F.col("gene").alias("protein_entrez_id"), "type", "action")


def normalised_actions(action: Column) -> Column:
    """array of the actions in a comma-separated list; an empty list and unknown actions are `other`."""
    return F.array_distinct(F.transform(F.split(F.coalesce(action, F.lit("")), ","), lambda a: F.when(a.isin(ACTIONS), a).otherwise("other")))


def drug_proteins(rows: DataFrame, proteins: DataFrame) -> DataFrame:
    """Edges of rows(drug_id, protein_entrez_id, action), one per action, to known proteins."""
    each = rows.withColumn("relation", F.explode(normalised_actions(F.col("action"))))
    return present(edges_of(each, drug_key("drug_id"), protein_key("protein_entrez_id"), F.col("relation"), "DRUGBANK"), proteins)


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, via: str) -> DataFrame:
    """Distinct (src, dst): left(src, code) meets bridge(code, via), which meets right(via, dst); all many to many."""
    return left.join(bridge, "code").join(right, via).select("src", "dst").distinct()


def bridged_counts(left: DataFrame, right: DataFrame, keys: list[str], via: str, end: str) -> DataFrame:
    """(keys, n): how many different ends of right(via, end) each of left(keys, via) meets, without making the pairs.

    Ends that are reached in the same ways are a class of a size, under its
    least end; keys meet classes instead of ends. An end of more than WAYS ways
    is a class by itself.
    """
    ends = right.where(F.col(via).isNotNull() & F.col(end).isNotNull()).select(F.col(via).alias("_via"), F.col(end).alias("_end")).distinct()
    ways = ends.groupBy("_end").agg(F.count("*").alias("_ways"))
    few = ends.join(ways.where(F.col("_ways") <= WAYS), "_end").groupBy("_end").agg(F.sort_array(F.collect_list("_via")).alias("_by"))
    classes = few.groupBy("_by").agg(F.min("_end").alias("_end"), F.count("*").alias("_size")).select(F.explode("_by").alias("_via"), "_end", "_size")
    alone = ends.join(ways.where(F.col("_ways") > WAYS), "_end").select("_via", "_end", F.lit(1).cast("long").alias("_size"))
    met = left.select(*keys, F.col(via).alias("_via")).distinct().join(classes.unionByName(alone), "_via")
    return met.select(*keys, "_end", "_size").distinct().groupBy(*keys).agg(F.sum("_size").alias("n"))


def _disease_gene_sides(mappings: DataFrame, genes: DataFrame, diseases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = diseases.where("etype = 'DISEASE'").select(F.col("id").alias("code"), F.col("key").alias("src"))
    bridge = mappings.where("vocabulary = 'MSH'").select("code", "diseaseId")
    right = genes.select("diseaseId", protein_key(F.trim(F.col("geneId").cast("string"))).alias("dst"))
    return known, bridge, right


def disease_genes(mappings: DataFrame, genes: DataFrame, diseases: DataFrame, proteins: DataFrame) -> DataFrame:
    """dis-gene edges: mappings(diseaseId, vocabulary, code) of MSH codes that are diseases, genes(geneId, diseaseId) that are proteins."""
    known, bridge, right = _disease_gene_sides(mappings, genes, diseases)
    return present(edges_of(bridged(known, bridge, right, "diseaseId"), F.col("src"), F.col("dst"), "dis-gene", "DISGENET"), proteins)


def disease_gene_counts(mappings: DataFrame, genes: DataFrame, diseases: DataFrame, proteins: DataFrame) -> DataFrame:
    """(src, n): the edges of disease_genes() by disease, counted without making them."""
    known, bridge, right = _disease_gene_sides(mappings, genes, diseases)
    return bridged_counts(known.where("src is not null").join(bridge, "code"), present(right, proteins), ["src"], "diseaseId", "dst")


def concept_graph(concepts: DataFrame, names: DataFrame, codes: DataFrame, nodes: DataFrame) -> Graph:
    """Concepts (cui), named by names(cui, name), and the same as the known nodes that codes(cui, vocabulary, code) names in three vocabularies."""
    cuis = concepts.select("cui").distinct()
    named = cuis.join(names, "cui", "left").select("cui", F.coalesce("name", "cui").alias("name"))
    parts = [codes.where(F.col("vocabulary") == v).select("cui", k("code").alias("dst")) for v, k in (("MSH", disease_key), ("DRUGBANK", drug_key), ("GO", function_key))]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(cuis, "cui", "left_semi")
    same = present(edges_of(met, concept_key("cui"), F.col("dst"), SAME, "UMLS"), nodes)
    return Graph(nodes_of(named, "UMLS", "UMLS", "cui", "name"), same)


def outcome_nodes(clusters: DataFrame) -> DataFrame:
    """Nodes of readers.numbered_clusters()."""
    return nodes_of(clusters, "PRIMARY_OUTCOME", "CUSTOM_VOCAB", "id", "cluster")


def numbered(concepts: DataFrame, column: str = "concept") -> DataFrame:
    """(concept, kgid): KG and eight digits, in ascending order of the concepts."""
    from kgspark.operators.graph import vocabulary

    return vocabulary(concepts, column).select(F.col("value").alias(column), F.format_string("KG%08d", "id").alias("kgid"))
