"""Readers and sinks on literal files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import builders, trials
from kgspark.sources import readers, sinks

CONCEPT = "{cui}|{lat}|{ts}|L1|PF|S1|{pref}|A1||SC1||{sab}|PT|{code}|{name}|0|{sup}|256|"
RELATION = "{c1}|A|CUI|{rel}|{c2}|A|CUI|{rela}|R1||{sab}|{sab}|||{sup}||"


def put(folder, name, text):
    path = folder / name
    (gzip.open(path, "wt", encoding="utf-8") if name.endswith(".gz") else open(path, "w", encoding="utf-8")).write(text)
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_headings_keep_the_last_record_and_the_wanted_categories(spark, tmp_path):
    text = (
        "*NEWREC\nRECTYPE = D\nMH = Asthma\nENTRY = Bronchial Asthma|T047|NON\nENTRY = Asthma, Bronchial\nMN = C08.127.108\nMN = C08.381.495.108\nMN = E01.1\nMS = A form of disorder.\nUI = D001249\n\n"
        "*NEWREC\nMH = Calcimycin\nMN = D03.633\nUI = D000001\n\n"
        "*NEWREC\nMH = Fear\nPRINT ENTRY = Dread|T041\nMN = F01.470.361\nMN = F02.5\nUI = D005239\n"
    )
    found = {r.id: r for r in readers.headings(spark, put(tmp_path, "d.bin", text)).collect()}
    assert sorted(found) == ["D001249", "D005239"]
    assert found["D001249"].entries == ["Asthma, Bronchial", "Bronchial Asthma"] and found["D001249"].tree_numbers == ["C08.127.108", "C08.381.495.108"]
    assert found["D001249"].name == "Asthma" and found["D001249"].note == "A form of disorder." and found["D005239"].entries == ["Dread"]


def test_supplementary_headings(spark, tmp_path):
    text = "*NEWREC\nNM = x\nHM = *Asthma\nHM = Fear\nUI = C000001\n\n*NEWREC\nHM = *Nose Diseases\nUI = C000002\n"
    assert rows(readers.supplementary_headings(spark, put(tmp_path, "c.bin", text))) == [("C000001", ["asthma", "fear"]), ("C000002", ["nose diseases"])]


def test_ontology(spark, tmp_path):
    text = (
        "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: biological_process\nalt_id: GO:11\nalt_id: GO:12\nis_a: GO:2 ! two\nrelationship: part_of GO:3 ! three\n\n"
        "[Term]\nid: GO:2\nname: two\nnamespace: biological_process\n\n[Term]\nid: GO:3\nname: three\nnamespace: cellular_component\nis_obsolete: true\n\n[Typedef]\nid: part_of\nname: part of\n"
    )
    found = {r.id: r for r in readers.ontology(spark, put(tmp_path, "go.obo", text)).collect()}
    assert sorted(found) == ["GO:1", "GO:2", "GO:3"]
    one = found["GO:1"]
    assert (one.name, one.parents, [tuple(r) for r in one.relations], one.alt_ids, one.obsolete) == ("one", ["GO:2"], [("part_of", "GO:3")], ["GO:11", "GO:12"], False)
    assert found["GO:3"].obsolete and found["GO:3"].name == "three"
    g = builders.function_graph(readers.ontology(spark, str(tmp_path / "go.obo")))
    assert rows(g.edges.select("src", "dst", "relation")) == [("FUNCTION:GO:GO:1", "FUNCTION:GO:GO:11", "KG-MERGE-SAME"), ("FUNCTION:GO:GO:1", "FUNCTION:GO:GO:12", "KG-MERGE-SAME"), ("FUNCTION:GO:GO:1", "FUNCTION:GO:GO:2", "is_a")]


def test_concepts_and_relations(spark, tmp_path):
    line = lambda **k: CONCEPT.format(**({"lat": "ENG", "ts": "P", "pref": "Y", "sab": "MSH", "code": "D1", "sup": "N"} | k))
    text = "\n".join([line(cui="C1", name="first"), line(cui="C1", name="last", sab="RXNORM", code="9"), line(cui="C2", name="un", lat="GER"), line(cui="C3", name="x", sup="O", code="D3"), line(cui="C3", name="y", ts="S", sup="", code="D4")]) + "\n"
    path = put(tmp_path, "names.rrf", text)
    assert rows(readers.concept_names(spark, path)) == [("C1", "last"), ("C3", "x")]
    assert rows(readers.concept_codes(spark, path)) == [("C1", "MSH", "D1"), ("C1", "RXNORM", "9"), ("C2", "MSH", "D1"), ("C3", "MSH", "D4")]
    rel = lambda **k: RELATION.format(**({"rela": "isa", "sab": "MTH", "sup": "N"} | k))
    found = rows(readers.relations(spark, put(tmp_path, "rel.rrf", "\n".join([rel(c1="P", rel="CHD", c2="K")] * 2))))
    assert found == [("CHD", "P", "K", "isa", "MTH", "MTH", "N")]


def test_lines_of_another_arity_raise(spark, tmp_path):
    with pytest.raises(Exception, match="another arity"):
        readers.rrf(spark, put(tmp_path, "bad.rrf", "a|b|\na|\n"), ["x", "y"]).collect()


def test_tables_of_text(spark, tmp_path):
    assert rows(readers.tsv(spark, put(tmp_path, "e.tsv", 'a\tb\n1\t"x\n2\ty\n'), ["a", "b"])) == [("1", '"x'), ("2", "y")]
    assert rows(readers.csv_table(spark, put(tmp_path, "t.csv", 'nct_id,condition\nN1,"(\'a\',\n\'b\')"\n'), ["nct_id", "condition"])) == [("N1", "('a',\n'b')")]
    assert rows(readers.id_mapping(spark, put(tmp_path, "m.tab.gz", "P1\tx\t10\tmore\nP2\tx\t20\nP1\tx\t11\n"))) == [("P1", "11"), ("P2", "20")]
    text = "# remark\n# Fields:\n# ChemicalName\tChemicalID\n#\nasp\tMESH:D1\n\nibu\n"
    assert rows(readers.commented_tsv(spark, put(tmp_path, "c.tsv.gz", text), ["name", "id"])) == [("asp", "MESH:D1"), ("ibu", None)]
    gaf = "!gaf-version: 2.1\n" + "".join(f"UniProtKB\tP{k}\tS\t\tGO:{k}\tref\t{code}\t\t{a}\tname\t\tprotein\ttaxon:9606\t2020\tX\n" for k, (code, a) in enumerate([("IDA", "P"), ("IEA", "P"), ("EXP", "F")]))
    found = readers.associations(spark, put(tmp_path, "g.gaf", gaf))
    assert rows(found.select("db_id", "go_id", "namespace")) == [("P0", "GO:0", "BP"), ("P2", "GO:2", "MF")]


def test_drug_dump_and_synonyms(spark, tmp_path):
    xml = (
        '<drugbank><drug type="x"><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>APR1</drugbank-id><name>Aspirin</name>'
        "<synonyms><synonym>ASA</synonym><synonym> </synonym></synonyms><international-brands><international-brand><name>Aspro</name><company/></international-brand></international-brands></drug>"
        '<drug type="y"><drugbank-id primary="true">DB2</drugbank-id><name>Water</name></drug></drugbank>'
    )
    assert rows(readers.drug_names(spark, put(tmp_path, "d.xml", xml))) == [("DB1", ["Aspirin", "ASA", "Aspro"]), ("DB2", ["Water"])]
    names, drugs = readers.synonyms(spark, put(tmp_path, "s.tsv", "DB1\tAspirin|ASA \nDB2\tWater|asa\n"))
    assert rows(names) == [("asa", "DB2"), ("aspirin", "DB1"), ("water", "DB2")] and rows(drugs) == [("DB1", "aspirin"), ("DB2", "water")]


@pytest.mark.parametrize("order", list(readers.TRIPLE_ORDERS))
def test_triples_in_any_order(spark, tmp_path, order):
    # Named by where head, relation and tail stand: the place of each letter, but for two orders that name the column each takes.
    at = readers.TRIPLE_ORDERS[order]
    line = ["", "", ""]
    for letter, k in zip("hrt", at, strict=True):
        line[k] = letter
    assert rows(readers.triples(spark, put(tmp_path, f"{order}.txt", "\t".join(line) + "\n"), order)) == [("h", "r", "t")]


def test_dictionaries_extra_edges_and_strict_lookup(spark, tmp_path):
    entities = readers.dictionary(spark, put(tmp_path, "entities.dict", "0\ta\n1\tb\tcode\n"))
    names = readers.dictionary(spark, put(tmp_path, "relations.dict", "0\tsource-GO:rel-name-is_a\n"))
    assert rows(entities) == [(0, "a", None), (1, "b", "code")]
    assert names.select(readers.relation_name(F.col("name"))).first()[0] == "is_a"
    triples = readers.triples(spark, put(tmp_path, "t.tsv", "a\tsource-GO:rel-name-is_a\tb\n"))
    triples = readers.with_optional(triples, put(tmp_path, "extra.tsv", "b\tsource-GO:rel-name-is_a\tz\n"), readers.triples)
    assert readers.with_optional(triples, None, readers.triples) is triples
    good, bad = readers.encoded(triples, entities, names)
    assert rows(good) == [(0, 0, 1)] and rows(bad) == [("b", "source-GO:rel-name-is_a", "z")]


def test_clusters_are_numbered_by_line(spark, tmp_path):
    text = "".join(f"tok{k}, of it\t{k}\n" for k in range(300))
    found = readers.numbered_clusters(spark, put(tmp_path, "v.txt", text)).collect()
    assert sorted((r.id, r.cluster, r["count"], r.tokens) for r in found) == [(k, f"tok{k}, of it", k, [f"tok{k}", "of it"]) for k in range(300)]


def test_embeddings_caches_and_chunks(spark, tmp_path):
    assert rows(readers.embedding_table(spark, put(tmp_path, "e.csv", ",V1,V2\nC1,0.5,1\n"), 2)) == [("C1", [0.5, 1.0])]
    cache = str(tmp_path / "cache")
    for k in (1, 2):
        sinks.append_cache(spark.createDataFrame([("a", k), (f"b{k}", k)], "term string, seq int"), cache)
    assert rows(readers.cached_terms(spark, cache, "term", "seq")) == [("a", 2), ("b1", 1), ("b2", 2)]
    for k in (1, 2):
        put(tmp_path, f"chunk{k}.json", json.dumps({f"N{k}_0": ["x", "y"], f"N{k}_1": []}))
    assert rows(readers.regrouped_chunks(spark, f"{tmp_path}/chunk*.json")) == [("N1", "0", ["x", "y"]), ("N1", "1", []), ("N2", "0", ["x", "y"]), ("N2", "1", [])]
    with pytest.raises(ValueError):
        readers.table(spark, "x.pkl")


def test_records_are_projected(spark, tmp_path):
    record = {
        "protocolSection": {
            "identificationModule": {"nctId": "N1"},
            "armsInterventionsModule": {"armGroups": [{"label": "A", "type": "EXPERIMENTAL", "description": "d"}], "interventions": [{"type": "DIETARY_SUPPLEMENT", "name": "zinc", "armGroupLabels": ["A"]}]},
            "conditionsModule": {"conditions": ["Asthma"]},
            "outcomesModule": {"primaryOutcomes": [{"measure": "FEV1"}]},
            "eligibilityModule": {"eligibilityCriteria": "adults", "sex": "ALL"},
            "descriptionModule": {"briefSummary": "s"},
        }
    }
    read = readers.records(spark, put(tmp_path, "r.json", json.dumps(record, indent=1)))
    trial = trials.project(read)
    r = trial.first()
    assert r.nct_id == "N1" and r.arm_group[0].arm_group_label == "A" and r.intervention[0].intervention_type == "Dietary_Supplement"
    assert r.maximum_age is None and r.clinical_results is None and r.intervention_mesh_terms is None
    assert rows(trials.arm_texts(trial)) == [("N1", 0, "zinc  Asthma  FEV1  A d s   adults")]


def test_sinks_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "2001/02"), ("c", "d", "2003")], "src string, dst string, year string")
    sinks.edge_tsv(edges, f"{tmp_path}/tsv")
    assert rows(readers.tsv(spark, f"{tmp_path}/tsv", ["src", "dst", "year"])) == rows(edges)
    sinks.edge_lists_by(edges, "year", f"{tmp_path}/lists")
    assert sorted(p.name for p in (tmp_path / "lists").iterdir() if p.is_dir()) == ["year=2001_02", "year=2003"]
    many = spark.range(2500).coalesce(1)
    sinks.batches(many, f"{tmp_path}/json", 1000)
    sinks.id_batches(many, "id", f"{tmp_path}/ids", 1000)
    sizes = lambda name: sorted(sum(1 for _ in open(p)) for p in (tmp_path / name).glob("part-*"))
    assert sizes("json") == sizes("ids") == [500, 1000, 1000]
    sinks.report(edges, f"{tmp_path}/report")
    assert rows(spark.read.schema(edges.schema).json(f"{tmp_path}/report")) == rows(edges)
    sinks.dataset(edges, f"{tmp_path}/set")
    assert rows(readers.table(spark, f"{tmp_path}/set")) == rows(edges)
