"""Text, feature and record functions on literal inputs and outputs."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import features, stemmer, text
from kgspark.operators import arm_matching, builders, graph, labels, layers, linking, metrics, scoring, splits, trials


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("f, value, wanted", [
    (text.ascii_only, "naïve µ", "na ve  "),
    (text.squeeze, "  a \n\t b ", "a b"),
    (text.one_line, "a\n   b", "a b"),
    (text.criterion_term, "severe asthma (with", "asthma "),
    # An adjective goes with both its spaces, as in the published rule.
    (text.criterion_term, "severe chronic active asthma", "chronicasthma"),
    (text.criterion_term, "mild severe", ""),
    (text.criterion_term, "patient 's pain", "patient's pain"),
    (text.criterion_term, "left) side", " side"),
    (text.term_relaxations, "grade 3 non-small pain", ["grade 3 non-small pain", " non-small pain", " small pain", None]),
    (text.term_relaxations, "chronic pain", ["chronic pain", "chronic pain", "chronic pain", "pain"]),
    (text.term_relaxations, "liver pain", ["liver pain", "liver pain", "liver pain", None]),
    (text.term_relaxations, "uncontrollable pain", ["uncontrollable pain", "uncontrollable pain", "uncontrollable pain", "pain"]),
    (text.term_relaxations, "the liver", ["the liver", "the liver", "the liver", "liver"]),
    (text.split_alternatives, "asthma or copd and flu, cough", ["asthma", "copd", "flu", "cough"]),
    (text.clean_drug_name, "aspirin 100 mg tablets (oral)", "aspirin"),
    (text.clean_drug_name, "sodium citrate bid", "sodium"),
    (text.normalise_drug_name, "aspirin 100 mg and ibuprofen (advil)", ["aspirin", "ibuprofen", "advil"]),
    (text.normalise_drug_name, "sildenafil (citrate)", ["sildenafil"]),
    (text.normalise_drug_name, "zinc (iron 5 mg) salt", ["zinc", "iron", "salt"]),
    (text.clean_trial_drug_name, "inert placebo", "placebo"),
    (text.clean_trial_drug_name, '"aspirin" 100 mg tablets (oral)', "aspirin"),
    (text.clean_trial_drug_name, "administration of zinc + iron", "zinc"),
    (text.clean_trial_drug_name, "zinc 7 or iron", "zinc"),
    (text.clean_trial_drug_name, "gold and silver", "gold"),
    (text.clean_trial_drug_name, "iron 5 % bid", "iron %"),
    (text.normalise_drug_name, "placebo pill", ["placebo"]),
    (text.normalise_drug_name, "daily treatment for all subjects", ["placebo"]),
    (text.normalise_drug_name, "inhaled budesonide following surgery", ["budesonide"]),
    (text.alias_parts, "Aspirin (ASA)", ["Aspirin", "ASA"]),
    (text.alias_parts, "drug a + drug b", ["drug a", "drug b"]),
    (text.strip_code, ":abc-123-xr", "abc-123"),
    (text.strip_code, "abt-493-single", "abt-493"),
    (text.is_healthy, "Healthy Human Volunteers", True),
    (text.is_healthy, "asthma", False),
    (text.is_placebo, "saline", True),
    (text.is_placebo, "placebo followed by drug", False),
    (text.tokens, "Don't eat the Crème brûlée, who 42!", ["dont", "eat", "creme", "brulee", "who"]),
    (text.list_literal, "('a', 'b c')", ["a", "b c"]),
    (text.list_literal, "()", []),
    (text.year_of, "March 2015", 2015),
    (text.year_of, None, None),
    (text.canonical_tokens, "b c a", "abc"),
    (lambda c: text.rewritten(c, text.NAME_REWRITES), "estrogen", "estradiol"),
    (lambda c: text.rewritten(c, text.SPECIAL_CONDITIONS), "ADHD", "Attention Deficit Disorder with Hyperactivity"),
    (lambda c: text.medication_text(F.lit("Aspirin"), c), "take  aspirin", "medication: take aspirin"),
    (lambda c: text.medication_text(F.lit("Aspirin"), c), "one pill", "medication: Aspirin one pill"),
    (lambda c: text.complete_code(c, F.lit("Study of abt-493-x in adults")), "abt-493", "abt-493-x"),
    (lambda c: text.interferon(c, F.lit("peg-interferon alfa-2a")), "interferon", "peginterferon alfa-2a"),
    (trials.titled, "DIETARY_supplement 2x", "Dietary_Supplement 2X"),
    (builders.normalised_actions, "", ["other"]),
    (builders.normalised_actions, "agonist,binder", ["agonist", "other"]),
    (lambda c: text.without_accents(c), "ÀÉîõüñçÿŁžḁ", "AEiouncyŁza"),
])
def test_text(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_mention_lines(spark):
    line = "N1_0\taspirin 5 mg|aspirin[0,7]|bayer|tablet|5 mg|||daily|||C1|r1|r2|asa"
    r = one(spark, line, text.mention_fields)
    assert (r.id, r.text, r.drug, r.brand, r.form, r.strength, r.frequency, r.cui, r.rxnorm_generic, r.generic) == ("N1_0", "aspirin 5 mg", "aspirin", "bayer", "tablet", "5 mg", "daily", "C1", "r2", "asa")


@pytest.mark.parametrize("titles, wanted", [(["arm one drug", "arm two drug"], " drug"), (["arm one", "arm two"], "arm "), (["abc"], "abc"), (["x", "y"], ""), (["", "a"], "")])
def test_common_part(spark, titles, wanted):
    assert one(spark, titles, arm_matching.common_part, "array<string>") == wanted


def test_hits_and_properties(spark):
    hits = [("x", "A"), ("y", "B"), ("z", "C")]
    kind = "array<struct<id:string,source:string>>"
    assert one(spark, hits, lambda c: text.preferred_hit(c, ["C", "B"])["id"], kind) == "y"
    assert one(spark, hits, lambda c: text.preferred_hit(c, ["Q"])["id"], kind) == "x"
    assert one(spark, hits, lambda c: text.preferred_hit(c, ["C"], 2)["id"], kind) == "x"
    assert one(spark, [("logP", "1"), ("SMILES", "CC")], lambda c: text.property_value(c, "SMILES"), "array<struct<kind:string,value:string>>") == "CC"
    assert one(spark, None, lambda c: text.property_value(c, "SMILES"), "array<struct<kind:string,value:string>>") == ""


@pytest.mark.parametrize("low, high, wanted", [("18 Years", "64 Years", [0, 1, 0]), (None, None, [1, 1, 1]), ("6 Months", "17 Years", [1, 0, 0]), ("65 Years", "N/A", [0, 0, 1]), ("30 Years", "80 Years", [0, 1, 1]), ("5 Years", "40 Years", [1, 1, 0])])
def test_age_classes(spark, low, high, wanted):
    row = spark.createDataFrame([(low, high)], "a string, b string").select(features.age_classes(F.col("a"), F.col("b"))).first()[0]
    assert row == wanted


def test_features(spark):
    assert one(spark, "Phase 1/Phase 2", features.phase_vector) == [0, 1, 1, 0, 0] and one(spark, "Phase 9", features.phase_vector) is None
    assert tuple(one(spark, "Phase 2/Phase 3", features.phase_bounds)) == (2, 3)
    assert one(spark, None, features.sex_vector) == [0, 0, 0]
    assert one(spark, None, lambda c: features.enrollment_vector(c, F.lit("Anticipated")), "long") == [0, 0]
    assert one(spark, "3 Weeks", features.age_vector) == [0, 0, 0, 0] and one(spark, "1 Week", features.age_vector) == [0, 0, 0, 7]
    assert one(spark, ["b", "z"], lambda c: features.multi_hot(c, ["a", "b"]), "array<string>") == [0, 1]
    assert one(spark, [0.0, 0.0], features.softmaxed, "array<double>") == [0.5, 0.5]
    assert [one(spark, p, features.frequency_class, "double") for p in (0.0, 0.00005, 0.0005, 0.005, 0.05, 0.5)] == [1, 1, 2, 3, 4, 5]
    assert one(spark, 0.0, lambda c: features.binary_cross_entropy(c, F.lit(1.0), 2.0), "double") == pytest.approx(1.386294)


def test_porter_stems_of_the_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "is": "is"}
    assert {w: stemmer.stem(w) for w in pairs} == pairs


def test_mentions_of_a_drug_merge_unless_they_contradict(spark):
    rows = [("t", "aspirin", 1, "5 mg", ""), ("t", "aspirin", 2, "5", "daily"), ("t", "aspirin", 3, "9 mg", "daily"), ("t", "zinc", 1, "", None)]
    found = trials.merged_mentions(spark.createDataFrame(rows, "trial string, name string, seq int, strength string, frequency string"), ["trial"], ["strength", "frequency"])
    assert sorted(map(tuple, found.collect())) == [("t", "aspirin", "5 mg", "daily"), ("t", "aspirin", "9 mg", "daily"), ("t", "zinc", "", "")]


def test_event_counts_are_flattened_in_order(spark):
    categories = [("Cardiac", [("MI", [("G1", 1, 10, 2), ("G2", 0, None, 0)]), (None, [("G1", 3, None, 3)])])]
    kind = "nct_id string, event_type string, categories array<struct<title:string,events:array<struct<sub_title:string,counts:array<struct<group_id:string,affected:int,at_risk:int,events:int>>>>>>"
    counts = trials.event_counts(spark.createDataFrame([("N1", "serious_events", categories)], kind))
    groups = spark.createDataFrame([("N1", "G1", "0")], "nct_id string, group_id string, arm_id string")
    r = trials.category_events(counts, groups).first()
    assert (r.category, [tuple(e) for e in r.events]) == ("cardiac", [("MI", 1, 10, 2), ("NONE", 3, 10, 3)])
    edge = trials.category_edges(trials.category_events(counts, groups)).first()
    assert (edge.src, edge.dst, edge.relation) == ("TRIAL_ARM:CLINICAL_TRIAL:N1:0", "SIDE_EFFECT_CAT:CLINICAL_TRIAL:cardiac", "has_side_effect_category_serious_events")
    cuis = spark.createDataFrame([("mi", "C9")], "event string, cui string")
    assert [(e.dst, e.attrs["affected"], e.attrs["at_risk"]) for e in trials.event_edges(counts, groups, cuis).collect()] == [("SIDE_EFFECT:UMLS:C9", "1", "10")]


def test_graphs_are_merged_and_hierarchies_built(spark):
    terms = spark.createDataFrame([("D1", "a", "C01"), ("D2", "b", "C01.1"), ("D3", "c", "C01.1.5"), ("D3", "c", "C02.7")], "id string, name string, tree_number string")
    parents = graph.tree_parents(terms)
    assert sorted(map(tuple, parents.collect())) == [("D2", "D1"), ("D3", "D2")]
    g = builders.disease_graph(terms.select("id", "name"), parents)
    both = builders.merged(g, g)
    assert both.nodes.count() == 4 and both.edges.count() == 2
    assert one(spark, ["C01.1.5", "C02"], graph.tree_level, "array<string>") == 1
    assert builders.rejected(g.edges, g.nodes.where("id <> 'D1'")).count() == 1


def test_sampling_and_splits(spark):
    rows = spark.range(2000).withColumn("y", (F.col("id") % 20 == 0).cast("int"))
    drawn = splits.drawn(rows, "id", 3000).groupBy("id").count()
    total, most = drawn.agg(F.sum("count"), F.max("count")).first()
    assert total == 3000 and most > 2
    balanced = splits.balanced(rows, "y", "id", 10, replace=True)
    assert balanced.where("y = 1").count() == 100 and balanced.where("y = 0").count() == 1000
    assert 850 < splits.balanced(rows, "y", "id", 10).where("y = 0").count() < 1150
    assert splits.repeated(rows.limit(100), 512).count() == 600
    shares = {r.split: r.n for r in splits.split_counts(splits.random_split(rows, "id")).collect()}
    assert 1300 < shares["train"] < 1500 and 240 < shares["val"] < 360
    arms = rows.select(splits.by_arms((F.col("id") % 2) + 1, F.col("id")).alias("split"), "id")
    assert arms.where("id % 2 = 0 and split <> 'train'").count() == 0 and 200 < arms.where("split = 'train' and id % 2 = 1").count() < 300
    assert splits.by_year_left_out(F.lit(2010), F.lit(2012), 2010, "since-start") is not None
    divided = graph.divide_edges(rows.select(F.col("id").alias("h"), F.lit(1).alias("r"), F.col("id").alias("t")))
    assert 500 < divided.where("supervised").count() < 700
    assert [splits_ for splits_ in spark.createDataFrame([("val",), ("test",), ("train",)], "s string").select(splits.train_on_validation(F.col("s"))).toPandas().iloc[:, 0].tolist()] == ["train", "test", None]
    assert labels.unmirrored(spark.createDataFrame([(1, 2, "train"), (2, 1, "train"), (3, 4, "train"), (4, 3, "val")], "arm1 int, arm2 int, split string")).count() == 1


def test_vocabulary_in_order_of_first_meeting(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0), (None, 4)], "v string, seq int")
    assert sorted((r.id, r.value) for r in graph.vocabulary(rows, "v", seq="seq").collect()) == [(0, "c"), (1, "b"), (2, "a")]
    assert sorted((r.v, r.id) for r in graph.with_ids(rows.where("v is not null"), "v").collect()) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def test_fan_out_keeps_so_many_neighbours(spark):
    edges = spark.range(1, 50).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    seeds = spark.createDataFrame([(0,)], "node long")
    assert graph.k_hop(seeds, edges, 1, fan_out=7).count() == 8 and graph.k_hop(seeds, edges, 1).count() == 50


def test_relational_layer_by_hand(spark):
    """Two nodes send over relation 0, one over relation 1."""
    features_ = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "node long, vector array<double>")
    edges = spark.createDataFrame([(1, 3, 0), (2, 3, 0), (1, 2, 1)], "src long, dst long, etype int")
    weights = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (0, 0, 1, [1.0, 2.0]), (1, 0, 0, [0.5, 0.0]), (1, 0, 1, [0.0, 0.5])], "relation int, block int, row int, values array<double>")
    root, bias = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row int, values array<double>"), spark.createDataFrame([(0, 0.1), (1, 0.2)], "place int, value double")
    out = {r.node: r.vector for r in layers.relational_layer(edges, features_, weights, root, bias).collect()}
    assert out[1] == pytest.approx([1.1, 2.2]) and out[2] == pytest.approx([3.1 + 0.5, 4.2 + 1.0]) and out[3] == pytest.approx([5.1 + 2 + 3, 6.2 + 6])
    same = scoring.relation_concat(edges, features_, [0, 1], 2, weights={0: 2.0, 1: 1.0}).where("node = 3").first().vector
    assert same == pytest.approx([5 + 4, 6 + 6])


def test_embeddings_heads_and_losses(spark):
    nodes = spark.createDataFrame([(1, "DRUG", [1.0]), (2, "DRUG", None), (3, "X", [1.0, 2.0])], "node long, etype string, vector array<double>")
    assert one(spark, [1.0, -3.0], lambda c: scoring.residual(c, F.array(F.lit(1.0), F.lit(1.0)), "res"), "array<double>") == [2.0, 0.0]
    assert one(spark, 2.0, lambda c: scoring.uncertainty_weighted([(c, F.lit(0.0)), (scoring.squared_error(c, F.lit(1.0)), F.lit(0.0))]), "double") == 3.0
    assert scoring.regularisation(nodes.where("vector is not null"), "vector", 3.0).first()[0] == pytest.approx(6.0)


def test_attention_over_all_neighbours_with_a_slope(spark):
    import numpy as np

    v = {1: [1.0, 0.0], 2: [0.0, -1.0], 3: [0.5, 0.5]}
    features_ = spark.createDataFrame(list(v.items()), "node long, vector array<double>")
    edges = spark.createDataFrame([(1, 3, 0), (2, 3, 1)], "src long, dst long, etype int")
    s = np.array([np.dot(v[1], v[3]), 0.2 * np.dot(v[2], v[3])])
    w = np.exp(s) / np.exp(s).sum()
    out = scoring.attention(edges, features_, ["dst"], slope=0.2, scaled=False).first().vector
    assert out == pytest.approx((w[0] * np.array(v[1]) + w[1] * np.array(v[2])).tolist())


def test_features_of_arms_and_outcomes(spark):
    f = spark.createDataFrame
    arms = f([("T1:0",), ("T1:1",), ("T2:0",)], "key string")
    found = labels.arm_vectors(arms, f([("T1", [1.0, 2.0]), ("T2", [3.0, 4.0])], "trial string, vector array<double>"), f([("T1", [9.0])], "trial string, vector array<double>"))
    assert sorted(map(tuple, found.collect())) == [("T1:0", [1.0, 2.0, 9.0]), ("T1:1", [1.0, 2.0, 9.0])]
    members = [("a", "TRIAL_ARM", "T1:0"), ("b", "FUNCTION", "x"), ("c", "UMLS", "x"), ("c", "PRIMARY_OUTCOME", "y"), ("d", "UMLS", "x"), ("d", "DRUGONT", "y")]
    vectors_ = found.unionByName(f([("x", [1.0]), ("y", [2.0])], "key string, vector array<double>"))
    out = labels.concept_features(f(members, "concept string, etype string, key string"), vectors_)
    assert sorted(map(tuple, out.collect())) == [("a", "TRIAL_ARM", [1.0, 2.0, 9.0]), ("c", "PRIMARY_OUTCOME", [2.0]), ("d", "UMLS", [1.0])]


def test_metrics_of_ties_and_one_class_labels(spark):
    rows = [("a", k, y, p) for k, (y, p) in enumerate([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)])] + [("b", 9, 1, 0.5)]
    scores = spark.createDataFrame(rows, "label_id string, example_id int, y int, p double")
    assert [tuple(r) for r in metrics.auroc(scores, ["label_id"]).collect()] == [("a", 0.625)]
    assert metrics.balanced_auprc(scores, ["label_id"], 20).first().balanced_auprc > 0
    assert metrics.macro(metrics.label_metrics(scores, ["label_id"])).first().n_labels == 1


def test_interventions_and_placebos(spark):
    codes = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", ""), ("2", "a"), ("2", "b")], "key string, code string")
    assert [tuple(r) for r in linking.consistent_code(codes, "key", "code").collect()] == [("1", "a")]


def test_trial_filters(spark):
    kind = "nct_id string, study_type string, enrollment int, intervention array<struct<intervention_type:string>>"
    rows = spark.createDataFrame([("1", "Interventional", 5, [("Drug",)]), ("2", "Interventional", 50, [("Device",)]), ("3", "Observational", 500, [("Drug",)])], kind)
    assert [r.nct_id for r in trials.drug_trials(rows).collect()] == ["1"]
    assert trials.larger_than(rows, "enrollment", 10).count() == 2 and trials.larger_than(rows, "enrollment", 0).count() == 3


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8])
def test_most_similar_rows_match_brute_force(spark, least):
    import random

    r = random.Random(8)
    texts = [(k, [r.choice("aaaabbbcdefghij") for _ in range(r.randint(2, 8))]) for k in range(60)]
    docs = spark.createDataFrame(texts, "id int, words array<string>")
    weights, _ = linking.tf_idf(docs, "id", "words", 1.0)
    vectors = {}
    for row in weights.collect():
        vectors.setdefault(row.id, {})[row.term] = row.w
    wanted = []
    for q in vectors:
        scored = sorted((-round(sum(w * vectors[i].get(t, 0) for t, w in vectors[q].items()), 6), i) for i in vectors if i % 2 and not q % 2)
        if scored and -scored[0][0] >= least:
            wanted.append((q, scored[0][1], -scored[0][0]))
    found = linking.most_similar(weights.where("id % 2 = 0").withColumnRenamed("id", "query"), weights.where("id % 2 = 1"), "query", "id", least)
    assert sorted((x.query, x.id, x.score) for x in found.collect()) == sorted(wanted)


def test_contraction_keeps_attributes(spark):
    edges = spark.createDataFrame([(1, 3, "r", "x"), (2, 3, "r", "a"), (1, 2, graph.SAME, "s"), (1, 4, "r", None)], "src int, dst int, relation string, attrs string")
    nodes = spark.createDataFrame([(k,) for k in range(1, 5)], "id int")
    concepts = graph.concept_map(nodes, edges.where(F.col("relation") == graph.SAME))
    assert sorted(map(tuple, graph.contract(edges, concepts).collect())) == [(1, 3, "r", 2, ["a", "x"]), (1, 4, "r", 1, [])]
    assert sorted(map(tuple, graph.contracted_attrs(edges, concepts).collect())) == [(1, 3, "r", "a"), (1, 3, "r", "x")]
    assert sorted(r.n for r in graph.contract(edges, concepts, lists=False).collect()) == [1, 2]
