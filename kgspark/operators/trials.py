"""Trial records: projection of the registry's JSON, arm texts, and the trials' part of the knowledge graph.

A projected trial has nct_id, arm_group, intervention, condition,
intervention_mesh_terms, primary_outcome, secondary_outcome,
eligibility_criteria, brief_summary, phase, enrollment, gender_sex,
minimum_age, maximum_age and event groups. The graph's builders take tables of
arms, labels and links, one row each, and join them; nothing is built per trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.builders import PLACEBO, disease_key, drug_key, edges_of, key, outcome_key

TRIAL = "CLINICAL_TRIAL"
TESTS = "arm_tests_drug"
# A trial's attributes and where its record holds them.
ATTRIBUTES = {
    "nct_id": "protocolSection.identificationModule.nctId",
    "arm_group": "protocolSection.armsInterventionsModule.armGroups",
    "intervention": "protocolSection.armsInterventionsModule.interventions",
    "condition": "protocolSection.conditionsModule.conditions",
    "intervention_mesh_terms": "derivedSection.conditionBrowseModule.meshes",
    "event_groups": "resultsSection.adverseEventsModule.eventGroups",
    "primary_outcome": "protocolSection.outcomesModule.primaryOutcomes",
    "secondary_outcome": "protocolSection.outcomesModule.secondaryOutcomes",
    "eligibility_criteria": "protocolSection.eligibilityModule.eligibilityCriteria",
    "brief_summary": "protocolSection.descriptionModule.briefSummary",
    "phase": "protocolSection.designModule.phases",
    "enrollment": "protocolSection.designModule.enrollmentInfo",
    "gender_sex": "protocolSection.eligibilityModule.sex",
    "minimum_age": "protocolSection.eligibilityModule.minimumAge",
    "maximum_age": "protocolSection.eligibilityModule.maximumAge",
}


def titled(c: Column) -> Column:
    """Each run of letters with a capital first and small letters behind, whatever stands between the runs."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def project(records: DataFrame, attributes: dict[str, str] = ATTRIBUTES) -> DataFrame:
    """One row per record with its attributes by their dotted paths; a path that isn't there gives null.

    Arms' labels and interventions' fields get the names that the rest of the
    library uses, types are titled, and event groups are wrapped as reported
    events, null where a record has none.
    """
    out = records.select(*[F.col(path).alias(name) for name, path in attributes.items()])
    if "arm_group" in attributes:
        out = out.withColumn("arm_group", F.transform("arm_group", lambda a: F.struct(a["label"].alias("arm_group_label"), a["type"].alias("arm_group_type"), a["description"].alias("description"))))
    if "intervention" in attributes:
        renamed = lambda i: F.struct(titled(i["type"]).alias("intervention_type"), i["name"].alias("intervention_name"), i["description"].alias("description"), i["otherNames"].alias("other_name"), i["armGroupLabels"].alias("arm_group_label"))
        out = out.withColumn("intervention", F.transform("intervention", renamed))
    if "event_groups" in attributes:
        wrapped = F.when(F.col("event_groups").isNotNull(), F.struct(F.struct(F.struct(F.col("event_groups").alias("group")).alias("group_list")).alias("reported_events")))
        out = out.withColumn("clinical_results", wrapped).drop("event_groups")
    return out


def arms_or_default(arms: Column) -> Column:
    """The arms, or one arm labelled default where there are none."""
    default = F.array(F.struct(F.lit("default").alias("arm_group_label"), F.lit("").alias("arm_group_type"), F.lit(None).cast("string").alias("description")))
    return F.coalesce(arms, default)


def drug_trials(trials: DataFrame, study_type: str = "study_type") -> DataFrame:
    """Interventional trials with an intervention of type Drug."""
    return trials.where((F.col(study_type) == "Interventional") & F.exists("intervention", lambda i: i["intervention_type"] == "Drug"))


def larger_than(rows: DataFrame, enrollment: str, least: int) -> DataFrame:
    """rows with an enrollment above `least`; all rows if that is 0 or less."""
    return rows.where(F.col(enrollment) > least) if least > 0 else rows


def arm_texts(trials: DataFrame) -> DataFrame:
    """(nct_id, arm, text): intervention, conditions, outcomes, arm, summary, intervention's description and criteria, joined by spaces.

    Of an arm's interventions the last one counts.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    spaced = lambda c: F.concat(F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(" "))), ""))
    rows = trials.withColumns({
        "_disease": spaced(F.col("condition")),
        "_outcome": spaced(F.transform("primary_outcome", lambda o: blank(o["measure"]))),
    }).select("nct_id", "_disease", "_outcome", "brief_summary", "eligibility_criteria", "intervention", F.posexplode(arms_or_default(F.col("arm_group"))).alias("arm", "a"))
    label = F.lower(F.col("a.arm_group_label"))
    mine = F.filter(F.coalesce("intervention", F.array().cast(trials.schema["intervention"].dataType)), lambda i: F.exists(F.coalesce(i["arm_group_label"], F.array(F.lit("default"))), lambda x: F.lower(x) == label))
    last = F.try_element_at(mine, F.lit(-1))
    parts = [
        F.when(F.size(mine) > 0, F.concat(last["intervention_name"], F.lit(" "))).otherwise(""), F.col("_disease"), F.col("_outcome"),
        F.concat(F.col("a.arm_group_label"), F.lit(" "), blank(F.col("a.description"))), blank(F.col("brief_summary")),
        F.when(F.size(mine) > 0, F.concat(blank(last["description"]), F.lit(" "))).otherwise(""), blank(F.col("eligibility_criteria")),
    ]
    return rows.select("nct_id", "arm", F.concat_ws(" ", *parts).alias("text"))


# The graph


def arm_key(nct_id: str = "nct_id", arm_id: str = "arm_id") -> Column:
    return key("TRIAL_ARM", TRIAL, F.concat_ws(":", F.col(nct_id), F.col(arm_id).cast("string")))


def arms(trials: DataFrame) -> DataFrame:
    """(nct_id, arm_id, label): arms by their 0-based place, labels lower-cased."""
    each = trials.select("nct_id", F.posexplode(arms_or_default(F.col("arm_group"))).alias("arm_id", "a"))
    return each.select("nct_id", F.col("arm_id").cast("string").alias("arm_id"), F.lower("a.arm_group_label").alias("label"))


def labelled(arm_rows: DataFrame) -> DataFrame:
    """(nct_id, label, arm_id): of arms with equal labels the last one answers to the label."""
    return arm_rows.groupBy("nct_id", "label").agg(F.max_by("arm_id", F.coalesce(F.expr("try_cast(arm_id AS int)"), F.lit(-1))).alias("arm_id"))


def result_arms(groups: DataFrame) -> DataFrame:
    """(nct_id, arm_id, label, drug_ids): result groups without an arm whose drugs all matched and none is extra; they become arms.

    groups(nct_id, group_id, title, arm_id, drug_ids, all_drugs_matched, has_extra_drugs).
    """
    fits = F.col("arm_id").isNull() & (F.size("drug_ids") > 0) & F.col("all_drugs_matched") & ~F.col("has_extra_drugs")
    id = F.concat(F.lit("group-"), F.col("group_id"))
    label = F.concat(F.lit("group-"), F.coalesce("title", F.lit("")), F.lit("-"), F.col("group_id"))
    return groups.where(fits).select("nct_id", id.alias("arm_id"), label.alias("label"), "drug_ids")


def intervention_links(interventions: DataFrame, labels: DataFrame) -> DataFrame:
    """(nct_id, arm_id, drug_ids, is_incomplete, non_drug): each intervention at each arm that it names.

    interventions(nct_id, type, drug_ids, is_incomplete, arm_labels): without labels it
    belongs to the default arm; without drugs it is incomplete.
    """
    named = F.coalesce("arm_labels", F.array(F.lit("default")))
    drugs = F.coalesce("drug_ids", F.array().cast("array<string>"))
    each = interventions.select("nct_id", F.explode(F.array_distinct(F.transform(named, F.lower))).alias("label"), drugs.alias("drug_ids"), ((F.size(drugs) == 0) | F.coalesce("is_incomplete", F.lit(False))).alias("is_incomplete"), (~F.coalesce(F.col("type").isin("Drug", "Placebo"), F.lit(False))).alias("non_drug"))
    return each.join(labels, ["nct_id", "label"]).drop("label")


def arm_flags(arm_rows: DataFrame, links: DataFrame) -> DataFrame:
    """(nct_id, arm_id, is_incomplete, non_drug): whether any of an arm's interventions is."""
    flags = links.groupBy("nct_id", "arm_id").agg(F.bool_or("is_incomplete").alias("is_incomplete"), F.bool_or("non_drug").alias("non_drug"))
    no = F.lit(False)
    return arm_rows.select("nct_id", "arm_id").join(flags, ["nct_id", "arm_id"], "left").select("nct_id", "arm_id", F.coalesce("is_incomplete", no).alias("is_incomplete"), F.coalesce("non_drug", no).alias("non_drug"))


def drug_edges(links: DataFrame) -> DataFrame:
    """arm_tests_drug edges of rows with nct_id, arm_id, drug_ids."""
    each = links.select("nct_id", "arm_id", F.explode("drug_ids").alias("drug_id"))
    return edges_of(each, arm_key(), drug_key("drug_id"), TESTS, TRIAL)


def fan_out(arm_rows: DataFrame, targets: DataFrame, dst: Column, relation: str | Column) -> DataFrame:
    """Edges from every arm of a trial to each of the trial's targets(nct_id, ..)."""
    return edges_of(arm_rows.select("nct_id", "arm_id").join(targets, "nct_id"), arm_key(), dst, relation, TRIAL)


def study_edges(arm_rows: DataFrame, diseases: DataFrame) -> DataFrame:
    """study-disease edges: diseases(nct_id, id), already without redundant ids."""
    return fan_out(arm_rows, diseases, disease_key("id"), "study-disease")


def outcome_edges(arm_rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """primary_outcome edges: outcomes(nct_id, cluster)."""
    return fan_out(arm_rows, outcomes, outcome_key("cluster"), "primary_outcome")


def population_edges(arm_rows: DataFrame, criteria: DataFrame, rolled: DataFrame) -> DataFrame:
    """eligibility-inclusion and -exclusion edges: criteria(nct_id, cui, inclusion) by their roll-ups rolled(concept, rolled)."""
    up = rolled.select(F.col("concept").alias("cui"), F.col("rolled").alias("to"))
    side = F.when(F.col("inclusion"), "eligibility-inclusion").otherwise("eligibility-exclusion")
    return fan_out(arm_rows, criteria.select("nct_id", "cui", side.alias("side")).join(up, "cui"), key("UMLS", "UMLS", "to"), F.col("side"))


def event_counts(events: DataFrame) -> DataFrame:
    """One row per count of events(nct_id, event_type, categories): with the category's, event's and count's places.

    categories: array<struct<title, events: array<struct<sub_title, counts: array<struct<group_id, affected, at_risk, events>>>>>>.
    """
    c = events.select("nct_id", "event_type", F.posexplode("categories").alias("c", "category"))
    e = c.select("nct_id", "event_type", "c", F.lower(F.coalesce("category.title", F.lit(""))).alias("category"), F.posexplode("category.events").alias("e", "event"))
    return e.select("nct_id", "event_type", "c", "category", "e", F.coalesce("event.sub_title", F.lit("NONE")).alias("event"), F.posexplode("event.counts").alias("k", "n")).select("nct_id", "event_type", "c", "category", "e", "event", "k", "n.*")


def last_at_risk(counts: DataFrame) -> DataFrame:
    """(nct_id, event_type, group_id, at_risk): the last at_risk given for a group, in the order of the events."""
    order = F.struct("c", "e", "k")
    given = counts.where(F.col("at_risk").isNotNull())
    return given.groupBy("nct_id", "event_type", "group_id").agg(F.max_by("at_risk", order).alias("at_risk"))


def category_events(counts: DataFrame, group_arms: DataFrame) -> DataFrame:
    """(nct_id, arm_id, event_type, category, events): an arm's events of a category, in their order; group_arms(nct_id, group_id, arm_id).

    A count without at_risk takes its group's last one, one without affected or events 0.
    """
    keys = ["nct_id", "event_type", "group_id"]
    joined = counts.join(group_arms, ["nct_id", "group_id"]).join(last_at_risk(counts).withColumnRenamed("at_risk", "group_at_risk"), keys, "left")
    zero = F.lit(0)
    event = F.struct("c", "e", "k", F.col("event").alias("event"), F.coalesce("affected", zero).alias("affected"), F.coalesce("at_risk", "group_at_risk", zero).alias("at_risk"), F.coalesce("events", zero).alias("events"))
    per = joined.groupBy("nct_id", "arm_id", "event_type", "category").agg(F.array_sort(F.collect_list(event)).alias("events"))  # one trial's events
    return per.withColumn("events", F.transform("events", lambda x: F.struct(x["event"].alias("event"), x["affected"].alias("affected"), x["at_risk"].alias("at_risk"), x["events"].alias("events"))))


def category_edges(rows: DataFrame) -> DataFrame:
    """has_side_effect_category edges of category_events(), the events as JSON in attrs."""
    attrs = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("ae_category"), F.col("category"), F.lit("events"), F.to_json("events"))
    return edges_of(rows, arm_key(), key("SIDE_EFFECT_CAT", TRIAL, "category"), F.concat(F.lit("has_side_effect_category_"), F.col("event_type")), TRIAL, attrs)


def event_edges(counts: DataFrame, group_arms: DataFrame, cuis: DataFrame) -> DataFrame:
    """has_side_effect edges to the concepts of events: cuis(event, cui) by the event's lower-cased name."""
    joined = counts.join(group_arms, ["nct_id", "group_id"]).join(last_at_risk(counts).withColumnRenamed("at_risk", "group_at_risk"), ["nct_id", "event_type", "group_id"], "left")
    joined = joined.withColumn("event", F.lower("event")).join(cuis, "event")
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    attrs = F.create_map(F.lit("affected"), text(F.col("affected")), F.lit("at_risk"), text(F.coalesce("at_risk", "group_at_risk")), F.lit("event_type"), F.col("event_type"), F.lit("ae"), F.col("event"))
    return edges_of(joined, arm_key(), key("SIDE_EFFECT", "UMLS", "cui"), F.concat(F.lit("has_side_effect_"), F.col("event_type")), TRIAL, attrs)


def complete_arms(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """edges without those of incomplete and non-drug arms, and with the placebo for arms left without a drug."""
    bad = flags.where("is_incomplete or non_drug").select(arm_key().alias("_bad"))
    for end in ("src", "dst"):
        edges = edges.join(bad, F.col(end) == F.col("_bad"), "left_anti")
    kept = flags.where("not is_incomplete and not non_drug").select(arm_key().alias("arm"))
    tested = edges.where(F.col("relation") == TESTS).select(F.col("src").alias("arm")).distinct()
    bare = kept.join(tested, "arm", "left_anti")
    return edges.unionByName(edges_of(bare, F.col("arm"), drug_key(F.lit(PLACEBO)), TESTS, TRIAL))


def drug_sets(edges: DataFrame) -> DataFrame:
    """(drugs, n_arms, first_arm): arms by the set of drugs that they test."""
    sets = edges.where(F.col("relation") == TESTS).groupBy(F.col("src").alias("arm")).agg(F.array_sort(F.collect_set("dst")).alias("drugs"))
    return sets.groupBy("drugs").agg(F.count("*").alias("n_arms"), F.min("arm").alias("first_arm"))


def placebo_arms(edges: DataFrame, placebo: Column | None = None) -> DataFrame:
    """(arm): arms that test the placebo and nothing else."""
    placebo = drug_key(F.lit(PLACEBO)) if placebo is None else placebo
    per = edges.where(F.col("relation") == TESTS).groupBy(F.col("src").alias("arm")).agg(F.bool_and(F.col("dst") == placebo).alias("only"))
    return per.where("only").select("arm")


def relation_counts(edges: DataFrame, placebo: Column | None = None) -> DataFrame:
    """(relation, rel_source, n) of the edges whose source is no placebo arm."""
    arms_ = placebo_arms(edges, placebo)
    return edges.join(arms_, F.col("src") == F.col("arm"), "left_anti").groupBy("relation", "rel_source").agg(F.count("*").alias("n"))


def type_counts(nodes: DataFrame, placebo: DataFrame) -> DataFrame:
    """(etype, n): nodes(key, etypes) once per type, placebo arms as a type of their own."""
    marked = nodes.join(placebo.select(F.col("arm").alias("key"), F.lit(True).alias("_p")), "key", "left")
    kinds = F.when(F.col("_p"), F.array(F.lit("placebo_arm"))).otherwise(F.col("etypes"))
    return marked.select(F.explode(kinds).alias("etype")).groupBy("etype").agg(F.count("*").alias("n"))


def frequencies(trials: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(value, n) of a list column over the rows with at most `most` values."""
    return trials.where(F.size(column) <= most).select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def counts_above(sizes: DataFrame, n: str, thresholds: list[int]) -> DataFrame:
    """One row per threshold: how many rows have at least so much."""
    each = sizes.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), n)
    return each.groupBy("threshold").agg(F.count_if(F.col(n) >= F.col("threshold")).alias("n_rows"))


def disease_networks(trials: DataFrame, by: str, least: int = 1) -> DataFrame:
    """(value, drug, disease, nct_id): per value of an index column, the edges of trials with exactly one, mapped drug.

    trials(nct_id, seq, drugs, mapped, diseases, <by>): values met in fewer than
    `least` trials go; of trials with an equal edge the last counts.
    """
    each = trials.where((F.size("drugs") == 1) & F.col("mapped")).select("nct_id", "seq", F.col("drugs")[0].alias("drug"), F.explode(F.array_distinct("diseases")).alias("disease"), F.explode(F.array(by) if not trials.schema[by].dataType.typeName() == "array" else F.array_distinct(by)).alias("value"))
    often = trials.select(F.explode(F.array(by) if not trials.schema[by].dataType.typeName() == "array" else F.array_distinct(by)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("value")
    return each.join(often, "value", "left_semi").groupBy("value", "drug", "disease").agg(F.max_by("nct_id", "seq").alias("nct_id"))


def location_network(trials: DataFrame, kind: str = "drugs") -> DataFrame:
    """(name, country, n_trials) of trials(nct_id, countries, <kind>): how often a drug or disease is studied in a country."""
    each = trials.select("nct_id", F.explode(F.array_distinct(kind)).alias("name"), F.explode(F.array_distinct("countries")).alias("country"))
    return each.groupBy("name", "country").agg(F.count_distinct("nct_id").alias("n_trials"))


def merged_mentions(mentions: DataFrame, keys: list[str], fields: list[str], name: str = "name") -> DataFrame:
    """Mentions of one drug merged while no field contradicts: fields are equal, empty, or one holds the other, and the longer stays.

    mentions: keys, name, seq and the fields, strings. Mentions of a key and name
    are folded in order of seq, each into the first merged one that it agrees
    with. A key's mentions of one drug are few; they meet in one array.
    """
    record = F.struct("seq", *[F.coalesce(f, F.lit("")).alias(f) for f in fields])
    agree = lambda a, b: [(a[f] == "") | (b[f] == "") | a[f].contains(b[f]) | b[f].contains(a[f]) for f in fields]

    def both(a: Column, b: Column) -> Column:
        ok = agree(a, b)[0]
        for c in agree(a, b)[1:]:
            ok = ok & c
        return ok

    longer = lambda a, b: F.struct(a["seq"].alias("seq"), *[F.when(F.length(a[f]) >= F.length(b[f]), a[f]).otherwise(b[f]).alias(f) for f in fields])
    ordered = F.array_sort(F.collect_list(record))

    def fold(done: Column, m: Column) -> Column:
        at = F.array_position(F.transform(done, lambda d: both(d, m)), F.lit(True))
        into = F.transform(done, lambda d, i: F.when(i + 1 == at, longer(d, m)).otherwise(d))
        return F.when(at > 0, into).otherwise(F.concat(done, F.array(m)))

    per = mentions.groupBy(*keys, name).agg(ordered.alias("_all"))
    first = F.slice("_all", 1, 1)
    merged = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(1))), first, fold)
    return per.select(*keys, name, F.explode(merged).alias("m")).select(*keys, name, *[f"m.{f}" for f in fields])


def turns(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows with `turn`, their 0-based place within the key."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
