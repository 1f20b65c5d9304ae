"""Linking cascades, text similarity and criteria over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import arm_matching, automata, hierarchy, linking, resolution


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(column: str):
    return F.col(column).cast("string")


def _words(table: DataFrame, id: str) -> DataFrame:
    return table.select(id, F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("words"))


def substring_filter(spark, sf):
    """Suppliers' numbers of a nation, without those that another number of it contains."""
    return linking.uncontained(_table(spark, sf, "supplier").select("s_nationkey", _text("s_suppkey").alias("name")), "s_nationkey", "name")


def tfidf_top1(spark, sf):
    """The most similar document of each benchmark item."""
    docs, items = _words(_table(spark, sf, "documents"), "doc_id"), _words(_table(spark, sf, "benchmark"), "item_id")
    raw, lengths, idf = linking.tf_idf_parts(docs, "doc_id", "words")
    counts = items.select("item_id", F.explode("words").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    return linking.most_similar(linking.weighted(counts, idf, "item_id"), raw, "item_id", "doc_id", 0.05, 4, lengths)


def phrase_bigrams(spark, sf):
    found = linking.phrases(_words(_table(spark, sf, "benchmark"), "item_id"), "item_id", "words", 2, 1.0)
    return found.select("a", "b", "n_ab", F.round("score", 4).alias("score"))


def phrase_join(spark, sf):
    """Words of the benchmark joined where they follow each other as one of the phrases."""
    docs = _words(_table(spark, sf, "benchmark"), "item_id")
    out = linking.join_phrases(docs, "item_id", "words", linking.phrases(docs, "item_id", "words", 2, 1.0))
    return out.select("item_id", F.size("words").alias("n"), F.replace(F.array_join("words", " "), F.lit("_"), F.lit(" ")).alias("text"))


def vocab_token_contains(spark, sf):
    """Documents that hold the first three words of a benchmark item in a row."""
    items = _words(_table(spark, sf, "benchmark"), "item_id").where(F.size("words") >= 3)
    vocabulary = items.select(F.array_join(F.slice("words", 1, 3), "_").alias("token"), F.col("item_id").alias("cluster"))
    return automata.vocabulary_hits(_words(_table(spark, sf, "documents"), "doc_id"), "doc_id", "words", vocabulary)


def vocab_phrase_contains(spark, sf):
    """Documents, their words joined in twos and threes as phrases are, that hold the first two to six words of a benchmark item in a row."""
    items = _words(_table(spark, sf, "benchmark"), "item_id").where(F.size("words") >= 6)
    first = F.slice("words", F.lit(1), (F.lit(2) + F.col("item_id") % 5).cast("int"))
    vocabulary = items.select(F.array_join(first, "_").alias("token"), (F.col("item_id") % 50).alias("cluster"))
    docs = _words(_table(spark, sf, "documents"), "doc_id")
    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / 5)).cast("int")), _phrases_at)
    return automata.vocabulary_hits(docs.select("doc_id", F.flatten(joined).alias("words")), "doc_id", "words", vocabulary)


def _phrases_at(k):
    """The phrase of two words and that of three from word 5 k on."""
    pair = lambda start, n: F.array_join(F.slice("words", start, F.lit(n)), "_")
    return F.filter(F.array(pair(k * 5 + 1, 2), pair(k * 5 + 3, 3)), lambda w: w != "")


def synonym_index(spark, sf):
    parts = _table(spark, sf, "part").select("p_partkey", F.array("p_name", F.concat(F.lit(" "), "p_brand"), F.lit("abc")).alias("synonyms"))
    found = linking.inverse_names(parts, "p_partkey", "synonyms")
    return found.select("name", F.size("ids").alias("n"), F.array_min("ids").alias("least"), F.array_max("ids").alias("most"))


def condition_links(spark, sf):
    """Customers with two conditions; nations as headings; one condition in seven is unknown, one in five healthy."""
    c = _table(spark, sf, "customer").join(_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    second = F.when(F.col("c_custkey") % 7 == 0, F.lit("Unheard Of")).when(F.col("c_custkey") % 5 == 0, "Healthy Volunteers").otherwise(F.concat(F.lit("Cancer "), "c_mktsegment"))
    trials = c.select(F.col("c_custkey").alias("trial"), F.array(F.col("n_name"), second).alias("conditions"), F.array(F.upper("n_name"), F.lit("Nothing")).alias("mesh_terms"))
    names = _table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("D"), _text("n_nationkey")).alias("id"))
    segments = _table(spark, sf, "customer").select(F.concat(F.lit("neoplasm "), F.lower("c_mktsegment")).alias("name"), F.concat(F.lit("S"), F.substring("c_mktsegment", 1, 1)).alias("id")).distinct()
    found = linking.link_conditions(trials, names.unionByName(segments))
    return found.select("trial", F.array_join("ids", ",").alias("ids"), "complete")


def drug_code_chain(spark, sf):
    """Parts under names that are unique, shared, hyphenated or unknown, with codes in three maps."""
    part = _table(spark, sf, "part")
    kind = F.col("p_partkey") % 6
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    name = F.when(kind == 0, F.concat(F.lit("single"), _text("p_partkey"))).when(kind == 1, brand).when(kind == 2, F.concat(F.lit("unknown"), _text("p_partkey"))).when(kind == 3, F.concat(F.lit("spaced-name"), _text("p_size"))).when(kind == 4, F.lit("half-brandless")).otherwise(F.concat(brand, F.lit("-xr")))
    drugs = part.select(F.col("p_partkey").alias("key"), name.alias("name"), F.when(kind == 2, _text("p_size")).otherwise("").alias("code"))
    names = part.where(kind == 0).select(F.concat(F.lit("single"), _text("p_partkey")).alias("name"), F.lit("primary").alias("category"), _text("p_partkey").alias("id"))
    names = names.unionByName(part.where(kind == 1).select(brand.alias("name"), F.lit("brand").alias("category"), F.lpad(_text("p_partkey"), 6, "0").alias("id")))
    names = names.unionByName(part.where(kind == 3).select(F.concat(F.lit("spaced name"), _text("p_size")).alias("name"), F.lit("product").alias("category"), F.concat(F.lit("S"), _text("p_size")).alias("id")).distinct())
    names = names.unionByName(spark.createDataFrame([("half", "primary", "H1"), ("brandless", "brand", "H2")], names.schema))
    codes = part.where("p_size % 3 = 0").select(_text("p_size").alias("code"), F.lit("external").alias("map"), F.concat(F.lit("E"), _text("p_size")).alias("id")).distinct()
    codes = codes.unionByName(part.where("p_size % 3 <> 2").select(_text("p_size").alias("code"), F.lit("precomputed").alias("map"), F.concat(F.lit("P"), _text("p_size")).alias("id")).distinct())
    preferred = part.where("p_size = 20").select(_text("p_size").alias("code"), F.lit("Half (Brandless)").alias("preferred")).distinct()
    return resolution.resolve(drugs, names, codes, preferred).select("key", "tier", F.array_join("ids", ",").alias("ids"))


def intervention_drugs(spark, sf):
    """Parts as interventions of eight kinds: devices, placebos, known names, other names, mixtures with placebo, unknown ones, coded mentions, drugs' own names."""
    part, kind, k = _table(spark, sf, "part"), F.col("p_partkey") % 8, _text("p_partkey")
    size = _text("p_size")
    none = F.array().cast("array<string>")
    mention = lambda *m: F.array(*[F.struct(a.alias("text"), b.alias("code")) for a, b in m])
    no_mention = F.array().cast("array<struct<text:string,code:string>>")
    name = F.when(kind == 0, F.lit("Pump")).when(kind == 1, "Placebo tablets").when(kind == 2, F.concat(F.lit("Single"), k)).when(kind == 3, F.concat(F.lit("Mixed "), k)).when(kind == 4, F.concat(F.lit("Single"), k, F.lit(" plus placebo")))
    name = name.when(kind == 5, F.concat(F.lit("unheard of "), k)).when(kind == 6, F.concat(F.lit("extract number "), size)).otherwise(F.concat(F.lit("Owned"), k, F.lit(" or single"), k))
    others = F.when(kind == 3, F.array(F.concat(F.lit("single"), k), F.concat(F.lit("common "), size))).otherwise(none)
    mentions = F.when(kind == 4, mention((F.concat(F.lit("single"), k), F.lit("")))).when(kind == 5, mention((F.lit("unheard of"), F.lit("")))).when(kind == 6, mention((F.lit("extract number"), size)))
    mentions = mentions.when(kind == 7, mention((F.concat(F.lit("single"), k), F.lit("")), (F.lit("owned"), F.lit("77")))).otherwise(no_mention)
    rows = part.select(F.col("p_partkey").alias("key"), F.when(kind == 0, "Device").otherwise("Drug").alias("type"), name.alias("name"), others.alias("other_names"), mentions.alias("mentions"), no_mention.alias("other_mentions"))
    names = part.select(F.concat(F.lit("single"), k).alias("name"), F.lit("primary").alias("category"), F.concat(F.lit("S"), k).alias("id"))
    names = names.unionByName(part.where("p_size % 2 = 0").select(F.concat(F.lit("common "), size).alias("name"), F.lit("brand").alias("category"), F.concat(F.lit("C"), size).alias("id")).distinct())
    codes = part.where("p_size % 3 = 0").select(size.alias("code"), F.lit("external").alias("map"), F.concat(F.lit("E"), size).alias("id")).distinct()
    primary = part.where((kind == 7) & (F.col("p_size") % 2 == 0)).select(F.concat(F.lit("S"), k).alias("id"), F.concat(F.lit("OWNED"), k, F.lit(" or single"), k).alias("name"))
    found = resolution.link_interventions(rows, names, codes, codes.select("code", F.lit("").alias("preferred")).where("false"), primary)
    return found.select("key", F.array_join("ids", ",").alias("ids"), "incomplete", "non_drug")


def concept_back_fill(spark, sf):
    c = _table(spark, sf, "customer")
    rows = c.select("c_custkey", F.lower("c_mktsegment").alias("orig_term"), F.concat(F.lit("n"), _text("c_nationkey")).alias("term"), F.when(F.col("c_acctbal") < 0, "own").alias("cui"))
    concepts = _table(spark, sf, "nation").where("n_nationkey < 15").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("term"), F.concat(F.lit("T"), _text("n_nationkey")).alias("cui"))
    return linking.back_filled(rows, concepts.unionByName(spark.createDataFrame([("building", "B")], concepts.schema)))


def term_map(spark, sf):
    o = _table(spark, sf, "orders")
    criteria = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("term"), F.concat(F.lit("o"), (F.col("o_custkey") % 70).cast("string")).alias("orig_term"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 25).cast("string")).alias("cui"), F.array((F.col("o_orderkey") % 5).cast("string")).alias("parents"))
    return linking.term_map(criteria, _table(spark, sf, "nation").select(_text("n_nationkey").alias("cui"), F.col("n_name").alias("name")))


def label_group_match(spark, sf):
    """Lines as arms of an order, and as result groups under titles that several stages find."""
    line = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    arms = line.select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("arm_id"), F.concat(F.lit("Arm "), F.element_at(F.array(*map(F.lit, ["one", "two", "three", "four", "five", "six", "seven"])), F.col("l_linenumber"))).alias("label"))
    shape = F.col("l_orderkey") % 4
    word = F.element_at(F.array(*map(F.lit, ["one", "two", "three", "four", "five", "six", "seven"])), F.col("l_linenumber"))
    title = F.when(shape == 0, F.concat(F.lit("ARM "), F.upper(word))).when(shape == 1, F.concat(F.lit("Arm-"), word)).when(shape == 2, F.concat(F.lit("patients arm "), word)).otherwise(F.concat(F.lit("Cohort: arm "), word))
    groups = line.select(F.col("l_orderkey").alias("trial"), _text("l_linenumber").alias("group_id"), title.alias("title"), F.lit("").alias("description"))
    return arm_matching.match_groups(groups, arms)


def criteria_flatten(spark, sf):
    """Conversations as records of one sentence a turn: user turns include, others exclude; the first words are the terms."""
    c = _table(spark, sf, "conversations")
    word = lambda k: F.lower(F.regexp_extract("text", r"^(?:\S+\s+){" + str(k) + r"}([A-Za-z]+)", 1))
    term = lambda id, category, k, neg: F.struct(F.lit(id).alias("term_id"), F.lit(category).alias("category"), neg.alias("neg"), word(k).alias("text"))
    sentence = F.struct("turn", F.array(term("T1", "Condition", 0, F.col("turn") % 3 == 0), term("T2", "Temporal", 1, F.lit(False)), term("T3", "Drug", 2, F.lit(False))).alias("terms"), F.array(F.struct(F.lit("T1").alias("first"), F.lit("has_temporal").alias("second"), F.lit("T2").alias("third"))).alias("relations"))
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, sentence))), lambda s: F.struct(s["terms"].alias("terms"), s["relations"].alias("relations")))
    records = c.groupBy(F.col("conv_id").alias("trial")).agg(side(F.col("role") == "user").alias("inclusion"), side(F.col("role") != "user").alias("exclusion"))
    found = linking.flatten_criteria(records)
    return found.groupBy("trial", "inclusion", "category", "negated").agg(F.count("*").alias("n"), F.sum(F.size("temporal")).alias("n_temporal"))


def stemmed_words(spark, sf):
    """Plural and -ing words of the benchmark by a rule that SQL can state: the stemmer's on words made of a fixed stem."""
    made = F.concat(F.lit("b"), F.regexp_replace(F.lower("p_brand"), "[^a-z]", ""), F.element_at(F.array(*map(F.lit, ["ts", "t", "ting", "ted"])), (F.col("p_size") % 4 + 1).cast("int")))
    return linking.stemmed(_table(spark, sf, "part").select("p_partkey", made.alias("word")), "word").select("p_partkey", "stem")


def folded_tokens(spark, sf):
    """Tokens of all documents, counted."""
    return _table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 200")


def trial_match_share(spark, sf):
    """Parts as drug interventions of orders, under names with a dose, known, shared or unknown."""
    line = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kind = F.col("l_partkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("Sole"), _text("l_partkey"), F.lit(" tablets daily"))).when(kind == 1, F.concat(F.lit("Shared"), (F.col("l_partkey") % 10).cast("string"))).otherwise("Nobody knows")
    rows = line.select(F.col("l_orderkey").alias("trial"), F.struct("l_linenumber", "l_partkey").alias("key"), name.alias("name"), F.array().cast("array<string>").alias("others"))
    part = _table(spark, sf, "part")
    names = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("sole"), _text("p_partkey")).alias("name"), _text("p_partkey").alias("id"), F.lit("primary").alias("category"))
    names = names.unionByName(part.where("p_partkey % 3 = 1").select(F.concat(F.lit("shared"), (F.col("p_partkey") % 10).cast("string")).alias("name"), _text("p_partkey").alias("id"), F.lit("synonyms").alias("category")))
    found = linking.matched_share(rows, names)
    return found.select("trial", "matched", "ambiguous", "total", F.round("percentage", 4).alias("percentage"))


def population_ids(spark, sf):
    c = _table(spark, sf, "customer").join(_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    trials = c.select(F.col("c_custkey").alias("trial"), F.array(F.lower("n_name"), F.when(F.col("c_custkey") % 4 == 0, "Healthy human volunteers").otherwise("x"), F.col("c_mktsegment")).alias("terms"))
    nation, n, r = _table(spark, sf, "nation"), _text("n_nationkey"), _text("n_regionkey")
    names = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("D"), n).alias("id"))
    # Nations of even number stand below a term between them and their region.
    terms = nation.select(F.concat(F.lit("D"), n).alias("id"), F.array(F.when(F.col("n_nationkey") % 2 == 0, F.concat(r, F.lit(".m."), n)).otherwise(F.concat(r, F.lit("."), n))).alias("tree_numbers"))
    for kind, tail in (("R", ""), ("M", ".m")):
        terms = terms.unionByName(nation.select(F.concat(F.lit(kind), r).alias("id"), F.array(F.concat(r, F.lit(tail))).alias("tree_numbers")).distinct())
    values = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("D"), n).alias("id"), F.concat(F.lit("V"), n).alias("value"))
    found = hierarchy.population(trials, names, values, terms, 2)
    return found.select("trial", "healthy", *[F.array_join(c, ",").alias(c) for c in ("ids", "associated_ids", "associations", "cut_ids", "cut_associated_ids")])


W = lambda t, id: f"SELECT {id}, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS words FROM {t}"
PHRASES = f"w AS ({W('benchmark', 'item_id')}), u AS (SELECT unnest(words) AS a FROM w), n AS (SELECT a, count(*) AS n FROM u GROUP BY 1), p AS (SELECT words[i] AS a, words[i + 1] AS b, count(*) AS n_ab FROM w, range(1, 100000) AS g(i) WHERE i < len(words) GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT p.a, p.b, n_ab, (n_ab - 2) / x.n / y.n * (SELECT count(*) FROM n) AS score FROM p JOIN n x ON x.a = p.a JOIN n y ON y.a = p.b)"
NUMBERS = "['one', 'two', 'three', 'four', 'five', 'six', 'seven']"
ORACLES = {
    "substring_filter": "SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey <> s.s_suppkey AND contains(CAST(o.s_suppkey AS VARCHAR), CAST(s.s_suppkey AS VARCHAR)))",
    "tfidf_top1": f"""WITH d AS ({W('documents', 'doc_id')}), q AS ({W('benchmark', 'item_id')}), t AS (SELECT doc_id, unnest(words) AS term FROM d), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
        i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents)),
        w AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM c JOIN i USING (term)),
        x AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(words) AS term FROM q) GROUP BY 1, 2), y AS (SELECT item_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM x JOIN i USING (term)),
        s AS (SELECT item_id, doc_id, round(sum(y.w * w.w), 4) AS score FROM y JOIN w USING (term) GROUP BY 1, 2 HAVING round(sum(y.w * w.w), 4) >= 0.05)
        SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS turn FROM s) WHERE turn = 1""",
    "phrase_bigrams": f"WITH {PHRASES} SELECT a, b, n_ab, round(score, 4) AS score FROM f WHERE score > 1.0",
    "phrase_join": f"""WITH RECURSIVE {PHRASES}, k AS (SELECT a, b FROM f WHERE score > 1.0),
        z AS (SELECT item_id, words, 1 AS i, 0 AS n FROM w UNION ALL SELECT item_id, words, i + CASE WHEN k.a IS NULL THEN 1 ELSE 2 END, n + 1 FROM z LEFT JOIN k ON k.a = words[i] AND k.b = words[i + 1] WHERE i <= len(words))
        SELECT item_id, CAST(max(n) AS INT) AS n, array_to_string(any_value(words), ' ') AS text FROM z GROUP BY 1""",
    "vocab_token_contains": f"WITH q AS ({W('benchmark', 'item_id')}), d AS ({W('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id AS cluster FROM d, q WHERE len(q.words) >= 3 AND contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(q.words[1:3], ' ') || ' ')",
    "vocab_phrase_contains": f"WITH q AS ({W('benchmark', 'item_id')}), d AS ({W('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id % 50 AS cluster FROM d, q WHERE len(q.words) >= 6 AND contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(q.words[1:2 + item_id % 5], ' ') || ' ')",
    "synonym_index": "WITH s AS (SELECT lower(p_name) AS name, p_partkey AS id FROM part UNION SELECT lower(p_brand), p_partkey FROM part) SELECT name, CAST(count(*) AS INT) AS n, min(id) AS least, max(id) AS most FROM s WHERE length(name) >= 4 GROUP BY 1",
    "condition_links": "SELECT c_custkey AS trial, CASE WHEN c_custkey % 7 = 0 THEN 'D' || n_nationkey WHEN c_custkey % 5 = 0 THEN 'D' || n_nationkey || ',HEALTHY' ELSE 'D' || n_nationkey || ',S' || c_mktsegment[1] END AS ids, c_custkey % 7 <> 0 AS complete FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "drug_code_chain": """WITH b AS (SELECT p_partkey, p_size, p_partkey % 6 AS k, lower(replace(p_brand, '#', '')) AS brand FROM part), s AS (SELECT brand, string_agg(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), ',' ORDER BY p_partkey) AS ids, count(*) AS n FROM b WHERE k = 1 GROUP BY 1)
        SELECT p_partkey AS key, CAST(CASE WHEN k = 0 THEN 1 WHEN k IN (1, 5) THEN CASE WHEN n = 1 THEN 1 WHEN n > 1 THEN 6 END WHEN k = 2 THEN CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size = 20 THEN 4 WHEN p_size % 3 = 1 THEN 5 END WHEN k = 3 THEN 7 ELSE 8 END AS INT) AS tier,
        CASE WHEN k = 0 THEN CAST(p_partkey AS VARCHAR) WHEN k IN (1, 5) THEN s.ids WHEN k = 2 THEN CASE WHEN p_size % 3 = 0 THEN 'E' || p_size WHEN p_size = 20 THEN 'H1,H2' WHEN p_size % 3 = 1 THEN 'P' || p_size END WHEN k = 3 THEN 'S' || p_size ELSE 'H1,H2' END AS ids FROM b LEFT JOIN s USING (brand)""",
    "intervention_drugs": """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 8 AS t FROM part)
        SELECT k AS key, CASE t WHEN 0 THEN '' WHEN 1 THEN 'PLACEBO' WHEN 2 THEN 'S' || k WHEN 3 THEN CASE WHEN s % 2 = 0 THEN 'C' || s || ',' ELSE '' END || 'S' || k WHEN 4 THEN 'PLACEBO,S' || k
            WHEN 5 THEN '' WHEN 6 THEN CASE WHEN s % 3 = 0 THEN 'E' || s ELSE '' END ELSE 'S' || k END AS ids,
        t = 5 OR (t = 3 AND s % 2 <> 0) OR (t = 6 AND s % 3 <> 0) OR (t = 7 AND s % 2 <> 0) AS incomplete, t = 0 AS non_drug FROM p""",
    "concept_back_fill": "SELECT c_custkey, lower(c_mktsegment) AS orig_term, 'n' || c_nationkey AS term, CASE WHEN c_acctbal < 0 THEN 'own' WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_nationkey < 15 THEN 'T' || c_nationkey END AS cui FROM customer",
    "term_map": "WITH c AS (SELECT o_orderkey AS s, 't' || o_custkey % 50 AS term, 'o' || o_custkey % 70 AS orig, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 25 AS VARCHAR) END AS cui, CAST(o_orderkey % 5 AS VARCHAR) AS up FROM orders), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS cui, n_name AS name FROM nation), e AS (SELECT s, 1 AS k, term, cui FROM c UNION ALL SELECT s, 2, orig, cui FROM c UNION ALL SELECT s, 0, name, cui FROM c JOIN n USING (cui) UNION ALL SELECT s, 3, name, up FROM c JOIN n ON n.cui = up WHERE c.cui IS NOT NULL) SELECT term, cui FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, k DESC) AS turn FROM e) WHERE turn = 1",
    "label_group_match": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM l) SELECT l_orderkey AS trial, CAST(l_linenumber AS VARCHAR) AS group_id, l_linenumber AS arm_id, CAST(CASE WHEN n = 1 THEN 0 WHEN l_orderkey % 4 = 0 THEN 1 WHEN l_orderkey % 4 = 1 THEN 2 WHEN l_orderkey % 4 = 2 THEN 10 ELSE 11 END AS INT) AS stage FROM n",
    "criteria_flatten": r"""WITH t AS (SELECT conv_id, turn, role, lower(regexp_extract(text, '^(?:\S+\s+){0}([A-Za-z]+)', 1)) AS a, lower(regexp_extract(text, '^(?:\S+\s+){2}([A-Za-z]+)', 1)) AS c FROM conversations), r AS (SELECT conv_id, role, 'Condition' AS category, turn % 3 = 0 AS neg, 1 AS temporal, a AS w FROM t UNION ALL SELECT conv_id, role, 'Drug', false, 0, c FROM t)
        SELECT conv_id AS trial, (role = 'user') <> neg AS inclusion, category, neg AS negated, count(*) AS n, CAST(sum(temporal) AS BIGINT) AS n_temporal FROM r WHERE w <> '' AND w NOT IN (SELECT unnest(""" + str(text.ADJECTIVES) + """)) GROUP BY 1, 2, 3, 4""",
    "stemmed_words": "SELECT p_partkey, 'b' || regexp_replace(lower(p_brand), '[^a-z]', '', 'g') || 't' AS stem FROM part",
    "folded_tokens": "WITH t AS (SELECT unnest(regexp_extract_all(strip_accents(lower(replace(text, '''', ''))), '\\p{L}+')) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE length(token) <= 25 AND token NOT IN (SELECT unnest(['i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', 'your', 'yours', 'yourself', 'yourselves', 'he', 'him', 'his', 'himself', 'she', 'her', 'hers', 'herself', 'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves', 'what', 'which', 'whom', 'this', 'that', 'these', 'those', 'am', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'having', 'do', 'does', 'did', 'doing', 'a', 'an', 'the', 'and', 'but', 'if', 'or', 'because', 'as', 'until', 'while', 'of', 'at', 'by', 'for', 'with', 'about', 'against', 'between', 'into', 'through', 'during', 'before', 'after', 'above', 'below', 'to', 'from', 'up', 'down', 'in', 'out', 'on', 'over', 'under', 'again', 'further', 'then', 'once', 'here', 'there', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so', 'than', 'too', 'very', 's', 'can', 'will', 'just', 'don', 'should', 'now', 'd', 'll', 'm', 'o', 're', 've', 'y', 'ain', 'aren', 'couldn', 'didn', 'doesn', 'hadn', 'hasn', 'haven', 'isn', 'ma', 'mightn', 'mustn', 'needn', 'shan', 'shouldn', 'wasn', 'weren', 'won', 'wouldn'])) GROUP BY 1 HAVING count(*) >= 200",
    "trial_match_share": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), s AS (SELECT p_partkey % 10 AS d, count(*) AS n FROM part WHERE p_partkey % 3 = 1 GROUP BY 1) SELECT l_orderkey AS trial, count(*) FILTER (l_partkey % 3 <> 2) AS matched, count(*) FILTER (l_partkey % 3 = 1 AND n > 1) AS ambiguous, count(*) AS total, round(100.0 * count(*) FILTER (l_partkey % 3 <> 2) / count(*), 4) AS percentage FROM r LEFT JOIN s ON d = l_partkey % 10 GROUP BY 1",
    "population_ids": """SELECT c_custkey AS trial, c_custkey % 4 = 0 AS healthy, 'D' || n AS ids, CASE WHEN n % 3 = 0 THEN 'D' || n ELSE '' END AS associated_ids, CASE WHEN n % 3 = 0 THEN 'V' || n ELSE '' END AS associations,
        CASE WHEN n % 2 = 0 THEN 'M' || n_regionkey ELSE 'D' || n END AS cut_ids, CASE WHEN n % 3 > 0 THEN '' WHEN n % 2 = 0 THEN 'M' || n_regionkey ELSE 'D' || n END AS cut_associated_ids FROM (SELECT *, n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
