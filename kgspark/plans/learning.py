"""Text, feature, split, vector, metric and event queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import features, text, vectors
from kgspark.operators import linking, metrics, splits
from kgspark.streaming import events


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """(label_id, example_id, y, p): does a click's or a view's value tell even users from odd ones?"""
    e = _table(spark, sf, "events")
    return e.select(F.col("event_type").alias("label_id"), F.col("event_id").alias("example_id"), (F.col("user_id") % 2).cast("int").alias("y"), F.round("value", 1).alias("p"))


def _years(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))


def _ages() -> list:
    return ["18 Years", "1 Year", "6 Months", "9 Weeks", "1 Week", "1 Month", "12 Hours", "5 Days", "30 Minutes", "N/A"]


def text_term_normalise(spark, sf):
    words = F.array(*map(F.lit, text.ADJECTIVES))
    picked = F.element_at(words, (F.col("p_size") % len(text.ADJECTIVES) + 1).cast("int"))
    term = F.concat_ws(" ", picked, "p_name", F.lit("'s fever (of"))
    return _table(spark, sf, "part").select("p_partkey", text.criterion_term(term).alias("term"))


def drug_name_clean(spark, sf):
    name = F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" mg")), F.lit("tablets (oral), given"))
    return _table(spark, sf, "part").select("p_partkey", text.clean_drug_name(name).alias("name"))


def condition_cascade(spark, sf):
    """Market segments as conditions, with names that the second and third stage alone can find."""
    c = _table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_acctbal") < 0, "Advanced ").otherwise(""), F.initcap("c_mktsegment"), F.lit(" Cancer")).alias("condition"))
    names = _table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("id")).select(F.concat(F.lower("c_mktsegment"), F.lit(" neoplasm")).alias("name"), "id")
    return linking.first_match(c, "condition", linking.condition_stages("condition"), names)


def age_vector_units(spark, sf):
    ages = F.array(*map(F.lit, _ages()))
    age = F.element_at(ages, (F.col("p_size") % 10 + 1).cast("int"))
    rows = _table(spark, sf, "part").select("p_partkey", F.posexplode(features.age_vector(age)).alias("pos", "val"))
    return rows.select("p_partkey", "pos", F.round("val", 6).alias("val"))


def feature_vector_trial(spark, sf):
    o = _table(spark, sf, "orders")
    phase = F.element_at(F.array(*map(F.lit, features.PHASES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    sex = F.when(F.col("o_orderstatus") == "O", "All").when(F.col("o_orderstatus") == "F", "Male").otherwise("Female")
    vector = F.concat(features.phase_vector(phase), features.sex_vector(sex), features.enrollment_vector(F.col("o_custkey"), F.lit("Anticipated")))
    return o.select("o_orderkey", F.posexplode(vector).alias("pos", "val")).select("o_orderkey", "pos", F.round("val", 6).alias("val"))


def complete_year(spark, sf):
    y = F.year("o_orderdate")
    primary = F.when(F.col("o_orderstatus") == "O", 0).otherwise(y)
    return _table(spark, sf, "orders").select("o_orderkey", features.complete_year(primary, y + 1).alias("year"))


def split_leave_out_year(spark, sf):
    y = F.col("year")
    return _years(spark, sf).select("o_orderkey", splits.by_year_left_out(y, y + 1, 1998).alias("split"))


def split_threshold_year(spark, sf):
    return _years(spark, sf).select("o_orderkey", splits.by_threshold(F.col("year"), 1997, 1999).alias("split"))


def split_temporal_percentile(spark, sf):
    return splits.temporal_end(_years(spark, sf), "year").select("o_orderkey", "split")


def split_group_quota(spark, sf):
    groups = _table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    ordered = groups.withColumn("turn", F.col("o_custkey") * 7919 % 10007)
    return splits.quota(ordered, "n", ["turn", "o_custkey"]).select("o_custkey", "n", "split")


def class_pos_weight(spark, sf):
    long = _table(spark, sf, "labels").select(F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "y"))
    return metrics.positive_weight(long, ["label"]).select("label", F.round("weight", 6).alias("weight"))


def auroc_by_label(spark, sf):
    return metrics.auroc(_scores(spark, sf), ["label_id"]).select("label_id", F.round("auroc", 6).alias("auroc"))


def auprc_by_label(spark, sf):
    return metrics.auprc(_scores(spark, sf), ["label_id"]).select("label_id", F.round("auprc", 6).alias("auprc"))


def freq_class_confusion(spark, sf):
    line = _table(spark, sf, "lineitem").select(features.frequency_class(F.col("l_discount")).cast("long").alias("truth"), features.frequency_class(F.col("l_tax")).cast("long").alias("predicted"))
    return metrics.confusion(line, "truth", "predicted")


def vector_mean_by_type(spark, sf):
    means = vectors.element_mean(_table(spark, sf, "embeddings"), ["label"], "embedding", "mean")
    return means.select("label", F.posexplode("mean").alias("pos", "val")).select("label", "pos", F.round("val", 4).alias("val"))


def triple_scores(spark, sf):
    e = _table(spark, sf, "embeddings")
    nth = lambda k: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(f"v{k}"))
    rows = nth(0).join(nth(1), "vec_id").join(nth(2), "vec_id")
    h, r, t = "v0", "v1", "v2"
    return rows.select("vec_id", F.round(vectors.distmult(F.col(h), F.col(r), F.col(t)), 4).alias("distmult"), F.round(vectors.transe(F.col(h), F.col(r), F.col(t), 12.0), 4).alias("transe"), F.round(vectors.norm(F.col(h)), 4).alias("norm"))


def top_k_per_arm(spark, sf):
    return metrics.top_k(_table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


def json_path_props(spark, sf):
    k = text.json_field(F.col("props"), "k").cast("long")
    return _table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"))


def html_record_extract(spark, sf):
    page = F.col("html")
    return _table(spark, sf, "pages").select("page_id", text.html_text(page, "title").alias("title"), text.html_attribute(page, "html", "lang").alias("lang"), text.occurrences(page, '<a href="').alias("n_links"))


def events_daily_windows(spark, sf):
    found = events.per_window(events.with_time(_table(spark, sf, "events")), "1 day", users=True)
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "n_users")


def events_sessions(spark, sf):
    found = events.sessions(events.with_time(_table(spark, sf, "events")), "2 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def _fold(pattern_and_words: tuple, inner: str, times: int) -> str:
    pattern, by = pattern_and_words
    for _ in range(times):
        inner = f"regexp_replace({inner}, '{pattern}', '{by}', 'g')"
    return inner


def _duck_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _term_sql() -> str:
    words = "|".join(text.ADJECTIVES + [w.capitalize() for w in text.ADJECTIVES])
    term = f"{_duck_list(text.ADJECTIVES)}[p_size % {len(text.ADJECTIVES)} + 1] || ' ' || p_name || ' ''s fever (of'"
    for pattern, by in ((" ''s", "''s"), (r"\([^)]*$", ""), (r"^[^(]*\)", "")):
        term = _fold((pattern, by), term, 1)
    return f"SELECT p_partkey, {_fold((f'( |^|$)({words})( |^|$)', ''), term, 5)} AS term FROM part"


def _drug_sql() -> str:
    name = "p_name || ' ' || p_size || ' mg' || ' tablets (oral), given'"
    for pattern in text.DRUG_NOISE:
        name = _fold((pattern, " "), name, 1)
    for mark in text.DRUG_CUTS:
        name = f"split_part({name}, '{mark}', 1)"
    for pattern in (*text.DRUG_FORMS, r"\s+"):
        name = _fold((pattern, " "), name, 1)
    return f"SELECT p_partkey, trim({name}) AS name FROM part"


CURVE = "t AS (SELECT event_type AS label_id, round(value, 1) AS p, sum(user_id % 2) AS pos, sum(1 - user_id % 2) AS neg FROM events GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY label_id) AS np, sum(neg) OVER (PARTITION BY label_id) AS nn FROM t WINDOW d AS (PARTITION BY label_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"
CLASS = lambda c: f"CASE WHEN {c} * 100 < 0.01 THEN 1 WHEN {c} * 100 < 0.1 THEN 2 WHEN {c} * 100 < 1 THEN 3 WHEN {c} * 100 < 10 THEN 4 ELSE 5 END"
YEARS = "SELECT o_orderkey, year(o_orderdate) AS y FROM orders"
ORACLES = {
    "text_term_normalise": _term_sql(),
    "drug_name_clean": _drug_sql(),
    "condition_cascade": "WITH n AS (SELECT c_mktsegment AS s, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Advanced ' ELSE '' END || upper(s[1]) || lower(s[2:]) || ' Cancer' AS condition, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS INT) AS stage, id FROM customer JOIN n ON c_mktsegment = s",
    "age_vector_units": "WITH v AS (SELECT p_partkey, [[0, 18, 0, 0], [0, 0, 12, 0], [0, 0, 6, 0], [0, 0, 2, 0], [0, 0, 0, 7], [0, 0, 0, 30], [0, 0, 0, 0.5], [0, 0, 0, 5], [0, 0, 0, 0.020833], [1, 0, 0, 0]][p_size % 10 + 1] AS a FROM part) SELECT p_partkey, CAST(i - 1 AS INT) AS pos, CAST(a[i] AS DOUBLE) AS val FROM v, range(1, 5) AS g(i)",
    "feature_vector_trial": "WITH v AS (SELECT o_orderkey, list_concat([[1.0,0,0,0,0],[0,1.0,0,0,0],[0,1.0,0,0,0],[0,1.0,1,0,0],[0,0,1.0,0,0],[0,0,1.0,1,0],[0,0,0,1.0,0],[0,0,0,0,1.0]][o_orderkey % 8 + 1], CASE o_orderstatus WHEN 'O' THEN [1.0, 0, 0] WHEN 'F' THEN [0, 1.0, 0] ELSE [0, 0, 1.0] END) AS a, round(ln(1 + o_custkey), 6) AS e FROM orders) SELECT o_orderkey, CAST(i - 1 AS INT) AS pos, CASE WHEN i <= 8 THEN CAST(a[i] AS DOUBLE) WHEN i = 9 THEN e ELSE 1.0 END AS val FROM v, range(1, 11) AS g(i)",
    "complete_year": "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS INT) AS year FROM orders",
    "split_leave_out_year": f"SELECT o_orderkey, CASE WHEN y + 1 > 2020 THEN 'test' WHEN y = 1998 THEN 'val' ELSE 'train' END AS split FROM ({YEARS})",
    "split_threshold_year": f"SELECT o_orderkey, CASE WHEN y <= 1997 THEN 'train' WHEN y <= 1999 THEN 'val' ELSE 'test' END AS split FROM ({YEARS})",
    "split_temporal_percentile": f"WITH y AS ({YEARS}), s AS (SELECT list(y ORDER BY y) AS l FROM y) SELECT o_orderkey, CASE WHEN y <= l[CAST(floor(len(l) * 0.7) AS BIGINT) + 1] THEN 'train' WHEN y <= l[CAST(floor(len(l) * 0.85) AS BIGINT) + 1] THEN 'val' ELSE 'test' END AS split FROM y, s",
    "split_group_quota": "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_custkey * 7919 % 10007, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS a FROM g), t AS (SELECT *, sum(CASE WHEN b < floor(a * 0.7) THEN n ELSE 0 END) OVER () AS trained FROM w) SELECT o_custkey, n, CASE WHEN b < floor(a * 0.7) THEN 'train' WHEN b - trained < floor(a * 0.15) THEN 'val' ELSE 'test' END AS split FROM t",
    "class_pos_weight": "SELECT 'quality' AS label, round(sqrt((count(*) - sum(quality)) / sum(quality)), 6) AS weight FROM labels UNION ALL SELECT 'toxic', round(sqrt((count(*) - sum(toxic)) / sum(toxic)), 6) FROM labels",
    "auroc_by_label": f"WITH {CURVE} SELECT label_id, round(sum(pos * (nn - fp) + pos * neg / 2) / any_value(np * nn), 6) AS auroc FROM c GROUP BY 1",
    "auprc_by_label": f"WITH {CURVE}, r AS (SELECT label_id, p, tp / np AS recall, tp / (tp + fp) AS prec FROM c), a AS (SELECT label_id, (recall - lag(recall, 1, 0) OVER d) * (prec + lag(prec, 1, 1) OVER d) / 2 AS area FROM r WINDOW d AS (PARTITION BY label_id ORDER BY p DESC)) SELECT label_id, round(sum(area), 6) AS auprc FROM a GROUP BY 1",
    "freq_class_confusion": f"SELECT CAST({CLASS('l_discount')} AS BIGINT) AS truth, CAST({CLASS('l_tax')} AS BIGINT) AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "vector_mean_by_type": "SELECT label, CAST(i - 1 AS INT) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 4) AS val FROM embeddings, range(1, 65) AS g(i) GROUP BY 1, 2",
    "triple_scores": "WITH x AS (SELECT a.vec_id, i, CAST(a.embedding[i] AS DOUBLE) AS h, CAST(b.embedding[i] AS DOUBLE) AS r, CAST(c.embedding[i] AS DOUBLE) AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2, range(1, 65) AS g(i)) SELECT vec_id, round(sum(h * r * t), 4) AS distmult, round(12 - sum(abs(h + r - t)), 4) AS transe, round(sqrt(sum(h * h)), 4) AS norm FROM x GROUP BY 1",
    "top_k_per_arm": "SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events) WHERE rank <= 3",
    "json_path_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1",
    "html_record_extract": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, len(string_split(html, '<a href="')) - 1 AS n_links FROM pages""",
    "events_daily_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= 7200) AS n_sessions, count(*) AS n_events FROM g GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}
