"""The queries op1 to op10 over the driver's tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import byte_pairs, fingerprints, languages, merkle, mixing, near_copies, orc_tokens, packing, private_data, quality, secrets, topk, vector_codes


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(table(spark, sf, "documents"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


def op5_orc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return orc_tokens.tokens_round_trip(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages.languages(table(spark, sf, "documents"))


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


def op9_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf, "documents"))


def op10_private_data(spark: SparkSession, sf: str) -> DataFrame:
    return private_data.digest(table(spark, sf, "documents"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf, "embeddings"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"))


def op13_byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.digest(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_top_k": op4_top_k,
    "op5_orc_tokens": op5_orc_tokens,
    "op6_mixing": op6_mixing,
    "op7_languages": op7_languages,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_copies": op9_near_copies,
    "op10_private_data": op10_private_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_byte_pairs": op13_byte_pairs,
}
TOP_K_SQL = """
    WITH e AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
NEAR_COPIES_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS name, s FROM s WHERE len(s) > 0),
    one AS (SELECT name, min(doc_id) AS a, any_value(n) AS n, any_value(s) AS s FROM e GROUP BY 1),
    sh AS (SELECT a, n, unnest(s) AS t FROM one),
    o AS (SELECT x.a AS a, y.a AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS common FROM sh x JOIN sh y ON x.t = y.t AND x.a <> y.a AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY 1, 2),
    l AS (SELECT a, b FROM o WHERE 100 * common >= 75 * (n + m - common)),
    r AS (SELECT a, a AS b FROM one UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
    FROM s LEFT JOIN e USING (doc_id) LEFT JOIN one USING (name) LEFT JOIN c ON c.a = one.a"""
ORACLES = {"op2_secrets": secrets.oracle(), "op4_top_k": TOP_K_SQL, "op9_near_copies": NEAR_COPIES_SQL, "op11_vector_codes": vector_codes.ORACLE, "op12_merkle": merkle.ORACLE}
