"""The corpus pipeline: language, near copies, secrets, mix, packing, each stage on all that its predecessor kept.

Every stage takes and returns the columns of its documents, whatever else is
among them and under whatever names; the last returns pieces. An empty table
gives an empty one. What becomes of null and empty texts, null ids, repeated
rows and very long texts is said at each stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import languages, mixing, near_copies, packing, secrets
from kgspark.llm.queries import tokenizer
from kgspark.session import written

#: Rows that a Python worker gets at a time: texts of some kB, so that workers of all five stages fit beside a full heap.
BATCH_ROWS = "2000"


def _bounded(stage):
    """The stage with Arrow batches of BATCH_ROWS rows, in this session from here on."""

    @wraps(stage)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return inner


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang becomes the prediction.

    Null texts and texts without a letter are in no language and go, and so do
    all if no document teaches a language. Repeated rows stay or go together;
    a document without an id is judged, but teaches nothing.
    """
    return languages.keep(docs)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: that of the smallest doc_id.

    Texts without words, and documents without an id, are linked with nothing
    and stay. Of rows equal in id and text one stays; rows of one id with texts
    that aren't linked stay. Long texts are sets like any other.
    """
    return near_copies.one_of_each(docs)


@_bounded
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark; a null text becomes an empty one."""
    return secrets.redacted(docs)


@_bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Documents without words are not taken. A null source is one of the
    sources, the last; repeated rows are documents of their own.
    """
    return mixing.mix(docs)


@_bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a document taken twice is packed twice, an empty one gives its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", mix),
    ("pack", pack),
]
#: Learned filters, transitive links, random rounding and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
