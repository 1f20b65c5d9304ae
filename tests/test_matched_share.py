from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import linking

SCHEMA = "trial long, key long, name string, others array<string>"
NAMES = [("aspirin", "1", "primary"), ("aspirin", "2", "synonyms"), ("shared", "3", "synonyms"), ("shared", "4", "synonyms"), ("other", "5", "mixture_names"), ("unused", "6", "unknown")]


def _found(spark, rows):
    found = linking.matched_share(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(NAMES, "name string, id string, category string"))
    return sorted((tuple(x) for x in found.collect()), key=repr)


def test_first_name_with_an_id_counts(spark):
    rows = [(1, 1, "Aspirin 5 mg", None), (1, 2, "Shared", []), (1, 2, "Shared", []), (1, 3, "nobody", ["unused"]), (1, 4, "nobody", ["shared", "aspirin"]), (1, 5, None, ["other"]), (2, 1, "nobody", None), (None, 1, "aspirin", None)]
    assert _found(spark, rows) == sorted([(1, 4, 2, 5, 80.0), (2, 0, 0, 1, 0.0), (None, 1, 0, 1, 100.0)], key=repr)


def test_each_different_name_is_taken_apart_once(spark, monkeypatch):
    """Of 2,000 interventions under two names, two rows reach the rules for names."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    plain = text.normalise_drug_name
    monkeypatch.setattr(text, "normalise_drug_name", lambda c: plain(counted(c)))
    _found(spark, [(k % 100, k, "Aspirin 5 mg" if k % 2 else "Nobody", None) for k in range(2000)])
    assert 0 < seen.value < 100  # more than 2 where the rules name their input more than once
