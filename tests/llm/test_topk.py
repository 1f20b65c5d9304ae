import pytest
from pyspark.sql import functions as F

from kgspark.llm import topk
from tests.llm.test_queries import brute_top


@pytest.mark.parametrize("n", [6, 12, 20])
def test_top_k_with_negative_scores(spark, n):
    rows = [(0, [10.0, 0.0])] + [(k, [-10.0 * k, float(k % 3)]) for k in range(1, n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 50, 5)
