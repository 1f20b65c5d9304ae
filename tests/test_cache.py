"""A cache whose runs are killed half way loses no key and repeats none."""

import pytest
from pyspark.sql import functions as F

from kgspark.sources.cache import Cache


def upper(keys):
    """Looks a term up; terms with an x have no result, terms of length 2 have two."""
    found = keys.where(~F.col("term").contains("x")).select("term", F.explode(F.when(F.length("term") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("place"))
    return found.select("term", F.upper("term").alias("name"), "place")


@pytest.fixture
def cache(spark, tmp_path):
    return Cache(spark, f"file://{tmp_path}/cache", "term", "name string, place int")


def wanted(spark, n=40):
    return spark.createDataFrame([(f"t{k}",) for k in range(n)] + [("x1",), ("t1",), (None,)], "term string")


def lines(cache):
    return sorted(((r.term, r.name, r.place) for r in cache.read().collect()), key=str)


def test_run_looks_each_key_up_once(spark, cache):
    asked = spark.sparkContext.accumulator(0)
    counted = lambda keys: asked.add(keys.count()) or upper(keys)
    assert cache.read().count() == 0
    assert cache.run(wanted(spark), counted, 10) == 41 and asked.value == 41
    assert cache.run(wanted(spark), counted, 10) == 0 and asked.value == 41
    out = lines(cache)
    assert len(out) == 10 * 2 + 30 + 1 and ("x1", None, None) in out and ("t1", "T1", 2) in out
    assert sum(b["keys"] for b in cache.manifest()) == 41


@pytest.mark.parametrize("before_commit", [False, True])
def test_a_killed_run_goes_on_where_it_stopped(spark, cache, monkeypatch, before_commit):
    done = []

    def dying(keys):
        if len(done) == 2 and not before_commit:
            raise KeyboardInterrupt
        done.append([r.term for r in keys.collect()])
        return upper(keys)

    if before_commit:
        keep = Cache._commit
        monkeypatch.setattr(Cache, "_commit", lambda self, *a: (_ for _ in ()).throw(KeyboardInterrupt()) if len(done) == 3 else keep(self, *a))
    with pytest.raises(KeyboardInterrupt):
        cache.run(wanted(spark), dying, 8)
    monkeypatch.undo()
    kept = len(cache.manifest())
    assert kept == 2
    sure = {t for keys in done[:2] for t in keys}
    assert {t for t, *_ in lines(cache)} == sure
    again = Cache(spark, cache.path, "term", "name string, place int")
    later = []
    assert again.run(wanted(spark), lambda keys: later.extend(r.term for r in keys.collect()) or upper(keys), 8) == 41 - len(sure)
    assert len(later) == len(set(later)) and not sure & set(later)
    whole = lines(again)
    assert len(whole) == 51 and len(set(whole)) == 51


def test_newer_rows_replace_a_keys_older_ones(spark, cache):
    row = "term string, name string, place int"
    cache.write(spark.createDataFrame([("a", "old", 1), ("a", "old", 2), ("b", "old", 1)], row))
    cache.write(spark.createDataFrame([("a", "new", 1), ("c", "new", 1), (None, "no", 1)], row))
    assert lines(cache) == [("a", "new", 1), ("b", "old", 1), ("c", "new", 1)]


def test_replayed_micro_batches_count_once(spark, cache, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(f"s{k}", "n", k)], "term string, name string, place int").coalesce(1).write.mode("append").json(source)

    def stream(checkpoint):
        rows = spark.readStream.schema("term string, name string, place int").option("maxFilesPerTrigger", 1).json(source)
        rows.writeStream.foreachBatch(cache.from_stream).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    stream("first")
    before = lines(cache)
    stream("second")  # the same epochs again, from a lost checkpoint
    assert lines(cache) == before and len(before) == 3 and len(cache.manifest()) == 3
