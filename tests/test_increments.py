"""Tables that grow by increments equal those made at once."""

from __future__ import annotations

import random
from datetime import timedelta

from conftest import make_events, ts
from pyspark.sql import functions as F

from eventide.operators.extract import dedupe_events, latest_per_person
from eventide.operators.stats import vocabulary
from eventide.sinks import latest
from eventide.sinks import vocabulary as stored


def log(spark, n, seed=1):
    """Events whose arrival number is not their time: many are late."""
    rng = random.Random(seed)
    rows = [(rng.randrange(12), str(ts("2031-01-01") + timedelta(seconds=rng.randrange(10**6))), rng.choice("abc"), 5,
             None, k) for k in range(n)]
    return make_events(spark, rows).withColumn("arrival", F.col("EventKey"))


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_increments_equal_the_full_extract(spark, tmp_path):
    every = log(spark, 900).cache()
    path, n = f"{tmp_path}/latest", 7
    for upto, fresh in ((300, 300), (301, 1), (301, 0), (900, 599)):
        part = every.where(F.col("arrival") < upto)
        assert latest.advance(part, path, n, mark="arrival", buckets=4) == fresh
        assert bag(latest.read_latest(spark, path)) == bag(latest_per_person(part, n))
    assert latest.stored_mark(spark, path) == 899


def test_an_increment_reads_and_writes_its_buckets_only(spark, tmp_path):
    import os

    path = f"{tmp_path}/latest"
    every = log(spark, 400).cache()
    latest.advance(every, path, 5, mark="arrival", buckets=8)

    def files():
        return {os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.startswith("part-")}

    before = files()
    one = make_events(spark, [(3, "2040-01-01", "z", 5, None, 5000)]).withColumn("arrival", F.col("EventKey"))
    latest.advance(every.unionByName(one), path, 5, mark="arrival", buckets=8)
    assert len({f.split("bucket=")[1].split("/")[0] for f in before ^ files()}) == 1
    assert latest.read_latest(spark, path).where("PersonId = 3 and DefinitionId = 'z'").count() == 1


def test_a_repeated_increment_changes_nothing(spark, tmp_path):
    every, path = log(spark, 200).cache(), f"{tmp_path}/latest"
    latest.advance(every, path, 5, mark="arrival", buckets=4)
    want = bag(latest.read_latest(spark, path))
    spark.createDataFrame([(50,)], "mark long").write.mode("overwrite").parquet(f"{path}-mark")  # as after a crash
    twice = dedupe_events(every).unionByName(every.where("arrival > 150"))
    latest.advance(twice, path, 5, mark="arrival", buckets=4)
    assert bag(latest.read_latest(spark, path)) == want


def test_ids_survive_new_types(spark, tmp_path):
    path, ids = f"{tmp_path}/vocab", {}
    for types in (["m", "c", None, "c"], ["c", "a", "z"], [None], ["b", "m", "zz", "a"]):
        rows = [(k, "2031-01-01", t) for k, t in enumerate(types)]
        assert stored.grow(make_events(spark, rows), path) == len({t for t in types if t} - set(ids))
        now = {r.token: r.token_id for r in stored.read_vocabulary(spark, path).collect()}
        assert {t: now[t] for t in ids} == ids and sorted(now.values()) == list(range(len(now)))
        ids = now
    assert ids == {"c": 0, "m": 1, "a": 2, "z": 3, "b": 4, "zz": 5}
    scratch = make_events(spark, [(k, "2031-01-01", t) for k, t in enumerate(["m", "c", "a", "z", "b", "zz"])])
    assert {r.token for r in vocabulary(scratch).collect()} == set(ids)


def test_nothing_to_add(spark, tmp_path):
    none = log(spark, 1).limit(0)
    assert latest.advance(none, f"{tmp_path}/latest", 5, mark="arrival") == 0
    assert stored.grow(none, f"{tmp_path}/vocab") == 0 and stored.read_vocabulary(spark, f"{tmp_path}/vocab").count() == 0


def test_vocabulary_is_the_same_by_ranges(spark, monkeypatch):
    from eventide.operators import stats

    rows = make_events(spark, [(k, "2031-01-01", f"t{(k * 7) % 53:02d}") for k in range(300)])
    one = {r.token: r.token_id for r in stats.vocabulary(rows).collect()}
    monkeypatch.setattr(stats, "ONE_RANGE", 10)
    assert {r.token: r.token_id for r in stats.vocabulary(rows).collect()} == one == {
        f"t{i:02d}": i for i in range(53)}
