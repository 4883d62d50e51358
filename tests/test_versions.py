import random
import threading

import pytest

from minutespark.operators import relational as rel
from minutespark.sources import versions
from pyspark.sql import functions as F

ROW = "id long, v string"


def held(spark, path, number=None):
    return sorted((tuple(r) for r in versions.read(spark, path, number).collect()), key=str)


def upsert(old, new):
    return rel.upsert(old, new, "id")


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "t")
    want = {i: f"v{i}" for i in range(40)}
    versions.create(spark.createDataFrame(list(want.items()), ROW), path, ["id"], 8)
    history = [dict(want)]
    for n in range(4):
        new = {rng.randrange(60): rng.choice(["", f"n{n}", None]) for _ in range(5)}
        assert versions.change(spark, path, spark.createDataFrame(list(new.items()), ROW), upsert) == 2 * n + 1
        want |= {k: v or want.get(k) for k, v in new.items()}
        history.append(dict(want))
        gone = rng.sample(range(60), 3)
        versions.delete(spark, path, spark.createDataFrame([(g,) for g in gone], "id long"))
        want = {k: v for k, v in want.items() if k not in gone}
        history.append(dict(want))
    for number, rows in enumerate(history):
        assert held(spark, path, number) == sorted(rows.items(), key=str)


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.range(200).select("id", F.lit("a").alias("v")), path, ["id"], 8)
    versions.change(spark, path, spark.createDataFrame([(5, "b")], ROW), upsert)
    before, after = (versions._state(spark, path, n)["folders"] for n in (0, 1))
    assert len(before) == 8 and sum(before[p] != after[p] for p in before) == 1


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([(1, "a"), (None, "n")], ROW), path, ["id"], 4)
    broken = lambda old, new: old.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.change(spark, path, spark.createDataFrame([(1, "b")], ROW), broken)
    with pytest.raises(ValueError):
        versions.change(spark, path, spark.createDataFrame([(1, "b")], ROW), lambda old, new: old.unionByName(spark.range(2, 40).select("id", F.lit("x").alias("v"))))
    assert versions.version(spark, path) == 0 and held(spark, path) == [(1, "a"), (None, "n")]


def test_two_writers_lose_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([(0, "0")], ROW), path, ["id"], 1)
    both = threading.Barrier(2)

    def write(k):
        first = []

        def apply(old, new):
            if not first:
                first.append(both.wait(60))  # both have read the same version
            return upsert(old, new)

        versions.change(spark, path, spark.createDataFrame([(k, str(k))], ROW), apply)

    writers = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [w.start() for w in writers]
    [w.join(120) for w in writers]
    assert held(spark, path) == [(0, "0"), (1, "1"), (2, "2")] and versions.version(spark, path) == 2


def test_empty_tables_and_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    none = spark.createDataFrame([], ROW)
    versions.create(none, path, ["id"], 4)
    with pytest.raises(versions.Overtaken):
        versions.create(none, path, ["id"], 4)
    assert versions.change(spark, path, none, upsert) == 0 and held(spark, path) == []
    versions.change(spark, path, spark.createDataFrame([(1, "a")], ROW), upsert)
    versions.delete(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert held(spark, path) == []
