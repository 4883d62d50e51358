import datetime as dt
import random
import re
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from minutespark.streaming import refresh

SCHEMA = "id long, text string, at timestamp, deleted boolean"


def batches(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["budget", "Plan", "é", "it's", "a", "x" * 300, "vote"]) + rng.choice(["", "", "1"])
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(600))
    return [[(rng.choice([*range(25), None]), rng.choice([None, " ".join(word() for _ in range(rng.randrange(0, 6)))]), at(), rng.choice([False, False, None, True])) for _ in range(rng.randrange(0, 15))] for _ in range(n)]


def rebuilt(changes):
    held = {}
    for i, text, at, deleted in changes:
        if i is not None:
            new = (at, text or "", text is not None, text, bool(deleted))
            held[i] = max(held.get(i, new), new)
    texts = {i: c[3] for i, c in held.items() if not c[4]}
    return texts, Counter(w for t in texts.values() for w in set(re.findall("[a-z0-9']+", (t or "").lower())) if len(w) <= 255)


def state(spark, folder):
    return {r["id"]: r["text"] for r in refresh.corpus(spark, folder).collect()}, {r["word"]: r["n"] for r in refresh.vocabulary(spark, folder).collect()}


def test_batches_replays_and_failures_equal_a_rebuild(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    refresh.start(spark, folder)
    given = batches(1, 6)
    for n, rows in enumerate(given):
        df = spark.createDataFrame(rows, SCHEMA)
        if n == 2:  # half of a batch, then a failure: nothing is seen of it
            spark.createDataFrame([("half", 5)], refresh.WORDS).write.parquet(f"{folder}/words/batch={n}")
            assert state(spark, folder) == rebuilt(sum(given[:n], []))
        refresh.apply_batch(df, n, folder)
        if n in (1, 4):  # delivered again
            refresh.apply_batch(df, n, folder)
        if n == 3:
            refresh.compact(spark, folder)
            refresh.compact(spark, folder)
        assert state(spark, folder) == rebuilt(sum(given[: n + 1], []))


def test_a_stream_goes_on_where_it_stopped(spark):
    folder, source = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    given = batches(2, 5)
    for part in (given[:3], given[3:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        refresh.follow(stream, folder + "/state", folder + "/checkpoint", every=2)
    assert state(spark, folder + "/state") == rebuilt(sum(given, []))
    assert refresh.corpus(spark, folder + "/state", before=0).count() == 0
    assert spark.read.parquet(folder + "/state/corpus").select(F.max("batch")).first()[0] >= 3


def test_a_batch_moves_no_texts_but_its_own(spark):
    """The stored texts that a batch does not change are not shuffled."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    refresh.start(spark, folder)
    stored = spark.range(3000).selectExpr("id", "repeat(sha2(string(id), 512), 30) text", "timestamp_seconds(0) at", "false deleted")
    refresh.apply_batch(stored, 0, folder)
    fresh = stored.selectExpr("id + 100000 id", "repeat(text, 3) text", "at", "deleted").where("id < 100500")
    executors = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = executors()
    refresh.apply_batch(fresh, 1, folder)
    own = 500 * 128 * 30 * 3
    assert executors() - before < own / 3
    assert refresh.corpus(spark, folder).count() == 3500


def test_a_large_fold_is_not_written_for_a_few_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    refresh.start(spark, folder)
    given = [[(i, f"w{i} a", dt.datetime(2024, 1, 1), False) for i in range(40)], [(i, f"v{i}", dt.datetime(2024, 1, 2), i % 2 > 0) for i in range(4)], [(1, "late", dt.datetime(2023, 1, 1), False), (2, "x", dt.datetime(2024, 1, 3), False)]]
    for n, rows in enumerate(given):
        refresh.apply_batch(spark.createDataFrame(rows, SCHEMA), n, folder)
    refresh.compact(spark, folder, whole=False)
    assert [(r["since"], r["upto"]) for r in refresh._committed(spark, folder, None)] == [(0, 0), (1, 1), (2, 2)]
    assert state(spark, folder) == rebuilt(sum(given, []))
    more = [[(i, "y", dt.datetime(2024, 1, 4), False) for i in range(50)], [(99, "z", dt.datetime(2024, 1, 4), False)] * 2]
    for n, rows in enumerate(more, 3):
        refresh.apply_batch(spark.createDataFrame(rows, SCHEMA), n, folder)
        refresh.compact(spark, folder, whole=False)
        assert state(spark, folder) == rebuilt(sum([*given, *more[: n - 2]], []))
    refresh.compact(spark, folder)
    assert [(r["since"], r["upto"]) for r in refresh._committed(spark, folder, None)] == [(0, 4)]
    assert state(spark, folder) == rebuilt(sum([*given, *more], [])) and refresh.corpus(spark, folder, before=1).count() == 40
