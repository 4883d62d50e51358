import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from minutespark.operators import failures as fail
from minutespark.operators import relational as rel
from minutespark.operators import state as st
from minutespark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def run(ok, total=3, priority=10):
    s = {"total": total, "done": 0, "consecutive": 0, "retries": 0, "priority": priority, "status": "queued", "next": None}
    for i, x in enumerate(ok):
        s = st.transition(s, x, float(i))
    return s


def test_transitions():
    assert run([True] * 3)["status"] == "completed"
    assert run([False, False, True])["consecutive"] == 0
    first = run([False] * 3)
    assert (first["status"], first["retries"], first["next"]) == ("retry_scheduled", 1, 2 + 3600.0)
    assert run([False] * 9)["next"] == 8 + 4 * 3600.0
    assert run([False] * 12)["status"] == "failed"
    assert run([False] * 3, priority=9)["status"] == "failed"
    assert run([True] * 3 + [False])["status"] == "completed"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stream_and_batch_agree(spark):
    batch = {tuple(r) for r in catalog.QUERIES["stm2_result_transitions"](spark, FOLDER).na.fill(-1.0, ["next"]).collect()}
    stream = {tuple(r) for r in catalog.QUERIES["stm2_stream_jobs"](spark, FOLDER).na.fill(-1.0, ["next"]).collect()}
    assert batch == stream and batch


def test_claim_order_and_leases(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda m: now - dt.timedelta(minutes=m)
    jobs = [
        (1, "queued", 10, ago(9), None, None), (2, "queued", 20, ago(5), None, ago(1)), (3, "in_progress", 20, ago(6), None, ago(6)),
        (4, "retry_scheduled", 30, ago(6), now + dt.timedelta(minutes=1), None), (5, "completed", 40, ago(6), None, None), (6, "queued", 20, ago(7), None, None),
    ]
    df = spark.createDataFrame(jobs, "id long, status string, priority int, created_at timestamp_ntz, next_retry_at timestamp_ntz, claimed_at timestamp_ntz")
    assert st.claim(df, F.lit(now).cast("timestamp_ntz")).first()["id"] == 6


def test_throttle_and_outbox(spark):
    rows = spark.createDataFrame([("a", float(s), i) for i, s in enumerate([0, 100, 180, 200, 400])], "k string, s double, id long")
    assert [r["id"] for r in st.throttle(rows, "k", "s", "id", 180.0).orderBy("id").collect()] == [0, 2, 4]
    log = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i), i % 2 == 0) for i in range(10)], "id long, at timestamp_ntz, worth boolean")
    true, false = F.lit(True), F.lit(False)
    got = st.outbox(log, true, false, F.lit(0), "at", "id", F.col("worth"), F.lit(dt.datetime(2024, 1, 1, 0, 12)).cast("timestamp_ntz"), 3)
    assert [r["id"] for r in got.collect()] == [0, 2, 4]


def test_alerts_advance_only_what_was_sent(spark):
    searches = spark.createDataFrame([(1, "budget", 5), (2, "roads", 5)], "search_id long, term string, cursor long")
    docs = spark.createDataFrame([(4, "budget"), (6, "The BUDGET"), (9, "budget roads")], "created long, text string")
    hits = st.new_matches(searches, docs, "created", "created")
    assert {(r["search_id"], r["created"]) for r in hits.collect()} == {(1, 6), (1, 9), (2, 9)}
    moved = st.advance(searches, hits.where("search_id = 1"))
    assert {(r["search_id"], r["cursor"]) for r in moved.collect()} == {(1, 9), (2, 5)}


def test_upsert_and_interleave(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, u string, v string")
    new = spark.createDataFrame([(1, "", "y"), (3, "c", "")], "id long, u string, v string")
    assert {tuple(r) for r in rel.upsert(old, new, "id").collect()} == {(1, "a", "y"), (2, "b", None), (3, "c", None)}
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(3)], "lane string, i long")
    order = "".join(r["lane"] for r in rel.interleave(rows, "lane", "i").orderBy("position", "lane").collect())
    assert len(order) == 9 and "aaa" not in order and "bb" not in order


def test_interleave_numbers_rows_as_one_window_would(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i * 3 - 50) for i in range(500)]
    df = spark.createDataFrame(rows, "lane string, i long")
    got = {r["i"]: r["position"] for r in rel.interleave(df, "lane", "i", parts=7).collect()}
    for lane in ("a", "b", None):
        own = sorted(i for x, i in rows if x == lane)
        assert all(abs(got[i] - (n + 0.5) * 500 / len(own)) < 1e-9 for n, i in enumerate(own))


def test_pairs_in_the_band_against_enumeration(spark):
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [(i, t0 + dt.timedelta(seconds=s), 1, "h.x.org") for i, s in enumerate([0, 600, 601, 1200, 1200])]
    rows += [(100 + i, t0 + dt.timedelta(seconds=rng.choice([0, 300, 600, rng.randrange(9000)])), rng.choice([1, 2, None]), rng.choice(["h.x.org", "g.x.org", "k.y.org", None])) for i in range(150)]
    rows.append((999, None, 1, None))
    got = {r["shape"]: r["pairs"] for r in fail.pair_shapes(spark.createDataFrame(rows, "id long, ts timestamp_ntz, job long, host string"), "ts", "id", "job", "host").collect()}
    expected = {}
    for a, b in itertools.combinations([r for r in rows if r[1]], 2):
        if abs((a[1] - b[1]).total_seconds()) <= 600:
            domain = [".".join(x[3].split(".")[-2:]) if x[3] else None for x in (a, b)]
            shape = "same_job" if a[2] == b[2] else "same_host" if a[3] == b[3] else "same_domain" if domain[0] and domain[0] == domain[1] else "unrelated"
            expected[shape] = expected.get(shape, 0) + 1
    assert got == expected


def test_jobs_and_throttle_against_plain_folds(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), 4, rng.choice([5, 20]), rng.random() < 0.5, float(rng.randrange(50)), i) for i in range(300)]
    rows = [(j, t, {1: 5, 2: 20, None: 20}[j], ok, at, i) for j, t, _, ok, at, i in rows]
    got = {r["job"]: tuple(r)[1:] for r in st.run_jobs(spark.createDataFrame(rows, "job long, total long, priority long, ok boolean, at double, id long")).collect()}
    passed = {(r["job"], r["id"]) for r in st.throttle(spark.createDataFrame(rows, "job long, total long, priority long, ok boolean, at double, id long"), "job", "at", "id", 7.0).collect()}
    kept = set()
    for job in (1, 2, None):
        s, last = {"total": 4, "done": 0, "consecutive": 0, "retries": 0, "priority": {1: 5, 2: 20, None: 20}[job], "status": "queued", "next": None}, None
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[4], r[5])):
            s = st.transition(s, r[3], r[4])
            if last is None or r[4] - last >= 7.0:
                last = r[4]
                kept.add((job, r[5]))
        assert got[job] == tuple(s.values())
    assert passed == kept


def test_new_matches_against_enumeration(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abÉ'中") for _ in range(rng.randrange(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(90, None), (91, "x" * 9), (91, "yy")]
    searches = [(i, " ".join(word() for _ in range(rng.randrange(1, 3)))[: rng.randrange(1, 6)], rng.randrange(60)) for i in range(60)] + [(70, "", 0), (71, None, 0), (72, "XX", 0)]
    got = st.new_matches(spark.createDataFrame(searches, "search_id long, term string, cursor long"), spark.createDataFrame(docs, "id long, text string"), "id", "id")
    expected = sorted((s, d) for s, term, cursor in searches for d, text in docs if term and term.strip() and text and d > cursor and term.lower() in text.lower())
    assert sorted((r["search_id"], r["id"]) for r in got.collect()) == expected


def test_checkpoints_of_other_work_are_not_taken_up(spark):
    jobs = spark.createDataFrame([(i, 900, 8, 7200.0) for i in range(6)], "job long, chunk_size int, chunks int, duration double")
    held = [(0, 900, 8, 7201.0, 3), (1, 600, 8, 7200.0, 3), (2, 900, 7, 7200.0, 3), (3, 900, 8, 7201.5, 3), (4, 900, 8, None, 3)]
    got = st.resumed(jobs, spark.createDataFrame(held, "job long, chunk_size int, chunks int, duration double, done long"), "job")
    assert {r["job"]: r["done"] for r in got.collect()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_replace_swaps_the_table(spark, tmp_path):
    from minutespark.sources import tables

    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    got = tables.replace(spark.read.parquet(path).where("id > 6"), path)
    assert sorted(r["id"] for r in got.collect()) == [7, 8, 9] and os.listdir(tmp_path) == ["t"]


def test_streamed_alerts_are_those_of_the_batch(spark, tmp_path):
    from minutespark.streaming import streams

    docs = [(4, "budget"), (6, "The BUDGET"), (9, "budget roads")]
    spark.createDataFrame(docs, "created long, text string").write.parquet(f"{tmp_path}/docs")
    searches = spark.createDataFrame([(1, "budget", 5), (2, "roads", 5)], "search_id long, term string, cursor long")
    stream = spark.readStream.schema("created long, text string").parquet(f"{tmp_path}/docs")
    got = streams.alerts(stream, searches, "created", "created")
    assert {(r["search_id"], r["created"]) for r in got.collect()} == {(1, 6), (1, 9), (2, 9)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from minutespark.streaming import streams

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        streams.work_folder(spark, "x")
