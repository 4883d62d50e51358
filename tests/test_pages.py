from minutespark.operators import relational as rel
from pyspark.sql import functions as F


def test_pages_and_totals(spark):
    rows = spark.range(500, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("n"), "id")
    order = [F.desc("n"), F.asc("id")]
    want = sorted(((r["n"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    for offset, limit in ((0, 20), (20, 20), (490, 20), (500, 20), (0, 1000)):
        got = rel.page_with_total(rows, order, offset, limit, parts=3).collect()
        assert [(r["n"], r["id"]) for r in got] == want[offset : offset + limit] and {r["total"] for r in got} <= {500}
    assert rel.page_with_total(rows.where("id < 0"), order, 0, 5).collect() == []
