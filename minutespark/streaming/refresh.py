"""A searched corpus and its vocabulary kept up to date by a stream of changes.

A batch of changes (id, text, at, deleted) writes what it changes, and nothing else: its texts, and for each word by how many texts more or fewer
hold it. Both go to folders named after the batch, then a row in ``commits`` makes them count; a batch is computed from the committed ones before it,
so a replayed batch writes the same again, and one that failed half-way is not seen. The newest change of an id (by ``at``, then the greater
text) holds, whichever batch brings it; a late one changes nothing. ``compact`` folds the batches so far into one.

A batch's texts are dealt out once, by bucket, together with the stored texts of its ids and no others. ``follow`` folds the newest batches, and older
ones only with as many rows of newer ones, so that a row is written again a logarithmic number of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from minutespark.operators.search import tokens

CORPUS = "id long, text string, at timestamp, deleted boolean"
WORDS = "word string, change long"
#: A row stands for the batches from ``since`` to ``upto``.
COMMITS = "batch long, upto long, since long"
#: Texts are kept in so many buckets by id; a batch reads those that its ids fall into.
BUCKETS = 64
#: So many ids of a batch at most are sent to all tasks to find their stored texts; of more, texts are shuffled.
BROADCAST_IDS = 2_000_000


def _bucket():
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def start(spark: SparkSession, folder: str) -> None:
    """An empty state, if there is none."""
    for name, columns in (("corpus", CORPUS + ", bucket int"), ("words", WORDS), ("commits", COMMITS)):
        empty = spark.createDataFrame([], columns)
        writer = empty.write.mode("ignore")
        writer.parquet(f"{folder}/{name}/batch=-1" if name != "commits" else f"{folder}/{name}")


def _committed(spark: SparkSession, folder: str, before: int | None) -> list[Row]:
    """The rows of ``commits`` that count now, from the oldest batches to the newest: committed, and not folded into a later compaction."""
    since = F.coalesce("since", F.when(F.col("batch") == F.col("upto"), F.col("batch")).otherwise(0)).alias("since")
    rows = spark.read.schema(COMMITS).parquet(f"{folder}/commits").select("batch", "upto", since).distinct().orderBy("since", F.desc("upto")).collect()
    kept: list[Row] = []
    for r in rows:
        if (before is None or r["upto"] < before) and (not kept or r["upto"] > kept[-1]["upto"]):
            kept.append(r)
    return kept


def _read(spark: SparkSession, folder: str, name: str, columns: str, before: int | None) -> DataFrame:
    return _of(spark, folder, name, columns, _committed(spark, folder, before))


def _of(spark: SparkSession, folder: str, name: str, columns: str, commits: list[Row]) -> DataFrame:
    batches = [r["batch"] for r in commits]
    return spark.read.schema(f"{columns}, batch long").parquet(f"{folder}/{name}").where(F.col("batch").isin(batches))


def _change():
    """What one change of an id is compared with another by; a null text is before all others."""
    return F.struct("at", "text", "deleted")


def _newest(changes: DataFrame, *by: str) -> DataFrame:
    """The change of each id that holds; rows that agree in an id agree in ``by``."""
    return changes.where("id is not null").groupBy(*by, "id").agg(F.max(_change()).alias("c")).select("id", "c.text", "c.at", "c.deleted", *by)


def corpus(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(id, text) as the committed batches (those ``before`` one) leave it."""
    rows = _read(spark, folder, "corpus", CORPUS + ", bucket int", before)
    return _newest(rows).where("not deleted").select("id", "text")


def vocabulary(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(word, n): how many texts hold each word."""
    rows = _read(spark, folder, "words", WORDS, before).groupBy("word").agg(F.sum("change").alias("n"))
    return rows.where("n > 0")


def _commit(spark: SparkSession, folder: str, batch: int, since: int, upto: int) -> None:
    spark.createDataFrame([(batch, upto, since)], COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def apply_batch(changes: DataFrame, batch: int, folder: str) -> None:
    """Take up a batch of changes; for ``foreachBatch``."""
    spark = changes.sparkSession
    new = changes.where("id is not null").select("id", "text", F.col("at").cast("timestamp").alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"), _bucket().alias("bucket"))
    ids = new.select("id", "bucket").distinct().persist()
    asked = ids.agg(F.count("*").alias("n"), F.collect_set("bucket").alias("buckets")).first()
    before = _read(spark, folder, "corpus", CORPUS + ", bucket int", batch).where(F.col("bucket").isin(asked["buckets"]))
    old = before.join(F.broadcast(ids.select("id")) if asked["n"] <= BROADCAST_IDS else ids.select("id"), "id", "left_semi")
    both = new.withColumn("stored", F.lit(False)).unionByName(old.drop("batch").withColumn("stored", F.lit(True)))
    # The rows of an id have one bucket: dealt out by it, they are grouped and written without another shuffle.
    held = both.repartition("bucket").groupBy("bucket", "id").agg(F.max(_change()).alias("now"), F.max(F.when(F.col("stored"), _change())).alias("was"))
    # Rows of changes that came too late are not kept.
    changed = held.where(~F.col("now").eqNullSafe(F.col("was"))).persist()

    def words(state: str, change: int) -> DataFrame:
        return changed.where(f"not {state}.deleted").select(F.explode(tokens(F.col(f"{state}.text"))).alias("word"), F.lit(change).cast("long").alias("change"))

    change = words("now", 1).unionByName(words("was", -1)).where(F.length("word") <= 255).groupBy("word").agg(F.sum("change").alias("change")).where("change <> 0")
    change.write.mode("overwrite").parquet(f"{folder}/words/batch={batch}")
    kept = changed.select("id", "now.text", "now.at", "now.deleted", "bucket")
    kept.sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{folder}/corpus/batch={batch}")
    _commit(spark, folder, batch, batch, batch)
    changed.unpersist()
    ids.unpersist()


def compact(spark: SparkSession, folder: str, whole: bool = True) -> None:
    """Fold committed batches into one: all, or (not ``whole``) the newest ones and, from there on back, those that have no more rows than all newer ones.
    Readers take it from its commit on. Batches to come go on as before."""
    taken = _committed(spark, folder, None)
    if not whole:
        sizes = {r["batch"]: r["count"] for r in _of(spark, folder, "corpus", CORPUS + ", bucket int", taken).groupBy("batch").count().collect()}
        at, rows = len(taken), 0
        while at and (at == len(taken) or sizes.get(taken[at - 1]["batch"], 0) <= rows):
            at -= 1
            rows += sizes.get(taken[at]["batch"], 0)
        taken = taken[at:]
    if len(taken) < 2:
        return
    since, upto = taken[0]["since"], taken[-1]["upto"]
    base = -2 - (since << 31 | upto)
    rows = _of(spark, folder, "corpus", CORPUS + ", bucket int", taken).repartition("bucket")
    _newest(rows, "bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{folder}/corpus/batch={base}")
    change = _of(spark, folder, "words", WORDS, taken).groupBy("word").agg(F.sum("change").alias("change")).where("change <> 0")
    change.write.mode("overwrite").parquet(f"{folder}/words/batch={base}")
    _commit(spark, folder, base, since, upto)


def follow(changes: DataFrame, folder: str, checkpoint: str, every: int = 20) -> None:
    """Run the stream ``changes`` over what is available; fold batches together now and then."""
    spark = changes.sparkSession
    start(spark, folder)

    def take(df: DataFrame, batch: int) -> None:
        apply_batch(df, batch, folder)
        if batch % every == every - 1:
            compact(spark, folder, whole=False)

    changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start().awaitTermination()
