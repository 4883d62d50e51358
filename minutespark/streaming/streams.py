"""Structured Streaming twins of the state machines: event time, watermarks, keyed state."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutespark.operators.state import STATE, new_matches, transition


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/minutespark/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """An event folder (or file) as a stream; event time as timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def run(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is available and return what it wrote (in append mode, or through
    ``each`` batch in update mode: the latest rows with their batch number)."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if each is None:
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.outputMode("update").foreachBatch(lambda df, n: each(df, n).withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    columns = stream.schema if each is None else None
    return spark.read.schema(columns).parquet(f"{folder}/rows") if columns else spark.read.parquet(f"{folder}/rows")


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, time: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    w = F.window(time, width, slide)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions close at a gap of at least ``gap`` (the batch form splits only above it)."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


_FIELDS = ["total", "done", "consecutive", "retries", "priority", "status", "next"]
_KEPT = "total long, done long, consecutive long, retries long, priority long, status string, next double"


def job_states(results: DataFrame) -> DataFrame:
    """The retry machine on a stream of results (job, total, priority, ok, at, id): the state of every
    job that a batch touched."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["at", "id"])
        if state.exists:
            s = dict(zip(_FIELDS, state.get, strict=True))
        else:
            head = pdf.iloc[0]
            s = {"total": int(head["total"]), "done": 0, "consecutive": 0, "retries": 0, "priority": int(head["priority"]), "status": "queued", "next": None}
        for r in pdf.itertuples():
            s = transition(s, bool(r.ok), float(r.at))
        state.update(tuple(s[f] for f in _FIELDS))
        yield pd.DataFrame([{"job": key[0], **s}])[[c.split()[0] for c in STATE.split(", ")]].astype({"next": "float64"})

    return results.groupBy("job").applyInPandasWithState(step, STATE, _KEPT, "update", "NoTimeout")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last batch's row of each key."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return best.select(key, "s.*")


def alerts(docs: DataFrame, searches: DataFrame, id_col: str, created: str) -> DataFrame:
    """Documents as they come against saved searches: each batch is matched like the batch form; (search_id, id)."""
    return run(docs, "alerts", each=lambda df, _: new_matches(searches, df, id_col, created).select("search_id", id_col))
