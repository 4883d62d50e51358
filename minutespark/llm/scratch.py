"""Intermediate tables in the cluster's shared folder, and joins whose broadcasts are size-checked."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows take at most so many bytes; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20
#: Rows of a batch of texts that is handed to Python; the copies of ten times as many long ones weigh on an executor.
PYTHON_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if all runs in one process (tests);
    executors of a cluster could not see that."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(shared_dir, "own", None)
    if known is None:
        known = shared_dir.own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return known


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a short lineage that
    survives lost executors, and a result that is computed once. While it runs, texts go to Python in batches
    of at most ``PYTHON_ROWS`` rows; then the session has its own setting again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/minutespark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, min(int(before), PYTHON_ROWS) if int(before) > 0 else PYTHON_ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def neutral(df: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... and the new names of ``used``, so that a table's own columns
    cannot clash with an operator's; ``df.columns`` restores the names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{df.columns.index(u)}" for u in used]


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName() == "minutespark":
                path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(docs: DataFrame, name: str, **columns: Column) -> DataFrame:
    """A table of ``columns`` of ``docs`` with a column ``row``, a number for each row that later readings keep; ids may
    be null or repeated."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in columns.items())), name)


def sized(df: DataFrame, *variable: str) -> DataFrame:
    """Mark ``df`` for broadcast if its rows take at most ``BROADCAST_BYTES``: eight bytes a column, and for each of
    ``variable`` its bytes (strings) or sixteen an element (arrays). Callers pass narrow tables that are
    already materialized, so that measuring is cheap."""
    each = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for name in variable:
        kind = df.schema[name].dataType.typeName()
        each = each + F.coalesce(F.size(name) * 16 if kind == "array" else F.octet_length(name), F.lit(0))
    held = df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a, b), by alternating large-star and small-star steps.

    Returns (id, component): one row per node that has an edge; component is the smallest id of its
    component. Every step groups with map-side partial aggregation, so a node with very many
    edges is no bottleneck. The state is written out after every round.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    current = materialize(pairs.distinct(), "edges")
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u").toDF("u", "v"))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = both.where("v > u").join(sized(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(sized(low), "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.toDF("u", "v"))
        current = materialize(small.distinct(), "small")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return materialize(current.toDF("id", "component").union(roots).distinct(), "components")


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
