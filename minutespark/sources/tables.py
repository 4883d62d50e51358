"""Readers and writers of tables and line files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a text file, one a line; blank lines and those that begin with # are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def expand(urls: DataFrame, playlists: DataFrame) -> DataFrame:
    """Playlist addresses become those of their entries (url, entries); others stay."""
    both = urls.join(playlists, "url", "left")
    return both.select(F.explode(F.when(F.col("entries").isNull(), F.array("url")).otherwise(F.col("entries"))).alias("url"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """'date TAB id' lines: (date, id); a line without a tab is an undated id."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.when(F.size(parts) > 1, F.get(parts, F.lit(0)).try_cast("date")).alias("date"), F.trim(F.element_at(parts, -1)).alias("id"))


def delimited(spark: SparkSession, path: str, sep: str = "|", encoding: str = "iso-8859-1") -> DataFrame:
    return spark.read.csv(path, sep=sep, encoding=encoding, header=True)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name, states): lower-cased names with all their states."""
    rows = spark.read.csv(path, header=True)
    return rows.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.array_sort(F.collect_set("state")).alias("states"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes within values are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Put ``df``, which may read the table itself, in the place of a table: written beside it first, then two renames swap the folders.
    If it fails before them the table is as it was; between them the old rows are beside it."""
    spark = df.sparkSession
    beside, before = (f"{path}.{word}-{uuid.uuid4().hex}" for word in ("new", "old"))
    df.write.parquet(beside)
    at, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, before))
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(at) and not files.rename(at, old):
        raise OSError(f"could not move {path}")
    if not files.rename(new, at):
        files.rename(old, at)
        raise OSError(f"could not move {beside}")
    files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
