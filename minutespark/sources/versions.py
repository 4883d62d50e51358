"""Parquet tables that are changed by rewriting only the parts which a change falls into.

Rows are dealt to parts by a hash of their key. A version is a small file that names the folder of each part; a change reads the parts it touches,
writes their successors beside them and then puts the next version's file in place, which succeeds for one writer only. Readers take the newest
version's folders, so they never see half a change, and a change that fails before its last step leaves the table as it was. A writer that
was overtaken starts again from the version that overtook it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Overtaken(RuntimeError):
    """Another writer made the next version first, each time."""


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return at, at.getFileSystem(conf), conf


def _names(spark: SparkSession, path: str) -> list[str]:
    at, files, _ = _place(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def version(spark: SparkSession, folder: str) -> int:
    """The newest version's number; -1 where there is no table."""
    return max((int(n) for n in _names(spark, f"{folder}/versions") if n.isdigit()), default=-1)


def _state(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/versions/{number:012}", wholetext=True).first()[0])


def _commit(spark: SparkSession, folder: str, number: int, state: dict) -> bool:
    """Put a version's file in place whole, or not at all if it is there already."""
    target, files, conf = _place(spark, f"{folder}/versions/{number:012}")
    beside, _, _ = _place(spark, f"{folder}/versions/_{uuid.uuid4().hex}")
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(beside, target, how)
    except Py4JJavaError as failed:
        files.delete(beside, False)
        if "FileAlreadyExistsException" in str(failed.java_exception):
            return False
        raise
    return True


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write(rows: DataFrame, folder: str, keys: list[str], parts: int) -> dict[str, str]:
    """Rows to a folder of their own: the folder of each part that has rows. Large parts are spread over several tasks."""
    own = f"{folder}/data/{uuid.uuid4().hex}"
    rows.withColumn("_part", _part(keys, parts)).hint("rebalance", "_part").write.partitionBy("_part").parquet(own)
    return {n.split("=")[1]: f"{own}/{n}" for n in _names(rows.sparkSession, own) if n.startswith("_part=")}


def create(rows: DataFrame, folder: str, keys: list[str], parts: int = 64) -> None:
    """A table of ``rows``; an error where there is one. Rows with null keys have a part like others. About as many parts as the table has
    gigabytes keep a small change cheap and files large."""
    spark = rows.sparkSession
    state = {"keys": keys, "parts": parts, "schema": rows.schema.json(), "folders": _write(rows, folder, keys, parts)}
    if not _commit(spark, folder, 0, state):
        raise Overtaken(folder)


def _rows(spark: SparkSession, state: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(state["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The table's rows, of its newest version or of an earlier one."""
    state = _state(spark, folder, version(spark, folder) if number is None else number)
    return _rows(spark, state, sorted(state["folders"].values()))


def change(spark: SparkSession, folder: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 10) -> int:
    """Replace the rows of all parts that keys of ``changes`` fall into by ``apply(rows of these parts, changes)``; the number of the
    version made, or of the present one where there are no changes. ``apply`` must leave rows alone whose keys are not in ``changes``,
    and be repeatable. Parts that are not touched are neither read nor written."""
    for _ in range(tries):
        now = version(spark, folder)
        state = _state(spark, folder, now)
        keys, parts = state["keys"], state["parts"]
        touched = {str(r[0]) for r in changes.select(_part(keys, parts)).distinct().collect()}  # at most ``parts`` rows
        if not touched:
            return now
        old = _rows(spark, state, sorted(f for p, f in state["folders"].items() if p in touched))
        fresh = _write(apply(old, changes).select(*old.columns), folder, keys, parts)
        folders = {p: f for p, f in state["folders"].items() if p not in touched} | fresh
        if not fresh.keys() <= touched:
            raise ValueError("a change made rows whose keys are not among its own")
        if _commit(spark, folder, now + 1, state | {"folders": folders}):
            return now + 1
    raise Overtaken(folder)


def delete(spark: SparkSession, folder: str, gone: DataFrame) -> int:
    """Rows whose keys (not null) are in ``gone`` go."""
    keys = _state(spark, folder, version(spark, folder))["keys"]
    return change(spark, folder, gone, lambda old, new: old.join(new.select(*keys).distinct(), keys, "left_anti"))
