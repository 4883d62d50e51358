"""Relational building blocks that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(probes: DataFrame, key: str, *sources: tuple[DataFrame, str, str]) -> DataFrame:
    """Prioritised lookup: (probe, found, rank) from the first source that knows the probe. Each
    source is (table, key column, value column)."""
    found = None
    for rank, (table, by, value) in enumerate(sources):
        hits = probes.join(table.select(F.col(by).alias(key), F.col(value).alias("found")), key).select(key, "found", F.lit(rank).alias("rank"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(key).agg(F.min(F.struct("rank", "found")).alias("best"))
    return probes.select(key).distinct().join(best, key, "left").select(key, F.col("best.found").alias("found"), F.col("best.rank").alias("rank"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or update: a new value wins only if it is neither null nor empty."""
    values = [c for c in old.columns if c != key]

    def pick(c: str) -> Column:
        fresh = F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}"))
        return F.coalesce(fresh, F.col(f"o.{c}")).alias(c)

    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(pick(c) for c in values))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks, one for each key."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def keep_latest(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in the given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int, parts: int = 256) -> DataFrame:
    """A page of ``rows`` in a (total) order, each with ``total``, how many rows there are; one pass over ``rows``, which may be dear to
    find. Rows are ranked within parts, and only those that can be on the page (``offset + limit`` of each part at most) meet."""
    dealt = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    part = Window.partitionBy("_part")
    ranked = dealt.withColumn("_rank", F.row_number().over(part.orderBy(*order))).withColumn("_size", F.count("*").over(part))
    near = ranked.where(F.col("_rank") <= offset + limit)
    total = F.sum(F.when(F.col("_rank") == 1, F.col("_size"))).over(Window.partitionBy(F.lit(0)))
    return near.withColumn("total", total).orderBy(*order).offset(offset).limit(limit).drop("_part", "_rank", "_size")


def count_close_pairs(df: DataFrame, sets: dict[str, tuple[Column, list[str]]], time: str, order: str, minutes: int) -> DataFrame:
    """(shape, pairs): for each named set (a condition on the rows, and columns that the two have in common, nulls
    included) the pairs of rows at most ``minutes`` apart (inclusive). Counted, not made: of the rows at or before a row, those
    more than the band before it are subtracted, both from one running count. Rows are dealt by the columns and by bins of the
    band's width, so no set is counted in one place, and the work is linear in the rows."""
    width = minutes * 60 * 1_000_000
    names = sorted({c for _, columns in sets.values() for c in columns})
    every = [F.when(where, F.struct(F.lit(shape).alias("shape"), *((F.col(c) if c in columns else F.lit(None).cast(df.schema[c].dataType)).alias(f"k_{c}") for c in names))) for shape, (where, columns) in sets.items()]
    rows = df.select(F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(order).alias("o"), F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("k")).where("us is not null")
    place = F.floor(F.col("us") / width)

    def mark(bin_: Column, at: Column, kind: int) -> Column:
        return F.struct(bin_.alias("bin"), at.alias("at"), F.lit(kind).alias("kind"))

    # Kinds in the order in which they stand at the same time: where the band begins, a row of the bin before, an own row.
    marks = rows.select("k.*", "o", F.explode(F.array(mark(place, F.col("us") - width, 0), mark(place + 1, F.col("us"), 1), mark(place, F.col("us"), 2))).alias("m")).select("*", "m.*")
    keys = ["shape", *(f"k_{c}" for c in names), "bin"]
    line = Window.partitionBy(*keys).orderBy("at", "kind", "o").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.when(F.col("kind") > 0, 1).otherwise(0)).over(line)
    counted = marks.select("shape", F.when(F.col("kind") == 0, -running).when(F.col("kind") == 2, running - 1).otherwise(0).alias("n"))
    return counted.groupBy("shape").agg(F.sum("n").alias("pairs"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time: one union and one
    window instead of a range join."""
    cols = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, *cols, F.lit(None).cast(_struct_type(right, values)).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(key, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def _struct_type(df: DataFrame, values: list[str]):
    return df.select(F.struct(*values).alias("v")).schema["v"].dataType


def interleave(df: DataFrame, lane: str, order: str, parts: int = 64) -> DataFrame:
    """Spread each lane evenly over the whole: the i-th of n rows of a lane (in order of the number ``order``) is at
    (i + 0.5) N / n. Rows are numbered within ranges of ``order``, so that a lane is spread over many tasks, and the ranges'
    sizes are added up; where the ranges lie changes no number."""
    edges = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) or [0.0]
    step = F.array_position(F.transform(F.lit(edges), lambda e: e <= F.col(order)), F.lit(False))  # 0: above all edges
    cut = df.withColumn("_range", F.coalesce(F.when(step == 0, len(edges) + 1).otherwise(step), F.lit(0)).cast("int"))
    sizes = cut.groupBy(lane, "_range").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(lane)
    before = F.sum("_size").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    sizes = sizes.select(F.col(lane).alias("_lane"), F.col("_range").alias("_of"), before.alias("_before"), F.sum("_size").over(w).alias("_n"))
    numbered = cut.withColumn("_i", F.row_number().over(Window.partitionBy(lane, "_range").orderBy(order)) - 1)
    both = numbered.join(sizes, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("_range") == F.col("_of")))
    total = df.count()
    return both.withColumn("position", (F.col("_before") + F.col("_i") + 0.5) * F.lit(total) / F.col("_n")).drop("_i", "_n", "_range", "_of", "_lane", "_before")


def diverse_examples(df: DataFrame, group: list[str], variety: str, preferred: Column, order: str, k: int) -> DataFrame:
    """``k`` examples of each group: preferred ones first, one of each variety before second ones (a null
    variety never repeats another), in order."""
    first = Window.partitionBy(*group, variety).orderBy(preferred.desc(), order)
    repeat = F.when(F.col(variety).isNull(), F.lit(0)).otherwise((F.row_number().over(first) > 1).cast("int"))
    return keep_latest(df.withColumn("_repeat", repeat), group, F.col("_repeat"), preferred.desc(), F.col(order), k=k).drop("_repeat")
