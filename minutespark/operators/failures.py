"""Failure analytics over event logs: groups, bursts, pairs and attempt-normalised rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.operators.relational import count_close_pairs


def summary(failures: DataFrame, keys: list[str], job: str, timeout: Column, first: Column) -> DataFrame:
    """One row per value of each key (grouping sets): failures, timeouts, first, later, jobs."""
    return (
        failures.withColumns({"_timeout": timeout, "_first": first})
        .groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
        .agg(
            F.count("*").alias("failures"),
            F.count_if("_timeout").alias("timeouts"),
            F.count_if("_first").alias("first"),
            F.count_if(~F.col("_first")).alias("later"),
            F.count_distinct(job).alias("jobs"),
        )
    )


def attempts(jobs: DataFrame, job: str, total: str) -> DataFrame:
    """(job, index): one attempt of every index 0..total-1 of each distinct job; none for total <= 0."""
    each = jobs.select(job, total).dropDuplicates([job])
    indexes = F.when(F.col(total) > 0, F.sequence(F.lit(0), F.col(total).cast("int") - 1))
    return each.select(job, total, F.explode(indexes).alias("index"))


def rate_by(attempted: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """failures per attempt by ``key``, driven from the attempts (a rate may exceed 1)."""
    a = attempted.groupBy(key).agg(F.count("*").alias("attempts"))
    f = failed.groupBy(key).agg(F.count("*").alias("failures"))
    rows = a.join(f, key, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return rows.select(key, "attempts", "failures", F.round(F.try_divide("failures", "attempts"), 3).alias("rate"))


def decile(index: Column, total: Column) -> Column:
    return F.least(F.lit(9), F.floor(index * 10 / total)).cast("int")


def position_bucket(index: Column) -> Column:
    return F.when(index == 0, "0").when(index.between(1, 2), "1-2").when(index >= 3, "3+").otherwise("unknown")


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def pair_shapes(failures: DataFrame, time: str, order: str, job: str, host: str, minutes: int = 10) -> DataFrame:
    """Counts of pairs of failures at most ``minutes`` apart by what they share first: job, host, domain. Null jobs and hosts are
    equal to each other, null domains are not."""
    rows = failures.withColumn("_domain", domain(F.col(host)))
    every, known = F.lit(True), F.col(host).isNotNull()
    sets = {"all": (every, []), "job": (every, [job]), "host": (every, [host]), "host_job": (every, [host, job])}
    sets |= {"domain": (known, ["_domain"]), "domain_job": (known, ["_domain", job]), "known": (known, [host]), "known_job": (known, [host, job])}
    counts = count_close_pairs(rows, sets, time, order, minutes)
    n = {s: F.coalesce(F.max(F.when(F.col("shape") == s, F.col("pairs"))), F.lit(0)) for s in sets}
    one = counts.agg(*(c.alias(s) for s, c in n.items()))
    same_host = F.col("host") - F.col("host_job")
    same_domain = F.col("domain") - F.col("domain_job") - F.col("known") + F.col("known_job")
    shapes = {"same_job": F.col("job"), "same_host": same_host, "same_domain": same_domain, "unrelated": F.col("all") - F.col("job") - same_host - same_domain}
    flat = one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("shape"), c.alias("pairs")) for s, c in shapes.items()))).alias("s"))
    return flat.select("s.shape", "s.pairs").where("pairs > 0")


def burst(failures: DataFrame, key: str, time: str, seconds: int = 3600) -> DataFrame:
    """The most failures of each key in any window of that length (both ends included)."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return failures.select(key, us.alias("_us")).select(key, F.count("*").over(w).alias("n")).groupBy(key).agg(F.max("n").alias("burst"))
