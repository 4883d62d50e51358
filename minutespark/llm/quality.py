"""Quality rules with robust multivariate outlier rejection.

Base statistics of every whole text, then a minimum-covariance-determinant (MCD) estimate for each
language and source. A text passes if the base rules pass and the Mahalanobis distance of its
transformed statistics is within a cut-off.

The MCD is searched from ``STARTS`` starts: medians with absolute deviations (by histogram), the scatter of hyperbolic
tangents, that of spatial signs, the rows near the median, and random subsets. A concentration step is one distributed pass
over all starts: squared distances are bucketed on a fine geometric grid, counts and moments are added up by group, start
and bucket with partial aggregation (so a source with a third of all rows is no hot key), and the buckets that hold the
nearest ``SUPPORT`` share of a group give its next mean and covariance. After ``FIRST_STEPS`` steps the two starts of least
determinant go on; after ``STEPS`` more the one of least determinant is the estimate. Its covariance is multiplied by the
consistency factor of the normal distribution, so distances follow chi-squared with 5 degrees of freedom on normal data, and
the cut-off is that distribution's quantile at 1 - 1e-9. Statistics that are zero in most texts have no spread
of their own there: ``FLOOR`` squared is added to the variances (minimum *regularized* covariance determinant), which is
what a statistic's smallest difference that matters is taken to be.

Groups with fewer than ``min_group`` texts are pooled by language, and those still too few over
all languages; a pool that is too small rejects nothing. Nulls: a null text has no words, thus fails the base rules; null
languages and sources are groups of their own. Repeated rows count as often as they come.
Texts that fail the base rules take no part in the estimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.llm.scratch import materialize, neutral, sized
from minutespark.llm.textkit import text_bytes

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
DIM = 5
SUPPORT = 0.75
STARTS, SUBSET = 7, 24
FIRST_STEPS, STEPS = 2, 4
MIN_GROUP = 100
#: Least spread of each transformed statistic: about the grid of the medians; for rates, one of 180 words.
FLOOR = np.array([0.02, 0.02, 0.15, 0.15, 0.15])
#: Buckets per factor of two of the squared distance.
GRID = 32
#: Of chi-squared with 5 degrees of freedom (fixed values): the median, the quantile at 1 - 1e-9, and the factor that makes the
#: covariance of the nearest three quarters consistent.
CHI2_MEDIAN, CHI2_CUT, CONSISTENCY = 4.351, 50.69, 1.412


def text_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line and not line.isspace():
                dup += line in seen
                seen.add(line)
    return n, chars, symbols, dup, _repeat_words(words)


def _repeat_words(words: list[bytes], width: int = 8) -> int:
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    span = 1
    while span < width:  # ranks of doubled spans: equal ranks are equal word sequences
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids = np.unique(pair, return_inverse=True)
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _measure(text_at: int, text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(text_at))
            raw = memoryview(buf)
            found = np.array([text_statistics(bytes(raw[offs[i] : offs[i + 1]])) for i in range(batch.num_rows)], np.int64).reshape(-1, 5)
            columns = [batch.column(i) for i in range(batch.num_columns) if text_out or i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if text_out or i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(5))], names=[*names, *(f"stat_{s}" for s in STATS)])

    return run


def with_statistics(docs: DataFrame, text_col: str, keep_text: bool = True) -> DataFrame:
    """``docs`` plus stat_<name> columns (an existing column of such a name is replaced)."""
    base = docs.drop(*(f"stat_{s}" for s in STATS))
    kept = [f for f in base.schema.fields if keep_text or f.name != text_col]
    layout = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"stat_{s} long" for s in STATS])
    return base.mapInArrow(_measure(base.columns.index(text_col), keep_text), layout)


def base_failed() -> Column:
    n, rep = F.col("stat_n_words"), F.col("stat_n_repeat_words")
    return (n < 20) | (rep * 100 > n * 30)


def features() -> list[Column]:
    """Transformed statistics: logarithms and square roots of rates, all of order 1."""
    n = F.greatest(F.col("stat_n_words"), F.lit(1)).cast("double")
    return [
        F.log(n) / 2,
        F.log(F.greatest(F.col("stat_word_chars"), F.lit(1)) / n) * 4,
        F.sqrt(F.col("stat_n_symbols") / n) * 2,
        F.sqrt(F.col("stat_n_dup_lines") / n) * 2,
        F.sqrt(F.col("stat_n_repeat_words") / n) * 2,
    ]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
PARAMS = "group_key string, start int, n_all long, mean array<double>, inverse array<double>, logdet double"


def _params(key: str, start: int, total: int, mean: np.ndarray, cov: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"group_key": [key], "start": [start], "n_all": [total], "mean": [mean], "inverse": [np.linalg.inv(cov).ravel()], "logdet": [np.linalg.slogdet(cov)[1]]})


def _mean_cov(pdf) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance from rows of moments."""
    n = int(pdf["n"].sum())
    mean = np.array([pdf[f"s{i}"].sum() for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = pdf[f"q{i}{j}"].sum() / n - mean[i] * mean[j]
    return n, mean, cov


def _solve(pdf):
    """From a group's bucketed moments at one start to its next estimate."""
    pdf = pdf.sort_values("bucket")
    running = np.cumsum(pdf["n"].to_numpy())
    total = int(running[-1])
    at = int(np.searchsorted(running, np.ceil(total * SUPPORT)))
    _, mean, cov = _mean_cov(pdf.iloc[: at + 1])
    return _params(pdf["group_key"].iloc[0], int(pdf["start"].iloc[0]), total, mean, CONSISTENCY * cov + np.diag(FLOOR**2))


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    d = [F.col(x) - F.col(mean)[i] for i, x in enumerate(X)]
    return sum((d[i] * d[j] * F.col(inverse)[i * DIM + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step of all starts."""
    near = rows.join(sized(params.select("group_key", "start", "mean", "inverse"), "mean", "inverse"), "group_key").withColumn("d2", _distance())
    near = near.withColumn("bucket", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * GRID).cast("int"))
    sums = near.groupBy("group_key", "start", "bucket").agg(*_sums())
    return materialize(sums.groupBy("group_key", "start").applyInPandas(_solve, PARAMS), "mcd-step")


def _least(params: DataFrame, most: int) -> DataFrame:
    """The starts of least determinant of each group."""
    line = Window.partitionBy("group_key").orderBy("logdet", "start")
    return materialize(params.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most).drop("rank"), "mcd-least")


def _starts(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """The first estimates; ``middle`` has the median, spread and size of each group."""
    near = rows.join(sized(middle, "median", "spread"), "group_key")
    z = [(F.col(x) - F.col("median")[i]) / F.col("spread")[i] for i, x in enumerate(X)]
    length = sum((v * v for v in z), F.lit(0.0))
    given = F.array(*(F.col(x) for x in X))

    def picked(start: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(start), *X), F.col("n_all")) < SUBSET

    variants = [(1, F.lit(True), F.array(*(F.tanh(v) for v in z))), (2, length > 0, F.array(*(v / F.sqrt(length) for v in z))), (3, length <= CHI2_MEDIAN, given)]
    variants += [(s, picked(s), given) for s in range(4, STARTS)]
    each = F.filter(F.array(*(F.struct(F.lit(s).alias("start"), use.alias("use"), v.alias("v")) for s, use, v in variants)), lambda t: t["use"])
    flat = near.select("group_key", F.explode(each).alias("t")).select("group_key", "t.start", *(F.col("t.v")[i].alias(x) for i, x in enumerate(X)))
    sums = flat.groupBy("group_key", "start").agg(*_sums())
    # The start without moments: medians and spreads alone.
    alone = middle.select("group_key", F.lit(0).alias("start"), *(F.lit(0).cast("long" if c == "n" else "double").alias(c) for c in sums.columns[2:]))
    both = sums.union(alone).join(sized(middle, "median", "spread"), "group_key")
    return materialize(both.groupBy("group_key", "start").applyInPandas(_first, PARAMS), "mcd-start")


def _first(pdf):
    row = pdf.iloc[0]
    start, total, median, spread = int(row["start"]), int(row["n_all"]), np.array(row["median"]), np.array(row["spread"])
    mean, cov = median, np.diag(spread**2)
    if start:
        n, own, scatter = _mean_cov(pdf)
        if start in (1, 2):  # scatter of standardized values, about the median
            cov = (scatter + 1e-3 * np.eye(DIM)) * np.outer(spread, spread)
        elif n > DIM:
            mean, cov = own, scatter + np.diag(FLOOR**2)
    return _params(row["group_key"], start, total, mean, cov)


def _keys(lang: str, source: str) -> list[Column]:
    """Keys of the group, of the language's pool and of the pool of all, in this order."""
    lang_key = F.concat(F.lit("L"), F.coalesce(F.col(lang).cast("string"), F.lit("\0")))
    return [F.concat(lang_key, F.lit("\1"), F.coalesce(F.col(source).cast("string"), F.lit("\0"))), lang_key, F.lit("*")]


def fit(stats: DataFrame, lang: str, source: str, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """(groups: key0, group_key; parameters by group_key) from rows with statistics."""
    key0, key1, key2 = _keys(lang, source)
    rows = stats.where(~base_failed()).select(key0.alias("key0"), key1.alias("key1"), key2.alias("key2"), *(f.alias(x) for f, x in zip(features(), X, strict=True)))
    sizes = materialize(rows.groupBy("key0", "key1", "key2").count(), "mcd-sizes")
    small = sizes.where(F.col("count") < min_group)
    pools = small.groupBy("key1").agg(F.sum("count").alias("pool"))
    groups = sizes.join(pools, "key1", "left")
    chosen = F.when(F.col("count") >= min_group, F.col("key0")).when(F.col("pool") >= min_group, F.col("key1")).otherwise(F.col("key2"))
    groups = materialize(groups.select("key0", chosen.alias("group_key")), "mcd-groups")
    rows = rows.join(sized(groups), "key0").select("group_key", *X)
    # Medians and median absolute deviations, from counts on a grid of 1/64.
    grid = rows.select("group_key", F.posexplode(F.array(*X)).alias("dim", "v")).groupBy("group_key", "dim", F.floor(F.col("v") * 64).alias("cell")).count()
    middle = materialize(grid.groupBy("group_key").applyInPandas(_middle, "group_key string, n_all long, median array<double>, spread array<double>"), "mcd-middle")
    params = _starts(rows, middle)
    for _ in range(FIRST_STEPS):
        params = _step(rows, params)
    params = _least(params, 2)
    for _ in range(STEPS):
        params = _step(rows, params)
    return groups, _least(params, 1)


def _middle(pdf):
    import pandas as pd

    median, spread, total = [], [], 0
    for dim in range(DIM):
        part = pdf[pdf["dim"] == dim].sort_values("cell")
        value, count = (part["cell"].to_numpy() + 0.5) / 64, part["count"].to_numpy()
        total = int(count.sum())
        m = value[np.searchsorted(np.cumsum(count), total / 2)]
        away = np.abs(value - m)
        order = np.argsort(away, kind="stable")
        median.append(m)
        spread.append(1.4826 * away[order][np.searchsorted(np.cumsum(count[order]), total / 2)])
    return pd.DataFrame({"group_key": [pdf["group_key"].iloc[0]], "n_all": [total], "median": [np.array(median)], "spread": [np.maximum(spread, FLOOR)]})


def judge(stats: DataFrame, groups: DataFrame, params: DataFrame, lang: str, source: str, min_group: int = MIN_GROUP) -> DataFrame:
    """Add base_failed, distance2 (squared distance, null without an estimate) and kept."""
    found = groups.join(params, "group_key").where(F.col("n_all") >= min_group).select("key0", "mean", "inverse").toDF("_key0", "_mean", "_inverse")
    found = sized(materialize(found, "mcd-params"), "_key0", "_mean", "_inverse")
    names = [*stats.columns, "base_failed", "distance2", "kept"]
    rows = stats.withColumns({x: f for f, x in zip(features(), [f"_{x}" for x in X], strict=True)} | {"_key": _keys(lang, source)[0]})
    rows = rows.join(found, F.col("_key") == F.col("_key0"), "left")
    d = [F.col(f"_{x}") - F.col("_mean")[i] for i, x in enumerate(X)]
    d2 = sum((d[i] * d[j] * F.col("_inverse")[i * DIM + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("distance2", d2)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CHI2_CUT)).select(*names)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, distance2 for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = materialize(with_statistics(slim, "text", keep_text=False), "quality")
    judged = judge(stats, *fit(stats, "lang", "source", min_group), "lang", "source", min_group)
    return judged.select("doc_id", *(F.col(f"stat_{s}").alias(s) for s in STATS), "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows that pass, unchanged. A verdict depends on a row's text, language and source alone, so what is rejected is looked up by
    them (the text by its 128-bit hash); each text goes to Python once, and none is written down."""
    rows, (text, lang_, source_) = neutral(docs, text_col, lang, source)
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    slim = rows.select(F.col(text).alias("text"), F.col(lang_).cast("string").alias("lang"), F.col(source_).cast("string").alias("source"), key.alias("key"))
    stats = materialize(with_statistics(slim, "text", keep_text=False), "quality")
    judged = judge(stats, *fit(stats, "lang", "source", min_group), "lang", "source", min_group)
    gone = materialize(judged.where("not kept").select(*(F.col(c).alias(f"_{c}") for c in ("key", "lang", "source"))).distinct(), "rejected")
    same = (key == F.col("_key")) & F.col(lang_).cast("string").eqNullSafe(F.col("_lang")) & F.col(source_).cast("string").eqNullSafe(F.col("_source"))
    return rows.join(sized(gone, "_key", "_lang", "_source"), same, "left_anti").toDF(*docs.columns)
