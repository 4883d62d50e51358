"""The language of a text: naive Bayes over character trigrams, trained by joins and applied in batches.

A word is a run of letters, lower-cased; its grams are the trigrams of the word between two spaces. Runs of over LONGEST letters are no
words of any language and count nothing, so that a text's grams stay linear in its length. A model has a row for each gram with the
rounded, scaled logarithm of its share in each language; sums of whole numbers are the same in any order. A model of usual size is sent to the
tasks, which take each distinct word of a batch apart once; a larger one is joined to the grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 40
#: Logarithms are kept as whole numbers of this fraction of a nat.
SCALE = 10_000
#: What is added to each count.
SMOOTHING = 0.5
#: A model of at most so many numbers (rows by languages) is broadcast; a task remembers so many words at most.
BROADCAST_CELLS, REMEMBERED = 4_000_000, 200_000


def words(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(*by, _w) for every word of whole texts."""
    return rows.select(*by, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("_w")).where(F.length("_w").between(1, LONGEST))


def grams(words: DataFrame, by: list[str]) -> DataFrame:
    """(*by, gram) for every trigram of every word."""
    padded = words.select(*by, F.concat(F.lit(" "), "_w", F.lit(" ")).alias("_p"), F.length("_w").alias("_n"))
    places = padded.select(*by, "_p", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    return places.select(*by, F.substring("_p", F.col("_i"), F.lit(3)).alias("gram"))


class Model:
    """The grams' table (gram, one column for each language) and the languages in order."""

    def __init__(self, table: DataFrame, languages: list[str], rows: list[tuple]):
        self.languages, self.table = languages, table
        small = len(rows) * len(languages) <= BROADCAST_CELLS
        self.shared = table.sparkSession.sparkContext.broadcast({gram: logs for gram, *logs in rows}) if small else None


def train(rows: DataFrame, text: str, label: str, most: int = 50_000, sample: int = 1_000_000) -> Model:
    """A model of the ``most`` frequent grams of labelled rows (null labels are left out; equally frequent grams in order). Of a
    language with more than ``sample`` rows a share is taken by the hash of the texts, of about that size."""
    labelled = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.col(label).alias("_label"))
    sizes = sorted((r["_label"], r["n"]) for r in labelled.groupBy("_label").agg(F.count("*").alias("n")).collect())
    names = [name for name, _ in sizes]
    large = [(name, sample / n) for name, n in sizes if n > sample]
    for name, share in large:
        labelled = labelled.where((F.col("_label") != name) | (F.pmod(F.xxhash64("_t"), F.lit(1 << 30)) < int(share * (1 << 30))))
    columns = [f"l{i}" for i in range(len(names))]
    # Each distinct word of a language is taken apart once.
    counted = words(labelled, ["_label"], "_t").groupBy("_label", "_w").agg(F.count("*").alias("_times"))
    tallied = grams(counted, ["_label", "_times"]).groupBy("gram").agg(
        F.sum("_times").alias("n"), *(F.coalesce(F.sum(F.when(F.col("_label") == name, F.col("_times"))), F.lit(0)).alias(c) for name, c in zip(names, columns, strict=True))
    )
    kept = tallied.orderBy(F.desc("n"), "gram").limit(most).drop("n").collect()  # ``most`` rows of a gram and some counts
    totals = [sum(r[c] for r in kept) + SMOOTHING * len(kept) for c in columns]
    logs = [(r["gram"], *(round(math.log((r[c] + SMOOTHING) / total) * SCALE) for c, total in zip(columns, totals, strict=True))) for r in kept]
    table = rows.sparkSession.createDataFrame(logs, "gram string" + "".join(f", {c} long" for c in columns))
    return Model(table, names, logs)


def _sums(shared: Broadcast, n: int):
    """(kept columns, words) to the kept columns and n sums over the words' known grams, null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scores = shared.value, {}

        def score(word: str | None) -> list[int]:
            padded = f" {word} "
            size = len(word) if word and len(word) <= LONGEST else 0
            found = [table[g] for i in range(size) if (g := padded[i : i + 3]) in table]
            return [len(found), *map(sum, zip(*found, strict=True))] if found else [0] * (n + 1)

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            words = lists.flatten().dictionary_encode()
            if len(scores) > REMEMBERED:
                scores.clear()
            each = []
            for w in words.dictionary.to_pylist():
                if (s := scores.get(w)) is None:
                    s = scores[w] = score(w)
                each.append(s)
            each = np.array(each, np.int64).reshape(-1, n + 1)
            ends = np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
            out, at = [], words.indices.to_numpy(zero_copy_only=False)
            for c in range(n + 1):
                running = np.concatenate([[0], np.cumsum(each[at, c])])
                out.append(running[ends[1:]] - running[ends[:-1]])
            unknown = out[0] == 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, mask=unknown) for x in out[1:])], names=[*batch.schema.names[:-1], *(f"l{i}" for i in range(n))])

    return run


def detect(rows: DataFrame, by: list[str], text: str, model: Model, name: str = "detected", total: str | None = None) -> DataFrame:
    """(*by, ``name``, and the sum of a column ``total`` of whole numbers): the most likely language of each row, of equally likely ones the first in alphabetical order. Null where a text
    has no known gram, or is null. ``by`` tells the rows apart; rows that agree in it are one text."""
    columns = [f"l{i}" for i in range(len(model.languages))]
    added = [] if total is None else [total]
    every = rows.groupBy(*by).agg(F.sum(total).alias(total)) if added else rows.select(*by).distinct()
    if not columns:
        return every.select(*by, F.lit(None).cast("string").alias(name), *added)
    if model.shared is not None:
        split = rows.select(*by, *added, F.split(F.lower(text), r"[^\p{L}]+").alias("_words"))
        schema = T.StructType([*(rows.schema[b] for b in [*by, *added]), *(T.StructField(c, T.LongType()) for c in columns)])
        found = split.mapInArrow(_sums(model.shared, len(columns)), schema)
        columns += added
    else:
        found = grams(words(rows, by, text), by).join(model.table, "gram")
    sums = found.groupBy(*by).agg(*(F.sum(c).alias(c) for c in columns))
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("s"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (c, lang) in enumerate(zip([f"l{i}" for i in range(len(model.languages))], model.languages, strict=True)))))
    if model.shared is not None:  # every row is there
        return sums.select(*by, F.when(F.col("l0").isNotNull(), best["lang"]).alias(name), *added)
    known = sums.select(*(F.col(b).alias(f"_{b}") for b in by), best["lang"].alias(name))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    on = same[0]
    for other in same[1:]:
        on = on & other
    return every.join(known, on, "left").select(*by, name, *added)
