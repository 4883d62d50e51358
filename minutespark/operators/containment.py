"""Stored terms against texts: which texts contain which of very many terms, literally.

The terms' automaton (Aho-Corasick) runs over batches of texts inside tasks: each text is read once, in time linear in its length whatever the
number of terms, and only hits leave a task. Terms are dealt to shards of about ``SHARD_BYTES`` by hash; a task fetches a shard when its batch of
texts comes to it and holds one automaton at a time, so memory does not grow with the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms of one automaton; bytes of texts that are searched before the next one is built.
SHARD_BYTES, BATCH_BYTES = 1 << 20, 16 << 20


def automaton(terms: list[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        built.add_word(term, i)
    built.make_automaton()
    return built


def _search(shards: list[Broadcast]):
    """(text, columns to keep) to (the kept columns, term), a row for each text and term that it holds."""

    def hits(terms: list[str], built, texts: pa.Array) -> tuple[list[int], list[str]]:
        rows, found = [], []
        for i, text in enumerate(texts):
            text = text.as_py()
            if text:
                held = {v for _, v in built.iter(text)}
                rows += [i] * len(held)
                found += [terms[v] for v in held]
        return rows, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = (shards[0].value, automaton(shards[0].value)) if len(shards) == 1 else None

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            for shard in shards:
                terms, built = only or (shard.value, automaton(shard.value))
                for part in table.to_batches():
                    rows, found = hits(terms, built, part.column(0))
                    kept = [part.column(i).take(pa.array(rows, pa.int64())) for i in range(1, part.num_columns)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*part.schema.names[1:], "term"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(0).nbytes
            if size >= BATCH_BYTES:
                yield from search(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from search(pa.Table.from_batches(held))

    return run


def containing(texts: DataFrame, text_col: str, terms: DataFrame, *kept: str) -> DataFrame:
    """(kept columns of ``texts``, term_id): a row for each row of ``texts`` and each of ``terms`` (term_id, term) that it contains, in any case.
    Blank and null terms match nothing. The terms go through the driver a shard at a time."""
    asked = terms.select("term_id", F.lower("term").alias("term")).where(F.col("term").rlike(r"\S")).persist()
    distinct = asked.select("term").distinct()
    count = max(1, -(-(distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("term"), F.lit(count))
    context = texts.sparkSession.sparkContext
    shards = [context.broadcast([r["term"] for r in distinct.where(shard == i).collect()]) for i in range(count)]
    rows = texts.select(F.lower(text_col).alias("text"), *(F.col(c) for c in kept))
    layout = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept)
    found = rows.mapInArrow(_search(shards), f"{layout}, `term` string")
    return found.join(asked, "term").select(*kept, "term_id")


def texts_containing(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, term_id), once each."""
    return containing(texts, text_col, terms, id_col).select(F.col(id_col).alias("id"), "term_id").distinct()
