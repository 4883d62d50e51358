"""Queries against their SQL over small tables of what the smallest driver tables lack."""

import tempfile

import duckdb
import pytest

from minutespark.functions.stemming import stem
from minutespark.plans.catalog import ORACLES, QUERIES
from minutespark.plans.stem_sql import stems
from tests.test_fulltext import PAIRS


def both(spark, query, **tables):
    """(query's rows, SQL's rows), sorted."""
    folder, con = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), duckdb.connect()
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    found, expected = QUERIES[query](spark, folder), con.sql(ORACLES[query])
    assert found.columns == expected.columns
    return sorted(map(tuple, found.collect())), sorted(expected.fetchall())


def test_src14_an_address_listed_twice_is_a_playlist_both_times(spark):
    got, expected = both(spark, "src14_url_list", pages=([(1, "a"), (2, "a"), (3, "b"), (5, "c"), (7, "c"), (10, "a")], "page_id long, url string"))
    assert got == expected == [("a/1",), ("a/1",), ("a/2",), ("a/2",), ("b",), ("c",)]


TEXTS = [(1, "wh thinglying"), (2, "th x thingedly y"), (3, "th thingful"), (4, "wh thingational things"), (5, "nothing wh"), (6, "th nd thinged"), (7, "th nd nt"), (8, None)]


@pytest.mark.parametrize("query", ["txt9_stemmed_search", "txt10_cover_rank"])
def test_stems_of_any_form(spark, query):
    got, expected = both(spark, query, documents=(TEXTS, "doc_id long, text string"))
    assert got == expected and {1} < {r[0] for r in got}


def test_stemmer_in_sql():
    ends = ["", "s", "ed", "edly", "ing", "ingly", "eed", "eedly", "ies", "ied", "sses", "e", "y", "ll", "ly", "li", "ogi", "logi", "ization", "fulness", "ative", "icate", "ement", "ion", "tion", "sion", "us", "é"]
    starts = PAIRS[::2] + ["thing", "gener", "commun", "arsen", "yyy", "sky", "say", "b", "ab", "bed", "hop", "hopp", "fiz", "at", "9", "é", "inning", "dying", "kwy", "ow", "box"]
    words = sorted({a + b for a in starts for b in ends} | {a + b + c for a in starts[-22:] for b in ends for c in ends if a + b + c})
    con = duckdb.connect()
    con.execute("create table ws as select unnest(?) as w", [words])
    got = dict(con.sql(f"WITH {stems('ws', 'w')} SELECT word, stem FROM stemmed").fetchall())
    assert got == {w: stem(w) for w in words}
