import random
import tempfile

import pytest

from minutespark.functions.stemming import STOP_WORDS, stem
from minutespark.operators import fulltext as ft

# Words and stems of the algorithm's published description.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consolidate consolid
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir constable constabl constant constant
knack knack knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knightly knight knights knight knit knit knitted knit knitting knit knives knive knob knob knock knock knocked knock knot knot knotted knot
budget budget budgets budget budgeting budget hoping hope hopping hop hoped hope ties tie cries cri gas gas gaps gap kiwis kiwi this this generate generat general general generic generic
communal communal communism communism skies sky dying die news news succeed succeed inning inning cry cri by by say say luxuriated luxuri hopefulness hope agreed agre feed feed
relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative format formalize formal
electriciti electr electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt activate activ effective effect probate probat rate rate cease ceas controll control roll roll bed bed shed shed youth youth boyish boyish""".split()


def test_stems():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert stem("dog's") == "dog" and stem("'tis") == "tis" and len(STOP_WORDS) == 127


def test_parse():
    t = ft.Term
    assert ft.parse('Budgets "city of halls" -draft or -"the plan"') == [
        [t((("budget", 0),)), t((("citi", 0), ("hall", 2))), t((("draft", 0),), True)], [t((("plan", 0),), True)]
    ]
    assert ft.parse("the of and") == [] and ft.parse("") == [] and ft.parse('or "" or') == []
    assert ft.parse("re-use") == [[t((("re", 0), ("use", 1)))]]


def within(alternatives, words, p, q):
    """Whether the query holds in words p..q; exclusions do not count here."""
    def has(t):
        return any(all(p <= i + o <= q and words[i + o - 1] == s for s, o in t.stems) for i in range(p, q + 1) if i + t.stems[-1][1] <= len(words))

    return any([t for t in terms if not t.excluded] and all(has(t) for t in terms if not t.excluded) for terms in alternatives)


def brute(alternatives, text):
    """(matches, rank) by enumeration of all spans."""
    words = [None if w in STOP_WORDS else stem(w) for w in ft._PY_WORD.findall((text or "").lower())]
    n = len(words)
    hit = any(all(t.excluded != within([[ft.Term(t.stems)]], words, 1, n) for t in terms) for terms in alternatives)
    good = {(p, q) for p in range(1, n + 1) for q in range(p, n + 1) if within(alternatives, words, p, q)}
    minimal = [(p, q) for p, q in good if not any((a, b) != (p, q) and p <= a and b <= q for a, b in good)]
    asked = {s for terms in alternatives for t in terms for s, _ in t.stems}
    return hit, sum(0.1 / (1 + (q - p) - (sum(w in asked for w in words[p - 1 : q]) - 1)) for p, q in minimal)


QUERIES = ["council budget", '"council budget"', '"budget of the city" or plans', "council -plan", '-"city plan"', "budget or council city", '"city plan" "plan budget" council', "the", "", "council council", '"plan plan"', "zebra or zebras", "-zebra"]


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(2)
    pieces = ["council", "Councils", "budget", "budgeting", "the", "of", "city", "plan", "planned", "x", "-", "é", "vote.", "\n"]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 18)))) for i in range(120)] + [(900, None), (901, ""), (902, "the of"), (None, "council budget")]
    rows = spark.createDataFrame(texts, "id long, t string")
    return texts, ft.write_index(rows, "id", "t", tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index")


@pytest.mark.parametrize("query", QUERIES)
def test_search_and_rank_against_all_spans(indexed, query):
    texts, index = indexed
    expected = {i: brute(ft.parse(query), t) for i, t in texts}
    assert {r["id"] for r in ft.search(index, query).collect()} == {i for i, (hit, _) in expected.items() if hit}
    got = {r["id"]: r["rank"] for r in ft.ranked(index, query).collect()}
    assert got == pytest.approx({i: rank for i, (hit, rank) in expected.items() if hit})


def test_query_reads_only_its_postings(indexed):
    plan = ft.search(indexed[1], "council")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "council" in plan[plan.index("PushedFilters") :]


def test_an_empty_table(spark):
    index = ft.index(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert index.count() == 0 and ft.ranked(index, "a council").count() == 0


def test_many_positions_are_linear():
    import numpy as np

    at = {"a": np.arange(1, 400_001, 2), "b": np.arange(2, 400_001, 2)}
    assert len(ft.covers(ft.parse("a1 or b1"), {"a1": at["a"], "b1": at["b"]})) == 400_000
    assert len(ft.covers(ft.parse("a1 b1"), {"a1": at["a"], "b1": at["b"]})) == 399_999


def test_a_stem_has_one_row_for_a_block_of_texts(spark):
    texts = [(i, "the councils and a council") for i in range(200)] + [(None, "council"), (900, None), (901, "of the")]
    rows = spark.createDataFrame(texts, "id long, t string").coalesce(1)
    index = ft.index(rows, "id", "t").collect()
    assert sorted((r.stem or "", len(r.ids)) for r in index) == [("", 203), ("council", 201)]
    held = next(r for r in index if r.stem)
    assert held.ids == [*range(200), None] and held.positions == [[2, 5]] * 200 + [[1]]


def test_blocks_by_their_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ft, "OUT", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["plan vote", "vote plan plan x", "", "votes"])], names=["id", "text"])
    got = [(r["stem"], r["ids"], r["positions"]) for b in ft._postings(iter([batch])) for r in b.to_pylist()]
    assert got == [
        ("plan", [1, 2], [[1], [2, 3]]), ("vote", [1, 2], [[2], [1]]), ("x", [2], [[4]]), (None, [1, 2], [[], []]),
        ("vote", [4], [[1]]), (None, [3, 4], [[], []]),
    ]
