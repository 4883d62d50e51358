"""Small documents with every awkward case: nulls, empties, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, sig string, th int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{rng.choice('abcdefgh')}" for _ in range(n)]


def documents(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = words(rng, rng.randrange(1, 260), 4000)
        if i % 5 == 0 and out:
            text = out[-1][1].split()
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = "changed"
        out.append((i, " ".join(text)))
    passage = "This is a passage that many share. " + " ".join(words(rng, 70, 4000)) + ". It ends here, after very many words of no importance at all."
    out += [(100, passage), (101, "Before it. " + passage + " After it."), (102, passage), (103, "x " + passage)]
    out += [(200, None), (201, ""), (202, "   \n\t "), (203, "one"), (204, "one"), (205, "ONE two"), (None, "null id " + passage), (None, None)]
    out += [(206, " ".join(words(rng, 30000, 9000))), (207, "é" * 500 + " ü " * 100), (207, "é" * 500 + " ü " * 100), (208, "der " * 400), (209, "der " * 400)]
    return [(i, t, None if i is None or i % 3 == 0 else "en", f"s{(i or 0) % 2}", 7, 5, 1, "x", 0) for i, t in out]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
