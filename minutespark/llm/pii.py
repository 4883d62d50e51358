"""Personal data by weak supervision, with DataFrame functions only on the rows.

Candidates are the matches of the base patterns (email, ip, card, phone) and of looser ones (``local``
phone numbers, ``ssn``, ``iban``). Five labelers vote for, against or abstain on each: the shape, a
gazetteer (known domains' ends, country codes, issuers, reserved ranges), cue words in four languages beside it, words
before it that tell against, and what touches it on either side.

Expectation-maximisation (two classes, conditionally independent votes) estimates every labeler's
reliability and each kind's rate from the counts of all vote patterns in the corpus; there are at most
7 x 3**5 such patterns, so they are counted by Spark and solved on the driver. The posterior is a column again, and
gives soft labels for the final span classifier, a logistic regression on features of the span and its context that are
not the votes (length, separators, the character on either side, whether a name and colon lead to it, cue words
before and after it, words against it, by kind). It is trained on counts and summed posteriors of the combinations that occur, of which
there are at most ``COMBINATIONS``, and its weights become the column expression that judges every candidate. Base matches
always stay; others need half.

Nulls: a null text is empty; null ids are kept. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutespark.llm.native_spans import Pattern, joined, matches, redact
from minutespark.llm.scratch import materialize

# Possessive quantifiers and look-behind keep the scans linear; no match changes by them.
PATTERNS = [
    Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    Pattern("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Pattern("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Pattern("local", r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Pattern("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    Pattern("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
]
BASE = ["email", "ip", "card", "phone"]
KINDS = [p.kind for p in PATTERNS]
LABELERS = ["shape", "gazetteer", "cue", "against", "touch"]
# Cue words by kind (English, German, French, Spanish), words against, and the gazetteers.
_PHONE = "phone|tel|call|mobile|cell|fax|reach|handy|rufen|anruf|mobil|portable|appel|llam|m\u00f3vil|movil"
CUES = {
    "email": "mail|contact|write|reach|address|kontakt|schreib|adresse|courriel|\u00e9cri|correo|contacto|escrib|direcci",
    "ip": r"\bip\b|server|host|login|from|anmeldung|rechner|serveur|h\u00f4te|servidor|equipo",
    "card": "card|visa|credit|payment|charge|karte|kredit|zahlung|carte|paiement|tarjeta|pago",
    "phone": _PHONE,
    "local": _PHONE,
    "ssn": "ssn|social|security|sozialversicherung|s\u00e9curit\u00e9|seguridad",
    "iban": "iban|bank|account|transfer|konto|\u00fcberweis|compte|virement|cuenta|transferencia",
}
AGAINST = "version|isbn|order|invoice|example|sample|release|page|bestell|rechnung|beispiel|seite|commande|facture|exemple|pedido|factura|ejemplo|p\u00e1gina"
TLDS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at"
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, text: Column) -> Column:
    """The base rules; looser kinds have none."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    bare = [F.ltrim(F.split(text, r"\.")[i], F.lit("0")) for i in range(4)]
    octets = F.lit(True)
    for part in bare:
        octets = octets & (F.length(part) <= 3) & (F.coalesce(F.when(F.length(part).between(1, 3), part).try_cast("int"), F.lit(0)) <= 255)
    card = F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == "ip", F.coalesce(octets, F.lit(False))).when(kind == "card", card).when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(F.lit(True))


def _cue(context: Column) -> Column:
    """Whether a cue word of the candidate's kind is in its context."""
    out = F.lit(False)
    for k, words in CUES.items():
        out = out | ((F.col("kind") == k) & F.lower(context).rlike(words))
    return out


def _side(character: Column) -> Column:
    """Nothing or a line break, white space, a letter, a digit, or another character."""
    return F.when(character.rlike(r"^\n?$"), 0).when(character.rlike(r"^\s"), 1).when(character.rlike(r"^\p{L}"), 2).when(character.rlike("^[0-9]"), 3).otherwise(4)


def _features() -> list[Column]:
    before, after, found = F.col("before"), F.col("after"), F.col("found")
    separators = F.array_distinct(F.regexp_extract_all(found, F.lit(r"[^A-Za-z0-9]"), F.lit(0)))
    return [
        F.least(F.floor(F.length(found) / 4), F.lit(7)),
        F.least(F.size(separators), F.lit(2)),
        _side(F.right(before, F.lit(1))),
        _side(F.left(after, F.lit(1))),
        before.rlike(r"\p{L}\s*[:=#]\s*$").cast("int"),
        _cue(before).cast("int"),
        _cue(after).cast("int"),
        F.lower(before).rlike(AGAINST).cast("int"),
    ]


FEATURES = ["length", "separators", "left", "right", "named", "cue_before", "cue_after", "told_against"]
#: Values of each feature; with the kinds they bound the combinations that are counted.
VALUES = [8, 3, 5, 5, 2, 2, 2, 2]
COMBINATIONS = len(KINDS) * 8 * 3 * 5 * 5 * 2**4


def _votes() -> list[Column]:
    kind, text, before, after = F.col("kind"), F.col("found"), F.lower("before"), F.col("after")
    digits = F.regexp_replace(text, "[^0-9]", "")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, -1).when(yes, 1).otherwise(0)

    shape = (
        F.when(kind == "email", vote(text.rlike(r"^[A-Za-z0-9][^@]{1,63}@[^@]+\.[A-Za-z]{2,6}$"), ~text.rlike(r"\.[A-Za-z]{2,}$")))
        .when(kind == "ip", vote(text.rlike(r"^[1-9][0-9]{0,2}\."), text.rlike(r"^0")))
        .when(kind == "card", vote(text.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([ -][0-9]{4}){3}$"), ~text.rlike(r"^[0-9]{13,19}$|^[0-9]{4}[ -]")))
        .when(kind == "phone", vote(F.length(digits).between(10, 13), F.lit(False)))
        .when(kind == "ssn", vote(text.rlike(r"^[0-8]"), text.rlike(r"^(000|666|9)|-00-|-0000$")))
        .when(kind == "local", vote(text.rlike(r"^\(?[2-9]"), text.rlike(r"^\(?[01]")))
        .otherwise(vote(F.length(F.regexp_replace(text, " ", "")).between(15, 34), F.lit(False)))
    )
    gazetteer = (
        F.when(kind == "email", vote(text.rlike(rf"(?i)\.({TLDS})$"), text.rlike(r"(?i)@example\.|\.(png|jpg|js|css)$")))
        .when(kind == "ip", vote(F.lit(False), text.rlike(r"^(10|127|192\.168|0)\.")))
        .when(kind == "card", vote(digits.rlike(r"^(4|5[1-5]|3[47]|6011|65|2[2-7])"), digits.rlike("^0")))
        .when(kind == "phone", vote(text.rlike(r"^\+(1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1246]|9[0-58])"), F.lit(False)))
        .when(kind == "iban", vote(text.rlike(rf"^({COUNTRIES})"), ~text.rlike(rf"^({COUNTRIES})")))
        .otherwise(F.lit(0))
    )
    cue = _cue(F.col("before")) | _cue(F.col("after"))
    touching = F.col("before").rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")
    return [shape, gazetteer, vote(cue, F.lit(False)), vote(F.lit(False), before.rlike(AGAINST)), vote(~touching, touching)]


Counts = list[tuple[str, tuple[int, ...], int]]


def estimate(counts: Counts, rounds: int = 30) -> tuple[dict[str, float], list[dict[tuple[int, int], float]], dict[tuple[str, tuple[int, ...]], float]]:
    """(rate of each kind, P(vote | class) of each labeler, posterior of each pattern)."""
    post = {(k, v): 1 / (1 + exp(-sum(v))) for k, v, _ in counts}
    rates: dict[str, float] = {}
    tables: list[dict[tuple[int, int], float]] = []
    for _ in range(rounds):
        for kind in {k for k, _, _ in counts}:
            total = sum(n for k, _, n in counts if k == kind)
            rates[kind] = (sum(n * post[k, v] for k, v, n in counts if k == kind) + 1) / (total + 2)
        tables = []
        for j in range(len(LABELERS)):
            table = {(c, y): 1.0 for c in (-1, 0, 1) for y in (0, 1)}
            for k, v, n in counts:
                table[v[j], 1] += n * post[k, v]
                table[v[j], 0] += n * (1 - post[k, v])
            whole = [sum(table[c, y] for c in (-1, 0, 1)) for y in (0, 1)]
            tables.append({(c, y): x / whole[y] for (c, y), x in table.items()})
        for k, v, _ in counts:
            odds = log(rates[k] / (1 - rates[k])) + sum(log(t[v[j], 1] / t[v[j], 0]) for j, t in enumerate(tables))
            post[k, v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return rates, tables, post


def posterior(rates: dict[str, float], tables: list[dict[tuple[int, int], float]]) -> Column:
    """The posterior of a candidate's votes as a column."""
    odds = F.lit(0.0)
    for k, rate in sorted(rates.items()):
        odds = odds + F.when(F.col("kind") == k, F.lit(log(rate / (1 - rate)))).otherwise(0.0)
    for name, t in zip(LABELERS, tables, strict=True):
        for c in (-1, 0, 1):
            odds = odds + F.when(F.col(name) == c, F.lit(log(t[c, 1] / t[c, 0]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def train(combinations: list[tuple[int, tuple[int, ...], int, float]], steps: int = 400) -> tuple[np.ndarray, list[np.ndarray]]:
    """A logistic regression of soft labels, from (kind, features, candidates, sum of posteriors): a bias for each kind and a
    weight for each value of each feature."""
    sizes = [len(KINDS), *VALUES]
    first = np.concatenate([[0], np.cumsum(sizes)])
    weight = np.zeros(first[-1])
    if combinations:
        place = np.array([(k, *f) for k, f, _, _ in combinations]) + first[:-1]
        n, label = (np.array([c[i] for c in combinations], float) for i in (2, 3))
        for _ in range(steps):
            off = label - n / (1 + np.exp(-weight[place].sum(1)))
            slope = np.zeros(len(weight))
            np.add.at(slope, place, np.repeat((off / n.sum())[:, None], len(sizes), 1))
            weight += 4 * (slope - 1e-4 * weight)
    return weight[: first[1]], [weight[a:b] for a, b in zip(first[1:-1], first[2:], strict=True)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, spans (array of order, start, kind, end, score; sorted) and base."""
    parts = matches(docs, id_col, text_col, PATTERNS)
    # Matches that fail their base rule are no candidates; the row of their text stays.
    kind = F.when(_valid(F.col("kind"), F.col("found")), F.col("kind"))
    votes = [v.cast("int").alias(name) for v, name in zip(_votes(), LABELERS, strict=True)]
    traits = [v.cast("int").alias(name) for v, name in zip(_features(), FEATURES, strict=True)]
    parts = materialize(parts.select("row", "doc_id", "text_hash", "order", kind.alias("kind"), "start", "end", *votes, *traits), "pii-candidates")
    known = parts.where("kind is not null")
    rows = known.groupBy("kind", *LABELERS).count().collect()
    counts = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in rows)
    rates, tables, _ = estimate(counts)
    said = known.groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum(posterior(rates, tables)).alias("label")).orderBy("kind", *FEATURES).collect()
    bias, weights = train([(KINDS.index(r["kind"]), tuple(r[x] for x in FEATURES), r["n"], r["label"]) for r in said])
    score = F.get(F.lit([float(x) for x in bias]), F.array_position(F.lit(KINDS), F.col("kind")).cast("int") - 1)
    for name, w in zip(FEATURES, weights, strict=True):
        score = score + F.get(F.lit([float(x) for x in w]), F.col(name))
    keep = F.col("kind").isin(BASE) | (score >= 0)
    span = F.when(F.col("kind").isNotNull() & keep, F.struct("order", "start", "kind", "end", (1 / (1 + F.exp(-score))).alias("score")))
    found = parts.groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return found.select("doc_id", "text_hash", "spans", F.filter("spans", lambda s: s["order"] < len(BASE)).alias("base"))


def with_digest(found: DataFrame) -> DataFrame:
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[PII]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``."""
    return redact(docs, find_personal_data(docs, id_col, text_col), id_col, text_col, mask)
