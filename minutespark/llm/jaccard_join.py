"""N-gram Jaccard join by universe partition, with exact verification.

A text's set holds its distinct k-word shingles (lower-cased A-Z, words split at ASCII white
space; fewer words: the whole sequence as one; no words: empty, linked with nothing). Equal sets are one class from the start.

Signatures. Set sizes are cut into bands such that partners are in the same or the next band. Each pair
of neighbouring bands is a scheme with a largest symmetric difference ``H``. A hash deals the
universe of shingles into segments, which are matched exactly (such a segment absorbs one error) or with one deletion (it
absorbs two). ``allocate`` sizes them so that together they absorb a third more errors than the ``H + 1`` that
suffice; empty segments are not indexed. A set whose other segments absorb too few is indexed by its
prefix tokens as well, which finds partners that have too few, too.

Allocation by measured cost. Once all signatures are counted, a set needs to look up only segments that
absorb ``H + 1`` errors, so it leaves out the ones with the longest lists, as far as its surplus goes. If the segments that it
shares with no other set suffice, it has no partner and leaves the index altogether, which shortens the lists for the
next round. Texts that share a passage, however many, go this way, since their own words fill most segments.

Links. First each remaining class is verified against one hub, the class that it shares most signatures with among the
smallest of its buckets; what that links is contracted. Then the lookups are chosen anew by what of other components lies in
their buckets, for a partner that is not yet connected is met there. Buckets of the same classes are looked up once. Lookups
whose classes are not yet connected give pairs, which are pruned by size and by a parity sketch (both lossless) and verified
on the texts' sets. So a large group of near copies gives pairs in proportion to its size, and no link is lost. A hub's
partners are verified in chunks, to which the hub's text is sent once each.

Nulls: a null text is an empty set; a null id is a row like any other, and its component is the smallest id that is
linked to it, if any. Repeated rows are equal sets, thus linked; rows that repeat an id with other texts are judged each by its
own text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import components, discard, materialize, neutral, numbered, sized

U = np.uint64
#: Longs of a parity sketch. Sets of n tokens that differ in half of them are told from links while n is a few times the bits; only sets
#: that share signatures have one.
SKETCH_WORDS = 16
SKETCH = [f"s{j}" for j in range(SKETCH_WORDS)]
#: Bits of a signature beyond those that number the corpus's tokens. It is an index key, so that collisions cost a comparison at
#: most, and short keys are cheaper to move.
SPARE_BITS = 10
#: Rounds in which sets without partners leave the index.
ROUNDS = 3
#: Partners of a hub that are verified together.
CHUNK = 256


@dataclass(frozen=True)
class Scheme:
    """Segments [0, exact) match exactly, [exact, exact + deletion) with one deletion."""

    exact: int
    deletion: int
    slack: int


def allocate(error: int, size: float) -> Scheme:
    """The allocation with the fewest index rows for sets of about ``size`` tokens: signatures, plus prefix tokens for the
    share of sets with too many empty segments. ``slack`` is what it absorbs beyond error + 1; at least a third as
    much again, to choose from when the lengths of the lists are known."""
    best = None
    for deletion in sorted({0, 1, 2, (error + 1) // 4, (error + 1) // 2}):
        for slack in range((error + 3) // 3, (error + 3) // 3 + 5 + error // 10):
            exact = max(0, error + 1 + slack - 2 * deletion)
            m = exact + deletion
            if m == 0:
                continue
            load = size / m
            rate = exp(-load) * (exact + 2 * deletion * (1 + load))
            term, below = exp(-rate), 0.0
            for i in range(slack + 1):
                below += term
                term *= rate / (i + 1)
            cost = exact + deletion * (1 + load) + max(0.0, 1 - below) * (0.15 * size + 1) * 8
            if best is None or cost < best[0]:
                best = (cost, Scheme(exact, deletion, slack))
    return best[1]


@lru_cache
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, list[Scheme | None]]:
    """Lower ends of the size bands up to ``largest``; error and allocation of each scheme."""
    ends = [1, 2]
    while ends[-2] <= largest:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * den // num + 1))
    ends.append(max(ends[-1] + 1, (ends[-1] - 1) * den // num + 1))
    errors, schemes = [], []
    for k in range(len(ends) - 2):
        x = ends[k + 1] - 1
        y = max(x, min(ends[k + 2] - 1, x * den // num))
        h = (den - num) * (x + y) // (den + num)
        errors.append(h)
        schemes.append(allocate(h, (ends[k] + x) / 2) if h else None)
    return np.array(ends), np.array(errors), schemes


@dataclass(frozen=True)
class Signatures:
    """One entry per signature: its key, its text, its unit (the segment and scheme; 0 for prefix tokens), the errors that the
    unit absorbs (0: the text does not look it up), and by how much the text's units of the scheme exceed what suffices (-1:
    prefix tokens are looked up in their place)."""

    key: np.ndarray
    owner: np.ndarray
    unit: np.ndarray
    weight: np.ndarray
    spare: np.ndarray


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, num: int, den: int) -> Signatures:
    """All signatures of the sets of ``n_docs`` texts."""
    size = np.bincount(doc, minlength=n_docs)
    ends, errors, plans = bands(num, den, 1 << int(max(1, size.max(initial=1))).bit_length())
    band = np.searchsorted(ends, size, "right") - 1
    out: list[tuple[np.ndarray, ...]] = []
    exact = np.array([p.exact if p else 0 for p in plans] + [0])
    total = np.array([p.exact + p.deletion if p else 0 for p in plans] + [0])
    errors = np.append(errors, 0)
    content = tk.mix(h ^ U(0x5851F42D4C957F2D))
    for which, scheme in enumerate((band, band - 1)):
        m = np.where((scheme >= 0) & (size > 0), total[np.maximum(scheme, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        use = m[doc] > 0
        t, d = h[use], doc[use]
        if not len(t):
            continue
        salt = tk.mix(scheme.astype(np.uint64) + U(0x1234567))
        spread = tk.mix(t ^ salt[d]) >> U(32)
        seg = ((spread * m[d].astype(np.uint64)) >> U(32)).astype(np.int64)
        cell = base[d] + seg
        held = np.bincount(cell, minlength=base[-1])
        summed = tk.group_sums(content[use], cell, int(base[-1]))
        owner = np.repeat(np.arange(n_docs), m)
        index = np.arange(base[-1]) - base[owner]
        tag = tk.mix(salt[owner] + index.astype(np.uint64))
        single = index >= exact[scheme[owner]]
        weight = np.where(single, 2 * (held > 1), held > 0)
        spare = np.bincount(owner, weight, n_docs).astype(np.int64) - errors[np.maximum(scheme, 0)] - 1
        weight = np.where(spare[owner] >= 0, weight, 0)
        spare = np.maximum(spare, -1)
        unit = 2 * index + 2 + which
        full = held > 0
        out.append((tk.mix(summed[full] ^ tag[full]), owner[full], unit[full], weight[full], spare[owner[full]]))
        less = single[cell] & (held[cell] > 1)
        at = cell[less]
        out.append((tk.mix((summed[at] - content[use][less]) ^ tag[at]), d[less], unit[at], weight[at], spare[d[less]]))
        over = (spare < 0) & (m > 0)
        if over.any():
            order = np.lexsort((t, d))
            t, d = t[order], d[order]
            first = np.searchsorted(d, np.arange(n_docs))
            rank = np.arange(len(d)) - first[d]
            prefix = size - (num * size + den - 1) // den + 1
            some = over[d] & (rank < prefix[d])
            zero = np.zeros(int(some.sum()), np.int64)
            out.append((tk.mix(t[some] ^ tk.mix(salt[d[some]] + U(0xABCDEF))), d[some], zero + which, zero + 1, zero - 1))
    if not out:
        return Signatures(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    return Signatures(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _describe(k: int):
    """Per (row, text, id): row, id, set size, two hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((2, batch.num_rows), np.uint64)
            for lo, hi, buf, offs in tk.slices(batch.column(1)):
                h, d = tk.distinct_shingles(*tk.word_hashes(buf, offs), k)
                size[lo:hi] = np.bincount(d, minlength=hi - lo)
                for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    sums[j, lo:hi] = tk.group_sums(tk.mix(h ^ U(salt)), d, hi - lo)
            columns = [batch.column(0), batch.column(2), pa.array(size), pa.array(tk.signed(sums[0])), pa.array(tk.signed(sums[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "h1", "h2"])

    return run


def _sketches(k: int):
    """Per (row, text): the class, set size and parity sketch, the number of the set's shingles by 1,024 values of a hash, each modulo 2."""
    bits = 64 * SKETCH_WORDS
    shift = U(65 - bits.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in tk.slices(batch.column(1)):
                h, d = tk.distinct_shingles(*tk.word_hashes(buf, offs), k)
                odd = np.bincount(d * bits + (h >> shift).astype(np.int64), minlength=(hi - lo) * bits).reshape(hi - lo, -1) & 1
                sketch = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(d, minlength=hi - lo))]
                columns += [pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH_WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", *SKETCH])

    return run


def _sign(k: int, num: int, den: int, bits: int):
    """cls (the row), sig and facts of each signature: one number that holds spare + 1, unit and weight. What differs from row to row, the
    leading ``bits`` of sig and the low bytes of facts, lies side by side, where the shuffle's compression takes it as one piece."""
    mask = ~U((1 << (64 - bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for lo, hi, buf, offs in tk.slices(batch.column(1)):
                h, d = tk.distinct_shingles(*tk.word_hashes(buf, offs), k)
                found = signatures(h, d, hi - lo, num, den)
                facts = (found.spare + 1) << 32 | found.unit << 2 | found.weight
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(found.owner + lo)), pa.array(tk.signed(found.key & mask)), pa.array(facts)], names=["cls", "sig", "facts"])

    return run


def _compare(k: int, num: int, den: int):
    """Rows (a, part, b, text) come in order of (a, part), each such group led by a's own text, where b is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b")
            leads = b.is_null().to_numpy(zero_copy_only=False)
            linked = []
            for lo, hi, buf, offs in tk.slices(batch.column("text")):
                h, d = tk.distinct_shingles(*tk.word_hashes(buf, offs), k)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    own = h[cut[i - lo] : cut[i - lo + 1]]
                    if leads[i]:
                        hub = own
                        continue
                    at = np.minimum(np.searchsorted(hub, own), max(0, len(hub) - 1))
                    both = int((hub[at] == own).sum()) if len(hub) else 0
                    if both and both * den >= (len(hub) + len(own) - both) * num:
                        linked.append(i)
            take = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a).take(take), b.take(take)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of rows of ``texts`` (row, text) whose sets are similar. The smaller side of the work, the hub's text, is
    repeated for every ``CHUNK`` partners; each partner's text moves once a pair."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = materialize(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b"), "jaccard-dealt")
    leads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("row")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    partners = dealt.join(texts, F.col("b") == F.col("row")).select("a", "part", "b", "text")
    ordered = leads.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = materialize(ordered.mapInArrow(_compare(k, num, den), "a long, b long"), "jaccard-links")
    discard(dealt)
    return found


def _without_singles(index: DataFrame) -> DataFrame:
    """The rows of buckets that hold two classes or more, with the smallest class (low) and the number of other rows (others)."""
    bucket = Window.partitionBy("sig")
    counted = index.withColumns({"low": F.min("cls").over(bucket), "high": F.max("cls").over(bucket), "others": F.count("*").over(bucket) - 1})
    return counted.where("low < high").drop("high")


def _with_partners(shared: DataFrame) -> DataFrame:
    """Without the sets whose unshared segments suffice; a set has its scheme in the last bit of unit."""
    scheme = F.col("unit").bitwiseAND(1)
    units = shared.select("cls", scheme.alias("scheme"), "unit", "weight", "spare").distinct()
    done = units.groupBy("cls", "scheme").agg(F.sum("weight").alias("held"), F.max("spare").alias("spare")).where("spare >= 0 and held <= spare")
    done = materialize(done.select("cls", "scheme"), "jaccard-alone")
    kept = shared.withColumn("scheme", scheme).join(sized(done), ["cls", "scheme"], "left_anti").drop("scheme")
    return kept


def _lookups(shared: DataFrame) -> DataFrame:
    """(cls, unit) to look up: by set and scheme the units with the shortest lists that suffice, and prefix tokens."""
    units = shared.where("weight > 0").groupBy("cls", "unit").agg(F.first("weight").alias("weight"), F.first("spare").alias("spare"), F.sum("others").alias("others"))
    line = Window.partitionBy("cls", F.col("unit").bitwiseAND(1)).orderBy(F.desc(F.col("others") / F.col("weight")), "unit").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("dropped", F.sum("weight").over(line)).where("spare < 0 or dropped > spare").select("cls", "unit")


def _mixed(shared: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components or more, with the number of rows of other components (others)."""
    of_bucket, of_own = (F.count("*").over(Window.partitionBy(*by)) for by in (["sig"], ["sig", "component"]))
    return shared.withColumn("others", of_bucket - of_own).where("others > 0")


def _distinct_buckets(marked: DataFrame) -> DataFrame:
    """(sig, same) of all buckets: buckets of the same classes have the same ``same``, the key of one of them. Told apart by their sizes and by
    sums of 128 bits of the classes' hashes."""
    parts = [F.shiftrightunsigned(F.xxhash64("cls", F.lit(salt)), by).bitwiseAND((1 << 32) - 1) for salt in (1, 2) for by in (0, 32)]
    held = marked.groupBy("sig").agg(F.count("*").alias("size"), *(F.sum(x).alias(f"m{i}") for i, x in enumerate(parts)))
    members = ["size", *(f"m{i}" for i in range(len(parts)))]
    held = materialize(held, "jaccard-members-of")
    found = held.join(held.groupBy(*members).agg(F.min("sig").alias("same")), members).select("sig", "same")
    return materialize(found, "jaccard-same")


def linked_classes(texts: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Of a table ``texts`` (row, id, text): (described, found). ``described`` has row, id, n (set size) and the set's hashes h1, h2 for
    every row. ``found`` has n, h1, h2 and component (a number) for every class of equal, non-empty sets;
    classes have the same component if links connect them. Every link was verified on the sets:
    ``den * |A & B| >= num * |A | B|``."""
    described = materialize(texts.select("row", "text", "id").mapInArrow(_describe(k), "row long, id long, n long, h1 long, h2 long"), "jaccard-sets")
    classes = described.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("cls"))
    classes = materialize(classes, "jaccard-classes")
    own = texts.select("row", "text").join(sized(classes.select(F.col("cls").alias("row"))), "row", "left_semi")

    tokens = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(64, -(-(int(tokens).bit_length() + SPARE_BITS) // 8) * 8)
    index = own.mapInArrow(_sign(k, num, den, bits), "cls long, sig long, facts long")
    unit, weight, spare = F.shiftright(F.col("facts").bitwiseAND((1 << 32) - 1), 2).cast("int"), F.col("facts").bitwiseAND(3).cast("int"), (F.shiftright("facts", 32) - 1).cast("int")
    shared = _without_singles(index).select("sig", "cls", unit.alias("unit"), weight.alias("weight"), spare.alias("spare"), "low", "others")
    shared = materialize(shared, "jaccard-buckets")
    for _ in range(ROUNDS):
        before = shared
        shared = _without_singles(_with_partners(shared).drop("low", "others"))
        shared = materialize(shared, "jaccard-buckets")
        discard(before)

    open_texts = own.join(sized(materialize(shared.select(F.col("cls").alias("row")).distinct(), "jaccard-open")), "row", "left_semi")
    open_texts = materialize(open_texts, "jaccard-texts")
    facts = materialize(open_texts.mapInArrow(_sketches(k), ", ".join(f"{c} long" for c in ("cls", "n", *SKETCH))), "jaccard-sketches")

    def plausible(a: str, b: str) -> Column:
        """Sizes and sketches do not rule a link out."""
        apart = sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in SKETCH), F.lit(0))
        fits = F.least(f"{a}_n", f"{b}_n") * den >= F.greatest(f"{a}_n", f"{b}_n") * num
        return fits & (apart * (den + num) <= (F.col(f"{a}_n") + F.col(f"{b}_n")) * (den - num))

    def side(name: str) -> DataFrame:
        return facts.toDF(name, *(f"{name}_{c}" for c in facts.columns[1:]))

    def prune(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sized(side("a")), "a").join(sized(side("b")), "b")
        return both.where(plausible("a", "b"))

    # One hub for each class: of the plausible ones, that of most buckets.
    stars = shared.where("cls > low").groupBy(F.col("low").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("times"))
    hubs = prune(stars).groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
    links = _verified(materialize(hubs, "jaccard-hubs"), open_texts, k, num, den)
    found = components(links).toDF("cls", "component")

    # Then every lookup in a bucket that holds another component.
    marked = shared.select("sig", "cls", "unit", "weight", "spare").join(sized(found), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    marked = materialize(_mixed(marked), "jaccard-mixed")
    before = marked
    marked = materialize(_mixed(_with_partners(marked).drop("others")), "jaccard-mixed")
    discard(before)
    same = _distinct_buckets(marked)
    lookups = marked.join(materialize(_lookups(marked), "jaccard-lookups"), ["cls", "unit"], "left_semi")
    lookups = materialize(lookups.join(sized(same), "sig").select(F.col("same").alias("sig"), F.col("cls").alias("a"), F.col("component").alias("a_component")).distinct(), "jaccard-lookups")
    asked = sized(materialize(lookups.select("sig").distinct(), "jaccard-asked"))
    entries = marked.join(asked, "sig", "left_semi").select("sig", F.col("cls").alias("b"), F.col("component").alias("b_component"))
    asking, entries = (materialize(rows.join(sized(side(x)), x), name) for rows, x, name in ((lookups, "a", "jaccard-asking"), (entries, "b", "jaccard-entries")))
    near = asking.join(entries, "sig").where((F.col("a_component") != F.col("b_component")) & plausible("a", "b"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = _verified(materialize(pairs, "jaccard-pairs"), open_texts, k, num, den)
    if not rest.isEmpty():  # what is connected already goes in as stars
        found = components(found.toDF("a", "b").union(rest)).toDF("cls", "component")
    discard(shared, marked, open_texts)
    labels = classes.select("n", "h1", "h2", "cls").join(sized(found), "cls", "left")
    return described, materialize(labels.select("n", "h1", "h2", F.coalesce("component", "cls").alias("component")), "jaccard-classes")


def _with_components(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """row, id, n and component (null for empty sets)."""
    described, found = linked_classes(texts, k, num, den)
    return described.join(sized(found), ["n", "h1", "h2"], "left").select("row", "id", "n", "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: id, n (set size), component (smallest id reachable by links)."""
    texts = numbered(docs, "jaccard-rows", id=F.col(id_col).cast("long"), text=F.col(text_col))
    rows = materialize(_with_components(texts, k, num, den), "jaccard-members")
    discard(texts)
    names = materialize(rows.where("component is not null").groupBy("component").agg(F.min("id").alias("smallest")), "jaccard-names")
    return rows.join(sized(names), "component", "left").select("id", "n", F.coalesce("smallest", "id").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays, that with the smallest id (null ids last); texts without words all stay."""
    plain, (key, text) = neutral(docs, id_col, text_col)
    whole = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    rows = materialize(_with_components(whole.select("row", F.col(key).cast("long").alias("id"), F.col(text).alias("text")), k, num, den), "jaccard-members")
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    gone = rows.join(sized(materialize(first.select("component", F.col("first.row").alias("stays")), "jaccard-stay")), "component").where("row <> stays").select("row")
    return whole.join(sized(materialize(gone, "jaccard-gone")), "row", "left_anti").select(*plain.columns).toDF(*docs.columns)
