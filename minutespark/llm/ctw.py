"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision is predicted in the context of the ``depth`` bytes
before it. A node of the context tree is a context of 0 to ``depth`` bytes and a prefix of the byte's bits;
its Krichevsky-Trofimov (KT) estimate comes from the training counts, and the weighted probability of
a node is half its own KT probability and half that of its extensions. From these follow the posterior
weights with which the estimates of all depths are mixed; the mixture is then fixed and scores
every text in bits per byte. Nodes that training never saw end the path at the last one it did.

The texts are dealt into blocks of about ``BLOCK`` bytes. A block counts the (context, byte) grams of its texts; they
are added up over all blocks and dealt by the two bytes next to the symbol, so that a task holds whole subtrees
below two-byte contexts and solves them level by level. Only the sums at the 257 contexts of 0 and 1 bytes go through
the driver. The tree then gives one logarithm for each gram of the corpus, which is joined to the blocks that hold the
gram, and a block's texts are scored with its own grams; no table of the tree is sent to all tasks. Grams that only held-out
texts have stand in the tree with a count of 0, which changes no estimate.

The unigram base needs a count for every word of every text. The most frequent words, at most
``FREQUENT``, are sent to the tasks; the others' counts are joined by word.

Held out are texts whose crc32(id as text) mod 10 is 0; the rest trains. A text counts with
start-of-text context and an end symbol. Nulls: a null text is empty (one end token); a null id counts as the id ''. Repeated rows
count as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import materialize

FREQUENT = 500_000
#: Bytes of context of the registered query; up to 6 fit a key.
DEPTH = 5
#: Bytes of text in a block and the least number of blocks (small blocks repeat each other's grams); grams of a bucket of
#: subtrees and the least number of buckets.
BLOCK, BLOCKS = 24 << 20, 8
BUCKET, BUCKETS = 1 << 18, 32
#: Entries that a tally takes before it merges them.
PENDING = 2_000_000
START, END = 0, 255  # neither the start context nor the end symbol is told apart from such bytes
WORD, GRAM = 0, 1
#: Key of the end token; words have hashes.
END_TOKEN = 1


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def grams(buf: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every byte and every end (the context, nearest byte first, then the symbol), and offsets by text."""
    n = len(offs) - 1
    size = np.diff(offs)
    ends = np.cumsum(size + depth + 1)
    line = np.full(int(ends[-1]) if n else 0, START, np.uint64)
    line[np.arange(len(buf)) + np.repeat(depth + (depth + 1) * np.arange(n), size)] = buf
    line[ends - 1] = END
    keys = line[depth:].copy() if n else line
    keep = np.ones(len(keys), bool)
    for j in range(1, depth + 1 if n else 0):
        keys |= line[depth - j : len(line) - j] << np.uint64(8 * (depth + 1 - j))
        keep[(ends - size - 1 - j)[1:] - depth] = False
    return keys[keep], np.concatenate([[0], np.cumsum(size + 1)])


class _Tally:
    """Counts by key that are merged whenever ``PENDING`` new entries have come, so that their number stays near that of the keys."""

    def __init__(self):
        self.parts, self.pending = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts.astype(np.int32)))
        self.pending += len(keys)
        if self.pending > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.parts, self.pending = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)], 0
        return self.parts[0]


def _count(depth: int):
    """Words of a block's training texts, and grams of all its texts with their count in training."""

    def run(block: pa.Table) -> pa.Table:
        kinds = {WORD: _Tally(), GRAM: _Tally()}
        for trains in (True, False):
            rows = block.select(["text"]).filter(pa.compute.equal(block["trains"], trains))
            if trains and rows.num_rows:
                kinds[WORD].add(np.array([END_TOKEN], np.uint64), np.array([rows.num_rows]))
            for part in rows["text"].chunks:
                for _, _, buf, offs in tk.slices(part):
                    if trains:
                        kinds[WORD].add(*np.unique(tk.word_hashes(buf, offs)[0], return_counts=True))
                    keys, count = np.unique(grams(buf, offs, depth)[0], return_counts=True)
                    kinds[GRAM].add(keys, count * trains)
        out = [(kind, *tally.merge()) for kind, tally in kinds.items() if tally.parts]
        columns = [np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in out]), np.concatenate([tk.signed(k) for _, k, _ in out]), np.concatenate([c for *_, c in out]).astype(np.int64)]
        which = pa.array(np.full(len(columns[0]), block["block"][0].as_py(), np.int32))
        return pa.Table.from_arrays([which, *(pa.array(c) for c in columns)], names=["block", "kind", "key", "n"])

    return run


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) for n >= 0, by Stirling's series after a shift of 8."""
    x = n + 0.5
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 bit-prefix nodes, from counts of the 256 symbols (last axis)."""
    zeros, ones = [], []
    for level in range(8):
        part = counts.reshape(*counts.shape[:-1], 1 << level, 2, -1).sum(-1)
        zeros.append(part[..., 0])
        ones.append(part[..., 1])
    return np.concatenate(zeros, -1), np.concatenate(ones, -1)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = zeros + ones
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - np.log(np.pi) - (_log_gamma_half(n + 0.5))


def _byte_logs(p_one: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol from the probabilities of a one at the 255 nodes."""
    out = np.zeros((*p_one.shape[:-1], 256))
    at = 0
    for level in range(8):
        p = p_one[..., at : at + (1 << level)]
        both = np.log10(np.stack([1 - p, p], -1)).reshape(*p.shape[:-1], -1)
        out += np.repeat(both, 256 >> (level + 1), axis=-1)
        at += 1 << level
    return out.astype(np.float32)


HALF = np.log(0.5)


def _bit_nodes(keys: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node of each gram (in order of key) at a place of the symbol's bits, and the nodes' zeros and ones."""
    prefix = keys >> np.uint64(8 - bit)
    node = np.concatenate([[0], np.cumsum(prefix[1:] != prefix[:-1])])
    one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
    total = np.bincount(node, n)
    ones = np.bincount(node, n * one, len(total))
    return node, total - ones, ones


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Grams, counts and each gram's place among those of one byte less, for contexts of ``top`` to ``depth`` bytes."""
    grams_, counts, up = [keys], [n], []
    for d in range(depth, top, -1):
        shorter, inverse = np.unique((grams_[0] >> np.uint64(16) << np.uint64(8)) | (grams_[0] & np.uint64(255)), return_inverse=True)
        counts.insert(0, np.bincount(inverse, counts[0], len(shorter)))
        grams_.insert(0, shorter)
        up.insert(0, inverse)
    return grams_, counts, up


def _weigh(levels, bit: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node of each gram, zeros, ones, share of the own estimate, log of the weighted probability) by level, at one bit."""
    keys, counts, up = levels
    out: list = []
    for at in range(len(keys) - 1, -1, -1):
        node, zeros, ones = _bit_nodes(keys[at], counts[at], bit)
        own = np.where(zeros + ones > 0, _kt(zeros, ones), 0.0)
        if not out:
            out.append((node, zeros, ones, np.ones(len(own)), own))
            continue
        below_node, *_, below = out[0]
        parent = np.zeros(len(below), np.int64)
        parent[below_node] = node[up[at]]
        weighted = np.logaddexp(own + HALF, np.bincount(parent, below, len(own)) + HALF)
        out.insert(0, (node, zeros, ones, np.exp(own + HALF - weighted), weighted))
    return out


def _sorted(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = bucket["key"].to_numpy().view(np.uint64), bucket["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.float64)


def _up(depth: int):
    """Of a bucket of subtrees, the counts and the sums of the logs of their weighted probabilities at (byte next to the
    symbol, bit node)."""

    def run(bucket: pa.Table) -> pa.Table:
        levels = _levels(*_sorted(bucket), depth, 2)
        below = np.zeros(65536)
        for bit in range(8):
            node, *_, weighted = _weigh(levels, bit)[0]
            place = _place(levels[0][0], bit)
            first = np.zeros(len(weighted), np.int64)
            first[node] = place
            below += np.bincount(first, weighted, 65536)
        one = levels[0][0]
        counts = np.bincount((((one >> np.uint64(16)) << np.uint64(8)) | (one & np.uint64(255))).astype(np.int64), levels[1][0], 65536)
        held = np.flatnonzero((below != 0) | (counts != 0))
        return pa.Table.from_arrays([pa.array(held), pa.array(below[held]), pa.array(counts[held].astype(np.int64))], names=["place", "below", "n"])

    return run


def _place(keys: np.ndarray, bit: int) -> np.ndarray:
    """256 x byte next to the symbol + node among the 255 (as in _nodes), for grams of two bytes of context."""
    return ((keys >> np.uint64(16)).astype(np.int64) << 8) + (1 << bit) - 1 + ((keys & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)


def _crown(n1: np.ndarray, below: np.ndarray) -> np.ndarray:
    """What contexts of 0 and 1 bytes give, for 256 bytes x 255 nodes: the share already mixed, the weight that is left,
    and the estimate where nothing longer was seen."""
    z0, o0 = _nodes(n1.sum(0))
    z1, o1 = _nodes(n1)
    seen = z1 + o1 > 0
    own1 = np.where(seen, _kt(z1, o1), 0.0) + HALF
    weighted1 = np.logaddexp(own1, below + HALF)
    own0 = _kt(z0, o0) + HALF
    beta0 = np.exp(own0 - np.logaddexp(own0, weighted1.sum(0) + HALF))
    beta1 = np.exp(own1 - weighted1)
    k0 = (o0 + 0.5) / (z0 + o0 + 1)
    k1 = np.where(seen, (o1 + 0.5) / (z1 + o1 + 1), k0)
    mixed = beta0 * k0 + (1 - beta0) * beta1 * k1
    stop = np.where(seen, beta0 * k0 + (1 - beta0) * k1, k0)
    return np.stack([mixed, (1 - beta0) * (1 - beta1), stop])


def _down(depth: int, crown: np.ndarray):
    """log10 of the probability of the symbol of each gram of a bucket, in its context."""

    def run(bucket: pa.Table) -> pa.Table:
        keys, n = _sorted(bucket)
        levels = _levels(keys, n, depth, 2)
        score = np.zeros(len(keys))
        for bit in range(8):
            place = _place(levels[0][0], bit)
            mixed, left, stop = (crown[i][place >> 8, place & 255] for i in range(3))  # by gram
            for at, (node, zeros, ones, beta, _) in enumerate(_weigh(levels, bit)):
                if at:
                    mixed, left, stop = (x[levels[2][at - 1]] for x in (mixed, left, stop))
                k = ((ones + 0.5) / (zeros + ones + 1))[node]
                stop = np.where((zeros + ones > 0)[node], mixed + left * k, stop)
                mixed, left = mixed + left * beta[node] * k, left * (1 - beta[node])
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            score += np.log10(np.where(one, stop, 1 - stop))
        return pa.Table.from_arrays([pa.array(tk.signed(keys)), pa.array(score.astype(np.float32))], names=["key", "log"])

    return run


def gram_logs(counts: DataFrame, depth: int) -> DataFrame:
    """key, log: log10 of the symbol's probability, for each gram of ``counts`` (key, n; a table on disk)."""
    buckets = max(BUCKETS, -(-counts.count() // BUCKET))
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("key", 8 * (depth - 1))), F.lit(buckets)))
    sums = dealt.groupBy("bucket").applyInArrow(_up(depth), "place long, below double, n long")
    sums = sums.groupBy("place").agg(F.sum("below").alias("below"), F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    n1, below = np.zeros(65536), np.zeros(65536)
    n1[sums["place"].to_numpy()], below[sums["place"].to_numpy()] = sums["n"].to_numpy(), sums["below"].to_numpy()
    crown = _crown(n1.reshape(256, 256), below.reshape(256, 256)[:, :255])
    return dealt.groupBy("bucket").applyInArrow(_down(depth, crown), "key long, log float")


def solve(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each two-byte context, table of log10 probabilities) from the training counts; a second,
    undistributed solution for two bytes of context, which tests compare.

    Works through the last context byte's 256 values one by one, twice (first for the root's
    weights), so that its memory is that of the result."""
    counts = counts.astype(np.float64)
    last = (keys >> 8) & 255
    n1 = np.bincount((last << 8) | (keys & 255), counts, 65536).reshape(256, 256)
    n0 = n1.sum(0)
    half = np.log(0.5)

    def subtree(c1: int):
        mine = last == c1
        contexts, row = np.unique(keys[mine] >> 16, return_inverse=True)
        n2 = np.zeros((len(contexts), 256))
        np.add.at(n2, (row, keys[mine] & 255), counts[mine])
        zeros, ones = _nodes(n2)
        below = _kt(zeros, ones).sum(0)
        z1, o1 = _nodes(n1[c1])
        own = _kt(z1, o1) + half
        weighted = np.logaddexp(own, below + half)
        return contexts, zeros, ones, z1, o1, np.exp(own - weighted), weighted

    z0, o0 = _nodes(n0)
    own = _kt(z0, o0) + half
    seen = np.flatnonzero(n1.sum(1) > 0)
    weighted = np.logaddexp(own, sum((subtree(int(c))[-1] for c in seen), np.zeros(255)) + half)
    beta0 = np.exp(own - weighted)
    k0 = (o0 + 0.5) / (z0 + o0 + 1)
    index = np.zeros(65536, np.int32)  # row 0: nothing seen
    rows = [_byte_logs(k0)[None]]
    count = 1
    for c in seen:
        contexts, zeros, ones, z1, o1, beta1, _ = subtree(int(c))
        k1 = np.where(z1 + o1 > 0, (o1 + 0.5) / (z1 + o1 + 1), k0)
        at_one = np.where(z1 + o1 > 0, beta0 * k0 + (1 - beta0) * k1, k0)
        k2 = (ones + 0.5) / (zeros + ones + 1)
        mixed = beta0 * k0 + (1 - beta0) * (beta1 * k1 + (1 - beta1) * k2)
        rows += [_byte_logs(at_one)[None], _byte_logs(np.where(zeros + ones > 0, mixed, at_one))]
        index[(np.arange(256) << 8) | c] = count
        index[(contexts << 8) | c] = count + 1 + np.arange(len(contexts))
        count += 1 + len(contexts)
    return index, np.concatenate(rows)


def _score(depth: int, keys: np.ndarray, logs: np.ndarray):
    """keys: frequent words' hashes in order; logs: log10 of their counts + 0.1."""

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        own = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(own)
        own, log = own[order], table["log"].to_numpy()[order]
        out = []
        for batch in texts.select(["doc_id", "text"]).combine_chunks().to_batches():
            for lo, hi, buf, offs in tk.slices(batch.column(1)):
                n = hi - lo
                gram, ends = grams(buf, offs, depth)
                gram, where = np.unique(gram, return_inverse=True)
                each = log[np.searchsorted(own, gram)][where].astype(np.float64)
                score = np.add.reduceat(each, ends[:-1])
                h, doc = tk.word_hashes(buf, offs)
                word, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                known = keys[at] == word if len(keys) else np.zeros(len(word), bool)
                value = np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(word))
                hit = known[inverse]
                rare = np.flatnonzero(~hit)
                cut = np.searchsorted(doc[rare], np.arange(n + 1)).astype(np.int32)
                columns = [
                    batch.column(0).slice(lo, n),
                    pa.array(np.bincount(doc, minlength=n) + 1),
                    pa.array(np.bincount(doc, hit, n).astype(np.int64)),
                    pa.array(np.bincount(doc, value[inverse], n).astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(tk.signed(h[rare]))),
                    pa.array(score),
                    pa.array(np.diff(offs)),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_frequent", "frequent_log", "rare", "score", "n_bytes"]))
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, depth: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the
    code length of text and end, per byte of text; null for empty texts) for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col).cast("long"))).alias("trains"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(BLOCKS, -(-size // BLOCK))
    # Written out, as the numbers of rows hold for one reading only.
    slim = materialize(slim.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "lm-texts")
    held = materialize(slim.groupBy("block").applyInArrow(_count(depth), "block int, kind int, key long, n long"), "lm-blocks")
    counts = materialize(held.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where(F.col("kind") == WORD)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = gram_logs(counts.where(F.col("kind") == GRAM).select("key", "n"), depth)
    table = held.where(F.col("kind") == GRAM).select("block", "key").join(table, "key").select("block", "key", "log")
    floor = _least_frequent(words, frequent)
    top = words.where(F.col("n") >= floor).select("key", "n").toArrow()
    keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    logs = np.log10(top.column("n").to_numpy()[order] + 0.1)
    end_count = words.where(F.col("key") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    layout = "doc_id long, n_tokens long, n_frequent long, frequent_log double, rare array<long>, score double, n_bytes long"
    scored = slim.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_score(depth, keys[order], logs), layout)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("key")).join(words.where(F.col("n") < floor).select("key", "n"), "key", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"))
    per_token = float(np.log10(total + 0.1 * (distinct + 1)))
    end_log = float(np.log10(end_count + 0.1))
    out = scored.drop("rare").join(rare, "row", "left")
    base = F.col("frequent_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(per_token)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(end_count > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _least_frequent(words: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` words have it or more (from a histogram of
    counts in steps of an eighth of a power of two)."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    held = 0
    floor = None
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        held += row["words"]
        if held > most:
            break
        floor = row["least"]
    return floor if floor is not None else 1 << 62
