"""The trie of conversations' prefixes, by van Emde Boas recursion.

A node is a distinct sequence of first d turns (role, text); members are the conversations that start with it.

1. Each conversation is one row of turn prints (128 bits). With the depth rounded up to a power of two, all sequences are cut at half
   depth, again and again: the upper half of a block keeps the block's root, the root of the lower half is the name of
   the cut prefix, (root, upper half). Names are 128-bit hashes of what they stand for, so that equal prefixes of all conversations have
   one name without a shuffle; log2(depth) vectorised steps name all nodes.
2. Nodes are counted by name, with partial sums before the shuffle: a first turn that a third of all conversations share is one row of each task.
3. Totals go upward by the same recursion, from the smallest blocks to the whole depth: every node knows the totals of its own
   block; a round joins blocks in pairs, and grafts the total of each lower tree's root onto the upper block's nodes above it, which one
   member's names give. That takes log2(depth) rounds, each of at most half of the names. Below a node of one member
   all is known (one leaf, nothing saved), so rounds only see shared nodes and the shared depth.
4. The digest of the members that end at a node needs them in order: they are joined in runs of ``RUN`` ids, and the runs of a node are
   hashed as a stream with constant memory.

A conversation is one row (16 bytes a turn), so the longest one bounds a task. Turns are ordered by turn (null first), role, text. Null roles
and texts are empty, repeated rows are turns each, rows with a null conversation are left out. Without conversations there
are no nodes, not even the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import discard, materialize

#: Conversation ids of a run of ends.
RUN = 4096
ROOT = bytes(16)


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), print, n (code points of the text) of all turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    line = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(line).cast("long"))
    printed = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.select("conv_id", "i", printed.alias("print"), F.length("text").cast("long").alias("n"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, i, print, n): the turns of each conversation as they are."""
    return _ordered(turns)


def shared_starts(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: c begins with the first h turns of conversation c - c % ``every`` (fewer if it has fewer), and goes on with its own
    after its first h; h is the CRC-32 of c's decimal digits modulo ``most``. Gives (conv_id, i, print, n) and all (conv_id)."""
    own = materialize(_ordered(turns), "trie-turns")
    base = lambda c: c - c % F.lit(every)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    ids = sizes.select("conv_id")
    bases = F.col("conv_id") % F.lit(every) == 0
    heads = own.where(bases & (F.col("i") < most)).select(F.col("conv_id").alias("base"), "i", "print", "n")
    first = ids.withColumn("base", base(F.col("conv_id"))).withColumn("h", h).join(heads, "base").where("i <= h").select("conv_id", "i", "print", "n")
    held = sizes.where(bases).select(F.col("conv_id").alias("base"), "size")
    rest = own.withColumn("h", h).where("i > h").withColumn("base", base(F.col("conv_id"))).join(held, "base", "left")
    at = F.least("h", F.coalesce("size", F.lit(0))) + F.col("i") - F.col("h")
    return first.unionByName(rest.select("conv_id", at.alias("i"), "print", "n")), ids


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """128-bit names of pairs of names; rows of two 64-bit numbers."""
    low = tk.mix(x[:, 0] * tk.U(3) ^ tk.mix(y[:, 0] + tk.U(0x9E3779B97F4A7C15)))
    high = tk.mix((x[:, 1] * tk.U(5) ^ tk.mix(y[:, 1] + tk.U(0xC2B2AE3D27D4EB4F))) + low)
    return np.stack([low, high], 1)


def prefix_names(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Names of all prefixes of sequences of 128-bit prints (n x 2), which lie one after the other; ``sizes``: their lengths.

    ``whole[k]`` names the whole blocks of 2**k turns. From the largest blocks down, positions in the lower half of a block
    take the name of its cut prefix as their root."""
    ends = np.cumsum(sizes)
    begin = np.repeat(ends - sizes, sizes)
    depth = np.arange(len(prints)) - begin
    left = np.repeat(ends, sizes) - np.arange(len(prints))
    whole = [prints]
    while 1 << len(whole) <= int(sizes.max(initial=0)):
        half = 1 << (len(whole) - 1)
        at = np.flatnonzero((depth & (2 * half - 1) == 0) & (left >= 2 * half))
        named = np.zeros_like(prints)
        named[at] = _joined(whole[-1][at], whole[-1][at + half])
        whole.append(named)
    root = np.zeros_like(prints)
    for k in reversed(range(len(whole))):
        low = np.flatnonzero(depth >> k & 1)
        cut = begin[low] + (depth[low] >> (k + 1) << (k + 1))
        root[low] = _joined(root[low], whole[k][cut])
    return _joined(root, prints)


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        flat = turns.flatten()
        sizes = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        prints = np.frombuffer(b"".join(flat.field("print").to_pylist()), np.uint64).reshape(-1, 2)
        names = prefix_names(prints, sizes)
        ends = np.cumsum(sizes)
        depth = np.arange(len(prints)) - np.repeat(ends - sizes, sizes) + 1
        parent = np.zeros_like(names)
        inner = np.flatnonzero(depth > 1)
        parent[inner] = names[inner - 1]
        last = np.zeros(len(names), bool)
        last[ends[sizes > 0] - 1] = True
        columns = [pa.array(np.repeat(batch.column("conv_id").to_numpy(), sizes)), pa.array(depth), _binary(names), _binary(parent), flat.field("n"), pa.array(last)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "name", "parent", "n", "last"])


def _binary(names: np.ndarray) -> pa.Array:
    offsets = np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(names))])


def named_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, parent, n, last) for each turn of ``turns`` (conv_id, i, print, n)."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "print", "n"))).alias("turns"))
    return materialize(rows.mapInArrow(_name, "conv_id long, depth long, name binary, parent binary, n long, last boolean"), "trie-paths")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are in order of (name, run): one digest for each name."""
    current, state = None, None
    for batch in batches:
        names, digests = [], []
        for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == current:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                names.append(current)
                digests.append(state.hexdigest())
            current, state = name, hashlib.sha256(ids.encode())
        yield _digest_rows(names, digests)
    if state is not None:
        yield _digest_rows([current], [state.hexdigest()])


def _digest_rows(names: list[bytes], digests: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["name", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(name, SHA-256 of the ascending ids) of ``members`` (name, conv_id)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = members.groupBy("name", F.floor(F.col("conv_id") / F.lit(RUN)).alias("run")).agg(ids.alias("ids"))
    return runs.repartition("name").sortWithinPartitions("name", "run").mapInArrow(_end_digests, "name binary, ends_sha256 string")


def _graft(shared: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, leaves, saved) over whole subtrees of ``shared`` (name, conv_id, depth, leaves, saved: the nodes' own)."""
    totals = shared
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    members = shared.select("conv_id").distinct()
    above = paths.join(members, "conv_id", "left_semi").join(shared.select("name"), "name", "left_semi")
    above = materialize(above.select("conv_id", F.col("depth") - 1, "name").toDF("conv_id", "at", "name"), "trie-above")
    size = 1
    while size < deepest:
        block = lambda at, size=size: F.floor(at / F.lit(2 * size)).alias("block")
        at = F.col("depth") - 1
        roots = totals.where(at.bitwiseAND(F.lit(2 * size - 1)) == size).select("conv_id", block(at), "leaves", "saved")
        upper = above.where(F.col("at").bitwiseAND(F.lit(size)) == 0).select("conv_id", block(F.col("at")), "name")
        grafted = roots.join(upper, ["conv_id", "block"]).select("name", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), "leaves", "saved")
        summed = totals.unionByName(grafted).groupBy("name").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        before, totals = totals, materialize(summed, "trie-totals")
        if before is not shared:
            discard(before)
        size *= 2
    discard(above)
    return totals.select("name", "leaves", "saved")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, i, print, n; see ``conversations``): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``ids`` (conv_id) are all conversations, those without turns too."""
    paths = named_paths(turns)
    ids = paths.select("conv_id").distinct() if ids is None else ids
    root = F.lit(ROOT)
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n"), "conv_id", "n_convs")
    counted = paths.groupBy("name", "parent", "depth", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialize(top.unionByName(counted), "trie-nodes")
    several: Column = F.col("n_convs") > 1
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"), F.count_if(~several).alias("single"))
    nodes = materialize(nodes.join(children, "name", "left").fillna(0, ["n_children", "single"]), "trie-children")
    own = F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = nodes.where(several & (F.col("depth") > 0)).select("name", "conv_id", "depth", own.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    shared = materialize(shared, "trie-shared")
    totals = _graft(shared, paths)
    first = totals.join(nodes.where(F.col("parent") == root).select("name"), "name", "left_semi").select(root.alias("name"), "leaves", "saved")
    whole = nodes.where("depth = 0").select("name", own.cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).unionByName(first)
    whole = whole.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = totals.unionByName(whole)
    turnless = ids.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(root.alias("name"), "conv_id")
    ends = _ends(paths.where("last").select("name", "conv_id").unionByName(turnless))
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "name", "left").join(ends, "name", "left").join(parents, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
