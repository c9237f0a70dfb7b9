"""Prefix trie of conversations: every distinct beginning with its members, leaves and the words that sharing it saves.

Conversations are rows (conv_id, turn, role, text). A turn is known by a 128-bit digest of role and text, a conversation by the digests of its turns one
after the other, so that byte order is the order of sequences. Copies are grouped first (count, smallest conv_id, digest of all their ids); distinct
sequences are dealt by range. Each task goes through its range in blocks of ``BLOCK_TURNS`` turns. A block encodes its digests by a dictionary and builds
a ternary search tree: the middle sequence of every stretch is inserted first, so the search among the children of a node is balanced. One pass over
the nodes from the last made to the first adds up members, smallest conv_id, children, leaves and saved words.

Nodes on the path of the first or last sequence of a block may go on in another block; all others are final. The former are merged by depth and digest of
their prefix; whether one is a leaf, and what its boundary descendants add, is known only then and is summed along the paths.

Nulls: a null turn comes first, null role and text are empty; equal turns are ordered by role, then by the digest of the text; rows without a conv_id
belong to no conversation and are left out. Repeated rows are turns of their own. An empty table has no nodes. Other columns are not read. Memory: one
conversation is one row of 20 bytes a turn; blocks bound the rest. The ids behind one node are digested in order from pieces of ``PIECE_IDS``, so that
a node with very many of them is a stream, not a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16  # bytes of a turn
BLOCK_TURNS = 100_000
PIECE_IDS = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "block string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, ends_sha256 string, paths array<string>"
)


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation from 1: conv_id, place, digest (hex), words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    told = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    slim = rows.select("conv_id", "turn", "role", F.substring(told, 1, 2 * DIGEST).alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words"), F.sha2("text", 256).alias("tie"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "tie"))
    return slim.select("conv_id", place.alias("place"), "digest", "words")


def with_shared_beginnings(turns: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 20, then its own turns after the first h; h = crc32(c) % 4. Turnless ones stay, with no digest."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    heads = turns.filter("place <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.struct("place", "digest", "words").alias("turn"))
    heads = heads.groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("head"))  # three at most
    convs = convs.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")).alias("head"))
    convs = convs.withColumn("borrowed", F.size("head"))
    tails = turns.join(convs.select("conv_id", "h", "borrowed"), "conv_id").filter("place > h")
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("borrowed")).cast("int").alias("place"), "digest", "words")
    return convs.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.*").union(tails)


def sequences(rebuilt: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, seq (digests of its turns joined), words of each turn, and a name by which copies are the same."""
    turn = F.when(F.col("place").isNotNull(), F.struct("place", "digest", "words"))
    whole = rebuilt.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    seq = F.unhex(F.array_join(F.col("turns.digest"), ""))
    return whole.select("conv_id", seq.alias("seq"), F.col("turns.words").alias("words"), F.sha2(seq, 256).alias("name"))


def distinct_sequences(seqs: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """Each sequence once: conv_id (the smallest), n_convs, seq, words, ends_sha256 of the ids of all its conversations."""
    groups = seqs.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    groups = groups.join(_digests_of_ids(seqs.select("name", "conv_id"), piece_ids), "name")
    return seqs.select("conv_id", "seq", "words").join(groups, "conv_id").select("conv_id", "n_convs", "seq", "words", "ends_sha256")


def _digests_of_ids(ids: DataFrame, piece_ids: int) -> DataFrame:
    """sha256 of the ascending ids of each name: pieces of joined ids first, made wherever the sorted ids lie, then each name's pieces in order."""
    dealt = ids.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = dealt.mapInArrow(lambda batches: _pieces(batches, piece_ids), "name string, first long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digested, "name string, ends_sha256 string")


def _pieces(batches, piece_ids):
    for batch in batches:
        names, ids = batch.column("name"), batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        codes = names.dictionary_encode().indices.to_numpy()
        begins = np.flatnonzero(np.diff(codes, prepend=-1))
        begins = np.concatenate([np.arange(a, b, piece_ids) for a, b in zip(begins, np.append(begins[1:], len(ids)))])
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begins, np.append(begins[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(begins)), pa.array(ids[begins]), pa.array(texts, pa.string())], ["name", "first", "ids"])


def _digested(batches):
    name, running = None, None
    for batch in batches:
        names, digests = [], []
        for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if own == name:
                running.update(b"," + ids.encode())
                continue
            if name is not None:
                names.append(name)
                digests.append(running.hexdigest())
            name, running = own, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
    if name is not None:
        yield pa.RecordBatch.from_pydict({"name": [name], "ends_sha256": [running.hexdigest()]})


class Tree:
    """A ternary search tree of sequences of codes: ``low`` and ``high`` lead to other turns at the same place, ``child`` to the turns that follow."""

    def __init__(self):
        self.code, self.low, self.high, self.child = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.words = [-1], [0], [0]

    def _node(self, code: int, parent: int, words: int) -> int:
        self.code.append(code)
        self.low.append(-1)
        self.high.append(-1)
        self.child.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append(words)
        return len(self.code) - 1

    def insert(self, codes: list[int], words: list[int]) -> int:
        """The node at which the sequence ends."""
        code, low, high, at = self.code, self.low, self.high, 0
        for own, n_words in zip(codes, words):
            node = self.child[at]
            if node < 0:
                node = self.child[at] = self._node(own, at, n_words)
            while code[node] != own:
                side = low if own < code[node] else high
                if side[node] < 0:
                    side[node] = self._node(own, at, n_words)
                node = side[node]
            at = node
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        found = [node]
        while found[-1]:
            found.append(self.parent[found[-1]])
        return found[::-1]


def middle_first(n: int):
    """0..n-1, the middle of every stretch before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


def _nodes(batches, block_turns):
    """Rows of nodes of every block of a range of sorted sequences."""
    task, number, held, turns = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        table = batch.to_pydict()
        for row in zip(*(table[c] for c in ("conv_id", "n_convs", "seq", "words", "ends_sha256"))):
            held.append(row)
            turns += 1 + len(row[3])
            if turns >= block_turns:
                yield _block(f"{task}-{number}", held)
                held, turns, number = [], 0, number + 1
    if held:
        yield _block(f"{task}-{number}", held)


def _block(name: str, rows: list[tuple]) -> pa.RecordBatch:
    convs, counts, seqs, words, ends = zip(*rows)
    halves = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(fresh) - 1
    stops = np.cumsum([len(w) for w in words])
    tree, last = Tree(), [0] * len(rows)
    for i in middle_first(len(rows)):
        last[i] = tree.insert(codes[stops[i] - len(words[i]) : stops[i]].tolist(), words[i])

    n = len(tree.code)
    members, smallest, ended = [0] * n, [None] * n, [None] * n
    for i, node in enumerate(last):
        members[node], smallest[node], ended[node] = counts[i], convs[i], ends[i]
    keys: list[bytes | None] = [None] * n
    paths: list[list[str] | None] = [None] * n
    for i, side in ((0, "a"), (len(rows) - 1, "b")):
        digest = hashlib.sha256()
        for d, node in enumerate(tree.path(last[i])):
            if d:
                digest.update(seqs[i][(d - 1) * DIGEST : d * DIGEST])
            keys[node], paths[node] = digest.digest()[:DIGEST], [*(paths[node] or []), name + side]

    children, leaves, saved, parent = [0] * n, [0] * n, [0] * n, tree.parent
    for node in range(n - 1, 0, -1):  # a node is made before those below it
        above = parent[node]
        members[above] += members[node]
        if smallest[above] is None or smallest[node] < smallest[above]:
            smallest[above] = smallest[node]
        if keys[node] is None:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    inner = [p >= 0 and keys[p] is None for p in parent]
    return pa.RecordBatch.from_arrays([
        pa.array([name] * n), pa.array(keys, pa.binary()), pa.array([keys[p] if p >= 0 else None for p in parent], pa.binary()), pa.array(smallest, pa.int64()),
        pa.array(tree.depth, pa.int64()), pa.array([smallest[p] if i else None for p, i in zip(parent, inner)], pa.int64()), pa.array(members, pa.int64()),
        pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array(tree.words, pa.int64()), pa.array(ended, pa.string()),
        pa.array(paths, pa.list_(pa.string())),
    ], [c.split(" ")[0] for c in NODE.split(", ")])


def trie(rebuilt: DataFrame, block_turns: int = BLOCK_TURNS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations (conv_id, place, digest, words)."""
    seqs = stored(sequences(rebuilt), "sequences")
    dealt = distinct_sequences(seqs, piece_ids).repartitionByRange("seq").sortWithinPartitions("seq")
    nodes = stored(dealt.mapInArrow(lambda batches: _nodes(batches, block_turns), NODE), "trie-blocks")

    edge = nodes.filter("key IS NOT NULL")
    merged = edge.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"),
        F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"), F.min(F.array_min("paths")).alias("owner"),
    )
    merged = stored(merged, "trie-edges")
    below = merged.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("edge_children"))
    whole = merged.join(below, "key", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0)))
    own_leaves = F.col("inner_leaves") + (F.col("n_children") == 0).cast("long")
    own_saved = F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words")

    # each edge node counts on one of the paths it lies on, for itself and all nodes above
    along = edge.select("key", F.explode("paths").alias("path"))
    mine = F.col("path") == F.col("owner")
    along = along.join(whole.select("key", "depth", "owner", own_leaves.alias("own_leaves"), own_saved.alias("own_saved")), "key")
    upward = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = along.select("key", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(upward).alias(c) for c in ("own_leaves", "own_saved")))
    sums = along.groupBy("key").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edges = whole.join(sums, "key").join(above, "parent_key", "left")

    inner = nodes.filter("key IS NULL")
    # nodes right below an edge node learn its smallest conversation by block, so that no node's children meet in one place
    named = edge.select("block", F.col("key").alias("parent_key")).join(above, "parent_key")
    outer = inner.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(named, ["block", "parent_key"])
    inner = inner.filter("parent_key IS NULL")
    return _final(edges).union(_final(outer)).union(_final(inner))


def _final(nodes: DataFrame) -> DataFrame:
    ends: Column = F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of conversations after their beginnings are shared."""
    return trie(with_shared_beginnings(stored(ordered(conversations), "turns")), **sizes)
