"""Prefix tries of conversations as succinct level-order tries (LOUDS), a shard at a time.

A prefix of turns is named by 128 bits: the exclusive or of a hash of every
(place, turn) in it, so prefixes come from running totals, whatever the length of
a conversation, and no task holds one. Distinct prefixes are the nodes. A node
is owned by its smallest member; what a conversation owns is the end of its
path, so the size of every subtree is one grouped sum. Subtrees of at most
``limit`` nodes go to prefix shards, where numpy builds the bit vector and the
labels and rolls up by levels. The nodes above them (heavy upper levels) get the
sums of their shards through the paths of their owners, again as grouped sums.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelforge.operators.scans import numbered, running

from .common import batch_of, materialise, task

#: Nodes of a subtree that a shard takes whole.
LIMIT = 1 << 13
#: Heavy nodes up to this count (56 bytes each) are broadcast, more are joined.
FEW = 100_000
#: Ids joined into one string before they go to the task that hashes a node's list.
RUN = 4096
NAME = ["depth", "p1", "p2"]


class Louds:
    """A level-order trie below a super-root: node 0 is the super-root, nodes 1 to n follow in level order.

    ``bits`` has, for each node in order, a one for each child and a zero; ``labels`` the label of nodes 1 to n.
    """

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)

    @classmethod
    def of(cls, degrees: np.ndarray, labels: np.ndarray) -> Louds:
        """From the number of children of nodes 0 to n in level order."""
        bits = np.ones(int(degrees.sum()) + len(degrees), np.uint8)
        bits[np.cumsum(degrees + 1) - 1] = 0
        return cls(bits, labels)

    def parents(self) -> np.ndarray:
        """Of nodes 1 to n: the zeros before the one that stands for the node."""
        return self.ones - np.arange(len(self.ones))

    def children(self, node: int) -> range:
        """The nodes below ``node``: the ones between its zero and the zero before it."""
        first = int(self.zeros[node - 1]) + 1 if node else 0
        return range(first - node + 1, int(self.zeros[node]) - node + 1)

    def levels(self) -> list[tuple[int, int]]:
        """First and last node (exclusive) of each level below the super-root."""
        out, low, high = [], 1, 1 + len(self.children(0))
        while low < high:
            out.append((low, high))
            low, high = high, int(self.zeros[high - 1]) - (high - 1) + 1
        return out

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of the values of nodes 0 to n, level by level from below."""
        total, above = values.copy(), self.parents()
        for low, high in reversed(self.levels()):
            np.add.at(total, above[low - 1 : high - 1], total[low:high])
        return total

    def packed(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits).tobytes(), np.ascontiguousarray(self.labels).tobytes()

    @classmethod
    def unpacked(cls, n: int, bits: bytes, labels: bytes) -> Louds:
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n + 1), np.frombuffer(labels, np.int64).reshape(n, 2))


def level_order(depth: np.ndarray, names: np.ndarray, edges: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """(trie, rows in level order, for each row the row of its parent or -1) of nodes named (depth, 128 bits) with their last edge."""
    n = len(depth)
    keys = np.concatenate([np.column_stack([depth, names]), np.column_stack([depth - 1, names ^ edges])])
    order = np.lexsort(keys.T[::-1])
    new = np.ones(2 * n, bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    group = np.empty(2 * n, np.int64)
    group[order] = np.cumsum(new) - 1
    row = np.full(2 * n, -1, np.int64)
    row[group[:n]] = np.arange(n)
    parent = row[group[n:]]
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth], prepend=depth[by_depth[0]] - 1)) if n else np.zeros(0, np.int64)
    place, rows = np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    # Roots of other depths hang below the super-root like the first level: a node's level is its distance from its root.
    level = np.zeros(n, np.int64)
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        here = by_depth[a:b]
        level[here] = np.where(parent[here] >= 0, level[parent[here]] + 1, 0)
    by_level = np.argsort(level, kind="stable")
    ends = np.cumsum(np.bincount(level, minlength=1)) if n else []
    out, start = [], 0
    for end in ends:
        here = by_level[start:end]
        here = here[np.lexsort((edges[here, 1], edges[here, 0], place[parent[here]]))]
        place[here] = start + 1 + np.arange(len(here))
        out.append(here)
        start = end
    rows = np.concatenate(out) if out else rows
    above = np.where(parent[rows] >= 0, place[parent[rows]], 0)
    return Louds.of(np.bincount(above, minlength=n + 1), edges[rows]), rows, parent


def _columns(batch: pa.Table):
    get = lambda name: batch.column(name).to_numpy()
    return get("depth"), np.column_stack([get("p1"), get("p2")]), np.column_stack([get("e1"), get("e2")])


ROLLED = "depth long, p1 long, p2 long, q1 long, q2 long, top long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_ROLLED = pa.schema([(x.split()[0], pa.int64()) for x in ROLLED.split(", ")])


def roll_up(table: pa.Table) -> pa.Table:
    """A row for each node of a shard; a subtree's top keeps the parent_conv_id that came with it."""
    depth, names, edges = _columns(table)
    trie, rows, parent = level_order(depth, names, edges)
    n_convs, w, conv, above = (table.column(c).to_numpy() for c in ("n_convs", "w", "conv_id", "above"))
    n_children = np.diff(trie.zeros) - 1
    leaves = trie.rolled_up(np.concatenate([[0], (n_children == 0).astype(np.int64)]))[1:]
    saved = trie.rolled_up(np.concatenate([[0], ((n_convs - 1) * w)[rows]]))[1:]
    up = np.where(parent[rows] >= 0, conv[parent[rows]], above[rows])
    q = names ^ edges
    return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in (depth[rows], names[rows, 0], names[rows, 1], q[rows, 0], q[rows, 1], parent[rows] < 0, conv[rows], up, n_convs[rows], n_children, leaves, saved)], schema=_ROLLED)


def pack_shard(key, table: pa.Table) -> pa.Table:
    trie, _, _ = level_order(*_columns(table))
    bits, labels = trie.packed()
    return pa.table({"shard": [key[0].as_py()], "n_nodes": [table.num_rows], "louds": [bits], "labels": [labels]}, pa.schema([("shard", pa.int64()), ("n_nodes", pa.int64()), ("louds", pa.binary()), ("labels", pa.binary())]))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (c, depth, t1, t2, w, last), lengths (c, length)) of the rebuilt conversations.

    Turns are ordered by turn (null first), turns of one number by role, then by
    a hash of the text. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), words.alias("w"))
    placed = materialise(numbered(turns, ["c"], ["turn", "role", "t1", "t2"], "i", "n").drop("turn", "role"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    convs = placed.where("i = 1").select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % 20).alias("base"))
    lengths = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = materialise(convs.join(lengths, "base", "left").select("c", "base", "h", "n", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")))
    heads = placed.where("i <= 3").select(F.col("c").alias("base"), "i", "t1", "t2", "w")
    head = convs.join(heads, "base").where("i <= taken").select("c", F.col("i").alias("depth"), "t1", "t2", "w", ((F.col("i") == F.col("taken")) & (F.col("n") <= F.col("h"))).alias("last"))
    short = convs.where("taken < h").select("c", (F.col("h") - F.col("taken")).alias("less"))
    own = placed.where(F.col("i") > h).join(short, "c", "left").select("c", (F.col("i") - F.coalesce("less", F.lit(0))).alias("depth"), "t1", "t2", "w", (F.col("i") == F.col("n")).alias("last"))
    return head.union(own), convs.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def paths(turns: DataFrame) -> DataFrame:
    """``turns`` with the name (p1, p2) of the prefix that ends at each, and its last edge (e1, e2)."""
    hashed = turns.select("c", "depth", F.xxhash64("depth", "t1").alias("e1"), F.xxhash64("depth", "t2", F.lit(1)).alias("e2"), "w", "last")
    return running(hashed, ["c"], "depth", {"p1": F.col("e1"), "p2": F.col("e2")}, F.bit_xor)


class Trie:
    """The trie of ``conversations``, cut into shards; intermediate tables are written."""

    def __init__(self, conversations: DataFrame, limit: int = LIMIT):
        turns, lengths = rebuilt(conversations)
        self.rows = materialise(paths(turns))
        self.lengths = materialise(lengths)
        zero = F.lit(0).cast("long")
        root = self.lengths.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").select(*(zero.alias(x) for x in (*NAME, "e1", "e2", "w")), "n_convs", "conv_id")
        nodes = self.rows.groupBy(*NAME).agg(F.max("e1").alias("e1"), F.max("e2").alias("e2"), F.max("w").alias("w"), F.count("*").alias("n_convs"), F.min("c").alias("conv_id"))
        self.nodes = materialise(nodes.union(root))
        owners = self.nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("from"), F.max("depth").alias("to"))
        owned = self.rows.select("c", *NAME).union(self.lengths.select("c", *(zero for _ in NAME))).join(owners, "c")
        owned = materialise(owned)
        size = owned.groupBy(*NAME).agg(F.sum(F.col("to") - F.greatest("depth", "from") + 1).alias("size"))
        heavy = size.where((F.col("size") > limit) | (F.col("depth") == 0)).drop("size").join(self.nodes, NAME)
        self.heavy = materialise(heavy)
        upper = F.broadcast(self.heavy) if self.heavy.count() <= FEW else self.heavy
        self.upper = materialise(owned.select("c", *NAME).join(upper, NAME))
        self.cuts = materialise(self.upper.groupBy("c").agg(F.max("depth").alias("cut"), F.max_by("conv_id", "depth").alias("above")))
        tops = owned.select("c", *NAME).join(self.cuts, "c").where(F.col("depth") == F.col("cut") + 1)
        n_shards = max(1, -(-self.nodes.count() // limit))
        shard = tops.select(F.col("c").alias("conv_id"), "cut", "above", F.pmod(F.xxhash64("p1", "p2"), F.lit(n_shards)).alias("shard"))
        self.light = self.nodes.join(shard, "conv_id").where(F.col("depth") > F.col("cut"))

    def shards(self) -> DataFrame:
        """(shard, n_nodes, louds, labels): the succinct tries themselves, one row each."""
        return self.light.groupBy("shard").applyInArrow(lambda key, t: pack_shard(key, t), "shard long, n_nodes long, louds binary, labels binary")

    def rolled(self) -> DataFrame:
        """Every node with its parent's conv_id and its sums."""
        low = materialise(self.light.select("shard", *NAME, "e1", "e2", "w", "n_convs", "conv_id", "above").groupBy("shard").applyInArrow(lambda t: roll_up(t), ROLLED))
        # A subtree's top counts once for all heavy nodes above it: through the path of its owner.
        tops = low.where("top = 1")
        below = tops.select(F.col("conv_id").alias("c"), "n_leaves", "saved_tokens")
        own = F.when(F.col("c") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("w")).otherwise(F.lit(0))
        way = self.upper.join(self.cuts.select("c", "cut"), "c").withColumn("up", F.col("cut") - F.col("depth") + 1)
        way = running(way, ["c"], "up", {"held": own}).join(below, "c", "left")
        sums = way.groupBy(*NAME).agg(F.sum(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"), F.sum(F.col("held") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"))
        before = self.upper.select("c", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
        mine = self.upper.where("c = conv_id").join(before, ["c", "depth"], "left")
        child = [(F.col("depth") - 1).alias("depth"), F.col("p1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("p2")]
        family = tops.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).union(mine.where("depth > 0").select(*child)).groupBy(*NAME).agg(F.count("*").alias("n_children"))
        high = mine.join(sums, NAME).join(family, NAME, "left")
        n_children = F.coalesce("n_children", F.lit(0))
        high = high.select(*NAME, "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens")
        return low.select(high.columns).union(high)

    def ends(self) -> DataFrame:
        """(node, ends_sha256): of the ids of the conversations that end at a node, numerically ascending, comma-joined.

        Ids are sorted in ranges and joined ``RUN`` at a time where they lie;
        the task of a node hashes those strings as a stream, so a node at which
        very many conversations end costs one task eleven bytes or so for each,
        never held together.
        """
        end = self.rows.where("last").select(*NAME, "c").union(self.lengths.where("length = 0").select(*(F.lit(0).cast("long") for _ in NAME), "c"))
        runs = end.repartitionByRange(*NAME, "c").sortWithinPartitions(*NAME, "c").mapInArrow(task(join_ids), "depth long, p1 long, p2 long, c long, ids string")
        return runs.repartition(*NAME).sortWithinPartitions(*NAME, "c").mapInArrow(task(hash_ids), "depth long, p1 long, p2 long, ends_sha256 string")


_RUNS = pa.schema([*((n, pa.int64()) for n in NAME), ("c", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([*((n, pa.int64()) for n in NAME), ("ends_sha256", pa.string())])


def join_ids(batches):
    """Sorted (node, c) to (node, first c, up to RUN ids joined by commas)."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(n).to_numpy() for n in NAME])
        c = b.column("c").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        cuts = np.unique(np.concatenate([*(np.arange(x, y, RUN) for x, y in zip(first, [*first[1:], len(c)], strict=True))]))
        ids = b.column("c").cast(pa.string()).to_pylist()
        joined = [",".join(ids[x:y]) for x, y in zip(cuts, [*cuts[1:], len(c)], strict=True)]
        yield batch_of(_RUNS, *(keys[cuts, k] for k in range(3)), c[cuts], joined)


def hash_ids(batches):
    """Sorted (node, c, ids) to (node, hash of all its ids)."""
    at, state = None, None
    for b in batches:
        done = []
        for d, p1, p2, ids in zip(*(b.column(n).to_pylist() for n in NAME), b.column("ids").to_pylist(), strict=True):
            if (d, p1, p2) != at:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (d, p1, p2), sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield batch_of(_ENDS, *zip(*done, strict=True))
    if at:
        yield batch_of(_ENDS, *([x] for x in (*at, state.hexdigest())))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations; an empty table has none.

    ``conv_id``: smallest member. ``parent_conv_id``: that of the parent (root:
    null). ``n_convs``: members. ``n_children``, ``n_leaves`` (childless nodes
    of the subtree), ``saved_tokens`` (over the subtree, members but one times
    words of the last text), ``ends_sha256`` as in ``Trie.ends``. Null roles and
    texts are empty; equal conversations, turns without number and other columns
    need no care.
    """
    trie = Trie(conversations, limit)
    ends = F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256")
    return trie.rolled().join(trie.ends(), NAME, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
