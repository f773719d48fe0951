"""Prefix trie of turn sequences with a minimal-perfect-hash node table.

The records of this project are observations, cells and tracks; none is a sequence of turns, so the
operator is general: it takes turns (conv_id, turn, role, text).

A prefix is known by its depth and two sums, modulo 2^64, of turn digests times powers of an odd number,
so prefix digests are running sums that can be cut anywhere, and the parent's digest is the own one less
the last term. Every node is checked to have one parent and one last turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut_lineage, release

SEGMENT = 4096  # turns of one conversation that a task may take together
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
_LOW = (1 << 32) - 1
NODE = ["depth", "s1", "s2"]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square, rest = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * np.uint64(square), out)
        square = square * square % (1 << 64)
        rest = rest >> np.uint64(1)
    return out


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, d1, d2, words per turn: its place in its conversation, the digest of role and text, and the words of its text.

    Turns are sorted over all tasks by conversation, turn (NULL first), role and text (beyond 64 characters by hash).
    Places count on where a conversation goes on in the next task; there are no more such places than tasks.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    named = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *[t.alias(c) for c, t in text.items()])
    keyed = named.withColumns({"__r": F.substring("role", 1, 64), "__t": F.substring("text", 1, 64), "__h": F.xxhash64("role", "text")})
    order = ["conv_id", F.col("turn").asc_nulls_first(), "__r", "__t", "__h"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def place(batches):
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -seen))
            at = np.arange(len(conv)) - start
            last, seen = conv[-1], int(at[-1]) + 1
            digests, words = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                r, t = role.encode(), text.encode()
                digests.append(hashlib.blake2b(b"%d %s%s" % (len(r), r, t), digest_size=16).digest())
                words.append(len(t.split()))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(conv), task, np.int32)), pa.array(conv), pa.array(at.astype(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(words, pa.int64())],
                names=["task", "conv_id", "pos", "d1", "d2", "words"])

    rows = cut_lineage(dealt.mapInArrow(place, "task int, conv_id bigint, pos bigint, d1 bigint, d2 bigint, words bigint"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(before))
    goes_on = counts.where("ahead > 0").select(F.col("conv_id").alias("__c"), F.col("task").alias("__k"), "ahead")
    placed = rows.join(F.broadcast(goes_on), (F.col("conv_id") == F.col("__c")) & (F.col("task") == F.col("__k")), "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "d1", "d2", "words")


def lookup(rows: DataFrame, table: DataFrame, on: str, key: str, n: str, parts: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row per ``key`` and the number ``n`` of rows that look for it.

    Keys that hold more than one in ``parts`` of all the rows, of which there are fewer than ``parts``, are
    broadcast; the others are joined by a shuffle, in which no key is large.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    often = table.where(F.col(n) * parts > total).drop(n)
    seldom = table.where(F.col(n) * parts <= total).drop(n)
    match = F.col(on) == F.col(key)
    return rows.join(F.broadcast(often), match).unionByName(rows.join(F.broadcast(often.select(key)), match, "left_anti").join(seldom, match)).drop(key)


def rebuilt_turns(ordered: DataFrame, group: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c as the first h turns of conversation c - c % ``group``, then its own after its first h.

    h is CRC-32 of c in decimal modulo ``shared`` + 1. Conversations are conv_id and the number of rebuilt turns they have.
    """
    size = ordered.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = F.col("conv_id")
    size = cut_lineage(size.select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % (shared + 1)).alias("h"), (c - c % group).alias("base")))
    bases = size.select(F.col("conv_id").alias("__c"), F.col("n").alias("__n"))
    given = F.least(F.col("h"), F.coalesce(F.col("__n"), F.lit(0)))
    conversations = size.join(bases, F.col("base") == F.col("__c"), "left").withColumn("given", given).drop("__c", "__n")
    conversations = cut_lineage(conversations.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = ordered.where(F.col("pos") < shared).select(F.col("conv_id").alias("__c"), "pos", "d1", "d2", "words")
    asked = conversations.where("given > 0").select("conv_id", "base", "given")
    front = asked.join(heads, F.col("base") == F.col("__c")).where("pos < given").select("conv_id", "pos", "d1", "d2", "words")
    side = conversations.where("n > h").select(F.col("conv_id").alias("__c"), "n", "h", "given")
    own = lookup(ordered, side, "conv_id", "__c", "n")
    own = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "d1", "d2", "words")
    return front.unionByName(own), conversations.select("conv_id", "length")


def _whole(low: Column, high: Column) -> Column:
    """A 64-bit sum from the sums of its terms' lower and upper halves, modulo 2^64."""
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(_LOW))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """conv_id, depth, s1, s2, p1, p2, words per rebuilt turn: the prefix that ends with it and its parent.

    Running sums are taken within segments of a conversation; segments start from the sums of those before.
    """

    def terms(batches):
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            made = []
            for base, d in zip(_BASE, ("d1", "d2")):
                t = batch.column(d).to_numpy().view(np.uint64) * _power(base, pos)
                made += [pa.array((t & np.uint64(_LOW)).view(np.int64)), pa.array((t >> np.uint64(32)).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pos"), *made, batch.column("words")], names=["conv_id", "pos", "l1", "h1", "l2", "h2", "words"])

    halves = ["l1", "h1", "l2", "h2"]
    split = turns.mapInArrow(terms, "conv_id bigint, pos bigint, l1 bigint, h1 bigint, l2 bigint, h2 bigint, words bigint")
    split = cut_lineage(split.withColumn("segment", F.floor(F.col("pos") / SEGMENT)))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy("conv_id", "segment").agg(*[F.sum(x).alias(x) for x in halves])
    ahead = sums.select("conv_id", "segment", *[F.sum(x).over(before).alias(f"a_{x}") for x in halves]).where("segment > 0")
    ahead = ahead.select(F.col("conv_id").alias("__c"), F.col("segment").alias("__s"), *[f"a_{x}" for x in halves])
    first = split.where("segment = 0").withColumns({f"a_{x}": F.lit(0).cast("bigint") for x in halves})
    later = split.where("segment > 0").join(ahead, (F.col("conv_id") == F.col("__c")) & (F.col("segment") == F.col("__s"))).drop("__c", "__s")
    so_far = Window.partitionBy("conv_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = first.unionByName(later).withColumns({f"r_{x}": F.sum(x).over(so_far) + F.col(f"a_{x}") for x in halves})
    own = [_whole(F.col(f"r_l{k}"), F.col(f"r_h{k}")).alias(f"s{k}") for k in (1, 2)]
    parent = [_whole(F.col(f"r_l{k}") - F.col(f"l{k}"), F.col(f"r_h{k}") - F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)]
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), *own, *parent, "words", "segment")


class NodeTable:
    """A minimal perfect hash of distinct (depth, s1, s2) keys: each has a slot of 0 .. n - 1 and no space is left.

    Keys are thrown into a bit array; those alone on their bit stay, the others are thrown into the
    next, smaller array. A slot is the number of kept bits before the key's. The keys stand at their slots,
    so a key that is not in the table is told apart.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = max(2 * len(left), 64)
            bit = self._bit(left, len(self.levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            left = left[~alone[bit]]
        self.keys = np.zeros_like(keys)
        self.keys[self._find(keys)] = keys

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = np.full(len(keys), level + 1, np.uint64)
        for column in keys.T:
            x = (x ^ (x >> np.uint64(31)) ^ column.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1)
        open_rows = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            bit = self._bit(keys[open_rows], level, len(alone))
            hit = alone[bit]
            slot[open_rows[hit]] = rank[bit[hit]]
            open_rows = open_rows[~hit]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not there."""
        slot = self._find(keys)
        if len(self.keys):
            slot[(self.keys[slot] != keys).any(1)] = -1
        return slot


def accumulate(keys: np.ndarray, parents: np.ndarray, leaf: np.ndarray, saved: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, leaves, saved) summed over the subtree of each distinct node of a shard, its top included.

    ``keys`` and ``parents`` are (depth, s1, s2) per row. The way up ends where a segment begins: what lies in later
    segments comes as a weight of its own.
    """
    distinct, at = np.unique(keys, axis=0, return_index=True)
    table = NodeTable(distinct)
    n = len(distinct)
    slot = table.slots(keys)
    if (slot < 0).any():
        raise ValueError("a node has no slot of its own")
    total = np.zeros((2, n), np.int64)
    np.add.at(total[0], slot, leaf)
    np.add.at(total[1], slot, saved)
    parent = np.full(n, -1)
    inner = at[(distinct[:, 0] - 1) % segment != 0]
    parent[slot[inner]] = table.slots(parents[inner])
    if (parent[slot[inner]] < 0).any():
        raise ValueError("a shard holds a node without its parent")
    order = np.argsort(-table.keys[:, 0], kind="stable")
    edges = np.flatnonzero(np.diff(table.keys[order, 0])) + 1
    for level in np.split(order, edges):  # deepest first
        level = level[parent[level] >= 0]
        for t in total:
            np.add.at(t, parent[level], t[level])
    return table.keys, total[0], total[1]


def _runs_of(batches, columns: list[str]):
    """Whole runs of rows, sorted by ``columns``, as tables that end where a run ends."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        values = [table.column(c).to_numpy() for c in columns]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for lo, hi in zip([0, *change[:-1].tolist()], change.tolist()):
            yield table.slice(lo, hi - lo)
        held = table.slice(int(change[-1]) if len(change) else 0)
    if held is not None and held.num_rows:
        yield held


def subtree_sums(rows: DataFrame, nodes: DataFrame, shard_rows: int) -> DataFrame:
    """depth, s1, s2, n_leaves, saved_tokens of every node below the root that has a leaf beneath it, hence of all.

    A shard holds whole segments of conversations. A node's weight is given to the segment in which the conversation
    that names the node has it, where all its ancestors of that segment are present too; sums of a
    shard's trie are then added up by node over the shards. A node that a third of all conversations share
    is one slot a shard. What lies in later segments of the same conversation is added at a segment's end.
    """
    weight = {"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    part = F.floor((F.col("depth") - 1) / SEGMENT).alias("segment")
    base = ["conv_id", "segment", "depth", "s1", "s2", "p1", "p2"]
    weights = nodes.where("depth > 0").select(*base[:1], part, *base[2:], *[w.alias(c) for c, w in weight.items()])
    paths = rows.select(*base, F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved"))
    ends = rows.where(F.col("depth") % SEGMENT == 0).select(*base)
    if not ends.isEmpty():  # conversations of more than one segment
        after = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
        there = weights.groupBy("conv_id", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        both = there.unionByName(ends.select("conv_id", "segment", F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved")))
        below = both.groupBy("conv_id", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        below = below.select(F.col("conv_id").alias("__c"), F.col("segment").alias("__s"), *[F.sum(x).over(after).alias(x) for x in weight])
        carried = ends.join(below, (F.col("conv_id") == F.col("__c")) & (F.col("segment") == F.col("__s"))).drop("__c", "__s")
        paths = paths.unionByName(carried.where("leaf IS NOT NULL"))
    every = paths.unionByName(weights)
    shards = max(rows.count() // shard_rows, 1)
    segment = SEGMENT
    dealt = every.withColumn("shard", F.pmod(F.xxhash64("conv_id", "segment"), F.lit(shards))).drop("conv_id", "segment")
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard")

    def climb(batches):
        for table in _runs_of(batches, ["shard"]):
            col = {c: table.column(c).to_numpy() for c in table.column_names}
            keys = np.stack([col["depth"], col["s1"], col["s2"]], 1)
            parents = np.stack([col["depth"] - 1, col["p1"], col["p2"]], 1)
            node, leaves, saved = accumulate(keys, parents, col["leaf"], col["saved"], segment)
            some = np.flatnonzero((leaves > 0) | (saved > 0))
            yield pa.RecordBatch.from_arrays([*[pa.array(node[some, k]) for k in range(3)], pa.array(leaves[some]), pa.array(saved[some])], names=[*NODE, "n_leaves", "saved_tokens"])

    got = dealt.mapInArrow(climb, "depth bigint, s1 bigint, s2 bigint, n_leaves bigint, saved_tokens bigint")
    return got.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def ends_digests(ends: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """depth, s1, s2, ends_sha256: SHA-256 of the ids that end at each node, ascending, joined by commas.

    Ids are sorted over all tasks and joined into pieces there; the hash, which can only be taken from start to
    end, then streams over a node's pieces.
    """
    order = [*NODE, "conv_id"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy() for c in NODE]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            cuts = [k for lo, hi in zip(edges, edges[1:]) for k in range(lo, hi, piece // 8)] + [batch.num_rows]
            ids = batch.column("conv_id").to_pylist()
            text = [",".join(map(str, ids[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*[pa.array(v[cuts[:-1]]) for v in values], pa.array([ids[k] for k in cuts[:-1]]), pa.array(text)], names=[*NODE, "first", "ids"])

    pieces = dealt.mapInArrow(join, "depth bigint, s1 bigint, s2 bigint, first bigint, ids string")
    runs = pieces.repartition(*[F.col(c) for c in NODE]).sortWithinPartitions(*NODE, "first")

    def digest(batches):
        open_key, state = None, None
        for batch in batches:
            keys, made = list(zip(*[batch.column(c).to_pylist() for c in NODE])), []
            for key, ids in zip(keys, batch.column("ids").to_pylist()):
                if key == open_key:
                    state.update(b"," + ids.encode())
                    continue
                if open_key is not None:
                    made.append((*open_key, state.hexdigest()))
                open_key, state = key, hashlib.sha256(ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=[*NODE, "ends_sha256"])
        if open_key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_key, state.hexdigest())], names=[*NODE, "ends_sha256"])

    return runs.mapInArrow(digest, "depth bigint, s1 bigint, s2 bigint, ends_sha256 string")


def _on(right: list[str], left: list[str] = NODE) -> Column:
    match = F.col(left[0]) == F.col(right[0])
    for a, b in zip(left[1:], right[1:]):
        match &= F.col(a) == F.col(b)
    return match


def prefix_trie(turns: DataFrame, group: int = 20, shared: int = 3, shard_rows: int = 1 << 18) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by ``turn`` (NULL first, ties by role and text); a NULL role or text is empty, a NULL conv_id is
    no conversation. Conversation c is rebuilt from the first h turns of conversation c - c % ``group`` (all if
    it has fewer, none if it is not there) and its own turns after its first h, h being CRC-32 of c modulo ``shared`` + 1.
    Each distinct sequence of first turns is a node, from the root without turns at depth 0.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent (NULL at the root), ``n_convs`` counts
    members, ``n_children`` the nodes one turn longer, ``n_leaves`` the childless nodes of the subtree (itself, if
    childless), ``saved_tokens`` sums (members - 1) times the words of the last text over the subtree, and
    ``ends_sha256`` is the hash of the ids that end here. Repeated rows are turns of their own. Other columns
    are ignored; an empty table gives an empty trie, without a root.
    """
    ordered = cut_lineage(ordered_turns(turns.select("conv_id", "turn", "role", "text")))
    rebuilt, conversations = rebuilt_turns(ordered, group, shared)
    conversations = cut_lineage(conversations)
    rows = cut_lineage(prefix_rows(rebuilt))
    release(ordered)

    same = [F.min(c) == F.max(c) for c in ("p1", "p2", "words")]
    node = rows.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.assert_true(same[0] & same[1] & same[2], F.lit("two prefixes have one digest")).alias("__ok"))
    top = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    top = top.select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "n_convs", "conv_id", zero.alias("words"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"))
    node = cut_lineage(node.where("__ok IS NULL").drop("__ok").unionByName(top))
    children = node.where("depth > 0").groupBy((F.col("depth") - 1).alias("__d"), F.col("p1").alias("__1"), F.col("p2").alias("__2")).agg(F.count("*").alias("n_children"))
    nodes = node.join(children, _on(["__d", "__1", "__2"]), "left").drop("__d", "__1", "__2").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = cut_lineage(nodes)
    release(node)

    sums = subtree_sums(rows, nodes, shard_rows)
    whole = nodes.agg(F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = sums.unionByName(whole.where("n_leaves > 0").select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "n_leaves", "saved_tokens"))
    last = rows.select("conv_id", *NODE).join(conversations.select(F.col("conv_id").alias("__c"), "length"), (F.col("conv_id") == F.col("__c")) & (F.col("depth") == F.col("length")))
    none = conversations.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("s1"), zero.alias("s2"))
    ends = cut_lineage(last.select("conv_id", *NODE).unionByName(none))
    digests = ends_digests(ends)

    keyed = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))))
    parents = nodes.where("n_children > 0").select(F.struct(*NODE).alias("__p"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below = lookup(keyed.where("depth > 0"), parents, "parent", "__p", "__n")
    named = keyed.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).unionByName(below).drop("parent")
    for table, made in ((sums, ["n_leaves", "saved_tokens"]), (digests, ["ends_sha256"])):
        side = table.select(*[F.col(c).alias(f"__{c}") for c in NODE], *made)
        named = named.join(side, _on([f"__{c}" for c in NODE]), "left").drop(*[f"__{c}" for c in NODE])
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
