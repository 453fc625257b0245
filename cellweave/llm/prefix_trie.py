"""The prefix trie of rebuilt conversations, as burst tries.

Every turn gets an identifier of its role and text, so that a conversation is a sequence of
identifiers; equal sequences are one row with their number of members from then on. All
sequences start in one container under the root. A container that holds too many turns bursts:
its head is moved down the turns that all its sequences share, and the suffixes go to new
containers by their next turn. When no container is too large, the sequences of each are sorted
and swept once: a turn that differs from the sequence before opens a node, and closing it adds
what lies below. What is known of a container's top is then carried up the burst heads.

Containers bound what one task holds, so that one first turn may stand in any share of the
conversations. The identifiers of one conversation (32 bytes a turn) stand in one row, like the
text of a document.

Defined cases: rows without conv_id are no conversation; null role or text counts as empty; turns
of one number are ordered by identifier; repeated rows are turns of their own; an empty table gives
no rows, not even a root; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

NON_WHITE = r"[^\x20\x09-\x0D]+"
#: How many conversations share a base, and how many of its turns at most go in front of theirs.
GROUP = 20
HEADS = 4
#: Turns in a container above which it bursts.
CONTAINER = 4096
#: Members are listed in blocks of so many consecutive ids.
BLOCK_BITS = 10
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, head string, above string"
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def sequence_id(turns: Column) -> Column:
    return F.md5(F.array_join(turns, ""))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (identifiers) and words (of each turn) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id.alias("id"), F.regexp_count(text, F.lit(NON_WHITE)).cast("int").alias("words"))
    # the smallest first: a null turn is smaller than every number
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own"))
    own = stage(own.select("conv_id", F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("own")), "conversations")
    base = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base_id"), F.slice("own", 1, HEADS - 1).alias("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    with_base = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base_id", "left").withColumn("h", h)
    front = F.coalesce(F.slice("base", F.lit(1), F.col("h")), F.array().cast("array<struct<id string, words int>>"))
    return with_base.select("conv_id", F.concat(front, F.slice("own", F.col("h") + 1, F.size("own"))).alias("all")).select("conv_id", F.col("all.id").alias("turns"), F.col("all.words").alias("words"))


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows (sequence, block, ids); the rows come sorted."""
    last, state = None, None
    for batch in batches:
        names, done = [], []
        for name, ids in zip(batch.column("sequence").to_pylist(), batch.column("ids").to_pylist()):
            part = ",".join(map(str, ids)).encode()
            if name == last:
                state.update(b"," + part)
                continue
            if state is not None:
                names.append(last)
                done.append(state.hexdigest())
            last, state = name, hashlib.sha256(part)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], ["sequence", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["sequence", "ends"])


def member_digests(members: DataFrame) -> DataFrame:
    """sequence, ends: digest of the ascending conv_ids of each sequence.

    A block of consecutive ids is put together before any sequence is, so that the task of a
    frequent sequence gets a row for each block; the rows pass through one after the other.
    """
    blocks = members.groupBy("sequence", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return blocks.repartition("sequence").sortWithinPartitions("sequence", "block").mapInArrow(list_digests, "sequence string, ends string")


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: turns, words, least conv_id, n members and their digest."""
    table = stage(rebuilt(conversations).withColumn("sequence", sequence_id(F.col("turns"))), "rebuilt")
    distinct = table.groupBy("sequence", "turns", "words").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return distinct.join(member_digests(table.select("sequence", "conv_id")), "sequence").drop("sequence")


def shared_turns(first: Column, last: Column) -> Column:
    """How many turns the smallest and the greatest sequence, and so all between, start with."""
    place = F.transform(F.sequence(F.lit(1), F.least(F.size(first), F.size(last))), lambda k: F.when(F.get(first, k - 1) != F.get(last, k - 1), k - 1))
    shorter = F.least(F.size(first), F.size(last))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(place), shorter))


def burst(table: DataFrame, container: int) -> tuple[DataFrame, list[DataFrame]]:
    """The sequences with their containers, and the burst heads of each round, upper ones first.

    A container is named by its head, the sequence id of the turns above its suffixes; ``at`` is
    their number and ``above`` the burst head it came from. Sequences that end where their head
    bursts have a container of their own. A burst head has the turns ``at`` to ``shared``.
    """
    open_rows = stage(table.withColumns({"at": F.lit(0), "head": sequence_id(F.array().cast("array<string>")), "above": F.lit(None).cast("string")}), "trie-rows")
    settled: DataFrame | None = None
    rounds: list[DataFrame] = []
    while True:
        held = open_rows.groupBy("head", "at", "above").agg(
            F.sum(F.size("turns") - F.col("at")).alias("turns_held"), F.min(F.struct("turns", "words")).alias("first"), F.max("turns").alias("last"))
        large = held.where((F.col("turns_held") > container) & (F.col("first.turns") != F.col("last")))
        large = stage(large.select("head", "at", "above", "first.words", shared_turns(F.col("first.turns"), F.col("last")).alias("shared")), "trie-heads")
        if large.isEmpty():
            return (open_rows if settled is None else settled.union(open_rows)), rounds
        rounds.append(large)
        marked = stage(open_rows.join(large.select("head", "shared"), "head", "left"), "trie-marked")
        kept = marked.where("shared is null").drop("shared").select(open_rows.columns)
        settled = kept if settled is None else settled.union(kept)
        down = F.least(F.size("turns"), F.col("shared") + 1)
        ends_here = F.size("turns") == F.col("shared")
        moved = marked.where("shared is not null").withColumns({"above": F.col("head"), "at": down})
        moved = moved.withColumn("head", F.concat(sequence_id(F.slice("turns", F.lit(1), F.col("at"))), F.when(ends_here, F.lit("$")).otherwise(F.lit("")))).drop("shared")
        open_rows = moved.select(open_rows.columns)


class Node:
    __slots__ = ("below", "depth", "ends", "leaves", "least", "n", "saved", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.ends = depth, words, NO_MEMBERS
        self.n = self.leaves = self.saved = 0
        self.least: int | None = None
        self.below: list[Node] = []


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a task, whose rows come sorted by head and turns."""
    names = [c.split()[0] for c in NODE.split(", ")]
    out: list[tuple] = []
    open_nodes: list[Node] = []
    head, above, before = None, None, []

    def close(downto: int) -> None:
        """Close nodes until ``downto`` are open; a closed node writes what hangs below it."""
        while len(open_nodes) > downto:
            node = open_nodes.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            for x in node.below:
                out.append((x.least, x.depth, node.least, x.n, len(x.below), x.leaves, x.saved, x.ends, None, None))
                x.below = []
            if open_nodes:
                top = open_nodes[-1]
                top.n, top.least = top.n + node.n, node.least if top.least is None else min(top.least, node.least)
                top.leaves, top.saved = top.leaves + node.leaves, top.saved + node.saved
                top.below.append(node)
            else:
                out.append((node.least, node.depth, None, node.n, len(node.below), node.leaves, node.saved, node.ends, head, above))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.string()] * 3]
        columns = list(zip(*out)) if out else [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        for row_head, row_above, at, turns, words, least, n, ends in zip(*[batch.column(c).to_pylist() for c in ("head", "above", "at", "turns", "words", "least", "n", "ends")]):
            if row_head != head:
                close(0)
                head, above, shared = row_head, row_above, at
                open_nodes.append(Node(at, words[at - 1] if at else 0))
            else:
                shared = at
                while shared < len(before) and shared < len(turns) and before[shared] == turns[shared]:
                    shared += 1
                close(shared - at + 1)
            before = turns
            open_nodes += [Node(d, words[d - 1]) for d in range(shared + 1, len(turns) + 1)]
            last = open_nodes[-1]
            last.n, last.ends = last.n + n, ends
            last.least = least if last.least is None else min(last.least, least)
        if len(out) >= 10_000:
            yield batch_of()
    close(0)
    yield batch_of()


def upper_nodes(tops: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Nodes of the burst heads, from the top nodes of the containers under them."""
    found: list[DataFrame] = []
    ends_here = F.col("head").endswith("$")
    for heads in reversed(rounds):
        # a sequence that ends where its head bursts is no child, it belongs to the head's own node
        sums = tops.groupBy(F.col("above").alias("head")).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count(F.when(~ends_here, True)).alias("n_children"),
            F.sum(F.when(ends_here, 0).otherwise(F.col("n_leaves"))).alias("n_leaves"), F.sum(F.when(ends_here, 0).otherwise(F.col("saved_tokens"))).alias("saved_tokens"),
            F.max(F.when(ends_here, F.col("ends_sha256"))).alias("ends_sha256"))
        # one node for each turn that all sequences of the head share; the lowest has the children
        rows = heads.join(sums, "head").withColumn("depth", F.explode(F.sequence("at", "shared")))
        lowest, highest, least_place = F.col("depth") == F.col("shared"), F.col("depth") == F.col("at"), F.greatest("depth", F.lit(1))
        words = F.aggregate(F.slice("words", least_place, F.col("shared") - least_place + 1), F.lit(0).cast("long"), lambda a, w: a + w)
        nodes = rows.select(
            "conv_id", "depth", F.when(~highest, F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(lowest, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
            F.when(lowest, F.coalesce("ends_sha256", F.lit(NO_MEMBERS))).otherwise(NO_MEMBERS).alias("ends_sha256"),
            F.when(highest, F.col("head")).alias("head"), F.when(highest, F.col("above")).alias("above"), F.when(lowest, F.col("head")).alias("bottom_of"))
        found.append(stage(nodes, "trie-upper"))
        tops = found[-1].where("head is not null").select(tops.columns).union(tops)
    return reduce(DataFrame.union, found)


def prefix_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, rounds = burst(sequences(conversations), container)
    nodes = rows.repartition("head").sortWithinPartitions("head", "turns").mapInArrow(swept, NODE)
    if rounds:
        lower = stage(nodes, "trie-lower")
        upper = upper_nodes(lower.where("head is not null"), rounds)
        parents = upper.where("bottom_of is not null").select(F.col("bottom_of").alias("above"), F.col("conv_id").alias("upper_id"))
        placed = lower.where("head is null or not endswith(head, '$')").union(upper.select(lower.columns))
        nodes = placed.join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("upper_id", "parent_conv_id"))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
