"""Prefix trie of conversations, from partial tries that merge.

A node is named by its depth and the exclusive-or of its turns' digests, each tagged
with its place, so a turn's row knows its node, and the node's parent, without the
turns before it being gathered anywhere. Each partition combines its rows to a table
of nodes; these partial tries are merged by key, a few partitions' tables at a time,
until one table of nodes is left. Sums over subtrees then roll up from the bottom.

For that the trie is cut into chains: a node belongs to the chain of its longest
member, so a chain runs from where its conversation leaves a longer one down to its
end. What hangs on a chain is handed up chain by chain, all chains of a round at once,
and a running total from its end gives each node of a chain its subtree. Where one
conversation continues another the two share a chain, so rounds are few.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import slices, written
from sentria.operators.running import running

#: A conversation takes its first turns from the one at the round number below it,
#: and fewer than so many.
EVERY, MOST = 100, 6
#: Partial tries that are merged to one in a round; rows that a task combines at a time.
FAN, HELD = 16, 1 << 18
#: Nodes with more children than this, and than this share of all nodes, meet their
#: children by broadcast: no more than WIDE_SHARE nodes can.
WIDE, WIDE_SHARE = 10_000, 10_000
#: Ids of a piece of an end list.
PIECE = 128
KEY = ["depth", "a", "b"]


def _items(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, a, b, chars): each turn as 120 bits of a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = turns.where(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), half(1).alias("a"), half(16).alias("b"), F.length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = EVERY, most: int = MOST) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, chars, length): a row for each turn of each
    rebuilt conversation, and one of depth 0 for each conversation. (depth, a, b) names
    the node, (depth - 1, up_a, up_b) its parent; ``length``: the conversation's turns."""
    items = _items(turns, id_col, turn_col, role_col, text_col)
    order = [F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()]
    placed = written(running(items, ["conv"], order, {"pos": ("sum", F.lit(1))}).drop("turn"), "turns")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = placed.where((F.col("conv") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv").alias("host")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("head"))
    convs = placed.select("conv").distinct().withColumn("host", F.col("conv") - F.col("conv") % every).join(heads, "host", "left")
    convs = written(convs.select("conv", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), taken.cast("int")).alias("head")), "convs")
    given = convs.select("conv", F.lit(0).alias("own"), F.inline("head"))
    kept = placed.where(F.col("pos") > taken).select("conv", F.lit(1).alias("own"), "pos", "a", "b", "chars")
    turn = running(given.unionByName(kept), ["conv"], [F.col("own").asc(), F.col("pos").asc()], {"depth": ("sum", F.lit(1))}, whole=("depth",))
    tag = [F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a", F.lit(1))]
    tagged = turn.select("conv", "depth", F.col("depth_all").alias("length"), "chars", tag[0].alias("tag_a"), tag[1].alias("tag_b"))
    named = running(tagged, ["conv"], [F.col("depth").asc()], {"a": ("xor", F.col("tag_a")), "b": ("xor", F.col("tag_b"))})
    named = named.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("tag_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("tag_b")).alias("up_b"), "chars", "length")
    named = written(named, "members")
    zero = F.lit(0).cast("long")
    lengths = convs.join(named.where("depth = length").select("conv", "length"), "conv", "left")
    roots = lengths.select("conv", *(zero.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "chars")), F.coalesce("length", zero).alias("length"))
    return named.unionByName(roots)


_NODE = "depth long, a long, b long, up_a long, up_b long, chars long, n long, conv long, rep long, length long"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def _combined(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of one node become one: members summed, the least id, and of the longest
    members the one with the least id."""
    order = np.lexsort((cols["rep"], -cols["length"], cols["b"], cols["a"], cols["depth"]))
    cols = {c: v[order] for c, v in cols.items()}
    if not len(order):
        return cols
    new = np.concatenate([[True], np.any([cols[c][1:] != cols[c][:-1] for c in KEY], axis=0)])
    starts = np.flatnonzero(new)
    out = {c: v[starts] for c, v in cols.items()}
    out["n"] = np.add.reduceat(cols["n"], starts)
    out["conv"] = np.minimum.reduceat(cols["conv"], starts)
    return out


def partial_tries(members: DataFrame) -> DataFrame:
    """The nodes of each partition's rows, combined there, with ``slot``, the partition.
    A task holds ``HELD`` rows at most; what it cannot combine further it passes on."""

    def run(batches):
        slot = TaskContext.get().partitionId()

        def emit(cols):
            arrays = [pa.array(cols[c]) for c in _NAMES] + [pa.array(np.full(len(cols["n"]), slot, np.int64))]
            return pa.record_batch(arrays, names=[*_NAMES, "slot"])

        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for batch in slices(batches, 1 << 14):
            cols = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
            held.append(cols | {"n": np.ones(batch.num_rows, np.int64), "rep": cols["conv"]})
            rows += batch.num_rows
            if rows > HELD:
                held = [_combined({c: np.concatenate([h[c] for h in held]) for c in _NAMES})]
                rows = len(held[0]["n"])
                if 2 * rows > HELD:
                    yield emit(held[0])
                    held, rows = [], 0
        if held:
            yield emit(_combined({c: np.concatenate([h[c] for h in held]) for c in _NAMES}))

    return members.mapInArrow(run, f"{_NODE}, slot long")


def merged(tries: DataFrame, slots: int, fan: int = FAN) -> DataFrame:
    """One table of nodes from the partial tries of ``slots`` partitions."""
    longest = F.max_by("rep", F.struct("length", -F.col("rep")))
    while True:
        tries = tries.withColumn("slot", F.floor(F.col("slot") / fan))
        tries = tries.groupBy(*KEY, "slot").agg(
            *(F.first(c).alias(c) for c in ("up_a", "up_b", "chars")), F.sum("n").alias("n"), F.min("conv").alias("conv"), longest.alias("rep"), F.max("length").alias("length")
        )
        if slots <= fan:
            return tries.drop("slot")
        slots = -(-slots // fan)


def _with_parents(nodes: DataFrame, wide: int, share: int) -> DataFrame:
    """``nodes`` with n_children, and their parent's smallest member and chain."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    known = written(nodes.join(kids, KEY, "left").fillna(0, ["n_children"]), "nodes")
    bound = max(wide, known.count() // share)
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent_conv_id"), F.col("rep").alias("up"), F.col("n_children").alias("siblings"))
    link, found = ["depth", "up_a", "up_b"], ["parent_conv_id", "up"]
    # nodes with more children than the bound are no more than nodes / bound <= share
    below = known.where("depth > 0").join(F.broadcast(parents.where(F.col("siblings") > bound).drop("siblings")), link, "left")
    few = below.where("up is null").drop(*found).join(parents.where(F.col("siblings") <= bound).drop("siblings"), link)
    none = F.lit(None).cast("long")
    top = known.where("depth = 0").withColumns({c: none for c in found})
    return written(below.where("up is not null").unionByName(few).unionByName(top), "linked")


def _hung(nodes: DataFrame) -> DataFrame | None:
    """(rep, depth, leaves, saved): what hangs below each node by way of other chains."""
    tops = written(nodes.where("up is not null and up <> rep").select("rep", "up", (F.col("depth") - 1).alias("at")), "tops")
    own = nodes.groupBy("rep").agg(F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("n") - 1) * F.col("chars")).alias("saved"))
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    hung, handed = None, own
    while True:
        given = tops.join(handed, "rep").groupBy(F.col("up").alias("rep"), F.col("at").alias("depth")).agg(*sums)
        given = written(given, "given")
        if given.isEmpty():
            return hung
        hung = given if hung is None else hung.unionByName(given)
        handed = given.groupBy("rep").agg(*sums)


def end_digests(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end.

    The lists are sorted in range partitions and cut into pieces there, so that a list
    of any length is made by many tasks; a digest reads its pieces in order, holding
    none. (SHA-256 itself cannot be split.)
    """
    ends = members.where("depth = length").select(*KEY, "conv")
    kind = "depth long, a long, b long, conv long"

    def cut(batches):
        for batch in batches:
            depth, a, b, conv = (batch.column(i).to_numpy() for i in range(4))
            new = (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(conv)]]).astype(np.int64)
            at = np.concatenate([np.arange(lo, hi, piece) for lo, hi in zip(starts[:-1], starts[1:])] or [starts[:0]])
            stops = np.minimum(at + piece, starts[np.searchsorted(starts, at, "right")]) if len(at) else at
            ids = list(map(str, conv.tolist()))
            texts = [",".join(ids[lo:hi]) for lo, hi in zip(at.tolist(), stops.tolist())]
            yield pa.record_batch([pa.array(c[at]) for c in (depth, a, b, conv)] + [pa.array(texts, pa.string())], names=[*KEY, "conv", "ids"])

    def read(batches):
        key, state, done = None, None, []

        def out():
            rows = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield out()
        if state:
            done.append((*key, state.hexdigest()))
        yield out()

    pieces = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(cut, f"{kind}, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv").select(*KEY, "ids").mapInArrow(read, "depth long, a long, b long, ends_sha256 string")


def conversation_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = EVERY, most: int = MOST, fan: int = FAN, wide: int = WIDE, wide_share: int = WIDE_SHARE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of every node of the trie of rebuilt conversations.

    A conversation c (a whole number) is rebuilt from the first crc32(c) % ``most``
    turns of c - c % ``every`` and its own turns after as many. Turns are ordered by
    ``turn_col``, null first; turns of one place stand in the order of their digests,
    and rows repeated whole are turns of their own. Null roles and texts are empty.
    Rows without an id are no conversation's. A conversation may be left without turns:
    it ends at the root. An empty table has no conversation, hence no node. Other
    columns are not read. No task holds a conversation, a node's members, its children
    or its ends.
    """
    members = rebuilt(turns, id_col, turn_col, role_col, text_col, every, most)
    tries = written(partial_tries(members), "tries")
    slots = (tries.agg(F.max("slot")).head()[0] or 0) + 1
    nodes = _with_parents(written(merged(tries, slots, fan), "merged"), wide, wide_share)
    hung = _hung(nodes)
    own = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("kept", (F.col("n") - 1) * F.col("chars"))
    if hung is not None:
        own = own.join(hung.groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), ["rep", "depth"], "left").fillna(0, ["leaves", "saved"])
        own = own.withColumn("leaf", F.col("leaf") + F.col("leaves")).withColumn("kept", F.col("kept") + F.col("saved"))
    own = own.select("rep", *KEY, "conv", "parent_conv_id", "n", "n_children", "leaf", "kept")
    rolled = running(own, ["rep"], [F.col("depth").desc()], {"n_leaves": ("sum", F.col("leaf")), "saved_tokens": ("sum", F.col("kept"))})
    found = rolled.join(end_digests(members), KEY, "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
