"""The trie of conversation prefixes, measured by an Euler tour.

Conversations that begin with the same turns share nodes of a trie. What a
node's whole subtree holds is found without walking the trie level by level:

1. **Nodes.** The first d turns have a key of 120 bits: the exclusive or of
   one digest per place and turn. It is a running value, so the prefixes of a
   conversation of any length are keyed by a distributed scan. Conversations
   that meet in a key are one node; every node checks that its members also
   agree on the parent's key and on the last turn, which by induction makes
   them equal, so a collision fails the query and never merges two nodes.
2. **Tour.** Each node has an enter arc and an exit arc. Children are ordered
   by their smallest member. Enter goes to the first child or to the own exit,
   exit to the next sibling or to the parent's exit.
3. **List ranking.** Arcs are numbered so that neighbours on the tour tend to
   have near numbers. Ranges of arcs are contracted in their tasks to maximal
   chains, the chains again, as long as that at least halves the list; pointer
   jumping ranks what is left, in a number of joins that grows with the
   logarithm of its length. Chains then hand their position down.
4. **Sums.** Leaves and savings are summed along the tour positions by the
   same scan; a subtree is what lies between its enter and its exit arc.

No step gathers a node's members, a conversation or the tour in one task. The
digest of the ids that end in a node needs them in order: ranges write them
out in parallel, joined in stretches, and one stream per node hashes those.

Defined cases: rows without a conversation id belong to none and are left out;
null turns sort first, turns that tie by their digest; repeated rows are turns
of their own; other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import blank, stored, words
from evalgrid.operators.scan import numbered, running

#: Arcs that a task contracts at a time.
BLOCK = 1 << 18
#: Ids that are joined before they are hashed.
STRETCH = 4096


def _numbers(digest: Column, name: str) -> list[Column]:
    """Two numbers of 60 bits from a digest in hexadecimal digits."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(f"{name}{i}") for i, at in ((1, 1), (2, 16))]


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, s1, s2, words): the turns in order from 0, as digests."""
    role, text = blank(F.col(role)), blank(F.col(text))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = df.where(F.isnotnull(conv)).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.size(words(text)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"),
        *_numbers(said, "s"),
    )
    ordered = numbered(turns, [F.col("turn").asc_nulls_first(), F.col("s1"), F.col("s2"), F.col("row")], "pos", ("conv",))
    return ordered.select("conv", (F.col("pos") - 1).alias("pos"), "s1", "s2", "words")


def rebuilt(turns: DataFrame, shared: int = 4, group: int = 20) -> DataFrame:
    """(conv, length, at, s1, s2, words): each conversation with a borrowed opening.

    The first ``h`` turns of conversation ``c - c % group``, then the own turns
    after the first ``h``, where ``h = crc32(c) % shared``. A conversation
    without any turn has one row, whose ``at`` is null.
    """
    turns = stored(turns, "turns")
    base = F.col("conv") - F.col("conv") % group
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"base": base, "head": head})
    opening = turns.where((F.col("conv") % group == 0) & (F.col("pos") < shared - 1))
    opening = opening.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "s1", "s2", "words"))).alias("opening"))
    convs = convs.join(opening, "base", "left").withColumn("opening", F.slice(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), 1, F.col("head").cast("int")))
    convs = convs.withColumn("taken", F.size("opening").cast("bigint"))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    convs = stored(convs.select("conv", "head", "taken", "length", "opening"), "conversations")
    borrowed = convs.select("conv", "length", F.explode_outer("opening").alias("o")).where(F.isnotnull("o") | (F.col("length") == 0))
    borrowed = borrowed.select("conv", "length", (F.col("o.pos") + 1).alias("at"), "o.s1", "o.s2", "o.words")
    own = turns.join(convs.select("conv", "head", "taken", "length"), "conv").where("pos >= head")
    return borrowed.union(own.select("conv", "length", F.expr("taken + pos - head + 1").alias("at"), "s1", "s2", "words"))


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of (conv, length, at, s1, s2, words): depth, keys, members, last turn."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("at", "s1", "s2")]).cast("binary"))
    placed = sequences.where(F.isnotnull("at")).select("*", *_numbers(digest, "x"))
    keyed = running(placed, [F.col("at")], {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2"))}, ("conv",))
    keyed = stored(keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))}), "prefixes")
    agreed = ("p1", "p2", "s1", "s2")
    nodes = keyed.groupBy(F.col("at").alias("depth"), "k1", "k2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.min(c).alias(c) for c in agreed], *[F.max(c).alias(f"max_{c}") for c in agreed],
    )
    same = F.lit(True)
    for c in agreed:
        same &= F.col(c) == F.col(f"max_{c}")
    held = nodes.withColumn("k1", F.when(same, F.col("k1")).otherwise(F.raise_error(F.lit("two prefixes share a key"))))
    root = sequences.agg(F.min("conv").alias("conv"), F.count_if((F.col("at") == 1) | F.isnull("at")).alias("n_convs")).where(F.isnotnull("conv"))
    none = F.lit(None).cast("bigint")
    root = root.select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv", "n_convs", F.lit(0).cast("bigint").alias("words"), none.alias("p1"), none.alias("p2"))
    nodes = held.select(root.columns).union(root)
    ends = keyed.where(F.col("at") == F.col("length")).select(F.col("at").alias("depth"), "k1", "k2", F.col("conv").alias("member"))
    ends = ends.union(sequences.where(F.isnull("at")).select(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "conv"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    linked = nodes.join(up, ["depth", "p1", "p2"], "left")
    return linked.join(ends_digest(ends), ["depth", "k1", "k2"], "left").select(
        "conv", "depth", "parent", "n_convs", "words", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, member) rows as stretches of joined ids."""
    for batch in batches:
        keys, members = batch.select(["depth", "k1", "k2"]).to_pylist(), batch.column("member").to_pylist()
        out, start = [], 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == STRETCH:
                out.append({**keys[start], "first": members[start], "ids": ",".join(map(str, members[start:i]))})
                start = i
        yield pa.RecordBatch.from_pylist(out, pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's stretches, which arrive in order."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    node = digest = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = (row["depth"], row["k1"], row["k2"])
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(row["ids"].encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], schema=schema)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the ascending members of each node."""
    node = ["depth", "k1", "k2"]
    ranged = ends.repartitionByRange(*node, "member").sortWithinPartitions(*node, "member")
    stretches = ranged.mapInArrow(_joined, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return stretches.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains inside one range of arcs: for each arc its chain's head and how far off that is.

    A head's row also carries the chain's length and what follows the chain.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("arc")
    arc, after, size = (table.column(c).to_numpy() for c in ("arc", "after", "size"))
    n = len(arc)
    at = np.minimum(np.searchsorted(arc, after), n - 1)
    inside = arc[at] == after
    head, off = np.arange(n), np.zeros(n, dtype=np.int64)
    led = np.flatnonzero(inside)  # these lead to another arc of the range
    head[at[led]], off[at[led]] = led, size[led]
    while not np.array_equal(up := head[head], head):
        head, off = up, off + off[head]
    tails = np.flatnonzero(~inside)
    length, follows = np.zeros(n, dtype=np.int64), np.full(n, -2, dtype=np.int64)
    length[head[tails]] = off[tails] + size[tails]
    follows[head[tails]] = after[tails]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (arc, arc[head], off, length, follows)], ["arc", "head", "off", "length", "follows"])


def list_ranks(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(arc, position) from 0 along the list (arc, after); the last has -1 after it.

    Arcs are numbers from 0, ``after`` is unique, and the list has one end.
    """
    left = arcs.select("arc", "after", F.lit(1).cast("bigint").alias("size"))
    levels, count = [], left.count()
    while True:
        ranges = left.repartitionByRange(max(1, -(-count // block)), "arc")
        level = stored(ranges.mapInArrow(_contract, "arc bigint, head bigint, off bigint, length bigint, follows bigint"), "chains")
        levels.append(level.select("arc", "head", "off"))
        left = level.where("arc = head").select("arc", F.col("follows").alias("after"), F.col("length").alias("size"))
        before, count = count, left.count()
        if count <= 1 or 2 * count > before:
            break
    places = _jumped(left, count)
    for level in reversed(levels):
        heads = places.select(F.col("arc").alias("head"), F.col("position").alias("start"))
        places = level.join(heads, "head").select("arc", (F.col("start") + F.col("off")).alias("position"))
    return places


def _jumped(chains: DataFrame, count: int) -> DataFrame:
    """(arc, position) of (arc, after, size) by pointer jumping."""
    total = chains.agg(F.sum("size").alias("total"))
    ahead = chains.select("arc", "after", F.col("size").alias("rest"))  # length up to the end of the list
    for _ in range(max(0, count - 1).bit_length()):
        onward = ahead.select(F.col("arc").alias("after"), F.col("after").alias("further"), F.col("rest").alias("more"))
        met = ahead.join(onward, "after", "left")
        ahead = stored(met.select("arc", F.coalesce("further", F.lit(-1)).alias("after"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")), "jumped")
    whole = total.first()[0] if count else 0
    return ahead.select("arc", (F.lit(whole) - F.col("rest")).alias("position"))


def measure(nodes: DataFrame) -> DataFrame:
    """``nodes`` (conv, depth, parent, n_convs, words) with subtree figures, by an Euler tour."""
    nodes = numbered(stored(nodes, "nodes"), [F.col("parent").asc_nulls_first(), F.col("depth"), F.col("conv")], "number")
    nodes = stored(nodes, "numbered")
    mine = nodes.where(F.isnotnull("parent")).groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
    mine = mine.agg(F.count(F.lit(1)).alias("n_children"), F.min("number").alias("first"), F.max("number").alias("last"))
    grown = stored(nodes.join(mine, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "grown")
    up = grown.where("n_children > 0").select(F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("number").alias("above"), F.col("last").alias("youngest"))
    family = grown.join(up, ["parent", "depth"], "left")

    def enter(number: str) -> Column:
        return 2 * F.col(number)

    down = F.when(F.col("n_children") > 0, enter("first")).otherwise(enter("number") + 1)
    onward = F.when(F.isnull("above"), -1).when(F.col("number") < F.col("youngest"), enter("number") + 2).otherwise(enter("above") + 1)
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaf = (F.col("n_children") == 0).cast("bigint")
    nothing = F.lit(0).cast("bigint")
    arcs = family.select(F.inline(F.array(
        F.struct(enter("number").alias("arc"), down.cast("bigint").alias("after"), leaf.alias("leaf"), saved.alias("saved")),
        F.struct((enter("number") + 1).alias("arc"), onward.cast("bigint").alias("after"), nothing.alias("leaf"), nothing.alias("saved")),
    )))
    arcs = stored(arcs, "arcs")
    tour = arcs.join(list_ranks(arcs), "arc").select("arc", "leaf", "saved", "position")
    sums = running(tour, [F.col("position")], {"leaves": ("sum", F.col("leaf")), "savings": ("sum", F.col("saved"))})
    entering = F.col("arc") % 2 == 0

    def between(total: str, own: str) -> Column:
        return F.sum(F.when(entering, F.col(own) - F.col(total)).otherwise(F.col(total)))

    whole = sums.groupBy(F.shiftright("arc", 1).alias("number")).agg(between("leaves", "leaf").alias("n_leaves"), between("savings", "saved").alias("saved_tokens"))
    return grown.join(whole, "number").select(*[c for c in nodes.columns if c != "number"], "n_children", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt ``conversations``."""
    sequences = stored(rebuilt(turns_of(conversations)), "sequences")
    return measure(trie(sequences))
