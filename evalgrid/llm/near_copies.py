"""Near copies by SimHash over five-word shingles, verified: Jaccard of 0.8 or more.

Every pair of texts at that similarity ends up in one class, in four steps:

* **What can be similar.** Texts equal but for A-Z and white space are one node.
  A node shares SIMILAR of its shingles with any similar one, so a node too many
  of whose shingles are in no other text is left out (an exact bound).
* **SimHash.** A fingerprint has ``3 * BANDS`` positional bytes of majority bits.
  A node is posted under each ``BANDS`` choices of three positional bytes and
  compared with one node, the hub, of each list. A pair at similarity 0.8 shares
  one choice with probability 0.0195 and meets under none with probability 0.006.
  A count filter drops pairs with fewer than ``SHARED_BYTES`` equal bytes of the
  first ``TALLY``, or more than ``BITS`` differing bits: at 0.8 some 69 bytes are
  equal and at most 316 bits differ, give or take 16. This settles most classes,
  in proportion to the postings; it decides nothing that it does not link.
* **Prefixes.** The exact way for the rest. A node's shingles are put in order of
  how many texts have them, and it is posted under the rarest fifth and one.
  Similar nodes share one of those at least (the prefix filter of set similarity
  joins). Nodes outside the largest class of a list are compared with its hub as
  long as that finds a link.
* **What is left.** Then all pairs of a list that are in different classes and
  can be similar, by their sizes and by the shingles that follow in the order,
  are compared. No list has a limit and no pair is left out.

Every link is verified on the texts. Copies of one text are in one class after
the first steps and cost the last nothing. A list of many texts that are close
to similar, but not similar, has the pairs that the bounds leave compared: that
is quadratic by nature. It is a join, which spills and can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import blank, fresh, passing, stored
from evalgrid.llm.simhash import components, shared_bytes

#: Words of a shingle.
WIDTH = 5
#: Jaccard similarity from which texts link.
SIMILAR = 0.8
#: Postings of a text, each under three positional bytes.
BANDS = 256
#: Positional bytes that the count filter tallies (whole words of eight), how many
#: of them similar texts share at least, and how many of their bits differ at most.
TALLY, SHARED_BYTES, BITS = 256, 16, 390
#: Texts of fewer shingles, and how many of their tallied bits differ at most.
FEW, FEW_BITS = 50, 480
#: A text is left out at first if these of every sixteen shingles tell that too many are its own.
PART = 6
#: Bands that are taken together; a large group of copies is settled by the first.
ROUNDS = ((0, 8), (8, BANDS))
_SEEDS = np.random.default_rng(42).integers(1, 2**63, (2, BANDS * 3 // 8), dtype=np.uint64) | np.uint64(1)
_POWERS = np.random.default_rng(43).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
#: Shingles whose votes are added up as single bytes.
_BLOCK = 255


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[bytes]:
    """The five-word shingles; fewer words are one shingle."""
    words = _words(text)
    return {b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _POWERS[0]
    return (h ^ (h >> np.uint64(29))) * _POWERS[1]


def _hashed(words: list[bytes]) -> np.ndarray:
    """The different shingles as numbers."""
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - WIDTH + 1)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(min(WIDTH, len(words))):
        sums += hashed[k : k + n] * _POWERS[k]
    return np.unique(_mixed(sums))


def fingerprint(hashed: np.ndarray) -> np.ndarray:
    """The positional bytes: a bit is 1 if set in over half of the shingles' digests."""
    votes = np.zeros(BANDS * 24, dtype=np.int64)
    for at in range(0, len(hashed), _BLOCK):
        digests = _mixed(_SEEDS[0] * hashed[at : at + _BLOCK, None] + _SEEDS[1]).astype("<u8", copy=False)
        votes += np.unpackbits(digests.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashed), bitorder="little")


def sketch(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many different shingles, the keys (band and three bytes) and the tallied bytes as signed numbers."""
    every = _hashed(words)
    found = fingerprint(every)
    keys = np.empty((BANDS, 4), dtype=np.uint8)
    keys[:, :3], keys[:, 3] = found.reshape(BANDS, 3), np.arange(BANDS)
    return len(every), keys.view("<i4").ravel(), found[:TALLY].view("<i8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sketch(_words(t)) for t in batch.column("text").to_pylist()]
        columns = [batch.column("node"), pa.array([n for n, _, _ in found], pa.int32())]
        columns += [pa.array([k for _, k, _ in found], pa.list_(pa.int32())), pa.array([p for _, _, p in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "size", "keys", "print"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_hashed(_words(t)).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_hashed(_words(t)) for t in batch.column("text").to_pylist()]
        sizes, parts = pa.array([len(f) for f in found], pa.int32()), [f[f % 16 < PART].view(np.int64) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("row"), sizes, pa.array(parts, pa.list_(pa.int64()))], ["row", "size", "shingles"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [xxhash.xxh3_128_digest(b" ".join(_words(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(found, pa.binary())], ["row", "id", "digest"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, set[bytes]] = {}  # of texts that meet many others; emptied when it has many
    for batch in batches:
        flags = []
        for texts in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            if len(held) > 64:
                held.clear()
            a, b = (held[t] if t in held else held.setdefault(t, shingles(t)) for t in texts)
            flags.append(similarity(a, b) >= SIMILAR)
        yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))


def _fits(a: str, b: str) -> Column:
    """Whether nodes ``a`` and ``b`` can be similar, with room for equal hashes.

    They have no more in common than the smaller holds. Where it is known, each
    shares at most its ``rest``.
    """
    counted = F.col(f"{a}.rest").isNotNull() & F.col(f"{b}.rest").isNotNull()
    common = F.when(counted, F.least(f"{a}.rest", f"{b}.rest")).otherwise(F.least(f"{a}.size", f"{b}.size")) + 1
    return common * (1 + SIMILAR) >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * F.lit(SIMILAR)


def _tallied(a: Column, b: Column, most: Column | int) -> Column:
    """The count filter on the tallied bytes, eight in each number."""
    differing = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    bits = F.aggregate(differing, F.lit(0), lambda n, d: n + F.bit_count(d))
    equal = F.aggregate(differing, F.lit(0), lambda n, d: n + shared_bytes(d, F.lit(0).cast("long")))
    return (bits <= most) & (equal >= SHARED_BYTES)


def filtered(pairs: DataFrame, prints: DataFrame, most: Column | int = BITS) -> DataFrame:
    """The (a, b) of ``pairs`` that pass the count filter, with at most ``most`` differing bits."""
    first = prints.select(F.col("node").alias("a"), F.col("print").alias("print_a"))
    second = prints.select(F.col("node").alias("b"), F.col("print").alias("print_b"))
    return pairs.join(first, "a").join(second, "b").where(_tallied(F.col("print_a"), F.col("print_b"), most)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``texts`` (node, text) are similar."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint"), "links")


def _unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings of lists that hold several classes, with their class and the largest one."""
    labelled = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("of"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("of", "root")).alias("m"), F.count("*").alias("classes")).where("classes > 1")
    return stored(labelled.join(mixed.select("key", F.col("m.root").alias("main")), "key"), "unsettled")


_NODE = ("node", "size", "rest", "root")


def _stars(lists: DataFrame) -> DataFrame:
    """Each node outside the largest class of its list, with the node of that class that shares most."""
    hubs = lists.where("root = main").groupBy("key").agg(F.max(F.struct("rest", "size", "node", "root")).alias("b"))
    return lists.where("root <> main").join(hubs, "key").select(F.struct(*_NODE).alias("a"), F.struct(*[f"b.{c}" for c in _NODE]).alias("b"))


def _across(lists: DataFrame) -> DataFrame:
    """All pairs of nodes of a list that are in different classes and can be similar."""
    first = lists.where("root <> main").select("key", "main", F.struct(*_NODE).alias("a"))
    second = lists.select("key", F.struct(*_NODE).alias("b"))
    once = (F.col("b.root") == F.col("main")) | (F.col("a.node") > F.col("b.node"))
    return first.join(second, "key").where(once & _differ()).select("a", "b")


def _differ() -> Column:
    return (F.col("a.root") != F.col("b.root")) & _fits("a", "b")


def _able(size: Column | str, rest: Column | str) -> Column:
    """Whether a text of ``size`` shingles, ``rest`` of them in other texts, can be similar to one."""
    return F.col(rest) + 1 >= F.col(size) * SIMILAR


def _lone(rows: DataFrame) -> DataFrame:
    """The ``row`` of ``rows`` (row, text) that can be similar to no other row.

    A part of the shingles, the same in all texts, is counted: texts are left out
    only if those that no other row has are too many already.
    """
    parts = rows.mapInArrow(_parts, "row bigint, size int, shingles array<bigint>")
    single = parts.select("row", "size", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("size").alias("size"))
    alone = single.where("n = 1").groupBy("row", "size").agg(F.count("*").alias("alone"))
    return alone.withColumn("rest", F.col("size") - F.col("alone")).where(~_able("size", "rest")).select("row")


def _rests(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, rest) of each node of ``crowd`` (node, size), whose ``texts`` these are.

    ``rest`` is how many of its shingles are in another text of the crowd, so
    how many it can share with one; two aggregations count it.
    """
    spread = texts.mapInArrow(_spread, "node bigint, shingles array<bigint>")
    single = spread.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = single.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return crowd.join(alone, "node", "left").select("node", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("rest"))


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, size, rest): postings of ``texts`` (node, text) under their rarest shingles.

    Two similar texts share the fraction SIMILAR of either's shingles. So the
    first of them, in an order by how many texts have them, comes before that
    many are left. One more is posted, as room for equal hashes. Shingles of no
    other text come first and need no posting. ``rest`` counts the shared ones
    from the posted one on: no more can be common to two nodes that meet first there.
    """
    spread = stored(texts.mapInArrow(_spread, "node bigint, shingles array<bigint>"), "spread")
    each = spread.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ordered = each.join(counts, "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l"))
    posted = F.greatest(F.size("l") - F.ceil(F.col("size") * SIMILAR - 1e-6) + 2, F.lit(0)).cast("int")
    listed = ordered.select("node", "size", F.size("l").alias("shared"), F.posexplode(F.slice("l", F.lit(1), posted)).alias("at", "p"))
    return listed.select("p.key", "node", "size", (F.col("shared") - F.col("at")).alias("rest"))


def links(texts: DataFrame) -> DataFrame:
    """(a, b), a > b: similar pairs of ``texts`` (node, text), enough to join the classes."""
    sketches = stored(texts.mapInArrow(_sketches, "node bigint, size int, keys array<int>, print array<bigint>"), "sketches")
    sizes = sketches.select("node", "size")
    crowd = stored(sizes.join(_rests(sizes, texts), "node").where(_able("size", "rest")).select("node"), "crowd")
    meeting = stored(texts.join(crowd, "node", "left_semi"), "meeting")
    sketches = sketches.join(crowd, "node", "left_semi")
    prints = stored(sketches.drop("keys"), "prints")
    rarest = stored(prefixes(meeting), "rarest")
    none = crowd.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    found, tested, roots = none, none, none.toDF("node", "root")

    def compared(pairs: DataFrame, tally: bool = False) -> bool:
        """Verify new pairs across classes; merge the classes they link."""
        nonlocal found, tested, roots
        most = F.when(F.least("a.size", "b.size") < FEW, FEW_BITS).otherwise(BITS).alias("most")
        pairs = pairs.where(_differ()).select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b"), most).distinct()
        new = pairs.join(tested, ["a", "b"], "left_anti")
        new = stored(filtered(new, prints, F.col("most")) if tally else new.select("a", "b"), "pairs")
        similar = verified(new, meeting)
        tested = stored(tested.union(new), "tested")
        if similar.isEmpty():
            return False
        found = stored(found.union(similar), "found")
        roots = stored(components(roots.where("node > root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(similar)), "roots")
        return True

    banded = sketches.select("node", "size", F.lit(None).cast("int").alias("rest"), F.explode("keys").alias("key"))
    for start, end in ROUNDS:
        compared(_stars(_unsettled(banded.where(F.shiftrightunsigned("key", 24).between(start, end - 1)), roots)), tally=True)
    while not (lists := _unsettled(rarest, roots)).isEmpty() and compared(_stars(lists)):
        pass
    compared(_across(lists))
    return found


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay when one of each class does: the smallest id.

    Of several rows with that id, or of a class without any id, one row stays.
    Null, empty and blank texts are one class. All columns are kept.
    """
    row = fresh(docs, "row")
    marked = stored(docs.withColumn(row, F.monotonically_increasing_id()), "marked", lasting=True)
    with passing(docs.sparkSession):
        stays = stored(_first_rows(marked, id, text, row), "stays", lasting=True)
    return marked.join(stays, row, "left_semi").select(docs.columns)


def _first_rows(marked: DataFrame, id: str, text: str, row: str) -> DataFrame:
    """The ``row`` of the document that stays, for each class."""
    rows = marked.select(F.col(row).alias("row"), F.col(id).alias("id"), blank(F.col(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    digests = rows.mapInArrow(_digests, f"row bigint, id {kind}, digest binary")
    first = F.min(F.struct(F.isnull("id"), "id", "row")).alias("first")
    nodes = stored(digests.groupBy("digest").agg(F.min("row").alias("node"), first).drop("digest"), "nodes")
    able = stored(nodes.select(F.col("node").alias("row")).join(_lone(rows.select("row", "text")), "row", "left_anti"), "able")
    texts = stored(rows.join(able, "row", "left_semi").select(F.col("row").alias("node"), "text"), "texts")
    roots = components(links(texts))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
