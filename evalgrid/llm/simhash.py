"""Near duplicates by SimHash fingerprints.

Fingerprints of 64 bits link when at most two bits differ. Two differing bits
touch at most two of the eight bytes, so linked fingerprints share at least
six positional bytes. That bound is used twice:

* **Index.** The eight positions form four pairs; two pairs at least are
  untouched. A fingerprint is posted under each of the six choices of two
  pairs, so a posting list is keyed by four positional bytes and stays short
  at any size of the corpus (one byte alone would list 1/256 of it).
* **Count filter.** For each pair met in a posting list the shared positional
  bytes are tallied, pairs with fewer than six are dropped, the rest verified
  by the number of differing bits.

A posting list longer than ``LIST`` would emit the square of its length.
Its fingerprints are linked exactly by another way, whose work is in
proportion to them: fingerprints two bits apart have a common neighbour one
bit from each, so each is posted under its 65 neighbours, and all that meet
under one neighbour link to the least of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from evalgrid.llm.common import blank, fresh, stored

#: Longest posting list whose pairs are tallied one by one.
LIST = 16
#: Differing bits at which fingerprints still link.
BITS = 2
#: Linked fingerprints share this many of the eight positional bytes at least.
SHARED_BYTES = 8 - BITS
_SEED = 42
_BLOCK = 65_536


def fingerprint(text: str | None) -> int:
    """Majority bits over the XXH64 of every three-word shingle; signed.

    A-Z are lower-cased. Fewer than three words are one shingle; no words, the
    empty text and null give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digests = np.fromiter((xxhash.xxh64_intdigest(s, _SEED) for s in shingles), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), _BLOCK):
        part = digests[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(digests), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Column of fingerprints of a text column."""
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _pair_of_bytes(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * at).bitwiseAND(F.lit(0xFFFF))


def postings(prints: DataFrame) -> DataFrame:
    """(slot, key, fp): six postings of four positional bytes each."""
    keys = []
    for slot, (i, j) in enumerate(combinations(range(4), 2)):
        key = F.shiftleft(_pair_of_bytes(F.col("fp"), i), 16).bitwiseOR(_pair_of_bytes(F.col("fp"), j))
        keys.append(F.struct(F.lit(slot).alias("slot"), key.alias("key")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.slot", "p.key", "fp")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are equal."""
    differing = a.bitwiseXOR(b)
    tally = F.lit(0)
    for at in range(8):
        byte = F.shiftrightunsigned(differing, 8 * at).bitwiseAND(F.lit(0xFF))
        tally = tally + F.when(byte == 0, 1).otherwise(0)
    return tally


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a > b: enough links between distinct ``fp`` to join every class.

    Every linked pair of a short posting list is there; in a long one each
    fingerprint links to the least under each common neighbour. Both are one
    bit from that neighbour at most, so all returned pairs are links.
    """
    posted = postings(prints)
    sizes = posted.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(posted.join(sizes, ["slot", "key"]), "postings")

    lists = met.where(F.col("n") <= LIST).groupBy("slot", "key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    pairs = lists.select(
        F.explode(
            F.flatten(
                F.transform(
                    "l",
                    lambda b, i: F.transform(
                        F.slice("l", i + 2, F.lit(LIST)), lambda a: F.struct(a.alias("a"), b.alias("b"))
                    ),
                )
            )
        ).alias("p")
    ).select("p.a", "p.b")
    tallied = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= SHARED_BYTES)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)

    crowded = met.where(F.col("n") > LIST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("neighbour"))
    hubs = near.groupBy("neighbour").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = near.join(hubs, "neighbour").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return verified.union(starred).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b), a > b.

    Large star and small star by turns, until the table of edges stays the
    same. Each round is an aggregate and a join with its unique result, so a
    node with very many edges is combined on the map side and AQE can split
    it in the join. A round's edges are written to the shared folder. The
    number of rounds grows with the logarithm of the longest chain.
    """
    edges, seen = stored(edges, "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def classes(prints: DataFrame, id: str = "doc_id") -> DataFrame:
    """(fp, component_id, root) of each distinct fingerprint of (``id``, fp).

    ``component_id`` is the smallest id of the class, null if none of its rows
    has one; ``root`` is the least fingerprint of the class and always there.
    """
    known = stored(prints.groupBy("fp").agg(F.min(id).alias("first")), "prints")
    found = components(links(known.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = known.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(firsts, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, fingerprint, component_id): each row and its class.

    One row out for each row in, repeated rows and null ids included. Null and
    empty texts have fingerprint zero and link like any other. Other columns
    are not read.
    """
    prints = stored(docs.select(F.col(id).alias("doc_id"), fingerprints(blank(F.col(text))).alias("fp")), "fingerprints")
    joined = prints.join(classes(prints).drop("root"), "fp")
    return joined.select(
        F.col("doc_id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay when one of each class does: the smallest id.

    Of several rows with that id, or of a class without any id, one row stays.
    All columns are kept. The rows are written once with their fingerprint and
    a row number, so that the choice and the filter see the same rows.
    """
    mark, row = fresh(docs, "fingerprint"), fresh(docs, "row")
    marked = stored(
        docs.withColumns({mark: fingerprints(blank(F.col(text))), row: F.monotonically_increasing_id()}), "marked"
    )
    prints = marked.select(F.col(id).alias("doc_id"), F.col(mark).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("first")
    stays = prints.join(classes(prints), "fp").groupBy("root").agg(first).select(F.col("first.row").alias(row))
    return marked.join(stays, row, "left_semi").select(docs.columns)
