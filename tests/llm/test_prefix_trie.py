import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    ordered = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in convs.items()}
    built = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(ordered.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(o) == len(s) + 1 and o[: len(s)] == s for o in below)]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].split()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == seq)
        parent = min(nodes[seq[:-1]]) if seq else None
        out.add((min(members), len(seq), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, df):
    nodes = prefix_trie.prefix_trie(df)
    return {tuple(r) for r in nodes.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def random_rows(seed, convs=70, turns=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-5, convs):
        if c in (20, 21):
            continue  # a base that is not there
        for t in range(int(rng.integers(1, turns))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"said {int(rng.integers(2))} and more" if rng.random() < 0.8 else None))
    return rows


def test_equals_walking_every_prefix(spark):
    rows = random_rows(1)
    rows += [(500 + k, t, "user", f"copy {t}") for k in range(0, 60) for t in range(5)]  # a third are copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(spark, df) == brute(rows)


def test_odd_rows_and_extra_columns(spark):
    rows = [
        (0, None, "user", "before all"), (0, 0, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (None, 0, "user", "nobody's"),
        (3, 0, "a:1", "b"), (3, 1, "a", ":1b"), (7, 5, "user", "x " * 4000), (-19, 0, "user", "y"), (5, 0, None, ""), (41, 0, "u", "z"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "pos", "depth", "row", "number", "arc", "s1", "x1"):
        df = df.withColumn(name, F.lit(name))
    assert found(spark, df) == brute(rows)


def test_empty_table_has_no_nodes(spark):
    assert found(spark, spark.createDataFrame([], SCHEMA)) == set()


def test_turnless_conversations_end_in_the_root(spark):
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in alone]
    ends = hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    assert found(spark, spark.createDataFrame(rows, SCHEMA)) == {(alone[0], 0, None, 3, 0, 1, 0, ends)} == brute(rows)


@pytest.mark.parametrize("block", [8, 1 << 18])
def test_list_ranks_of_scattered_and_of_local_lists(spark, block):
    for order in (np.random.default_rng(3).permutation(90), np.arange(90)[::-1]):
        arcs = [(int(a), int(b)) for a, b in zip(order, [*order[1:], -1])]
        ranks = prefix_trie.list_ranks(spark.createDataFrame(arcs, "arc bigint, after bigint"), block)
        assert {r["arc"]: r["position"] for r in ranks.collect()} == {int(a): i for i, a in enumerate(order)}


def test_keys_that_collide_stop_the_query(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_numbers", lambda digest, name: [F.lit(1).cast("bigint").alias(f"{name}{i}") if name == "x" else F.conv(F.substring(digest, i, 15), 16, 10).cast("bigint").alias(f"{name}{i}") for i in (1, 2)])
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b"), (1, 1, "user", "c"), (2, 1, "user", "d"), (1, 2, "u", "e"), (2, 2, "u", "f"), (1, 3, "u", "e"), (2, 3, "u", "f")]
    with pytest.raises(Exception, match="two prefixes share a key"):
        found(spark, spark.createDataFrame(rows, SCHEMA))
