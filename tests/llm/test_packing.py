"""Best fit against a search of all bins, and what every packing must hold."""

import random

from pyspark.sql import functions as F
from small import docs_table, prose

from evalgrid.llm import packing


def plain_best_fit(items, capacity):
    """Bins as lists; each item tries all of them."""
    bins, where = [], []
    for length, source, cluster in items:
        full, rest = divmod(length, capacity)
        pieces = []
        for k in range(full):
            pieces.append((k, capacity, len(bins), 0))
            bins.append([capacity, set(), set()])
        if rest:
            fits = [
                (capacity - used, n) for n, (used, sources, clusters) in enumerate(bins)
                if capacity - used >= rest and source not in sources and cluster not in clusters
            ]
            if fits:
                n = min(fits)[1]
            else:
                n = len(bins)
                bins.append([0, set(), set()])
            pieces.append((full, rest, n, bins[n][0]))
            bins[n][0] += rest
            bins[n][1].update({source} - {None})
            bins[n][2].update({cluster} - {None})
        where.append(pieces)
    return where


def test_best_fit_against_all_bins():
    rng = random.Random(3)
    for _ in range(60):
        items = [(rng.randint(0, 45), rng.choice([None, "a", "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, *range(10, 60)])) for _ in range(120)]
        items.sort(key=lambda x: -(x[0] % 20))
        assert packing.pack(items, 20)[0] == plain_best_fit(items, 20)


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(i % 40, rng.randint(1, 90)), "en", f"s{i % 3 if i % 2 else 0}") for i in range(400)]
    rows += [(7, prose(7)), (7, prose(7)), (None, prose(8), "en", "s1"), (None, None), (500, ""), (501, "word " * 5000), (502, "y" * 50_000)]
    docs = docs_table(spark, rows, extra=True)
    text = F.col("text")
    out = packing.best_fit(docs, packing.word_count(text), packing.text_cluster(text), capacity=100, per_shard=64).collect()
    by_bin, tokens = {}, {}
    for r in out:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            by_bin.setdefault(r["bin_id"], []).append(r)
    want = {}
    for doc_id, t, *_ in rows:
        want[doc_id] = want.get(doc_id, 0) + len((t or "").split())
    assert tokens == want
    texts = {d: t for d, t, *_ in rows if d is not None}
    for members in by_bin.values():
        members.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in members:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at <= 100
        sources = [r["source"] for r in members if r["source"]]
        assert len(sources) == len(set(sources))
        copies = [texts[r["doc_id"]] for r in members if r["doc_id"] in texts]
        assert len(copies) == len(set(copies))


def test_shards_are_packed_as_by_hand(spark):
    rows = [(i, prose(i, 1 + i * 7 % 50), "en", f"s{i % 5}") for i in range(150)]
    text = F.col("text")
    out = packing.best_fit(docs_table(spark, rows), packing.word_count(text), F.lit(None), capacity=64, per_shard=1000).collect()
    items = sorted(((1 + i * 7 % 50, i, f"s{i % 5}") for i in range(150)), key=lambda x: (-(x[0] % 64), x[1]))
    placed = plain_best_fit([(n, s, None) for n, _, s in items], 64)
    want = {(i, *p) for (_, i, _), pieces in zip(items, placed) for p in pieces}
    assert {(r["doc_id"], r["piece"], r["n_tokens"], int(r["bin_id"].split(":")[1]), r["bin_offset"]) for r in out} == want


def test_windows_bound_a_task(spark):
    rows = [(None, "a b c", "en", f"s{i}") for i in range(300)]  # one key for all rows
    text = F.col("text")
    out = packing.best_fit(docs_table(spark, rows), packing.word_count(text), F.lit(None), capacity=10, per_shard=16).collect()
    assert len(out) == 300 and len({(r["bin_id"], r["bin_offset"]) for r in out}) == 300


def test_no_rows(spark):
    text = F.col("text")
    docs = docs_table(spark, [(1, "x")]).where("false")
    assert packing.best_fit(docs, packing.word_count(text), packing.text_cluster(text)).count() == 0
