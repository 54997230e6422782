"""Fingerprints bit by bit, and classes by comparing all pairs."""

import re

import xxhash
from pyspark.sql import functions as F
from small import classes, docs_table, prose

from evalgrid.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD = [None, "", " \n\t ", "One", "one TWO", "a b c", "a b c d É É", "ÀB ÀB ÀB " * 50, "x" * 200_000, "tie tie tie tie"]


def test_fingerprint_bit_by_bit():
    for text in [*ODD, prose(1), prose(2, 2000)]:
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def _check(spark, rows):
    found = simhash.near_duplicates(docs_table(spark, rows, extra=True)).collect()
    prints = {}
    for doc_id, text, *_ in rows:
        prints.setdefault(plain_fingerprint(text), []).append(doc_id)
    roots = classes({p: p for p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for p, ids in prints.items():
        known = [i for i in ids if i is not None]
        if known:
            least[roots[p]] = min(least.get(roots[p], known[0]), *known)
    want = sorted(((i, f"{p:016x}", least.get(roots[p])) for p, ids in prints.items() for i in ids), key=repr)
    assert sorted(((r[0], r[1], r[2]) for r in found), key=repr) == want


def test_classes_by_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(20, prose(5)), (20, prose(5)), (21, prose(5)), (None, prose(6)), (None, prose(7)), (22, prose(7)), (3, prose(8))]
    base = prose(9, 300).split()
    for k in range(40):
        copy = list(base)
        copy[k * 7] = f"changed{k}"
        rows.append((100 + k, " ".join(copy)))
    _check(spark, rows)


def test_crowded_lists_lose_no_link(spark):
    # 64 + 300 fingerprints near one value share positional bytes in every list
    values = [0] + [1 << b for b in range(63)] + [(1 << a) | (1 << b) for a in range(0, 30) for b in range(a + 1, a + 11)]
    values += [(1 << a) | (1 << 40) | (1 << 50) | (1 << 60) for a in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint").distinct()
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    roots = classes({v: v for v in set(values)}, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {v: found.get(v, v) for v in roots} == roots


def test_links_are_links_and_counts_hold(spark):
    values = [7, 7 ^ 3, 7 ^ (3 << 20), 7 ^ (7 << 20), -1, -1 ^ 1, 1 << 62, -(1 << 63)]
    pairs = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()]
    near = {(max(a, b), min(a, b)) for a in values for b in values if a != b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert set(pairs) == near
    a, b = F.lit(0x0102030405060708), F.lit(0x01020304050607FF)
    assert spark.range(1).select(simhash.shared_bytes(a, b).alias("n")).first()["n"] == 7


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1001, 1000)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_one_of_each_class_stays(spark):
    rows = [(5, prose(1), "en", "s"), (3, prose(1), "en", "s"), (3, prose(1), "en", "s"), (9, prose(2)), (None, prose(2)), (None, prose(3)),
            (None, prose(3)), (1, None), (2, ""), (8, prose(4))]
    docs = docs_table(spark, rows, extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(3, prose(1)), (9, prose(2)), (None, prose(3)), (1, None), (8, prose(4))], key=repr
    )


def test_no_rows(spark):
    docs = docs_table(spark, [(1, "x")]).where("false")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
