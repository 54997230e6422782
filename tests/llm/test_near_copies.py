"""Near copies against the five-word similarity of all pairs."""

import re
import uuid

import numpy as np
from small import classes, docs_table, prose

import corpus_pipeline
from evalgrid.llm import common, near_copies


def _plain(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def _edited(text, seed, edits):
    words, rng = text.split(), np.random.default_rng(seed)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


def _check(spark, rows):
    docs = docs_table(spark, rows, extra=True)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, docs, "")
    roots = classes({i: _plain(t) for i, t in rows}, _similar)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    return roots


def test_edited_texts_by_all_pairs(spark):
    rows = [(0, None), (1, " "), (2, "a B c"), (3, "A b  c"), (4, "a b d")]
    for k in range(40):
        base = prose(k, 200, 5000)
        rows += [(10 * k + 10, base), (10 * k + 11, _edited(base, k, 1)), (10 * k + 12, _edited(base, k + 100, 4)), (10 * k + 13, _edited(base, k + 200, 9))]
    roots = _check(spark, rows)
    assert len(set(roots.values())) < 90 and roots[12] == 10


def test_long_lists_lose_no_class(spark):
    base = prose(7, 150, 5000)  # copies of one text, many of them similar only by way of others
    rows = [(k, _edited(base, k, 1 + k % 7)) for k in range(150)]
    line = prose(8, 60, 5000)  # one passage in many texts that are not similar
    rows += [(1000 + k, f"{line} {prose(1000 + k, 30, 5000)}") for k in range(60)]
    roots = _check(spark, rows)
    assert 1 < len({r for k, r in roots.items() if k < 1000}) < 150


def test_number_of_pairs_that_meet():
    rng, met = np.random.default_rng(3), 0
    for k in range(300):
        base = prose(k, 300, 50_000)
        near = _edited(base, k, int(rng.integers(1, 7)))
        if _similar(_plain(base), _plain(near)):
            keys = [near_copies.sketch(near_copies._words(t))[1] for t in (base, near)]
            met += 1
            assert (keys[0] == keys[1]).any()
    assert met > 250


def test_odd_rows_and_an_empty_table(spark):
    base, long = prose(1, 200, 5000), prose(2, 20_000, 50_000)
    rows = [(None, base), (5, base), (5, base), (5, base), (6, _edited(base, 1, 1)), (None, "alone without id"), (7, None), (None, ""), (8, long), (9, _edited(long, 2, 40))]
    kept = near_copies.keep_one(docs_table(spark, rows, extra=True))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(True, 5, base), (False, 0, "alone without id"), (True, 7, None), (True, 8, long)], key=lambda r: r[:2])
    assert near_copies.keep_one(docs_table(spark, rows).where("false")).count() == 0


def test_fingerprints_by_hand():
    words = near_copies._words(prose(4, 300, 5000))
    hashed = near_copies._hashed(words)
    digests = [b"".join(int(d).to_bytes(8, "little") for d in near_copies._mixed(near_copies._SEEDS[0] * h + near_copies._SEEDS[1])) for h in hashed]
    votes = [sum(d[at // 8] >> (at % 8) & 1 for d in digests) for at in range(24 * near_copies.BANDS)]
    found = near_copies.fingerprint(hashed)
    assert [found[at // 8] >> (at % 8) & 1 for at in range(len(votes))] == [int(2 * v > len(hashed)) for v in votes]
    size, keys, first = near_copies.sketch(words)
    assert size == len(hashed) and first.tobytes() == found[: near_copies.TALLY].tobytes()
    assert [int(k).to_bytes(4, "little", signed=True) for k in keys] == [found[3 * b : 3 * b + 3].tobytes() + bytes([b]) for b in range(near_copies.BANDS)]


def test_count_filter_keeps_what_is_similar(spark):
    rng, rows = np.random.default_rng(9), []
    for k in range(120):
        base = prose(k, 300, 50_000)
        for n, text in enumerate((base, _edited(base, k, int(rng.integers(1, 7))))):
            rows.append((2 * k + n, near_copies.sketch(near_copies._words(text))[2].tolist(), _plain(text)))
    prints = spark.createDataFrame([r[:2] for r in rows], "node bigint, print array<bigint>")
    pairs = spark.createDataFrame([(2 * k + 1, 2 * j) for k in range(120) for j in (k, (k + 1) % 120)], "a bigint, b bigint")
    kept = {tuple(r) for r in near_copies.filtered(pairs, prints).collect()}
    similar = {(2 * k + 1, 2 * k) for k in range(120) if _similar(rows[2 * k][2], rows[2 * k + 1][2])}
    assert len(similar) > 90 and similar <= kept <= {(2 * k + 1, 2 * k) for k in range(120)}


def test_count_filter_drops_what_is_far_from_similar(spark):
    rows = []
    for k in range(60):
        base = prose(k, 150, 50_000)
        for n, text in enumerate((_edited(base, k, 4), _edited(base, k + 100, 4))):
            rows.append((2 * k + n, near_copies.sketch(near_copies._words(text))[2].tolist(), _plain(text)))
    prints = spark.createDataFrame([r[:2] for r in rows], "node bigint, print array<bigint>")
    far = [(2 * k + 1, 2 * k) for k in range(60) if len(rows[2 * k][2] & rows[2 * k + 1][2]) < 0.67 * len(rows[2 * k][2] | rows[2 * k + 1][2])]
    assert len(far) > 20
    assert near_copies.filtered(spark.createDataFrame(far, "a bigint, b bigint"), prints).count() < 0.2 * len(far)


def test_pairs_of_a_crowd_share_no_more_than_their_rest(spark):
    crowd = [(k, f"{prose(1, 100, 5000)} {prose(k + 2, 5 * k, 5000)}") for k in range(8)]
    texts = spark.createDataFrame(crowd, "node bigint, text string")
    sizes = spark.createDataFrame([(k, len(_plain(t))) for k, t in crowd], "node bigint, size int")
    rests = dict(map(tuple, near_copies._rests(sizes, texts).collect()))
    assert rests == {k: len(_plain(t) & set().union(*(_plain(o) for j, o in crowd if j != k))) for k, t in crowd}
    nodes = {k: (k, len(_plain(t)), rests[k]) for k, t in crowd}
    node = "struct<node:bigint,size:int,rest:int>"
    pairs = spark.createDataFrame([(nodes[j], nodes[k]) for j in nodes for k in nodes if j < k], f"a {node}, b {node}")
    kept = {(r["a"]["node"], r["b"]["node"]) for r in pairs.where(near_copies._fits("a", "b")).collect()}
    plain = {k: _plain(t) for k, t in crowd}
    similar = {(j, k) for j in nodes for k in nodes if j < k and _similar(plain[j], plain[k])}
    assert similar and similar <= kept and (3, 5) not in kept


def test_only_the_rows_and_the_choice_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    base = prose(5, 100, 5000)
    kept = near_copies.keep_one(docs_table(spark, [(1, base), (2, _edited(base, 1, 1)), (3, prose(6, 100, 5000))]))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["marked", "stays"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_no_pair_inside_a_crowd_is_missed(spark):
    passage = prose(1, 130, 50_000)  # strangers are 0.733 similar, each to one other text 0.817
    tails = [prose(k + 2, 23, 50_000).split() for k in range(600)]
    rows = [(k, " ".join([passage, *tail])) for k, tail in enumerate(tails)]
    for k in range(40):
        other = [f"edit{k}" if at in (4, 10, 16) else word for at, word in enumerate(tails[k])]
        rows.append((600 + k, " ".join([passage, *other])))
    kept = near_copies.keep_one(docs_table(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(600))


def test_similar_texts_share_a_posting_where_they_can_still_be_similar(spark):
    texts = [(k, f"{prose(1, 100, 5000)} {prose(k // 2 + 2, 20, 5000)} {prose(k + 90, 1 + k % 4, 5000)}") for k in range(24)]
    texts += [(24, "a b"), (25, prose(3, 9, 5000)), (26, prose(3, 9, 5000) + " z")]
    plain = {k: _plain(t) for k, t in texts}
    posted = {}
    for r in near_copies.prefixes(spark.createDataFrame(texts, "node bigint, text string")).collect():
        assert r["size"] == len(plain[r["node"]])
        posted.setdefault(r["key"], {})[r["node"]] = r["rest"]
    met = {(a, b) for l in posted.values() for a in l for b in l if a < b and (min(l[a], l[b]) + 1) * 1.8 >= 0.8 * (len(plain[a]) + len(plain[b]))}
    similar = {(a, b) for a in plain for b in plain if a < b and _similar(plain[a], plain[b])}
    assert len(similar) > 10 and similar <= met
