"""The leak scan against plain substring search."""

import pytest

from evalgrid.operators import leaks


@pytest.mark.parametrize("n_tokens,part", [(1, 2_000_000), (10_000, 2_000_000), (10_000, 30_000), (0, 10)])
def test_equals_substring_search(spark, monkeypatch, n_tokens, part):
    monkeypatch.setattr(leaks, "PART", part)
    tokens = [f"case_{i * 37 % 10_007}_x" for i in range(n_tokens)] + ([" ", "\t", "é", "se_1", "_"] if n_tokens else [])
    texts = [(k, f"Ünder case_{k * 37}_x and case_{k}_xcase_{k + 1}_x é") for k in range(200)] + [(None, "case_1_x"), (900, None), (901, ""), (3, "case_0_x again"), (3, "case_0_x again")]
    documents = spark.createDataFrame(texts, "doc bigint, body string").repartition(3)
    found = leaks.find_tokens(documents, spark.createDataFrame([(t,) for t in tokens], "token string"), "doc", "body")
    wanted = {(k, t) for k, body in texts if k is not None and body for t in set(tokens) if t.strip() and t in body}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
