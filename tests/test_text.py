"""Alias matching and negation scope against a scan of characters."""

import random

import pytest
from pyspark.sql import functions as F

from evalgrid.functions import text


def _match(spark, rows):
    df = spark.createDataFrame(rows, "aliases array<string>, body string")
    out = df.select(
        text.alias_match(F.col("aliases"), F.col("body")).alias("m"),
        text.asserts_alias(F.col("aliases"), F.col("body")).alias("a"),
    )
    return [(r["m"], r["a"]) for r in out.collect()]


def _edge(left, right):
    """Whether a word starts or ends between two characters; empty is outside."""
    inside = [c != "" and (c.isalnum() or c == "_") for c in (left, right)]
    return inside[0] != inside[1]


def _places(alias, body):
    """Starts of the whole-word places of one alias, left to right."""
    at = 0
    while (at := body.find(alias, at)) >= 0:
        ends = (at + len(alias + tail) for tail in ("s", "es", "d", "ed", "ing", "") if body.startswith(alias + tail, at))
        end = next((e for e in ends if _edge(body[e - 1], body[e : e + 1])), None)
        if end is not None and _edge(body[max(at - 1, 0) : at], body[at]):
            yield at
            at = end
        else:
            at += 1


def _recent(before):
    """The last words of a text, letters and apostrophes only, read backwards."""
    words, word = [], ""
    for c in reversed(before + " "):
        if "a" <= c <= "z" or c == "'":
            word = c + word
        elif word:
            words.append(word)
            word = ""
    return [*words, *([word] if word else [])][: text.WORD_REACH]


def _plain(aliases, body):
    body = body.lower()
    places = [at for alias in aliases for at in _places(alias.lower(), body)]
    scopes = [(body[:at][-text.PHRASE_REACH :], _recent(body[:at])) for at in places]
    free = [not any(p in tail for p in text.NEGATOR_PHRASES) and not set(words) & set(text.NEGATORS) for tail, words in scopes]
    return bool(places), any(free)


SAID = [
    (["valve"], "The valves were opened", True, True),
    (["valve"], "bivalve shells", False, False),
    (["leak"], "LEAKED overnight", True, True),
    (["leak"], "leakage overnight", False, False),
    (["tide pool"], "nobody lacks tide pools here", True, False),
    (["tide pool"], "nobody lacks water, and every coast here has tide pools", True, True),
    (["rust"], "instead of paint only rust", True, False),
    (["rust"], "never mind; later on we found rust", True, True),
    (["c++ code"], "legacy c++ code", True, True),
    (["señal"], "dos señales", True, True),
    (["se"], "señal", False, False),
    (["tank 4"], "isn’t tank 4", True, False),
    (["tank 4"], "tank 42", False, False),
]


@pytest.mark.parametrize("case", SAID)
def test_said(spark, case):
    aliases, body, hit, asserted = case
    assert _plain(aliases, body) == (hit, asserted)
    assert _match(spark, [(aliases, body)]) == [(hit, asserted)]


def test_random_texts_against_the_scan(spark):
    rng = random.Random(5)
    words = ["pump", "pumps", "seal", "sealed", "broken seal", "not", "no", "instead", "of", "too early", "to", "ß", "77", "isn't", "'",
             "pumping", ";", "-", "should", "avoids", "unsupported", "pump_a", "\t"]
    aliases = [["pump"], ["seal", "broken seal"], ["no", "pump sealed"], ["77"]]
    rows = [(rng.choice(aliases), rng.choice([" ", " ", ""]).join(rng.choices(words, k=rng.randint(0, 22)))) for _ in range(1500)]
    got = _match(spark, rows)
    wrong = [(r, g, _plain(*r)) for r, g in zip(rows, got) if g != _plain(*r)]
    assert not wrong
