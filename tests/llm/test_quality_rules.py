"""Base counts by plain Python, and which lines and documents stay."""

import re
from collections import Counter

from small import docs_table, prose

from evalgrid.llm import quality_rules

JUNK = ["a*** b### c$$$ " * 40 + ".", "HOME | NEWS | SPORT | SHOP | " * 30, "WIN!! NOW!! BIG!! FREE!! " * 20 + ".", " ".join(f"k{i}" for i in range(90))]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(covered), failed)


ROWS = [
    (1, None), (2, ""), (3, "a b c a b c a b c"), (4, "x\n\nx\n x\nx\r\n\x0bx y\n" * 3), (5, prose(1) + "\n" + prose(2)), (5, prose(1) + "\n" + prose(2)),
    (None, prose(3, 3000)), (6, "z" * 300_000), (7, "go " * 30_000), (8, " \t\r\n"), (9, "# é😀 % | " * 20), (10, prose(4, 60) + "\n" + "All rights reserved."),
    *[(20 + k, text) for k, text in enumerate(JUNK)], (30, prose(5, 200) + "\n" + JUNK[1][:60]),
]


def test_base_counts_by_hand(spark):
    out = quality_rules.assess(docs_table(spark, ROWS, extra=True))
    got = [(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((i, plain(t)) for i, t in ROWS), key=repr)


def test_lines_first_then_documents(spark):
    out = {r["doc_id"]: r for r in quality_rules.assess(docs_table(spark, ROWS)).collect()}
    assert all(not out[20 + k]["kept"] for k in range(len(JUNK)))
    assert out[5]["kept"] and out[5]["lost_chars"] == 0
    assert out[10]["kept"] and out[10]["clean_text"] == prose(4, 60)
    assert out[30]["kept"] and out[30]["clean_text"] == prose(5, 200)
    assert not out[1]["kept"] and not out[2]["kept"]


def test_no_python_in_the_plan(spark):
    plan = quality_rules.assess(docs_table(spark, ROWS[:1]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash", plan)


def test_no_rows(spark):
    assert quality_rules.assess(docs_table(spark, ROWS[:1]).where("false")).count() == 0
