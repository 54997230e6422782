"""Line-first quality rules in DataFrame functions.

Each line of a text is judged by itself: symbols, shouting, navigation,
boilerplate, repetition and missing punctuation. Failing lines are removed,
and a document that loses too much of its text is rejected. Everything is a
column expression over one row; no text leaves its row, and no row its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import BLANKS, blank, let, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Fewest words of a document, and largest share of repeated words in percent (fixed values).
MIN_WORDS, MAX_REPEATED = 50, 50
#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here",
    "licensed under",
)
#: A line fails with more symbols, bars or exclamation marks than this per word.
MAX_SYMBOLS, MAX_BARS, MAX_SHOUTS = 0.3, 0.2, 0.3
#: Words from which a line is long enough to judge its repetition.
LONG_LINE = 12
#: A long line fails if less than this share of its words are distinct.
MIN_DISTINCT = 0.3
#: Words from which a line needs a sentence end somewhere.
NEEDS_END = 30
#: A document is rejected if it loses more than this share of its word characters.
MAX_LOST = 0.5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points outside ASCII white space."""
    return F.length(_without(text, BLANKS)).cast("bigint")


def n_dup_lines(lines: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    worded = F.filter(lines, lambda line: _without(line, BLANKS) != "")
    return let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("bigint"))


def n_repeat_words(found: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``found``.

    Windows are compared by XXH64. A text without repeats is done after one
    hash set; otherwise windows are sorted with their positions, those equal
    to a neighbour are marked, and the marked positions cover
    ``min(3, distance to the previous one)`` new words each.
    """

    def count(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def marked(p: Column) -> Column:
            same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
            return F.filter(p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1)))

        def covered(at: Column) -> Column:
            gains = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(p - F.get(at, j - 1), F.lit(3))))
            return F.aggregate(gains, F.lit(0).cast("bigint"), lambda s, g: s + g)

        positions = let(placed, lambda p: F.sort_array(F.transform(marked(p), lambda x: x["i"])))
        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, F.lit(0).cast("bigint")).otherwise(let(positions, covered))

    def windows(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(starts, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    return let(found, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(windows(w), count)))


def line_passes(line: Column) -> Column:
    """Whether one line is prose worth keeping; a line without words passes."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        size = F.length(line)
        last = F.element_at(w, -1)
        per_word = lambda characters: (size - F.length(_without(line, characters))) / n
        noisy = per_word(SYMBOLS) > MAX_SYMBOLS
        navigation = per_word("|»•") > MAX_BARS
        shouting = per_word("!") > MAX_SHOUTS
        stuffed = (n >= LONG_LINE) & (F.size(F.array_distinct(w)) < MIN_DISTINCT * n)
        lower = F.lower(line)
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate = boilerplate | lower.contains(phrase)
        ends = last.rlike("[.!?…:;][\"'”»)]*$") | F.exists(w, lambda x: x.rlike("[.!?]$"))
        endless = (n >= NEEDS_END) & ~ends
        return (n == 0) | ~(noisy | navigation | shouting | stuffed | boilerplate | endless)

    return let(words(line), judged)


def assess(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, counts, base_failed, n_lines, n_kept_lines, lost_chars, kept, clean_text).

    Null texts count as empty. A document without words has zero counts and
    fails the base rules. Lines are what stands between line feeds; removed
    lines are left out of ``clean_text`` and the others keep their order.
    """
    body = docs.select(F.col(id).alias("id"), blank(F.col(text)).alias("t"))
    parts = body.select("id", "t", F.split("t", "\\n", -1).alias("lines"), words(F.col("t")).alias("w"))

    def with_lines(lines: Column) -> Column:
        kept = F.filter(lines, line_passes)
        return let(
            kept,
            lambda k: F.struct(
                F.size(lines).alias("n_lines"),
                F.size(k).alias("n_kept_lines"),
                F.array_join(k, "\n").alias("clean_text"),
                n_dup_lines(lines).alias("n_dup_lines"),
            ),
        )

    counted = parts.select(
        "id",
        "t",
        let(F.col("lines"), with_lines).alias("l"),
        let(F.col("w"), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))).alias("c"),
    )
    flat = counted.select(
        "id", "c.*", word_chars(F.col("t")).alias("word_chars"), n_symbols(F.col("t")).alias("n_symbols"), "l.*"
    ).withColumn("lost_chars", F.col("word_chars") - word_chars(F.col("clean_text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = flat.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("lost_chars") <= MAX_LOST * F.col("word_chars"))).withColumnRenamed("id", id)
