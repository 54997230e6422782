"""Whole-word alias matching and negation scope, as native expressions.

A word character is a Unicode letter, number or underscore. The class is
spelled out instead of using ``\\b`` so that every engine agrees on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word class, the inflections an alias may carry, and the cues
# that put an alias hit inside a negation.
WORD = r"[\p{L}\p{N}_]"
INFLECTION = "(?:s|es|d|ed|ing)"
NEGATORS = (
    "not", "no", "never", "without", "cannot", "n't", "lack", "lacks", "lacking",
    "avoid", "avoids", "avoiding", "isn", "aren", "wasn", "weren", "don", "doesn",
    "didn", "won", "shouldn", "couldn", "wouldn", "insufficient", "unsupported",
)
NEGATOR_PHRASES = (
    "rather than", "instead of", "too early to", "no evidence",
    "can not", "would not", "should not",
)
PHRASE_REACH = 30
WORD_REACH = 4

_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_MARK = "\u0001"


def quote_literal(text: Column) -> Column:
    """Escape regular-expression metacharacters of ``text``."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-&#~])", r"\\$1")


def alias_pattern(alias: Column) -> Column:
    """The whole-word, inflection-tolerant pattern of one alias.

    The literal comes first, so that the engine can skip to it; what must stand
    before it is looked up from there.
    """
    lowered = F.lower(alias)
    literal = quote_literal(lowered)
    before = F.when(F.rlike(lowered, F.lit(f"^{WORD}")), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    after = F.when(F.rlike(lowered, F.lit(f"{WORD}$")), f"{INFLECTION}?(?!{WORD})").otherwise(
        f"(?:{INFLECTION}(?!{WORD})|(?={WORD}))"
    )
    pattern = F.concat(literal, F.lit("(?<="), before, literal, F.lit(")"), after)
    return F.when(lowered == "", F.lit(_BOUNDARY)).otherwise(pattern)


def prepared_aliases(aliases: Column) -> Column:
    """Aliases ready for matching: what to look for first, and the pattern."""
    return F.transform(
        aliases, lambda a: F.struct(F.lower(a).alias("needle"), alias_pattern(a).alias("pattern"))
    )


def haystack(text: Column) -> Column:
    """``text`` as the matchers below want it: lower-cased, free of the cut mark."""
    return F.regexp_replace(F.lower(text), _MARK, "\u0002")


def has_hit(prepared: Column, body: Column) -> Column:
    """Whether a haystack holds any of the prepared aliases as a whole word.

    Most texts are dismissed by a plain search before a pattern is tried.
    """
    found = F.exists(
        prepared, lambda a: F.contains(body, a["needle"]) & F.rlike(body, a["pattern"])
    )
    return F.coalesce(found, F.lit(False))


def has_open_hit(
    prepared: Column,
    body: Column,
    negators: Sequence[str] = NEGATORS,
    phrases: Sequence[str] = NEGATOR_PHRASES,
) -> Column:
    """Whether some alias occurs in a haystack outside a negation scope.

    Each alias is walked on its own, because two aliases may overlap and the
    scope is measured from the start of the hit.
    """
    found = F.exists(
        prepared,
        lambda a: F.when(
            F.contains(body, a["needle"]), _has_open_hit(body, a["pattern"], negators, phrases)
        ).otherwise(F.lit(False)),
    )
    return F.coalesce(found, F.lit(False))


def alias_match(aliases: Column, text: Column) -> Column:
    """Whether any alias occurs in ``text`` as a whole word."""
    return has_hit(prepared_aliases(aliases), haystack(text))


def asserts_alias(
    aliases: Column,
    text: Column,
    negators: Sequence[str] = NEGATORS,
    phrases: Sequence[str] = NEGATOR_PHRASES,
) -> Column:
    """Whether some alias occurs in ``text`` outside a negation scope."""
    return has_open_hit(prepared_aliases(aliases), haystack(text), negators, phrases)


def _has_open_hit(
    body: Column, pattern: Column, negators: Sequence[str], phrases: Sequence[str]
) -> Column:
    """Fold over the text cut at each hit, carrying only the recent context.

    Every piece after the first starts with a hit. The state keeps the last few
    words, whether the last word is still open at the cut, and the last
    characters, so the fold is linear in the text.
    """
    pieces = F.split(F.regexp_replace(body, pattern, _MARK + "$0"), _MARK, -1)
    no_words = F.array().cast("array<string>")
    start = F.struct(
        F.lit(False).alias("hit"),
        F.lit(-1).alias("seen"),
        no_words.alias("words"),
        F.lit(False).alias("open"),
        F.lit("").alias("tail"),
    )

    def step(state: Column, piece: Column) -> Column:
        negated = F.arrays_overlap(state["words"], F.array(*[F.lit(w) for w in negators]))
        for phrase in phrases:
            negated = negated | F.contains(state["tail"], F.lit(phrase))
        found = F.regexp_extract_all(piece, F.lit("[a-z']+"), F.lit(0))
        joins = state["open"] & piece.rlike("^[a-z']")
        words = (
            F.when(
                joins,
                F.concat(
                    F.slice(state["words"], 1, F.greatest(F.size(state["words"]) - 1, F.lit(0))),
                    F.array(F.concat(F.element_at(state["words"], -1), F.element_at(found, 1))),
                    F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))),
                ),
            )
            .when(F.size(found) > 0, F.concat(state["words"], found))
            .otherwise(state["words"])
        )
        kept = F.reverse(F.slice(F.reverse(words), 1, WORD_REACH))
        return F.struct(
            (state["hit"] | ((state["seen"] >= 0) & ~negated)).alias("hit"),
            (state["seen"] + 1).alias("seen"),
            kept.alias("words"),
            F.when(piece == "", state["open"]).otherwise(piece.rlike(r"[a-z']\z")).alias("open"),
            F.right(F.concat(state["tail"], piece), F.lit(PHRASE_REACH)).alias("tail"),
        )

    return F.aggregate(pieces, start, step, lambda state: state["hit"])
