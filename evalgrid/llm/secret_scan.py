"""Secrets in texts, told apart by who owns them.

A scan finds candidates in whole texts: three base kinds that always count,
and random-looking strings. The digests of all candidates are then counted
over the corpus by distinct repositories and owners. A value of many owners,
or in many repositories of few owners, is a copied example; one looks live that
has at most ``MAX_OWNERS`` and is in at most ``MAX_REPOSITORIES``. Random-looking strings
become spans of kind ``live`` only where they are owner-specific; base spans
stay whatever the count says.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from evalgrid.llm.common import blank, fresh, stored

#: Base kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
#: A value with at most this many owners counts as owner-specific.
MAX_OWNERS = 2
#: And a value in at most this many repositories, whoever owns them.
MAX_REPOSITORIES = 10
#: What stands in place of a secret.
MARK = "[SECRET]"
#: Bits of entropy per character from which a string looks random.
MIN_ENTROPY = 3.5

# Patterns of the base kinds (fixed values).
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{16}")
# Least lengths: the value of an assignment, an access key, a hex string (fixed values).
_LEAST = (12, 18, 16)
# An assignment has one of these words, whatever its case (fixed values).
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, in order.

    Per kind the matches are leftmost and non-overlapping, and too short ones
    are dropped after matching. Positions count code points; ends are exclusive.
    """
    found = []
    lower = text.encode().lower()
    if any(word in lower for word in _WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _LEAST[0]:
                found.append((m.start(), 0, m.end(), m[2]))
    for m in _ACCESS.finditer(text):
        if len(m[0]) >= _LEAST[1]:
            found.append((m.start(), 1, m.end(), m[0]))
    at = 0
    while long := _HEX_LONG.search(text, at):  # skips the runs that are too short
        m = _HEX.match(text, long.start())
        found.append((m.start(), 2, m.end(), m[0]))
        at = m.end()
    return sorted(found)


def _looks_random(value: str) -> bool:
    classes = (str.isdigit, str.islower, str.isupper)
    if not all(any(map(kind, value)) for kind in classes):
        return False
    n = len(value)
    return -sum(k / n * log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


def random_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Whole strings of mixed classes and high entropy outside ``taken``.

    ``taken`` is in order of starts; both lists are walked once.
    """
    found, ahead, reached = [], 0, 0
    for m in _RANDOM.finditer(text):
        while ahead < len(taken) and taken[ahead][0] < m.end():
            reached = max(reached, taken[ahead][2])
            ahead += 1
        if reached <= m.start() and _looks_random(m[0]):
            found.append((m.start(), len(KINDS), m.end(), m[0]))
    return found


def _digest(value: str) -> str:
    return hashlib.blake2b(value.encode(), digest_size=16).hexdigest()


_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            every = sorted(base + random_spans(text, base))
            spans.append([{"start": s, "kind": k, "end": e, "value": _digest(v)} for s, k, e, v in every])
        columns = [batch.column("row"), batch.column("id"), batch.column("owner"), pa.array(spans, _ARROW_SPAN)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "id", "owner", "spans"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) of candidates (value, repository, owner).

    Distinct pairs first, so that a value in a third of all rows is combined
    on the map side and never gathered. A null repository or owner counts as none.
    """
    repositories = candidates.select("value", "repository").distinct().groupBy("value").agg(F.count("repository").alias("n_repositories"))
    owners = candidates.select("value", "owner").distinct().groupBy("value").agg(F.count("owner").alias("n_owners"))
    return repositories.join(owners, "value")


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """(row, ``id``, spans): every row of ``docs`` with its spans.

    ``spans`` is an array of (start, kind, end, value, n_repositories,
    n_owners, live), ordered by start and kind; ``kind`` indexes ``KINDS``,
    3 stands for random-looking strings, which are there only if live;
    ``value`` is a digest. Each document is a repository, ``owner`` names its
    owner. Repeated rows each come out; null and empty texts have no spans. A
    value is live if both counts are small: at most ``max_owners`` owners and
    ``max_repositories`` repositories. Null owners and ids are not counted.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(owner).cast("string").alias("owner"), blank(F.col(text)).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.mapInArrow(_scan, f"row bigint, id {kind}, owner string, spans array<{_SPAN}>"), "spans")
    each = found.select("row", F.col("id").alias("repository"), "owner", F.explode("spans").alias("s")).select("*", "s.value")
    counted = each.join(ownership(each), "value")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    kept = counted.where((F.col("s.kind") < len(KINDS)) | live)
    full = F.struct("s.start", "s.kind", "s.end", "value", "n_repositories", "n_owners", live.alias("live"))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(full)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    joined = found.select("row", "id").join(spans, "row", "left")
    return joined.select("row", F.col("id").alias(id), F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "live")))
    one = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return F.array_join(one, ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(KINDS))


@F.pandas_udf(BooleanType())
def has_candidates(texts: pd.Series) -> pd.Series:
    """Whether a text has any span, live or not."""
    found = ((base := base_spans(t)) or random_spans(t, base) for t in texts)
    return pd.Series([bool(f) for f in found], dtype="bool")


@F.pandas_udf(StringType())
def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text with its "start:end" spans, in order, replaced by a mark.

    Spans that overlap become one mark.
    """

    def one(text: str, listing: str) -> str:
        out, at = [], 0
        for start, end in (map(int, span.split(":")) for span in listing.split(",") if span):
            if start >= at:
                out += [text[at:start], MARK]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype="object")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", length: str | None = None) -> DataFrame:
    """``docs`` with all secrets replaced in ``text``; every row stays.

    ``length`` names a column of text lengths to renew where a text changed.
    Rows without any candidate, nearly all, pass as they are read. The others
    are written once with a row number, and only they meet the counts.
    """
    marked = has_candidates(blank(F.col(text)))
    row, spans = fresh(docs, "row"), fresh(docs, "spans")
    hits = stored(docs.where(marked).withColumn(row, F.monotonically_increasing_id()), "hits")
    found = scan(hits.select(F.col(row).alias("at"), F.col(text).alias("text"), F.col(owner).alias("owner")), "at", "text", "owner")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    fixed = hits.join(found.select(F.col("at").alias(row), places.alias(spans)), row)
    fixed = fixed.withColumn(text, redacted(F.col(text), F.col(spans)))
    if length is not None:
        fixed = fixed.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return docs.where(~marked).unionByName(fixed.select(docs.columns))
