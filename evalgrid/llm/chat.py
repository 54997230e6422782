"""Chat formatting on the level of tokens.

A conversation is ``<|begin|>`` and then, for each turn, ``<|turn|>`` role
``<|text|>`` text ``<|end|>``. The four marks are reserved ids above the
vocabulary. Role and text are encoded separately and the ids spliced between
them, so no token spans a boundary. Which tokens are learned follows from the
lengths of the segments: +1 where an assistant's text starts and -1 after it,
summed up.

Control strings inside roles and texts, of this template and of common others,
are broken by an escape character after their first character, and escape
characters are doubled; taking them out again gives the text back exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import blank

#: Default vocabulary: byte-level ranks, one "base64 rank" per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's authors split text into words (fixed value).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The marks of the template, in the order of their reserved ids.
MARKS = ("<|begin|>", "<|turn|>", "<|text|>", "<|end|>")
#: Control strings of common chat templates (fixed values).
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
ESCAPE = "␛"
#: The role whose text is learned.
LEARNED = "assistant"
#: White space as the split pattern knows it (fixed value), in runs beyond which its search would exhaust the stack.
_LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (*MARKS, *FOREIGN)))
_ESCAPED = re.compile(f"{ESCAPE}(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double the escape character, then break every control string."""
    return _CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    """The inverse: a doubled escape character is one, a single one goes."""
    return _ESCAPED.sub(lambda m: m[1], text)


class Codec:
    """A vocabulary with the template's marks as reserved ids."""

    def __init__(self, ranks: bytes) -> None:
        lines = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.first = max(table.values()) + 1
        self.begin, self.turn, self.text, self.end = range(self.first, self.first + len(MARKS))
        self.encoder = tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})
        self.one_word = tiktoken.Encoding("word", pat_str=r"(?s:.)+", mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The vocabulary's ids of the whole text.

        A very long run of white space is a word by itself, up to its last
        character where a text follows, so the text can be cut around it.
        """
        ids: list[int] = []
        at = 0
        for run in _LONG_BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.encoder.encode_ordinary(text[at : run.start()])
            ids += self.one_word.encode_ordinary(text[run.start() : end])
            at = end
        return ids + self.encoder.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return self.encoder.decode_bytes(ids).decode()


def turn_tokens(codec: Codec, role: str, text: str) -> tuple[list[int], np.ndarray]:
    """Ids and loss mask of one turn."""
    segments = [[codec.turn], codec.encode(escape(role)), [codec.text], codec.encode(escape(text)), [codec.end]]
    bounds = np.cumsum([0, *map(len, segments)])
    steps = np.zeros(bounds[-1] + 1, dtype=np.int8)
    if role == LEARNED:
        np.add.at(steps, [bounds[3], bounds[4]], [1, -1])
    return [i for s in segments for i in s], np.cumsum(steps[:-1], dtype=np.int8)


def _lists(parts: list, kind: np.dtype) -> pa.ListArray:
    """A list column from the lists or arrays of its rows."""
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([np.asarray(p, dtype=kind) for p in parts]) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(offsets, flat)


def _headed(column: pa.ListArray, first: np.ndarray, value: int) -> pa.ListArray:
    """The lists of a column, those of ``first`` rows with ``value`` in front."""
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    flat = np.insert(column.flatten().to_numpy(), offsets[:-1][first], value)
    return pa.ListArray.from_arrays((offsets + np.concatenate([[0], np.cumsum(first)])).astype(np.int32), flat)


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    return np.split(column.flatten().to_numpy(), offsets[1:-1]) if len(column) else []


def _encoder(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            turns = [turn_tokens(codec, r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            columns = [
                *map(batch.column, ("id", "turn", "role", "hash")),
                _lists([ids for ids, _ in turns], np.dtype("int32")),
                _lists([mask for _, mask in turns], np.dtype("int8")),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "turn", "role", "hash", "ids", "mask"])

    return run


def _assembler(begin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, number = object(), 0, 0
        for batch in batches:
            starts, numbers, first = [], [], []
            sizes = np.diff(np.asarray(batch.column("ids").offsets)).tolist()
            for own, size in zip(batch.column("id").to_pylist(), sizes):
                opens = own != last
                if opens:
                    last, start, number = own, 0, 0
                starts.append(start)
                numbers.append(number)
                first.append(opens)
                start, number = start + size + opens, number + 1
            opening = np.array(first, dtype=bool)
            columns = [
                batch.column("id"),
                pa.array(numbers, pa.int64()),
                pa.array(starts, pa.int64()),
                _headed(batch.column("ids"), opening, begin),
                _headed(batch.column("mask"), opening, 0),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "number", "token_start", "ids", "mask"])

    return run


def _ranks(df: DataFrame, vocabulary: str):
    """The vocabulary as bytes for the tasks, under a megabyte; read on the driver."""
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def format_chats(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(``id``, number, token_start, token_ids, loss_mask): a row for each turn.

    Turns are encoded where they are read. One shuffle brings a conversation
    together, and a running sum over the sorted stream gives each turn its
    place, so a conversation of any length passes through a task turn by turn.
    A conversation's tokens are its rows' in order of ``number``; the first
    row starts with the begin mark. Turns with equal numbers are ordered by
    role, then by a hash of the text, null turns come first, null ids are one conversation. Null
    roles and texts are empty. Repeated rows are turns of their own.
    """
    turns = conversations.select(
        F.col(id).alias("id"), F.col(turn).alias("turn"), blank(F.col(role)).alias("role"), blank(F.col(text)).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    ranks = _ranks(conversations, vocabulary)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("id", "turn")}
    encoded = turns.mapInArrow(
        _encoder(ranks), f"id {kinds['id']}, turn {kinds['turn']}, role string, hash bigint, ids array<int>, mask array<tinyint>"
    )
    ordered = encoded.repartition("id").sortWithinPartitions("id", "turn", "role", "hash", "ids")
    begin = Codec(ranks.value).begin
    placed = ordered.select("id", "ids", "mask").mapInArrow(
        _assembler(begin), f"id {kinds['id']}, number bigint, token_start bigint, ids array<int>, mask array<tinyint>"
    )
    return placed.select(F.col("id").alias(id), "number", "token_start", F.col("ids").alias("token_ids"), F.col("mask").alias("loss_mask"))


def _reader(ranks):
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        kind, last, state = pa.int64(), None, None

        def done() -> pa.RecordBatch:
            turns, whole, chars, learned, shown, tokens = state
            row = [last, turns, whole.hexdigest(), chars, learned.hexdigest(), shown, tokens]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            kind = batch.schema.field("id").type
            out = []
            for own, ids, mask in zip(batch.column("id").to_pylist(), _rows(batch.column("token_ids")), _rows(batch.column("loss_mask"))):
                if state is None or own != last:
                    if state is not None:
                        out.append(done())
                    last, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                marks = np.flatnonzero(ids >= codec.first)
                at, text_at, end = marks[-3:]
                role, text = (codec.decode(part.tolist()) for part in (ids[at + 1 : text_at], ids[text_at + 1 : end]))
                learned = unescape(codec.decode(ids[(mask != 0) & (ids < codec.first)].tolist()))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(role) + len(text) + sum(len(MARKS[ids[m] - codec.first]) for m in marks)
                state[5] += len(ids)
            yield from out
        if state is not None:
            yield done()

    return run


def read_back(formatted: DataFrame, id: str = "conv_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Decode the output of ``format_chats`` and digest each conversation.

    Turns, roles, texts and the learned text come from the token ids and the
    mask alone. Digests are fed turn by turn over a sorted stream.
    """
    rows = formatted.select(F.col(id).alias("id"), "number", "token_ids", "loss_mask")
    ordered = rows.repartition("id").sortWithinPartitions("id", "number").drop("number")
    kind = rows.schema["id"].dataType.simpleString()
    out = ordered.mapInArrow(
        _reader(_ranks(formatted, vocabulary)),
        f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint",
    )
    return out.withColumnRenamed("id", id)
