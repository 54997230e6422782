"""Exact round trips of chats and escapes."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import chat

BITS = ["<", "/s>", "</s>", "[INST]", "[/INST", "]", chat.ESCAPE, "<|end|>", "<|", "turn|>", " ", "é", "x", "<<SYS>>", "<s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in (*chat.MARKS, *chat.FOREIGN))


def _chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string, mask int, number int").repartition(3)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", "again <|end|>"),
    (2, 0, "assistant", None), (2, 1, None, ""), (3, None, "user", "first"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"),
    (None, 0, "assistant", "nobody's"), (4, 0, "assistant", " " * 9000 + "y" * 50_000), (5, 1, "assistant", f"{chat.ESCAPE}<s>é😀"), (5, 0, "<|turn|>", "odd role"),
]


def test_round_trip(spark):
    out = chat.read_back(chat.format_chats(_chats(spark, [(*r, "x", 1, 2) for r in ROWS]))).collect()
    want = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        turns = want[r["conv_id"]]
        learned = "".join(t for role, t in turns if role == "assistant")
        shown = chat.MARKS[0] + "".join(chat.MARKS[1] + chat.escape(a) + chat.MARKS[2] + chat.escape(b) + chat.MARKS[3] for a, b in turns)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == len(shown)


def test_long_texts_have_the_ids_of_the_whole_text():
    codec = chat.Codec(open(chat.VOCABULARY, "rb").read())
    run = " \u3000\n" * 5000
    for text in ("the cat's 1st mat, \n\n" * 900, run, run + "x", "x" + run, f"a'{run[:-1]} b{run}\n'll {run[:9999]}c", "y\x1c" * 9000, "\x1c" * 30_000):
        ids = codec.encode(text)
        assert ids == codec.encoder.encode_ordinary(text) and codec.decode(ids) == text
    huge = "a" + " " * 1_500_000 + "b"  # more than the split pattern can search
    assert codec.decode(codec.encode(huge)) == huge


def test_turns_of_one_number_do_not_depend_on_partitions(spark):
    rows = [(1, 0, "user", f"text {k % 7}", "x", 1, 2) for k in range(20)] + [(1, 0, "assistant", "b", "x", 1, 2), (1, 0, "assistant", "a", "x", 1, 2)]
    found = []
    for order, parts in ((rows, 1), (rows[::-1], 5)):
        out = chat.read_back(chat.format_chats(_chats(spark, order).repartition(parts))).first()
        found.append(out["turns_sha256"])
        assert (out["n_turns"], out["loss_chars"]) == (22, 2)
    assert found[0] == found[1]


def test_tokens_and_masks(spark):
    rows = [(1, 0, "user", "hello there", "x", 1, 2), (1, 1, "assistant", "general", "x", 1, 2)]
    out = sorted(chat.format_chats(_chats(spark, rows)).collect(), key=lambda r: r["number"])
    codec = chat.Codec(open(chat.VOCABULARY, "rb").read())
    ids = [i for r in out for i in r["token_ids"]]
    mask = [m for r in out for m in r["loss_mask"]]
    text = codec.encode("general")
    assert ids == [codec.begin, codec.turn, *codec.encode("user"), codec.text, *codec.encode("hello there"), codec.end,
                   codec.turn, *codec.encode("assistant"), codec.text, *text, codec.end]
    assert [i for i, m in zip(ids, mask) if m] == text
    assert [r["token_start"] for r in out] == [0, len(out[0]["token_ids"])]


def test_long_conversation_is_a_stream(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", "x", 1, 2) for i in range(25_000)]
    r = chat.read_back(chat.format_chats(_chats(spark, rows))).first()
    learned = "".join(f"turn {i}" for i in range(1, 25_000, 2))
    assert (r["n_turns"], r["loss_sha256"]) == (25_000, hashlib.sha256(learned.encode()).hexdigest())


def test_no_rows(spark):
    assert chat.read_back(chat.format_chats(_chats(spark, [(1, 0, "user", "x", "x", 1, 2)]).where("false"))).count() == 0
