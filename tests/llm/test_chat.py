import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import chat

PIECES = st.lists(st.sampled_from([*chat.MARKERS, "\\", " ", "a", "[", "<", ">", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]) | PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    out = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(out)] == turns


def test_text_without_conflict_stays_as_it_is():
    assert chat.render_turn("user", "a \\ b")[0] == "[INST] a \\ b [/INST]"
    with pytest.raises(chat.Conflict):
        list(chat.parse("[INST] a </s>"))


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    return {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(df)).collect()}


def test_digests(spark):
    long = "word " * 80_000
    rows = [(1, 1, "assistant", "ok </s>", "x"), (1, 0, "user", "hi [INST]", "x"), (2, 0, "assistant", None, "x"), (2, 0, "assistant", None, "x"), (None, None, None, None, "x"), (3, 0, "user", long, "x"), (3, 1, "assistant", long, "x"), (3, 2, "assistant", "end", "x")]
    got = digests(spark, rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhi [INST]\nassistant\nok </s>\n") and got[1]["loss_sha256"] == sha("ok </s>") and got[1]["loss_chars"] == 7
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == sha("")
    assert got[None]["turns_sha256"] == sha("\n\n")
    assert got[3]["loss_sha256"] == sha(long + "end") and got[3]["n_turns"] == 3
    assert digests(spark, []) == {}
