import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat

PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "\\", "\\\\", "[\\INST]", "<\\s>", "<\\/s>", " ", "\n", "<", "[", "/", "ok", "é", "INST]", "s>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.lists(st.sampled_from(PIECES), max_size=4).map("".join)), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_round_trip(turns):
    rendered = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(rendered)) == turns
    for r, t in turns:
        assert chat.unescape(chat.escape(t)) == t and not chat.CONTROL.search(chat.escape(t))


def test_plain_text_is_not_escaped():
    assert chat.render("user", "a \\n b [x]") == "[INST] a \\n b [x] [/INST]"
    assert chat.render("assistant", "</s>[INST] ok [/INST]") == "<s><\\/s>[\\INST] ok [\\/INST]</s>"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>", 0), (1, 0, "user", None, 0), (2, 0, "system", "be\nkind", 0), (2, 1, "user", "hi", 0), (2, 1, "user", "hi", 0), (None, 0, None, "x", 0), (3, None, "assistant", "a" * 100_000, 0), (3, 2, "assistant", "", 0)]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))).collect()}
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(*t)) for t in turns)


def test_loss_mask_over_the_joined_conversation(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "ask [INST]"), ("assistant", "</s> é"), ("system", "x"), ("assistant", ""), ("assistant", "last")])] + [(2, 0, "user", "only")]
    chats = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    joined = "".join(chat.render(r, t) for c, _, r, t in rows if c == 1)
    got = sorted((r.conv_id, r.start, r.stop) for r in chat.loss_mask(chats).collect())
    assert [c for c, *_ in got] == [1, 1, 1] and [chat.unescape(joined[a:b]) for _, a, b in got] == ["</s> é", "", "last"]


def test_a_broken_string_is_no_conversation():
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1], "formatted": ["<s>a</s>", "<s>b"]})
    with pytest.raises(ValueError):
        list(chat._digested(iter([batch])))


def test_empty(spark):
    assert chat.loss_mask(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
