import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tensorloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, added string"
text = st.text(alphabet=st.sampled_from(list("ab \\\n<>/[]sINTROLE")) | st.characters(blacklist_categories=["Cs"]), max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", "\\</s>", "<</ROLE>>", " [/INST]"])
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a b\n"]), text), max_size=8)


@given(turns)
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(conversation):
    assert chat.read_back(chat.instruct(conversation)) == conversation


@given(turns)
@settings(max_examples=100, deadline=None)
def test_spans(conversation):
    whole = chat.instruct(conversation)
    found = list(chat.rendered(chat.instruct, iter(conversation)))
    assert "".join(f["added"] for _, f in found) == (whole if conversation else "")
    for (_, t), f in found:
        assert not f["rewrites"] and chat.unescape(f["added"][f["begin"] : f["end"]]) == t


def test_rewriting_template_is_detected():
    def last_only(turns):  # drops what earlier assistants said
        return "".join(f"<{t}>" if r == "user" or i == len(turns) - 1 else "<>" for i, (r, t) in enumerate(turns))

    found, _ = chat.spans(last_only, [("user", "q"), ("assistant", "one"), ("user", "r"), ("assistant", "two")])
    assert [f["rewrites"] for f in found] == [False, False, True, False]


def test_long_conversations_in_windows(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i} </s>", None) for i in range(300)] + [(2, 0, "user", "x", None)]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    said = "".join(r[3] for r in rows if r[2] == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].formatted_chars == len(chat.instruct([r[2:4] for r in rows if r[0] == 1]))


def test_nulls_and_repeats(spark):
    rows = [(None, 1, "user", "a", None), (None, None, None, None, None), (3, 1, "assistant", None, "x"), (3, 1, "assistant", None, "x"), (4, 2, "tool", "", None)]
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {None: 2, 3: 2, 4: 1}
    assert not chat.digests(chat.format_turns(spark.createDataFrame([], SCHEMA))).collect()


def test_long_conversations_are_rendered_from_their_start():
    def last_ten(turns):
        return "".join(f"<{t}>" for _, t in turns[-10:])

    def numbered(turns):
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    conversation = [("user", f"t{i}") for i in range(150)]
    found = [f for _, f in chat.rendered(last_ten, iter(conversation))]
    assert [f["rewrites"] for f in found] == [i >= 10 for i in range(150)]
    assert all(f["added"] == last_ten(conversation[: i + 1]) for i, f in enumerate(found) if i >= 10)
    assert "".join(f["added"] for _, f in chat.rendered(numbered, iter(conversation))) == numbered(conversation)
