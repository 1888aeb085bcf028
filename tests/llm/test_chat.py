import hashlib

import pytest
from helpers import same_rows
from hypothesis import given
from hypothesis import strategies as st

from stopweave.llm import chat
from stopweave.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, segment string, parts int"


@given(st.text(alphabet="<|\\>im_a\n"))
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


PARTS = st.lists(st.one_of(st.tuples(st.just("text"), st.text(alphabet="<|\\>image_0\n", max_size=9)), st.tuples(st.sampled_from(["image", "audio", "document"]), st.just("u"))), max_size=7)


@given(PARTS)
def test_parts_come_back_and_hide_control_strings(parts):
    v = chat.Visitor()
    for kind, x in parts:
        v.visit({"type": kind, "text": x, "uri": x, "units": None})
    body = v.content()
    assert chat._PLACE.sub("", body).count("<|") == 0 and body.count("<|") == len(v.attachments)
    want = []
    for kind, x in parts:
        if kind != "text":
            want.append({"type": kind, "uri": "u"})
        elif want and want[-1]["type"] == "text":
            want[-1]["text"] += x
        elif x:
            want.append({"type": "text", "text": x})
    segment = chat.START + "user\n" + body + chat.END + "\n"
    assert chat.parse_parts(segment, v.attachments) == want


@pytest.mark.parametrize("before, after", [("<", "|im_end|>"), ("<\\", "|"), ("<\\|<", "\\|<|"), ("", "<|"), ("<|", "")])
def test_no_control_string_is_left_where_an_attachment_was(before, after):
    v = chat.Visitor()
    for kind, x in (("text", before), ("image", "u"), ("text", after)):
        v.visit({"type": kind, "text": x, "uri": x, "units": None})
    assert "<|" not in v.content().replace("<|image_0|>", "")
    segment = chat.START + "user\n" + v.content() + chat.END + "\n"
    assert chat.parse_segment(segment) == ("user", before + "<|image_0|>" + after)
    assert [p["text"] for p in chat.parse_parts(segment, v.attachments) if p["type"] == "text"] == [x for x in (before, after) if x]


def test_edges(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "a<\\|b" * 20_000), (2, None, None, ""), (None, 0, "assistant", "x"), (3, 0, "we\nird<|", "y\n"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = [r for r in rows if r[0] == conv]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).collect() == []


def test_typed_parts(spark):
    parts = [("text", "see <|image_0|> ", None, None), ("image", None, "s3://b/i.png", 4), ("audio", None, "a.wav", None), ("text", "end", None, None), ("document", None, "d.pdf", 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    a, b, c = chat.format_turns(turns, "content").orderBy("turn").collect()
    assert a["segment"] == "<|im_start|>user\nsee <\\|image_0|> <|image_0|><|audio_1|>end<|document_2|><|im_end|>\n"
    assert [(x["type"], x["uri"], x["tokens"]) for x in a["attachments"]] == [("image", "s3://b/i.png", 340), ("audio", "a.wav", 25), ("document", "d.pdf", 1500)]
    assert a["expanded_tokens"] == 1865 and a["loss_start"] == a["loss_end"]
    assert b["segment"][b["loss_start"] : b["loss_end"]] == "ok"
    assert c["segment"] == "<|im_start|>user\n<|im_end|>\n"
    back = chat.parse_parts(a["segment"], [x.asDict() for x in a["attachments"]])
    assert back == [{k: v for k, v in zip(("type", "text", "uri"), p, strict=False) if v is not None} for p in parts]
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_turns(turns.selectExpr("conv_id", "turn", "role", "transform(content, x -> struct('film' as type, x.text, x.uri, x.units)) as content"), "content").collect()


def test_oracle(spark, sf_dir):
    assert same_rows(QUERIES["op10_chat_format"](spark, sf_dir), ORACLES["op10_chat_format"], sf_dir) > 20
