"""Chat formatting: round trips, masks, attachments."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat
from tidemark.llm import queries as Q

HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\.", "<\\.s>", "[INST]", "[/INST]", "<s>", "[TURN]x[MSG] ", "<|image|>", "[", "]", "<", "", " ",
        "\n", "a", "[SYS] ", " [/SYS]", "\\.", "[\\INST]"]
texts = st.lists(st.sampled_from(HARD), max_size=8).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "tool", "", "<s>", "[MSG] x", "a\\"])


@settings(max_examples=300, deadline=None)
@given(texts)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    got = chat.escape(text)
    assert chat.unescape(got) == text
    assert not [m for m in chat._CONTROL.findall(got) if m != "\\"]


def part(kind, text=None, ref=None, **sizes):
    return {"type": kind, "text": text, "ref": ref, "width": None, "height": None, "duration_ms": None, "pages": None, **sizes}


parts = st.lists(st.one_of(texts.map(lambda t: part("text", t)), st.sampled_from(
    [part("image", ref="i.png", width=28, height=15), part("audio", duration_ms=81), part("document", ref="d", pages=2),
     part("hologram", ref="h"), part(None), None, part("text"), part("image", width=-1)])), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, parts), max_size=5))
def test_messages_read_back(messages):
    done = [chat.format_message(r, p) for r, p in messages]
    got = chat.read_turns("".join(d[0] for d in done))
    kinds = [[p["type"] if p["type"] in ("image", "audio", "document") else "file" for p in ps if p and p["type"] != "text"]
             for _, ps in messages]
    want = ["".join(p["text"] or "" for p in ps if p and p["type"] == "text") for _, ps in messages]
    assert got == [(r, t, k) for (r, _), t, k in zip(messages, want, kinds)]
    for (r, _), (text, spans, attachments), t in zip(messages, done, want):
        assert "".join(chat.unescape(text[i:j]) for i, j in spans) == (t if r == "assistant" else "")
        assert all(text[a:].startswith(f"<|{k}|>") for k, _, a, _ in attachments)


def test_expanded_tokens():
    _, _, got = chat.format_message("user", [part("image", ref="a", width=29, height=14), part("audio", ref="b", duration_ms=81),
                                             part("document", ref="c", pages=3), part("image"), part("x", ref="e")])
    assert [(k, r, n) for k, r, _, n in got] == [("image", "a", 3), ("audio", "b", 3), ("document", "c", 768), ("image", "", 1), ("file", "e", 1)]


def digest(turns):
    h = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


ROWS = [(1, 0, "system", "be"), (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (None, 0, "user", "x"),
        (None, None, None, None), (2, 0, "assistant", None), (3, 0, "tool", "</s>"), (3, 0, "tool", ""), (4, 0, "assistant", "é🙂" * 50),
        *((5, i, ("user", "assistant")[i % 2], f"t{i} [INST]") for i in range(200))]


@pytest.mark.parametrize("chunk", [1_000_000, 1, 60])
def test_conversations(spark, chunk):
    rows = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, chunk int, message string")
    done = chat.format_chat(rows.repartition(4), chunk=chunk)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(done).collect()}
    held = defaultdict(list)
    for c, t, r, x in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        held[c].append((r or "", x or ""))
    assert got == {c: digest(ts) for c, ts in held.items()}
    out = defaultdict(list)
    for r in sorted(done.collect(), key=lambda r: r["chunk"]):
        assert r["start"] == sum(len(x["text"]) for x in out[r["conv_id"]])
        out[r["conv_id"]].append(r)
    assert all([x["last"] for x in xs] == [False] * (len(xs) - 1) + [True] for xs in out.values())
    assert (len(out[5]) > 1) == (chunk < 1_000_000)


def test_typed_parts_in_a_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", [part("text", "see "), part("image", ref="i", width=28, height=28)]), (1, 1, "assistant", None)],
                                 "conv_id long, turn long, role string, content " + f"array<{chat.PART.simpleString()}>")
    r, = chat.format_chat(rows, content="content").collect()
    assert r["text"] == "[INST] see <|image|> [/INST]<s></s>" and r["attachment_tokens"] == 4 and r["n_turns"] == 2
    a, = r["attachments"]
    assert (a["kind"], a["ref"], a["turn"], a["at"]) == ("image", "i", 0, 11)


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    held = defaultdict(list)
    for c, t, r, x in sorted(rows):
        held[c].append((r, x))
    got = Q.QUERIES["op13_chat_format"](spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: digest(ts) for c, ts in held.items()}
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_empty_table(spark):
    none = chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.collect() == [] and chat.read_back(none).collect() == []
