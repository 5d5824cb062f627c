import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from voltide.llm import chat_format as c
from voltide.llm.queries import op6_chat_formatting, table


def expected(conversations):
    out = {}
    for conv, messages in conversations.items():
        loss = "".join(t for r, t in messages if r == "assistant")
        out[conv] = (len(messages), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in messages).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark, medium):
    conversations = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(table(spark, medium, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        conversations.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in op6_chat_formatting(spark, medium).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == expected(conversations)
    assert all(r["formatted_chars"] == len(c.template(conversations[k])) and not r["rewrites_history"] for k, r in got.items())


def test_hard_rows(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, "assistant", "", 9), (1, None, None, "no role", 9), (2, 0, "tool ]x", "\\[INST] \\\\ <s> [/ASST]</s>\n", 9), (2, 0, "tool ]x", "\\[INST] \\\\ <s> [/ASST]</s>\n", 9), (None, 3, "assistant", "lost", 9)]
    rows += [(7, k, ("user", "assistant")[k % 2], f"turn {k} [/INST]</s>\n<s>[ASST] ", 9) for k in range(1500)] + [(8, 0, "assistant", "word " * 200_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, spans int").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:5] for r in c.digest(df).collect()}
    want = {1: [("", "no role"), ("user", ""), ("assistant", "")], 2: [("tool ]x", rows[3][3])] * 2, None: [("assistant", "lost")], 7: [(r[2], r[3]) for r in rows if r[0] == 7], 8: [("assistant", rows[-1][3])]}
    assert got == expected(want)
    assert c.digest(df.where("false")).count() == 0
    full = {r["conv_id"]: r for r in c.format_conversations(df).collect()}
    assert [full[1]["formatted"][a:z] for a, z in full[1]["loss_mask"]] == [""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x]=", ""]), st.text(st.sampled_from("<>/s[]INSTA\\ \n"), max_size=20)), max_size=6))
def test_round_trip(messages):
    text, spans, rewrites = c.locate(messages, c.template)
    assert not rewrites and c.read_back(text, spans)[0] == messages


def test_rewriting_template_is_found(spark):
    only_last = lambda ms: "".join(f"{r}: {t if k == len(ms) - 1 else '...'}\n" for k, (r, t) in enumerate(ms))
    assert c.locate([("user", "hello"), ("assistant", "hi")], only_last)[2]
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", "one")], "conv_id long, turn int, role string, text string")
    assert {r["conv_id"]: (r["rewrites"], r["loss_mask"]) for r in c.format_conversations(df, only_last).collect()} == {1: (True, None), 2: (False, None)}


def test_rewriting_at_any_turn_is_found():
    plain = lambda ms: "".join(f"{r}: {t}\n" for r, t in ms)
    once = lambda ms: plain(ms) if len(ms) != 300 else "x" + plain(ms)
    for n in (301, 512):
        messages = [("user", str(k)) for k in range(n)]
        assert not c.locate(messages, plain)[2] and c.locate(messages, once)[2]


def test_every_prefix_is_rendered():
    seen = []
    messages = [("user", str(k)) for k in range(400)]
    c.locate(messages, lambda ms: seen.append(len(ms)) or c.template(ms))
    assert seen == list(range(1, 401))
