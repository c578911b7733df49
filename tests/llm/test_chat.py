import hashlib

from hypothesis import given
from hypothesis import strategies as st

from rampart.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", MARKS), (1, 2, "assistant", MARKS), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "more"),
    (2, 0, "user", "nobody answers"), (3, 0, "assistant", "\\"), (3, 1, "assistant", "</turn>\n### assistant: x</turn>\n"),
    (4, 7, None, None), (4, None, "user", "first"), (5, 2, "a: b</turn>\n### c", "odd role"), (5, 3, "assistant", "日本 🎉"),
    (6, 0, "user", "same"), (6, 0, "user", "same"), (6, 1, "assistant", "twice"), (6, 1, "assistant", "twice"), (None, 0, "assistant", "no id"),
    (8, 0, "user", "x" * 100_000), (8, 1, "Assistant", "another role"),
]


def escaped(x, marks):
    return "".join("\\" + {"#": "h", "<": "l", ":": "c"}.get(c, c) if c in marks else c for c in x)


def plain(rows):
    """Per conversation the texts of all examples, and the digests."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[2] or "", r[3] or "", r[1]) for r in rows if r[0] == conv), key=lambda t: (t[2] is not None, t[2] or 0, t[0]))
        line, examples, replies = "", [], []
        for n, (role, text, _) in enumerate(turns):
            line += f"### {escaped(role, chr(92) + '#<:')}: {escaped(text, chr(92) + '#<')}</turn>\n"
            if role == "assistant":
                replies.append(text)
            if role == "assistant" or n == len(turns) - 1:
                examples.append(line)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        digest = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _ in turns)), len("".join(replies)), sha("".join(replies)), sum(map(len, examples)), len(examples))
        out[conv] = examples, digest, replies
    return out


def test_digests_equal_a_plain_version(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as segment", "2 as tie", "3 as _conv")
    got = {r[0]: tuple(r[1:]) for r in chat.digests(df).collect()}
    assert got == {k: v[1] for k, v in plain(ROWS).items()}


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    written = chat.turns(spark.createDataFrame(ROWS, SCHEMA))
    got = {}
    for r in chat.rendered(written, chat.examples(written)).orderBy("conv_id", "example").collect():
        assert len(r.text) == r.chars and r.text.count("### ") == r.text.count("</turn>") == r.n_turns
        got.setdefault(r.conv_id, []).append((r.text, None if r.loss_start is None else r.text[r.loss_start : r.loss_stop]))
    want = plain(ROWS)
    assert {k: [t for t, _ in v] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: [chat.unescaped(t) for _, t in v if t is not None] for k, v in got.items()} == {k: v[2] for k, v in want.items()}


def test_long_conversations_are_summed_up_in_slices(spark, monkeypatch):
    rows = [(1, i if i % 11 else None, "assistant" if i % 3 == 1 else "user", f"turn {i}") for i in range(200)]
    want = [tuple(r) for r in chat.examples(chat.turns(spark.createDataFrame(rows, SCHEMA))).orderBy("example").collect()]
    monkeypatch.setattr(chat, "SLICE", 7)
    got = [tuple(r) for r in chat.examples(chat.turns(spark.createDataFrame(rows, SCHEMA))).orderBy("example").collect()]
    assert got == want and got[-1][3] == len(plain(rows)[1][0][-1])


def test_sample(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in chat.digests(df).collect()} == {k: v[1] for k, v in plain(rows).items()}


def test_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.text(st.sampled_from("\\#<:/turn> \n🎉")), st.text(st.sampled_from("\\#<:/turn> \n🎉")))
def test_marks_inside_texts_come_back(role, text):
    segment = f"### {escaped(role, chr(92) + '#<:')}: {escaped(text, chr(92) + '#<')}</turn>\n"
    assert chat.parsed(segment) == (role, text) and segment.count("</turn>") == segment.count("### ") == 1


def test_examples_are_written_out_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)  # some examples are several rows
    written = chat.turns(spark.createDataFrame(ROWS, SCHEMA))
    got = {}
    for r in chat.expanded(written).collect():
        got.setdefault((r.conv_id, r.example), []).append(r)
    whole = {k: ("".join(r.text for r in v), v[0].chars, v[0].loss_start, v[0].loss_stop) for k, v in got.items()}
    want = {(r.conv_id, r.example): (r.text, r.chars, r.loss_start, r.loss_stop) for r in chat.rendered(written, chat.examples(written)).collect()}
    assert whole == want and any(len(v) > 1 for v in got.values())
