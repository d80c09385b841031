"""Layouts of JSON records and of tables, long texts, ties and clashing columns."""

import hashlib
import json
import random

import pytest

from seqloom.llm import chat

U, A, S = ("user", "q?"), ("assistant", "a!"), ("system", "s")
RECORDS = [
    ({"prompt": "q?", "response": "a!"}, [U, A]),
    ({"prompt": "q?", "completion": "a!"}, [U, A]),
    ({"system": "s", "prompt": "q?", "response": "a!"}, [S, U, A]),
    ({"instruction": "q?", "output": "a!"}, [U, A]),
    ({"instruction": "q?", "input": "x", "output": "a!"}, [("user", "q?\n\nx"), A]),
    ({"instruction": "q?", "input": "", "output": "a!"}, [U, A]),
    ({"question": "q?", "answer": "a!"}, [U, A]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q?"}, {"role": "assistant", "content": "a!"}]}, [S, U, A]),
    ({"conversations": [{"from": "human", "value": "q?"}, {"from": "gpt", "value": "a!"}]}, [U, A]),
    ({"turns": [{"role": "user", "text": "q?"}, {"role": "assistant", "text": "a!"}]}, [U, A]),
]
EXTRA = {"id": 7, "meta": {"source": "web", "tags": ["x"]}, "name": None}
UNKNOWN = [{"foo": "bar"}, {"prompt": "only"}, {"messages": []}, {"messages": "text"}, ["list"], 5]


def test_every_layout_with_and_without_other_fields(spark):
    assert len({tuple(sorted(r)) for r, _ in RECORDS}) == len(chat.LAYOUTS) == 9
    rows = [(i, json.dumps(r), "t") for i, (r, _) in enumerate(RECORDS)]
    rows += [(100 + i, json.dumps(EXTRA | r), "t") for i, (r, _) in enumerate(RECORDS)]
    rows += [(200, json.dumps({"messages": [{"role": "user", "content": "q?", "name": "n"}, {"role": "assistant", "content": None}]}), "t")]
    rows += [(300 + i, json.dumps(r), "t") for i, r in enumerate(UNKNOWN)] + [(400, "{not json", "t"), (401, None, "t")]
    got = {r.conv_id: r for r in chat.turns_of_records(spark.createDataFrame(rows, "conv_id long, payload string, turns string")).collect()}
    for i, (_, want) in enumerate(RECORDS):
        assert [tuple(x) for x in got[i].turns] == want == [tuple(x) for x in got[100 + i].turns]
        assert got[i].layout == got[100 + i].layout is not None and got[i].unread is None
    assert [tuple(x) for x in got[200].turns] == [U, ("assistant", None)]
    for i, text in [(k, p) for k, p, _ in rows if k >= 300]:
        assert (got[i].turns, got[i].layout, got[i].unread) == ([], None, text)


def test_table_layouts(spark):
    other = spark.createDataFrame([(1, 0, "user", "q?", 9), (1, 1, "assistant", "a!", 9)], "conversation_id long, position long, role string, content string, turn int")
    assert [(r.conv_id, [tuple(x) for x in r.turns]) for r in chat.turns_of_table(other).collect()] == [(1, [U, A])]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, "x")], "a long, b string"))


def test_digest_against_plain_python(spark):
    """Long texts, ties, repeated rows and columns of other names."""
    r = random.Random(1)
    marks = ["<|turn|>", "<|end|>\n", "\\", "[INST]", "</s>", "é", "\n", "x", "<", "[", "\\l"]
    rows = [(i % 7, i % 3, r.choice(["user", "assistant", "system", None]), None if i == 4 else "".join(r.choice(marks) for _ in range(r.randint(0, 30))), "v", "f") for i in range(60)]
    rows += [(50, 0, "assistant", "<|end|>\n y" * 30_000, "v", "f"), (50, 1, "assistant", "", "v", "f"), rows[0]]
    got = {x.conv_id: x for x in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, v string, formatted string")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {x[0] for x in rows}:
        turns = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        loss = "".join(t for _, who, t in turns if who == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), sha("".join(f"{who}\n{t}\n" for _, who, t in turns)), len(loss), sha(loss))
    assert set(got) == {x[0] for x in rows} | {-7}
    empty = chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [(x.conv_id, x.n_turns) for x in empty] == [(-7, 2)]
