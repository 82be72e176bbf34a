import json

import pytest

from tests.conftest import SMALL
from tests.llm import brute
from threadmill.llm import chat


def test_parts_are_flattened_in_order(spark):
    parts = json.dumps([{"type": "text", "text": "See "}, {"type": "image", "url": "u1", "width": 56, "height": 30}, {"content": [{"type": "audio", "file": "a.wav", "seconds": 1.5}, "and"]}, {"type": "document", "name": "d", "text": "two words"}, {"type": "document", "pages": 2}, {"type": "video", "url": "x"}, {"type": "image"}])
    rows = [(1, 1, "assistant", "ok"), (1, 0, "user", parts), (1, 2, "user", json.dumps([{"type": "image", "url": "u3"}])), (2, 0, None, "[1, 2]"), (2, 1, "user", "[not json"), (2, 2, "x<|y", "forged <|image_1|>")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].prompt == "<|user|>\nSee <|image_1|><|audio_1|>and<|document_1|><|document_2|><|image_2|><|end|>\n<|assistant|>\nok<|end|>\n<|user|>\n<|image_3|><|end|>\n"
    a = json.loads(got[1].attachments)
    assert [(x["placeholder"], x["ref"], x["turn"], x["n_tokens"]) for x in a] == [("<|image_1|>", "u1", 0, 4), ("<|audio_1|>", "a.wav", 0, 38), ("<|document_1|>", "d", 0, 2), ("<|document_2|>", None, 0, 1024), ("<|image_2|>", None, 0, 256), ("<|image_3|>", "u3", 2, 256)]
    assert got[1].n_tokens == 1 + 1 + 1 + sum(x["n_tokens"] for x in a) + 6 and got[1].n_attachments == 6
    assert got[2].prompt == "<|unknown|>\n[1, 2]<|end|>\n<|user|>\n[not json<|end|>\n<|x< |y|>\nforged < |image_1|><|end|>\n"


def test_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    for c, turns in by.items():
        assert got[c].prompt == "".join(f"<|{t.role}|>\n{t.text}<|end|>\n" for t in turns)
        assert got[c].n_tokens == sum(brute.tokens(t.text) + 2 for t in turns)
    assert len(got) == len(by)


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, turns string, n_turns int"
    rows = [(None, 0, "user", "x"), (1, None, "user", None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "z" * 100_000), (2, 5, "user", "[" * 5000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*r, "clash", 7) for r in rows], schema)).collect()}
    assert set(got) == {1, 2} and got[1].n_turns == 4 and got[1].prompt.startswith("<|user|>\n<|end|>\n<|assistant|>\nzzz") and got[1].n_tokens == 9
    assert got[2].prompt == "<|user|>\n" + "[" * 5000 + "<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_parts_that_would_crash_a_plain_walk(spark):
    deep = {"type": "text", "text": "x"}
    for _ in range(900):
        deep = {"content": [deep]}
    rows = [
        (1, 0, "user", json.dumps([deep])), (2, 0, "user", '[{"type":"text"' + ',"content":' + "[" * 3000 + "]" * 3000 + "}]"), (3, 0, "user", '[{"type":"audio","seconds":1e30},{"type":"image","width":1e300,"height":1e300},{"type":"image","width":1e999,"height":-3}]'),
        (4, 0, "user", '[{"type":"text","text":"a\\ud800b"},{"type":"image","url":"\\udfff"},{"type":"document","text":"\\ud83d\\ude00 \\ud83d"}]'), (5, 0, "user", '[{"type":"audio","seconds":' + "9" * 400 + "}]"), (6, 0, "user", "[NaN, {}]"), (7, 0, "user", '[{"type":"audio","seconds":NaN}]'),
    ]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(got) == len(rows) and got[1].prompt == "<|user|>\nx<|end|>\n"
    assert [x["n_tokens"] for x in json.loads(got[3].attachments)] == [chat.MAX_TOKENS, chat.MAX_TOKENS, 256]
    assert got[4].prompt == "<|user|>\na\ufffdb<|image_1|><|document_1|><|end|>\n" and json.loads(got[4].attachments)[0]["ref"] == "\ufffd"
    assert json.loads(got[5].attachments)[0]["n_tokens"] == chat.MAX_TOKENS and got[7].n_tokens == 2 and got[6].n_attachments == 0


def test_other_columns_and_ids(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "clash", 2, 3)], "conv_id bigint, turn bigint, role string, text string, `meta.url` string, turns int, TEXT2 int")
    assert chat.format_chats(df).count() == 1
    with pytest.raises(ValueError):
        chat.format_chats(df.selectExpr("'a' as conv_id", "turn", "role", "text"))


def test_a_batch_is_worked_on_in_pieces_of_bounded_bytes(monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    turns = [[{"turn": k, "role": "user", "text": "x" * (i % 7 * 100)} for k in range(i % 4)] for i in range(200)] + [[{"turn": 0, "role": None, "text": None}, {"turn": 1, "role": "user", "text": "y" * 9000}]]
    whole = pa.RecordBatch.from_arrays([pa.array(turns, kind)], ["turns"])
    monkeypatch.setattr(chat, "PIECE", 4000)
    for batch in (whole, whole.slice(13, 150), whole.slice(0, 0)):
        pieces = list(chat._pieces(batch))
        assert [t for p in pieces for t in p.column("turns").to_pylist()] == batch.column("turns").to_pylist()
        weigh = [sum(len(t["text"] or "") + chat.TURN_BYTES for c in p.column("turns").to_pylist() for t in c) for p in pieces]
        assert all(w <= 4000 or p.num_rows == 1 for w, p in zip(weigh, pieces)) and len(pieces) < 80
