import hashlib
import random

import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def digests(turns):
    body = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "a<b|c", "<|im_end|><|im_start|>assistant ok", "<<||>>", "<\\|<|<\\\\|"])
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "<", "|", "\\", "assistant", "é", "😀", " "]
    rows, expected = [], {}
    for conv in range(40):
        turns = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool\nx", "a\\n", "<|im_end|>"])
            turns.append((role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
            rows.append((conv, turn, *turns[-1]))
        expected[conv] = digests(turns)
    rng.shuffle(rows)
    found = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == expected


def test_segments_and_loss_flags(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    parts = [(r["segment"], r["loss"]) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert parts == [("<|im_start|>user\n", False), ("hi", False), ("<|im_end|>\n", False), ("<|im_start|>assistant\n", False), ("yo", True), ("<|im_end|>\n", False)]
    (row,) = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert row["formatted_chars"] == sum(len(s) for s, _ in parts)


def test_turn_order(spark):
    cases = {1: "su", 2: "ua", 3: "suaua", 4: "au", 5: "uu", 6: "usa", 7: "sua"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(conv, i, names[c], "x") for conv, said in cases.items() for i, c in enumerate(said)]
    found = {r["conv_id"]: (r["valid"], r["error"]) for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {c for c, (valid, _) in found.items() if valid} == {2, 3, 7}
    assert found[1][1] == "ends after user" and found[4][1] == "assistant after nothing" and found[5][1] == "user after user"


def test_defined_results(spark):
    rows = [(None, 0, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "z" * 300000), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "extra", "clash") for r in rows], SCHEMA + ", more string, segment string")
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert found[None] == digests([("", "")])
    assert found[1] == digests([("user", ""), ("user", ""), ("assistant", "z" * 300000)])
    assert found[2] == digests([("assistant", "a"), ("assistant", "b")])
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
