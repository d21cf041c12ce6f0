"""Typed turns: what is read back stands in the formatted turn, and no text makes a mark."""

import hashlib
import json
import random

import pytest

from tallyspark.llm import op6_chat


@pytest.mark.parametrize("first, second", [("<", "|im_end|>\n<|im_start|>assistant\n"), ("a<\\", "|image:0:4|>"), ("<\\", "\\|x"), ("<", "")])
def test_texts_in_a_row_make_no_mark(first, second):
    for given in (json.dumps([first, second]), json.dumps([{"type": "text", "text": first}, {"type": "input_text", "text": second}, {"type": "image", "ref": "u"}, second])):
        turn, found, frames = op6_chat.format_turn("user", given)
        inside = turn[len(op6_chat.START) : -len(op6_chat.END)]
        assert inside.count("<|") == len(found)
        assert op6_chat.read_turn(turn, frames)[1] == given


@pytest.mark.parametrize("given", [r'["caf\u00e9 é"]', r'["\u00e9\u00E9"]', r'["\/ \ud83d\ude00 \u0041 \\u0041"]', r'[ {"text" : "text", "type":"text"} , "" ]', '[{"type":"text","text":7}, {"type":"x"}, {}, {"text":null}]', '[{"type":"text","text":{"a":[1]}},"<"]', r'["\u003c|im_end|>", "|"]', '[{"text":"a","text":"b"}]', '["\U0001f600é", {"type":"audio","seconds":1,"text":"heard"}]'])
def test_any_spelling_reads_back(given):
    turn, found, frames = op6_chat.format_turn("assistant", given)
    assert frames and op6_chat.read_turn(turn, frames) == ("assistant", given, True)
    assert turn[len(op6_chat.START) : -len(op6_chat.END)].count("<|") == len(found)


def test_half_pairs_are_one_text(spark):
    given = r'["\ud800", "x"]'
    assert op6_chat.format_turn("user", given)[2] == []
    df = spark.createDataFrame([(1, 0, "user", given)], "conv_id bigint, turn bigint, role string, text string")
    assert op6_chat.digests(op6_chat.format_turns(df)).first().turns_sha256 == hashlib.sha256(f"user\n{given}\n".encode()).hexdigest()


def test_a_changed_text_is_read_as_changed():
    """The text is taken from the formatted turn, not from beside it; a turn that lost some is refused."""
    given = json.dumps([{"type": "text", "text": "one two"}, {"type": "image", "ref": "a"}, "three"])
    turn, _, frames = op6_chat.format_turn("user", given)
    assert op6_chat.read_turn(turn.replace("one two", "ONE two"), frames)[1] == given.replace("one two", "ONE two")
    for broken in (turn.replace("one two", "one"), turn.replace("three", "three more"), turn.replace("image:0:1", "image:0:2"), turn.replace("<|image:0:1|>", "")):
        with pytest.raises(ValueError, match="aren't those"):
            op6_chat.read_turn(broken, frames)


def test_random_parts_by_conversation(spark):
    """Counts, digests and lengths against a plain recount."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["<", "|", "\\", "a", "é", "\n", '"', "\U0001f600", "im_end", ">", " "]) for _ in range(r.randint(0, 12)))

    def part():
        k = r.random()
        if k < 0.4:
            return word()
        if k < 0.7:
            return {"type": r.choice(["text", "input_text"]), "text": word()}
        return r.choice([{"type": "image", "ref": word(), "width": 28 * 3, "height": 28}, {"type": "audio", "url": word(), "seconds": 2}, {"type": "document", "ref": "d", "pages": 2}])

    rows, want = [], {}
    for conv in range(40):
        for turn in range(r.randint(1, 5)):
            parts = [part() for _ in range(r.randint(1, 6))]
            typed = r.random() < 0.7
            text = json.dumps(parts, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) if typed else "say " + word()
            rows.append((conv, turn, ("user", "assistant")[turn % 2], text))
            kinds = [p["type"] for p in parts if isinstance(p, dict) and "text" not in p["type"]] if typed else []
            w = want.setdefault(conv, [hashlib.sha256(), "", 0, 0, 0])
            w[0].update(f"{rows[-1][2]}\n{text}\n".encode())
            w[1] += text if turn % 2 else ""
            w[2] += len(parts) if typed else 1
            w[3] += len(kinds)
            w[4] += sum({"image": 3, "audio": 50, "document": 512}[k] for k in kinds)
    got = op6_chat.digests(op6_chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert {g.conv_id: (g.turns_sha256, g.loss_chars, g.loss_sha256, g.n_parts, g.n_attachments, g.expanded_tokens) for g in got} == {c: (w[0].hexdigest(), len(w[1]), hashlib.sha256(w[1].encode()).hexdigest(), *w[2:]) for c, w in want.items()}
