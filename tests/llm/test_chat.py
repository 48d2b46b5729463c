import random

import pytest

from quirespark.llm import chat


def brute(rows, template=chat.CHATML):
    """{id: (turns, trained text, blocks)} by a plain loop."""
    found = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, chat_key(r[2]), chat_key(r[3]))):
        turns, loss, blocks = found.setdefault(i, ([], [], []))
        turns.append((role or "", text or ""))
        if role in template.trained:
            loss.append(text or "")
        if not blocks or blocks[-1] != (role or ""):
            blocks.append(role or "")
    return {i: (turns, "".join(loss), len(blocks)) for i, (turns, loss, blocks) in found.items()}


def chat_key(text):
    return (text or "").encode()


def test_round_trip(spark):
    rng = random.Random(3)
    parts = [*chat.CHATML.control, "\\", "\\\\", "<", "[", "|>", "/s>", "ü", "𝄞", "\n", "im_end", "INST]", " "]
    text = lambda: rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])
    rows = [(i % 40 or None, rng.randint(0, 9), rng.choice(["user", "assistant", "assistant", "system", None, "a\n<|im_sep|>"]), text()) for i in range(600)]
    rows += [(99, i, "assistant", "𝄞" * rng.randint(0, 3000)) for i in range(1500)] + [rows[0]] * 3 + [(98, None, "user", "x")]
    turns = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id int, turn int, role string, text string, formatted int, loss string").repartition(3)
    formatted = chat.format_chats(turns)
    found = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    want = brute(rows)
    assert set(found) == set(want)
    for i, (own, loss, n_blocks) in want.items():
        assert ([tuple(t) for t in found[i]["turns"]], found[i]["loss_text"]) == (own, loss)
        assert found[i]["formatted"].count(chat.CHATML.opening) == found[i]["formatted"].count(chat.CHATML.closing) == n_blocks
        assert not any(c in found[i]["formatted"] for c in chat.CHATML.others)
    for r in formatted.collect():
        assert all(chat.CHATML.opening not in r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"])


def test_running_sums(spark):
    lengths = [[], [3], list(range(chat.CHUNK)), [1] * (3 * chat.CHUNK + 1)]
    df = spark.createDataFrame([(x,) for x in lengths], "x array<long>").select("x", chat.running_sums(chat.F.col("x")).alias("s"))
    for x, s in df.collect():
        assert s == [sum(x[: i + 1]) for i in range(len(x))]


def test_templates():
    with pytest.raises(ValueError):
        chat.ChatTemplate(opening="[INST]")
    with pytest.raises(ValueError):
        chat.ChatTemplate(others=("<s", "<s>"))
    with pytest.raises(ValueError):
        chat.ChatTemplate(others=("x<",))


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert chat.read_chats(chat.format_chats(turns)).collect() == []
