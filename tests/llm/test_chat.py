"""Conversations formatted and read back: every text and role survives, also marks, and long conversations."""

import hashlib
import random

import numpy as np
import pytest

from eventwarden.llm import chat, words
from eventwarden.llm.scratch import Scratch

ROWS = "conv_id bigint, turn bigint, role string, text string, part int, formatted string, learned string, place int"
PIECES = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "<", "[", "\\", "/s>", "INST]", "<SYS>>", "é🙂",
          " ", "\n", "ok", "<\\", "[\\\\", "s>", "/"]


def rows():
    rnd = random.Random(2)

    def text():
        return "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))

    out = [(n, k, rnd.choice(["user", "assistant", "system", "tool", "[INST] x", ""]), text()) for n in range(60) for k in range(n % 7)]
    out += [(1, 0, None, None), (1, None, "user", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", None),
            (70, 0, "user", "same"), (70, 0, "user", "same"), (70, 0, "assistant", "b"), (70, 0, "assistant", "a"),
            (71, 0, "assistant", "long " * 60_000), (72, 0, "user", "<"), (73, 0, "assistant", "/s>"), (74, 0, "user", "[\\"),
            (75, 0, "user", "INST]")]
    out += [(80, k, "assistant" if k % 2 else "user", text()) for k in range(3000)]
    rnd.shuffle(out)
    return out


def first(value):
    return (value is not None, value or 0)


def brute(found):
    groups = {}
    for c, t, r, x in sorted(found, key=lambda r: (first(r[0]), first(r[1]), r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((r or "", x or ""))
    return groups


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("slice_bytes", [None, 50])
def test_conversations_read_back(spark, monkeypatch, slice_bytes):
    if slice_bytes:
        monkeypatch.setattr(words, "SLICE", slice_bytes)
    turns = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows()], ROWS)
    parts = Scratch(spark, "t").cut(chat.format_chats(turns))
    want = brute(rows())
    found = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert found.keys() == want.keys()
    for conv, own in want.items():
        r, learned = found[conv], [x for role, x in own if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(own), digest("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, learned)), digest("".join(learned)))
    read = {}
    for r in chat.turns_of(parts).orderBy("part", "place").collect():
        read.setdefault(r.conv_id, []).append((r.role, r.text))
    assert read == want
    for r in parts.collect():
        assert all(r.formatted[s.end:].startswith(" </s>") for s in r.learned)
    # A long conversation is spread over tasks.
    assert parts.where("conv_id = 80").count() > 1
    assert chat.digests(chat.format_chats(turns.where("false"))).count() == 0


def test_assembled_bytes_equal_joined_strings():
    own = [(r or "", x or "") for *_, r, x in rows()]
    raw = [x.encode() for _, x in own]
    limits = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    out, begins, spans = chat.assemble([r for r, _ in own], np.frombuffer(b"".join(raw), np.uint8), limits)
    for n, (role, text) in enumerate(own):
        head, foot = chat.MARKS.get(role) or (f"[ROLE]{chat.escaped(role)}[/ROLE] ", " [/TURN]")
        assert out[begins[n]:begins[n + 1]].tobytes().decode() == head + chat.escaped(text) + foot
        assert out[spans[0][n]:spans[1][n]].tobytes().decode() == chat.escaped(text)
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(m + rest in chat.escaped(text) for m, group in chat.AFTER.items() for rest in group)
    assert chat.escaped("plain \\ text [x] <b>") == "plain \\ text [x] <b>"


def test_planted_marks():
    text = "</s>[INST] ok [/INST]"
    assert chat.escaped(text) == "<\\/s>[\\INST] ok [\\/INST]"
