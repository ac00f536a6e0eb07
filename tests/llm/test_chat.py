import random

import pytest
from brute import sha

from lakestrata.llm.chat import chat_tree, digests, escape, format_turn, read_back, read_turns, shared_depth, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</s>[INST] ok [/INST]", "<s>[user]x</s>", "\\", "\\\\<", "[\\]", "a\nb", "é😀<", "]", "x" * 50_000]


def sample(seed):
    random.seed(seed)
    rows = []
    for i in range(60):
        for t in range(random.randrange(1, 6)):
            text = random.choice(["hello", "hi", "tell me more", random.choice(ODD[:9])]) if t < 3 else f"own {i}"
            rows.append((i, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(100, k, random.choice(["user", "assistant", "sys[tem]", "<s>"]), text) for k, text in enumerate(ODD)]
    rows += [(101, 0, None, None), (101, 1, "assistant", None), (None, 0, "user", "null id"), (102, 0, "user", "twice"), (102, 0, "user", "twice")]
    return rows + [(103, None, "user", "no number"), (103, 0, "assistant", "first")]


def ordered(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(own)] for conv, own in found.items()}


def expected(rows):
    out = []
    for conv, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), sha(said), len(loss), sha(loss), sum(len(format_turn(r, t)[0]) for r, t in turns)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", path int, node string").repartition(4)
    found = digests(read_back(*chat_tree(df)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_shared_turns_once_depth_first_with_intervals(spark):
    rows = sample(3)
    stream, index = chat_tree(spark.createDataFrame(rows, SCHEMA).repartition(4))
    nodes = sorted(stream.collect(), key=lambda r: r.offset)
    prefixes = {tuple(turns[: k + 1]) for turns in ordered(rows).values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes)
    at, stack = 0, []
    for n in nodes:
        assert n.offset == at and n.length == len(n.text)
        at += n.length
        stack = stack[: n.depth]  # in a depth-first order the ancestors are the last nodes of each smaller depth
        assert [(a.begin, a.end) for a in n.ancestors] == [(m.offset, m.offset + m.length) for m in stack]
        assert n.position == sum(m.length for m in stack)
        stack.append(n)
    by_offset = {n.offset: n for n in nodes}
    for r in index.collect():
        said = "".join(by_offset[x.begin].text for x in r.intervals)
        assert read_turns(said) == ordered(rows)[r.conv_id]


def test_a_conversation_that_all_have_in_common(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"common {t}") for i in range(300) for t in range(4)] + [(i, 4, "user", f"{i}") for i in range(0, 300, 7)]
    stream, index = chat_tree(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert stream.count() == 4 + 43 and index.count() == 300
    assert sorted((tuple(r) for r in digests(read_back(stream, index)).collect()), key=repr) == expected(rows)


def test_empty_table(spark):
    stream, index = chat_tree(spark.createDataFrame([], SCHEMA))
    assert stream.collect() == [] and index.collect() == [] and digests(read_back(stream, index)).collect() == []


@pytest.mark.parametrize("text", ODD)
def test_escape(text):
    assert unescape(escape(text)) == text
    said, begin, end = format_turn("assistant", text)
    assert read_turns(said) == [("assistant", text)] and unescape(said[begin:end]) == text
    assert not any(x in escape(text).replace("\\\\", "").replace("\\<", "").replace("\\[", "") for x in "<[")


def test_shared_depth():
    a, b = bytes(range(64)), bytes(range(32)) + bytes(32)
    assert shared_depth(a, a) == 4 and shared_depth(a, b) == 2 and shared_depth(a, a[:16]) == 1 and shared_depth(a, b"") == 0
