"""The template compiler and formatted conversations."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import chat, queries

HARD = queries.HARD_TEXT


def test_constants_fold_away():
    compiler = chat.Compiler(chat.CONTROLS)
    tree = compiler.fold_block(chat.parse("a{{ 'b' ~ 'c' | upper }}{% if 'x' == 'y' %}never{% elif not false %}d{% else %}e{% endif %}"))
    assert tree == (chat.Emit(chat.Const("abC")), chat.Emit(chat.Const("d")))
    assert compiler.fold(chat.Expression("true and message.text").whole()) == chat.Name("message.text")
    assert compiler.fold(chat.Expression("message.role == 'a' ~ 'b'").whole()) == chat.Apply("==", (chat.Name("message.role"), chat.Const("ab")))


def test_language():
    source = "{% set who = message.role | upper %}{{ who }}>{% generation %}{{ message.text | trim }}{% endgeneration %}{% if message.text != '' and who %}!{% endif %}"
    assert chat.compile_template(source)("user", " é ") == ("USER>é!", [(5, 6)])
    assert chat.compile_template(source)("user", "") == ("USER>", [(5, 5)])


@pytest.mark.parametrize("source", [
    "{% if message.text %}", "{% endif %}", "{% else %}", "{{ message.text.real }}", "{{ message['text'] }}", "{{ open('x') }}", "{{ 'a' | system }}",
    "{{ }}", "{{ 'a' 'b' }}", "{% for x in y %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ (1 }}", "{% import os %}",
])
def test_nothing_else_compiles(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "", "=x", "Assistant", "a: b", "</turn>"]), st.text(alphabet="\\# :<>/turn\né", max_size=30))
def test_any_turn_reads_back(role, text):
    made, spans = chat.compile_template()(role, text)
    assert chat.turn_reader()(made) == [(role, text)]
    assert [chat.unescape(made[a:b]) for a, b in spans] == ([text] if role == "assistant" else [])


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 200)
    draw = random.Random(1)
    rows = [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD), (None, 0, "assistant", "no id"), (5, None, "user", "no turn"), (5, 1, None, None), (6, 0, "assistant", None)]
    rows += [(1, k, draw.choice(["user", "assistant", "tool"]), draw.choice(["", HARD, "é" * 500, "\\", "a <turn> b"])) for k in range(300)]
    rows += [(2, 0, "assistant", "twice"), (2, 0, "assistant", "twice"), (2, 0, "assistant", "also"), (3, 0, "user", "long " * 40_000)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, mask string, part int").repartition(5)
    parts = chat.format_conversations(turns)
    kept = parts.collect()
    assert Counter(r.conv_id for r in kept)[1] > 50 and parts.columns == ["conv_id", "part", "text", "mask"]
    got = {r.conv_id: r for r in chat.read_digests(parts).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, row in got.items():
        assert tuple(row)[1:5] == digests(want[conv])
        assert row.formatted_chars == sum(len(r.text) for r in kept if r.conv_id == conv)
    empty = turns.limit(0)
    assert chat.format_conversations(empty).collect() == [] and chat.read_digests(chat.format_conversations(empty)).collect() == []
