from __future__ import annotations

import pytest

from duotext.llm.chat import FILTERS, TEMPLATE, format_conversations, read_back, unescape
from duotext.llm.template import TemplateError, compile_template, fold, parse

HARD = ["", "\\", "\\\\#<", "</turn>\n### user: x", "a: b", "### ", "<|\\", "é😀\n", "\\n", "#" * 300 + "<"]


def test_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ["user", "assistant", "a: b\\", ""] for t in HARD)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert read_back(out.formatted) == [(r, t) for _, _, r, t in rows]
    loss = [unescape(out.formatted[s.start : s.end]) for s in out.loss_spans]
    assert loss == [t for _, _, r, t in rows if r == "assistant"]


def test_templates():
    render = compile_template("{% if 1 + 1 == 2 %}yes{% else %}no{% endif %}{{ 'a' + 'b' | upper }}{% for m in ms %}[{{ m.x }}{% if not m.y or m.y == 'q' %}!{% elif m.y != 'z' %}?{% endif %}]{% endfor %}", FILTERS)
    assert render(ms=[{"x": 1, "y": ""}, {"x": 2, "y": "k"}, {"x": 3, "y": "z"}])[0] == "yesaB[1!][2?][3]"
    assert fold(parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% endif %}d", FILTERS), FILTERS) == [("text", "abcd")]
    text, spans = compile_template("x{% generation %}{{ v }}{% endgeneration %}y", FILTERS)(v="é")
    assert (text, spans) == ("xéy", [(1, 2)])


@pytest.mark.parametrize("bad", ["{{ x.__class__() }}", "{{ __import__ }}", "{% for a %}{% endfor %}", "{% if x %}", "{{ x | nosuch }}", "{{ 'a }}", "{% macro %}", "{{ }}", "{{ 1 + 'a' }}"])
def test_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad, FILTERS)


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, "k"), (2, 1, "user", "b" * 200000, "k"), (2, 1, "user", "a", "k"), (2, 1, "user", "a", "k"), (2, 0, "assistant", None, "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: read_back(r.formatted) for r in format_conversations(df).collect()}
    assert out == {None: [("", "")], 2: [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b" * 200000)]}
    assert format_conversations(df.where("turn > 5")).count() == 0
    assert format_conversations(df.where("conv_id is null").union(df.where("conv_id is null"))).count() == 2
    assert TEMPLATE.count("generation") == 2
