"""Chat formatting: conversations rendered by a compiled template, with loss spans.

Each turn is ``### role: text</turn>`` and a line feed. Inside texts a backslash goes before every
backslash, ``#`` and ``<`` (inside roles also before ``:``), so control strings never occur in
them and :func:`read_back` recovers every turn exactly. Loss spans cover the texts of generation
blocks.

A conversation is one output row, so its turns meet in one task; conversations are spread by id.

Defined results: turns are ordered by turn, then role, then text, nulls first; null texts and roles
are empty; rows that repeat are turns of their own; a row without a conversation id is a conversation
of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

TEMPLATE = (
    "{% for turn in messages %}{{ '### ' }}{{ turn.role | label }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
FILTERS = {
    "escape": lambda s: re.sub(r"[\\#<]", r"\\\g<0>", s),
    "label": lambda s: re.sub(r"[\\#<:]", r"\\\g<0>", s),
    "trim": lambda s: s.strip(),
    "upper": lambda s: s.upper(),
}
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@cache
def _compiled(template: str):
    return compile_template(template, FILTERS)


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = _compiled(template)
        for batch in batches:
            made = [render(messages=turns) for turns in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in made], pa.string()), pa.array(spans, _SPANS)], ["conv_id", "formatted", "loss_spans"])

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans array<struct<start, end>>``."""
    rows = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # Rows without an id belong to nobody's conversation: each is one of its own, so none is unbounded.
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    return grouped.mapInArrow(_render(template), f"conv_id {dict(rows.dtypes)['conv_id']}, formatted string, loss_spans array<struct<start:long,end:long>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def query_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    done = format_conversations(turns.unionByName(extra))
    return done.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SQL_CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::bigint as formatted_chars
from c group by conv_id
"""
