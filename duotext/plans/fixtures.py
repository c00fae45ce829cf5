"""Corpora derived from the given tables, in Spark and as SQL. Queries and oracles start from them.

``bitext``: user turns paired with the next assistant turn, tokenised, with links by rule.
``pseudo``: words of all turns with a pseudo-translation that EM can learn.
``catalogue``: a phrase table from part names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import none, point
from ..functions.text import tokenise, tokens
from ..scratch import written
from ..session import read_table


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src_raw"))
    a = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("tgt_raw"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("row_id"), "src_raw", "tgt_raw")


def rule_points(src: str = "src", tgt: str = "tgt"):
    ls, lt = F.size(src), F.size(tgt)
    n = F.least(ls, lt)
    i = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    more = F.filter(i, lambda x: (x % 5 == F.col("row_id") % 5) & (x + 1 < lt))
    return F.concat(none(), F.transform(i, lambda x: point(x, x)), F.transform(more, lambda x: point(x, x + 1)))


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_pairs(spark, sf_dir)
    # Written after each step: the next one's lambdas then read columns instead of repeating the step.
    out = written(raw.withColumn("src", tokens(tokenise(F.col("src_raw")))).withColumn("tgt", tokens(tokenise(F.col("tgt_raw")))), "bitext-tokens")
    out = out.select(
        (F.col("row_id") % 3).alias("project_id"), "row_id", "src_raw", "tgt_raw", "src", "tgt", rule_points().alias("points"),
        F.when(F.col("row_id") % 13 != 0, (F.col("row_id") * 7919 % 1000) / 1000.0).alias("score"), (F.col("row_id") % 11 == 0).alias("deleted"),
    )
    return written(out, "bitext")


def pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    src = turns.select("row_id", words.alias("src")).where("size(src) > 0")
    same = lambda x: (F.col("row_id") % 7 == 0) | ((F.length(x) < 3) & (F.col("row_id") % 2 == 0))
    out = written(src, "pseudo-words").withColumn("tgt", F.transform("src", lambda x: F.when(same(x), x).otherwise(F.reverse(x))))
    return written(out.withColumn("points", F.transform(F.sequence(F.lit(0), F.size("src") - 1), lambda i: point(i, i))), "pseudo")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    direction = F.when(F.col("p_partkey") % 5 == 0, -1).when(F.col("p_partkey") % 5 == 1, 1).otherwise(0)
    return part.groupBy(F.col("p_name").alias("src_phrase"), F.col("p_type").alias("tgt_phrase"), direction.alias("direction")).agg(F.count(F.lit(1)).alias("num_occurrences")).select(
        F.lit(0).cast("long").alias("project_id"), "src_phrase", "tgt_phrase", "direction", "num_occurrences", (F.length("src_phrase") % 7 == 0).alias("ignore")
    )


def words_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the first word as source: single-word phrases."""
    return catalogue(spark, sf_dir).withColumn("src_phrase", F.split_part("src_phrase", F.lit(" "), F.lit(1)))


def hidden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden entries from all part names: pairs, and sources for any target; most have a word more than
    any phrase, some differ in case, some repeat."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_partkey") % 17))).alias("p_name"), "p_type")
    tgt = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    src = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("project_id"), src.alias("src_phrase"), tgt.alias("tgt_phrase"))


# --- SQL -----------------------------------------------------------------------------------------

_CLASS = r"""['!"$%&\\().*+;@^`_|~\-\]\[}{<>?,/:=]"""


def sql_tokenise(x: str, symbols: str = _CLASS) -> str:
    cls = symbols.replace("'", "''")
    out = f"regexp_replace({x}, '[\\x20\\x09-\\x0D]', chr(2), 'g')"
    out = f"regexp_replace({out}, '({cls})', chr(1) || '\\1' || chr(1), 'g')"
    out = f"regexp_replace({out}, '[\\x01\\x02]*\\x02[\\x01\\x02]*', ' ', 'g')"
    out = f"regexp_replace({out}, '\\x01+', ' #NB ', 'g')"
    out = f"regexp_replace({out}, ' +', ' ', 'g')"
    return f"trim(regexp_replace({out}, '(^| )#NB ?$', ''))"


def sql_tokenise_query(x: str, symbols: str) -> str:
    """One character a token of each marker; neighbours of unlike kind cancel until none is left."""
    cls = symbols.replace("'", "''")
    parts = f"string_split(regexp_replace(nfc_normalize({x}), '({cls})', ' ' || chr(1) || ' \\1 ' || chr(1) || ' ', 'g'), ' ')"
    marked = f"list_transform({parts}, lambda y: case when trim(y) = '' then chr(2) else y end)"
    out = f"array_to_string({marked}, chr(3))"
    for _ in range(24):
        out = f"replace(replace(chr(3) || {out} || chr(3), chr(3) || chr(1) || chr(3) || chr(2) || chr(3), chr(3)), chr(3) || chr(2) || chr(3) || chr(1) || chr(3), chr(3))"
        out = f"trim({out}, chr(3))"
    out = f"replace(replace(replace({out}, chr(3), ' '), chr(1), '#NB'), chr(2), '#BLANK')"
    return f"case when trim({x}) = '' then '' else trim(regexp_replace({out}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) end"


def sql_detokenise(x: str) -> str:
    b = "[\\x20\\x09-\\x0D]*"
    return f"regexp_replace(regexp_replace({x}, '{b}#NB{b}', '', 'g'), '{b}#BLANK{b}', ' ', 'g')"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^((#NB|#BLANK)( |$))+', ''), '(( |^)(#NB|#BLANK))+$', '')"


def sql_points(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda p: p.s::varchar || '-' || p.t::varchar), ' ')"


SQL_RAW = """
raw_pairs as (
  select u.conv_id * 1000 + u.turn as row_id, u.text as src_raw, a.text as tgt_raw
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')"""

SQL_BITEXT = f"""{SQL_RAW},
toks as (
  select row_id, src_raw, tgt_raw, list_filter(string_split({sql_tokenise('src_raw')}, ' '), lambda x: x <> '') as src,
         list_filter(string_split({sql_tokenise('tgt_raw')}, ' '), lambda x: x <> '') as tgt
  from raw_pairs),
bitext as (
  select row_id % 3 as project_id, row_id, src_raw, tgt_raw, src, tgt,
    list_concat(list_transform(range(least(len(src), len(tgt))), lambda i: {{'s': i::int, 't': i::int}}),
      list_transform(list_filter(range(least(len(src), len(tgt))), lambda i: i % 5 = row_id % 5 and i + 1 < len(tgt)), lambda i: {{'s': i::int, 't': (i + 1)::int}})) as points,
    case when row_id % 13 <> 0 then (row_id * 7919 % 1000) / 1000.0::double end as score, row_id % 11 = 0 as deleted
  from toks)"""

SQL_PSEUDO = """
pseudo0 as (
  select conv_id * 1000 + turn as row_id,
         list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') as src
  from conversations),
pseudo as (
  select row_id, src, list_transform(src, lambda x: case when row_id % 7 = 0 or (length(x) < 3 and row_id % 2 = 0) then x else reverse(x) end) as tgt
  from pseudo0 where len(src) > 0)"""

SQL_CATALOGUE = """
catalogue as (
  select 0::bigint as project_id, p_name as src_phrase, p_type as tgt_phrase,
         case when p_partkey % 5 = 0 then -1 when p_partkey % 5 = 1 then 1 else 0 end as direction,
         count(*) as num_occurrences, length(p_name) % 7 = 0 as ignore
  from part group by all),
words_catalogue as (select project_id, split_part(src_phrase, ' ', 1) as src_phrase, tgt_phrase, direction, num_occurrences, ignore from catalogue),
hidden as (
  select p_partkey as id, 0::bigint as project_id, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as src_phrase,
         case when p_partkey % 2 = 0 then p_type else '' end as tgt_phrase
  from (select p_partkey, p_name || case when p_partkey % 17 = 0 then '' else ' ' || (p_partkey % 17)::varchar end as p_name, p_type from part))"""

#: Phrase pairs of the bitext: spans, projection, back-projection, texts; as extract_phrases gives them.
SQL_OCC = SQL_BITEXT + f""",
links as (select row_id, src, tgt, p.s as s, p.t as t from (select row_id, src, tgt, unnest(points) as p from bitext)),
spans as (select row_id, src, tgt, a as s0, a + k - 1 as s1 from (select row_id, src, tgt, k, unnest(range(len(src) - k + 1)) as a from bitext, (values (1), (2), (3)) v(k))),
proj as (select x.row_id, any_value(x.src) as src, any_value(x.tgt) as tgt, s0, s1, min(t) as t0, max(t) as t1
         from spans x join links l on l.row_id = x.row_id and l.s between x.s0 and x.s1 group by x.row_id, s0, s1),
ahead0 as (select p.row_id, any_value(p.src) as src, any_value(p.tgt) as tgt, p.s0, p.s1, p.t0, p.t1, min(l.s) = p.s0 and max(l.s) = p.s1 as agrees
          from proj p join links l on l.row_id = p.row_id and l.t between p.t0 and p.t1 group by p.row_id, p.s0, p.s1, p.t0, p.t1),
rspans as (select row_id, src, tgt, a as t0, a + k - 1 as t1 from (select row_id, src, tgt, k, unnest(range(len(tgt) - k + 1)) as a from bitext, (values (1), (2), (3)) v(k))),
rproj as (select x.row_id, any_value(x.src) as src, any_value(x.tgt) as tgt, t0, t1, min(s) as s0, max(s) as s1
         from rspans x join links l on l.row_id = x.row_id and l.t between x.t0 and x.t1 group by x.row_id, t0, t1),
back0 as (select p.row_id, any_value(p.src) as src, any_value(p.tgt) as tgt, p.s0, p.s1, p.t0, p.t1, min(l.t) = p.t0 and max(l.t) = p.t1 as agrees
          from rproj p join links l on l.row_id = p.row_id and l.s between p.s0 and p.s1 group by p.row_id, p.s0, p.s1, p.t0, p.t1),
texts as (select row_id, {sql_strip("array_to_string(src[s0 + 1 : s1 + 1], ' ')")} as src_phrase,
                 {sql_strip("array_to_string(tgt[t0 + 1 : t1 + 1], ' ')")} as tgt_phrase, 0 as direction, s0 as s_start, t0 as t_start, agrees from ahead0
          union all
          select row_id, {sql_strip("array_to_string(src[s0 + 1 : s1 + 1], ' ')")}, {sql_strip("array_to_string(tgt[t0 + 1 : t1 + 1], ' ')")}, -1, s0, t0, agrees from back0),
occ as (select row_id, src_phrase, tgt_phrase, direction, s_start, t_start from texts
        where agrees and regexp_matches(src_phrase, '^[^[:punct:]](.*[^[:punct:]])?$') and regexp_matches(tgt_phrase, '^[^[:punct:]](.*[^[:punct:]])?$')),
directed as (select row_id, src_phrase, tgt_phrase, case when direction = 0 and not agrees then 1 else direction end as direction, s_start, t_start from texts
        where (direction = 0 or not agrees) and regexp_matches(src_phrase, '[^[:punct:]\\s]') and regexp_matches(tgt_phrase, '[^[:punct:]\\s]')),
by_row as (select src_phrase, tgt_phrase, row_id, max(direction) as direction, count(*) as k from occ group by all),
counts as (select src_phrase, tgt_phrase, max(direction) as direction, count(*) as num_occurrences, sum(k)::bigint as num_emissions from by_row group by 1, 2)"""

#: The translation table of a relation of phrases.
def sql_table(source: str, name: str = "tab", split: bool = True, top_k: int = 10, where: str = "true") -> str:
    direction = "direction::varchar" if split else "'all'"
    return f"""
{name}_pairs as (select {direction} as direction, trim(src_phrase) as src, trim(tgt_phrase) as tgt, sum(num_occurrences)::bigint as c
  from {source} where num_occurrences > 0 and trim(src_phrase) <> '' and trim(tgt_phrase) <> '' and {where} group by all),
{name}_ranked as (select *, row_number() over (partition by direction, src order by c desc, tgt) as rank, sum(c) over (partition by direction, src)::bigint as total from {name}_pairs),
{name} as (select direction, src, any_value(total) as total, max(tgt) filter (where rank = 1) as top_tgt, max(c) filter (where rank = 1) as top_count,
  max(c) filter (where rank = 1) / any_value(total)::double as top_share, count(*) as num_tgts,
  round(ln(any_value(total)::double) - sum(c * ln(c::double)) / any_value(total), 6) + 0.0 as entropy,
  string_agg(tgt || '(' || c || ')', '|' order by rank) filter (where rank <= {top_k}) as topk
  from {name}_ranked group by direction, src)"""
