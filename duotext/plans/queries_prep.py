"""Preparation, symmetrisation sets, scores and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import points as P
from ..functions import text as T
from ..operators import browse, em, prep, scores
from ..sources import readers
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_TRIMMED = f"f as (select row_id, trim(src_raw, {_BL}) as src_raw, trim(tgt_raw, {_BL}) as tgt_raw from raw_pairs), g as (select * from f where length(src_raw) between 1 and 2000 and length(tgt_raw) between 1 and 2000 and len(string_split(src_raw, ' ')) <= 512 and len(string_split(tgt_raw, ' ')) <= 512)"


@query("pre1_filter_bitext", f"with {fx.SQL_RAW}, {_TRIMMED} select row_id, src_raw, tgt_raw from g")
def _(spark, d):
    return prep.filter_bitext(fx.raw_pairs(spark, d))


@query("pre2_cap_rows", f"with {fx.SQL_RAW} select row_id, src_raw from raw_pairs order by row_id limit 1000000")
def _(spark, d):
    return prep.cap_rows(fx.raw_pairs(spark, d)).select("row_id", "src_raw")


@query("pre3_tokenise", f"with {fx.SQL_RAW} select row_id, {fx.sql_tokenise('src_raw')} as src, {fx.sql_tokenise('tgt_raw')} as tgt from raw_pairs")
def _(spark, d):
    return fx.raw_pairs(spark, d).select("row_id", T.tokenise(F.col("src_raw")).alias("src"), T.tokenise(F.col("tgt_raw")).alias("tgt"))


_WIDE = fx._CLASS[:-1] + "€§»«]"


@query("pre4_tokenise_query", f"with {fx.SQL_RAW} select row_id, {fx.sql_tokenise_query('src_raw', _WIDE)} as src from raw_pairs")
def _(spark, d):
    return fx.raw_pairs(spark, d).select("row_id", T.tokenise_query(F.col("src_raw")).alias("src"))


@query("pre5_detokenise", f"with {fx.SQL_BITEXT} select row_id, {fx.sql_detokenise(chr(97) + 'rray_to_string(src, chr(32))')} as text from bitext")
def _(spark, d):
    return fx.bitext(spark, d).select("row_id", T.detokenise(F.array_join("src", " ")).alias("text"))


@query(
    "pre6_strip_markers",
    f"with {fx.SQL_BITEXT}, w as (select row_id, i, array_to_string(src[i + 1 : i + 3], ' ') as p from (select row_id, src, unnest(range(len(src))) as i from bitext)) select row_id, i, {fx.sql_strip('p')} as phrase from w",
)
def _(spark, d):
    w = fx.bitext(spark, d).select("row_id", "src", F.posexplode("src").alias("i", "tok"))
    return w.select("row_id", F.col("i").cast("long").alias("i"), T.strip_markers(F.array_join(F.slice("src", F.col("i") + 1, 3), " ")).alias("phrase"))


@query("pre7_nfkc")
def _(spark, d):
    return fx.raw_pairs(spark, d).select("row_id", T.nfkc(F.col("src_raw")).alias("src"))


@query(
    "pre8_content_tokens",
    f"with {fx.SQL_BITEXT} select row_id, array_to_string(list_filter(src, lambda x: not regexp_full_match(x, '{_WIDE.replace(chr(39), chr(39) * 2)}') and x not in ('#NB', '#BLANK')), ' ') as words from bitext",
)
def _(spark, d):
    return fx.bitext(spark, d).select("row_id", F.array_join(T.content_tokens(F.col("src")), " ").alias("words"))


@query(
    "pre9_find_sublists",
    f"with {fx.SQL_BITEXT} select row_id, array_to_string(list_reverse(list_filter(range(greatest(len(src) - 1, 0)), lambda i: src[i + 1 : i + 2] = src[1:2])), ',') as starts from bitext where len(src) >= 2",
)
def _(spark, d):
    rows = fx.bitext(spark, d).where("size(src) >= 2")
    return rows.select("row_id", F.array_join(T.span_starts(F.col("src"), F.slice("src", 1, 2)).cast("array<string>"), ",").alias("starts"))


@query(
    "pre10_occurrence_spans",
    f"with {fx.SQL_BITEXT}, w as (select row_id, src, unnest(list_distinct(src)) as word from bitext), s as (select row_id, word, list_filter(range(len(src)), lambda i: src[i + 1] = word) as starts from w) select row_id, word, array_to_string(list_transform(starts, lambda i: i::varchar || '-' || (i + 1)::varchar), ' ') as spans from s",
)
def _(spark, d):
    rows = fx.bitext(spark, d).select("row_id", "src", F.explode(F.array_distinct("src")).alias("word"))
    spans = T.occurrence_spans(F.col("src"), F.array("word"))
    return rows.select("row_id", "word", F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("spans"))


@query("pre11_explode_tokens", f"with {fx.SQL_BITEXT} select row_id, i::bigint as pos, src[i + 1] as word from (select row_id, src, unnest(range(len(src))) as i from bitext)")
def _(spark, d):
    return prep.explode_tokens(fx.bitext(spark, d), "src").withColumn("pos", F.col("pos").cast("long"))


@query("pre12_vocab", f"with {fx.SQL_BITEXT}, w as (select unnest(src) as word from bitext union select unnest(tgt) from bitext) select word, row_number() over (order by word) - 1 as id from w")
def _(spark, d):
    return prep.vocab(fx.bitext(spark, d))


@query("pre13_norm_token", f"with {fx.SQL_BITEXT} select row_id, i::bigint as pos, lower(trim(tgt[i + 1])) as word from (select row_id, tgt, unnest(range(len(tgt))) as i from bitext)")
def _(spark, d):
    return prep.explode_tokens(fx.bitext(spark, d), "tgt").select("row_id", F.col("pos").cast("long").alias("pos"), T.norm_token(F.col("word")).alias("word"))


@query("pre14_is_single", "select p_partkey, trim(p_name) <> '' and not regexp_matches(trim(p_name), '[\\x20\\x09-\\x0D]') as single_name, trim(p_type) <> '' and not regexp_matches(trim(p_type), '[\\x20\\x09-\\x0D]') as single_type from part")
def _(spark, d):
    part = fx.read_table(spark, d, "part")
    return part.select("p_partkey", T.is_single(F.col("p_name")).alias("single_name"), T.is_single(F.col("p_type")).alias("single_type"))


@query(
    "sta1_line_stats",
    f"with {fx.SQL_RAW} select count(*) as lines, max(length(src_raw)) as longest, min(length(src_raw)) as shortest, round(avg(length(src_raw)), 2) as avg_length, max(len(list_filter(regexp_split_to_array(src_raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) as max_tokens, round(avg(len(list_filter(regexp_split_to_array(src_raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))), 2) as avg_tokens, (select string_agg(src_raw, ' / ' order by row_id) from (select * from raw_pairs order by row_id limit 5)) as sample from raw_pairs",
)
def _(spark, d):
    return prep.line_stats(fx.raw_pairs(spark, d), "src_raw")


# --- sources read from columns --------------------------------------------------------------------

_ALIGN_TEXT = f"select row_id, case when row_id % 4 = 0 then 'x ||| y ||| ' when row_id % 4 = 1 then '1- a-b ' else '' end || {fx.sql_points('points')} as line from bitext"


def _align_text(spark, d):
    head = F.when(F.col("row_id") % 4 == 0, "x ||| y ||| ").when(F.col("row_id") % 4 == 1, "1- a-b ").otherwise("")
    return fx.bitext(spark, d).select("row_id", F.concat(head, P.format_points(F.col("points"))).alias("line"), "points")


@query("src2_parse_points", f"with {fx.SQL_BITEXT} select row_id, {fx.sql_points('points')} as points from bitext")
def _(spark, d):
    return _align_text(spark, d).select("row_id", P.format_points(P.parse_points(F.col("line"))).alias("points"))


@query("src3_valid_alignment", f"with {fx.SQL_BITEXT}, a as ({_ALIGN_TEXT}) select row_id, regexp_full_match(line, '[0-9]+-[0-9]+(\\s+[0-9]+-[0-9]+)*') as valid from a")
def _(spark, d):
    return _align_text(spark, d).select("row_id", P.valid_alignment(F.col("line")).alias("valid"))


@query("src6_clean_hidden", "select distinct trim(src) as src, coalesce(trim(tgt), '') as tgt from (select ' ' || p_name as src, case when p_partkey % 3 > 0 then p_type || ' ' end as tgt from part) where trim(src) <> ''")
def _(spark, d):
    part = fx.read_table(spark, d, "part")
    return readers.clean_hidden(part.select(F.concat(F.lit(" "), "p_name").alias("src"), F.when(F.col("p_partkey") % 3 > 0, F.concat("p_type", F.lit(" "))).alias("tgt")))


@query("src7_hidden_from_wordlist", "select trim(v) as src, '' as tgt from (select case when p_partkey % 5 = 0 then '# ' || p_name when p_partkey % 7 = 0 then '  ' else ' ' || p_name end as v from part) where trim(v) <> '' and not starts_with(trim(v), '#')")
def _(spark, d):
    v = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    return readers.wordlist_entries(fx.read_table(spark, d, "part").select(v.alias("value")))


@query("src8_pairs", "select p_name as src, p_type as tgt from part")
def _(spark, d):
    return readers.split_pairs(fx.read_table(spark, d, "part").select(F.concat_ws("|||", "p_name", "p_type").alias("value")))


@query("src12_load_bitext", f"with {fx.SQL_BITEXT} select row_id, array_to_string(src, ' ') as src from bitext where project_id = 1 and not deleted")
def _(spark, d):
    return fx.bitext(spark, d).where("project_id = 1 and not deleted").select("row_id", F.array_join("src", " ").alias("src"))


# --- point sets -----------------------------------------------------------------------------------


def _two(spark, d):
    """The rule's points against a shifted set."""
    n = F.least(F.size("src"), F.size("tgt"))
    i = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    some = F.transform(F.filter(i, lambda x: x % 3 != F.col("row_id") % 3), lambda x: P.point(x, x))
    more = F.transform(F.filter(i, lambda x: (x % 4 == F.col("row_id") % 4) & (x + 1 < F.size("src"))), lambda x: P.point(x + 1, x))
    return fx.bitext(spark, d).select("row_id", "src", "tgt", F.col("points").alias("a"), F.concat(P.none(), more, some).alias("b"))


_TWO = (
    fx.SQL_BITEXT
    + """, two as (select row_id, points as a, list_concat(
  list_transform(list_filter(range(least(len(src), len(tgt))), lambda x: x % 4 = row_id % 4 and x + 1 < len(src)), lambda x: {'s': (x + 1)::int, 't': x::int}),
  list_transform(list_filter(range(least(len(src), len(tgt))), lambda x: x % 3 <> row_id % 3), lambda x: {'s': x::int, 't': x::int})) as b from bitext)"""
)


def _set_query(name, column, sql):
    query(name, f"with {_TWO} select row_id, {fx.sql_points(sql)} as points from two")(
        lambda spark, d: _two(spark, d).select("row_id", P.format_points(column(F.col("a"), F.col("b"))).alias("points"))
    )


_set_query("sym1_normalise", lambda a, b: P.normalise(F.concat(b, a)), "list_sort(list_distinct(list_concat(b, a)))")
_set_query("sym2_invert", lambda a, b: P.normalise(P.invert(b)), "list_sort(list_transform(b, lambda p: {'s': p.t, 't': p.s}))")
_set_query("sym3_intersect", P.intersect, "list_sort(list_filter(a, lambda p: list_contains(b, p)))")
_set_query("sym4_union", P.union, "list_sort(list_distinct(list_concat(a, b)))")
_HELD = "list_contains(held, x)"
_ROW, _COL = "len(list_filter(held, lambda q: q.s = x.s)) > 0", "len(list_filter(held, lambda q: q.t = x.t)) > 0"


def sql_grow(two: str, final: str = "") -> str:
    """CTEs from ``two (row_id, a, b)`` to ``grown (row_id, held)``: a point of the union a step, until as many in a row as
    the union has add nothing; then each direction's points once, where ``final`` (and, or) is given."""
    near = "len(list_filter(held, lambda q: abs(q.s - x.s) <= 1 and abs(q.t - x.t) <= 1)) > 0"
    last = "select row_id, held from walk join ends using (row_id) where quiet >= len(un)"
    out = f"""
ends as (select row_id, list_sort(list_distinct(a)) as a, list_sort(list_distinct(b)) as b, list_sort(list_distinct(list_concat(a, b))) as un,
  list_distinct(list_filter(a, lambda p: list_contains(b, p))) as held0 from {two}),
walk as (select row_id, held0 as held, 0 as i, 0 as quiet from ends
  union all select row_id, case when ok then list_append(held, x) else held end, i + 1, case when ok then 0 else quiet + 1 end
  from (select row_id, held, i, quiet, x, not {_HELD} and {near} and not (({_ROW}) and ({_COL})) as ok
        from (select walk.*, un[i % len(un) + 1] as x from walk join ends using (row_id) where quiet < len(un)))),
grown0 as ({last})"""
    if not final:
        return out + ",\ngrown as (select * from grown0)"
    return out + f""",
sweep as (select row_id, held, 0 as i from grown0
  union all select row_id, case when not {_HELD} and not (({_ROW}) {'and' if final == 'or' else 'or'} ({_COL})) then list_append(held, x) else held end, i + 1
  from (select sweep.*, list_concat(a, b)[i + 1] as x from sweep join ends using (row_id) where i < len(a) + len(b))),
grown as (select row_id, held from sweep join ends using (row_id) where i = len(a) + len(b))"""


for _name, _key, _final in (("sym5_grow_diag", "grow-diag", ""), ("sym6_grow_diag_final", "grow-diag-final", "or"), ("sym7_grow_diag_final_and", "grow-diag-final-and", "and")):
    query(_name, f"with recursive {_TWO},{sql_grow('two', _final)} select row_id, {fx.sql_points('list_sort(held)')} as points from grown")(
        lambda spark, d, k=_key: _two(spark, d).select("row_id", P.format_points(P.SYMMETRISE[k](F.col("a"), F.col("b"))).alias("points"))
    )


@query(
    "sym8_fmeasure",
    f"with {_TWO}, x as (select sum(len(list_filter(a, lambda p: list_contains(b, p))))::bigint as common, sum(len(a))::bigint as hypothesis, sum(len(b))::bigint as reference from two) select *, common / hypothesis::double as precision, common / reference::double as recall, 2 * common / (hypothesis + reference)::double as fmeasure from x",
)
def _(spark, d):
    two = _two(spark, d)
    return em.alignment_fmeasure(two.select("row_id", F.col("a").alias("points")), two.select("row_id", F.col("b").alias("points")))


@query("sym9_matrix", f"with {fx.SQL_BITEXT} select row_id, len(src) * len(tgt) as cells, len(points) as linked from bitext where len(src) > 0 and len(tgt) > 0")
def _(spark, d):
    return em.matrix_rows(fx.bitext(spark, d)).groupBy("row_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("linked").alias("linked"))


# --- scores ---------------------------------------------------------------------------------------

_STAB = fx.SQL_BITEXT + """, cov as (select row_id, len(src)::double as ls, len(tgt)::double as lt, len(list_distinct(list_transform(points, lambda p: p.s)))::double as a, len(list_distinct(list_transform(points, lambda p: p.t)))::double as b from bitext),
stab as (select row_id, case when ls > 0 and lt > 0 then round(case when b / lt + a / ls > 0 then 2 * (b / lt) * (a / ls) / (b / lt + a / ls) else 0 end * (1 - (ls + lt - a - b) / (ls + lt)), 5) else 0 end as score from cov)"""


@query("sco1_stability", f"with {_STAB} select row_id, score from stab")
def _(spark, d):
    return fx.bitext(spark, d).select("row_id", scores.stability_score(F.col("src"), F.col("tgt"), F.col("points")).alias("score"))


_AMB = (
    fx.SQL_BITEXT
    + "," + fx.SQL_CATALOGUE + """,
sing as (select src_phrase, tgt_phrase from occ_pairs where not contains(src_phrase, ' ') and not contains(tgt_phrase, ' ')),
sc as (select src_phrase as word, count(*) as entries from sing group by 1), tc as (select tgt_phrase as word, count(*) as entries from sing group by 1),
sm as (select row_id, avg(coalesce(entries, 5)) as m from (select row_id, unnest(list_distinct(src)) as word from bitext) left join sc using (word) group by 1),
tm as (select row_id, avg(coalesce(entries, 5)) as m from (select row_id, unnest(list_distinct(tgt)) as word from bitext) left join tc using (word) group by 1),
raw as (select b.row_id, (coalesce(sm.m, 1) + coalesce(tm.m, 1)) / 2 as raw from bitext b left join sm on sm.row_id = b.row_id left join tm on tm.row_id = b.row_id)"""
)
# Single-word entries of the rule's links: word pairs of linked positions.
_PAIRS_SQL = "occ_pairs as (select distinct src[p.s + 1] as src_phrase, tgt[p.t + 1] as tgt_phrase from (select src, tgt, unnest(points) as p from bitext))"
_AMB = _AMB.replace("sing as (", _PAIRS_SQL + ",\nsing as (", 1)


def _word_pairs(spark, d):
    links = fx.bitext(spark, d).select("src", "tgt", F.explode("points").alias("p"))
    return links.select(F.get("src", F.col("p.s")).alias("src_phrase"), F.get("tgt", F.col("p.t")).alias("tgt_phrase")).distinct()


@query("sco2_ambiguity", f"with {_AMB} select row_id, round(raw, 9) as raw from raw")
def _(spark, d):
    return scores.ambiguity_raw(fx.bitext(spark, d), _word_pairs(spark, d)).select("row_id", F.round("raw", 9).alias("raw"))


@query("sco3_normalise", f"with {_AMB} select row_id, case when max(raw) over () = min(raw) over () then 0.5 else round(1 - (raw - min(raw) over ()) / (max(raw) over () - min(raw) over ()), 5) end as score from raw")
def _(spark, d):
    return scores.normalise_scores(scores.ambiguity_raw(fx.bitext(spark, d), _word_pairs(spark, d))).select("row_id", "score")


@query("sco4_import_scores", f"with {fx.SQL_BITEXT}, s as (select row_id, row_id * 31 % 997 / 997.0::double as score from bitext where row_id % 3 > 0) select b.row_id, round(s.score, 2) as score from bitext b left join s using (row_id)")
def _(spark, d):
    df = fx.bitext(spark, d)
    return scores.import_scores(df, df.where("row_id % 3 > 0").select("row_id", (F.col("row_id") * 31 % 997 / 997.0).alias("score"))).select("row_id", "score")


@query("sco5_save_scores", f"with {fx.SQL_BITEXT} select row_id, case when row_id % 3 > 0 then 0.25 else score end as score from bitext")
def _(spark, d):
    df = fx.bitext(spark, d)
    return scores.save_scores(df, df.where("row_id % 3 > 0").select("row_id", F.lit(0.25).alias("score"))).select("row_id", "score")


@query(
    "sco6_histogram",
    f"with {fx.SQL_BITEXT}, r as (select round(score, 2) as score from bitext where score is not null), b as (select min(score) as mn, max(score) as mx, (max(score) - min(score)) / 20 as w from r), c as (select case when w > 0 then least(floor((score - mn) / w), 19) else 0 end::int as bin, count(*) as n from r, b group by 1) select i::int as bin, round(mn + i * w, 6) as lo, coalesce(n, 0) as n from b, range(20) t(i) left join c on c.bin = i",
)
def _(spark, d):
    return scores.score_histogram(fx.bitext(spark, d))


@query("sco7_init_scores", f"with {fx.SQL_BITEXT} select row_id, 1.0::double as score from bitext")
def _(spark, d):
    return scores.init_scores(fx.bitext(spark, d)).select("row_id", "score")


@query("sco8_score_bands", f"with {fx.SQL_BITEXT} select case when score >= 0.7 then 'good' when score >= 0.4 then 'medium' else 'low' end as band, count(*) as n from bitext group by 1")
def _(spark, d):
    return fx.bitext(spark, d).groupBy(scores.score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# --- rows -----------------------------------------------------------------------------------------

_Q = f"with {fx.SQL_BITEXT} "


@query("qry2_search_bitext", _Q + "select row_id from bitext where not deleted and contains(' ' || lower(array_to_string(src, ' ')) || ' ', ' the ')")
def _(spark, d):
    return browse.search_filter(fx.bitext(spark, d), src="The").select("row_id")


@query("qry2_search_text", _Q + f"select row_id from bitext where not deleted and (contains(lower({fx.sql_detokenise(chr(97) + 'rray_to_string(src, chr(32))')}), 'on the') or contains(lower({fx.sql_detokenise(chr(97) + 'rray_to_string(tgt, chr(32))')}), 'on the'))")
def _(spark, d):
    return browse.search_filter(fx.bitext(spark, d), text="on the").select("row_id")


@query("qry4_rows_by_id", _Q + "select row_id, array_to_string(tgt, ' ') as tgt from bitext semi join (select row_id % 3 as project_id, row_id from raw_pairs where row_id % 2 = 0) using (project_id, row_id)")
def _(spark, d):
    df = fx.bitext(spark, d)
    return browse.rows_by_id(df, df.where("row_id % 2 = 0")).select("row_id", F.array_join("tgt", " ").alias("tgt"))


@query("qry5_rows_by_score", _Q + "select row_id, coalesce(score, 0) as score from bitext where score >= 0.2 and score <= 0.9 order by bitext.score desc nulls last, project_id, row_id limit 100")
def _(spark, d):
    return browse.rows_by_score(fx.bitext(spark, d), 0.2, 0.9).select("row_id", "score")


@query("qry6_update_rows", _Q + f"select row_id, case when row_id % 2 = 0 then {fx.sql_tokenise(chr(39) + 'New: ' + chr(39) + ' || tgt_raw')} else array_to_string(src, ' ') end as src from bitext")
def _(spark, d):
    df = fx.bitext(spark, d)
    edits = df.where("row_id % 2 = 0").select("project_id", "row_id", F.concat(F.lit("New: "), "tgt_raw").alias("src_raw"), "tgt_raw")
    return browse.update_rows(df, edits).select("row_id", F.array_join("src", " ").alias("src"))


@query("qry7_delete_rows", _Q + "select row_id, deleted or row_id % 5 = 0 as deleted from bitext")
def _(spark, d):
    df = fx.bitext(spark, d)
    return browse.delete_rows(df, df.where("row_id % 5 = 0")).select("row_id", "deleted")


@query("qry8_linked_words", _Q + ", l as (select row_id, src, tgt, unnest(list_distinct(points)) as p from bitext) select row_id, p.s as s, src[p.s + 1] as word, string_agg(tgt[p.t + 1], ' ' order by p.t) as linked from l where p.s < len(src) and p.t < len(tgt) group by row_id, p.s, src[p.s + 1]")
def _(spark, d):
    return browse.linked_words(fx.bitext(spark, d))


@query("prj2_delete_project", _Q + "select project_id, count(*) as n from bitext where project_id <> 1 group by 1")
def _(spark, d):
    tables = browse.delete_project({"bitext": fx.bitext(spark, d)}, 1)
    return tables["bitext"].groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
