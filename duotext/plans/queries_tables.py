"""Phrase tables, morphology, hidden phrases and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morph as M
from ..operators import browse, hidden, morphology, tables
from ..operators import phrases as ph
from ..sources import writers
from . import fixtures as fx
from .queries_phrases import occ_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_COLS = "direction, src, total, top_tgt, top_count, top_share, num_tgts, entropy, topk"


def _flat(table):
    return table.withColumn("topk", tables.topk_text())


def _words(spark, d):
    """Word pairs of the pseudo-translation: sources with sure and dubious targets."""
    links = fx.pseudo(spark, d).select(F.explode(F.arrays_zip("src", "tgt")).alias("p"))
    return links.groupBy(F.col("p.src").alias("src_phrase"), F.col("p.tgt").alias("tgt_phrase")).agg(F.count(F.lit(1)).alias("num_occurrences")).withColumn("direction", F.lit(0))


_WORDS = fx.SQL_PSEUDO + ", words as (select src_phrase, tgt_phrase, 0 as direction, count(*) as num_occurrences from (select unnest(src) as src_phrase, unnest(tgt) as tgt_phrase from pseudo) group by all)"


@query("tab1_phrase_table", f"with {fx.SQL_OCC},{fx.sql_table('counts')} select {_COLS} from tab")
def _(spark, d):
    return _flat(tables.phrase_table(ph.phrase_counts(occ_of(spark, d))))


@query("tab2_phrase_table_all", f"with {fx.SQL_CATALOGUE},{fx.sql_table('catalogue', split=False)} select {_COLS} from tab")
def _(spark, d):
    return _flat(tables.phrase_table(fx.catalogue(spark, d), split_by_direction=False))


@query("tab3_table_summary", f"with {fx.SQL_CATALOGUE},{fx.sql_table('catalogue')} select direction, count(*) as num_rows from tab group by 1")
def _(spark, d):
    return tables.table_summary(tables.phrase_table(fx.catalogue(spark, d)))


@query("tab4_sure", f"with {_WORDS},{fx.sql_table('words')} select {_COLS} from tab where total >= 10 and top_share >= 0.75")
def _(spark, d):
    return _flat(tables.sure(tables.phrase_table(_words(spark, d))))


@query("tab5_dubious", f"with {_WORDS},{fx.sql_table('words')} select {_COLS} from tab where total >= 10 and top_share < 0.75")
def _(spark, d):
    return _flat(tables.dubious(tables.phrase_table(_words(spark, d))))


_ROBUST = f"with {_WORDS},{fx.sql_table('words', where=chr(100) + 'irection = 0 and not regexp_matches(trim(src_phrase), chr(92) || chr(115))')}, cl as (select *, case when total < 10 then 'below' when top_share >= 0.75 then 'sure' else 'dubious' end as class from tab) "


@query("tab6_robustness_report", _ROBUST + "select count(*) as unique_src_considered, count_if(class = 'below') as below_min_total, count_if(class <> 'below') as classified_total, count_if(class = 'sure') as sure_found, count_if(class = 'dubious') as dubious_found, count_if(class <> 'sure') as to_review from cl")
def _(spark, d):
    return tables.robustness_report(_words(spark, d))


@query("tab6_robustness_examples", _ROBUST + ", r as (select *, row_number() over (partition by class order by total desc, src) as rank from cl where class <> 'below'), alt as (select direction, src, string_agg(tgt || '(' || c || ')', '|' order by rank) filter (where rank between 2 and 7) as alternatives from tab_ranked group by 1, 2) select class, rank::int as rank, r.src, top_tgt, top_count, total, round(top_share, 6) as top_share, coalesce(alternatives, '') as alternatives from r join alt using (direction, src) where rank <= 25")
def _(spark, d):
    return tables.robustness_examples(_words(spark, d))


@query("tab7_report_totals", _ROBUST + "select count_if(class <> 'sure') as to_review, count_if(class = 'below') as excluded from cl")
def _(spark, d):
    return tables.robustness_report(_words(spark, d)).select("to_review", F.col("below_min_total").alias("excluded"))


_SETS = f"with {fx.SQL_CATALOGUE}, ra as (select distinct src_phrase as src, tgt_phrase as tgt from catalogue where num_occurrences >= 2), fo as (select distinct src_phrase as src, tgt_phrase as tgt from catalogue where length(src_phrase) % 2 = 0) "


def _sets(spark, d):
    c = fx.catalogue(spark, d).withColumnsRenamed({"src_phrase": "src", "tgt_phrase": "tgt"})
    return c.where("num_occurrences >= 2"), c.where(F.length("src") % 2 == 0)


@query("tab8_hidden_report", _SETS + "select (select count(*) from ra) as robust, (select count(*) from fo) as form, (select count(*) from ra join fo using (src, tgt)) as both, (select count(*) from (from ra except from fo)) as only_robust, (select count(*) from (from fo except from ra)) as only_form, (select count(*) from (from ra union from fo)) as \"all\"")
def _(spark, d):
    return tables.hidden_report(*_sets(spark, d))[0]


@query("hid8_pair_overlap", _SETS + "select (select count(*) from ra join fo using (src, tgt)) as both, (select count(*) from (from ra except from fo)) as only_left, (select count(*) from (from fo except from ra)) as only_right, (select count(*) from (from ra union from fo)) as union_size")
def _(spark, d):
    return hidden.pair_overlap(*_sets(spark, d))


@query("hid7_hidden_union", f"with {fx.SQL_CATALOGUE}, a as (select src_phrase as src, tgt_phrase as tgt, max(num_occurrences) as total from catalogue where num_occurrences >= 2 group by 1, 2), b as (select distinct src_phrase as src, tgt_phrase as tgt from catalogue where length(src_phrase) % 2 = 0) select src, tgt, case when a.total is null then 1 else 0 end as origin, coalesce(a.total, 0) as total from a full join b using (src, tgt)")
def _(spark, d):
    robust, form = _sets(spark, d)
    return hidden.hidden_union(robust.withColumn("total", F.col("num_occurrences")), form)


@query("snk2_csv_columns", f"with {_WORDS},{fx.sql_table('words')} select direction, src, total, top_tgt, top_count, printf('%.6f', top_share) as top_share, num_tgts, printf('%.6f', entropy) as entropy, topk from tab")
def _(spark, d):
    return writers.csv_columns(tables.phrase_table(_words(spark, d)))


@query("snk3_phrase_json_summary", f"with {_WORDS},{fx.sql_table('words')} select direction, count(*) as n from tab group by 1")
def _(spark, d):
    rows = writers.phrase_json(tables.phrase_table(_words(spark, d)))
    return rows.where("json is not null").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("snk10_beam_ttable", f"with {_WORDS}, t as (select src_phrase as e, tgt_phrase as f, num_occurrences / sum(num_occurrences) over (partition by src_phrase)::double as p from words), b as (select *, max(p) over (partition by e) as best from t) select e, f, round(ln(p), 9) as logp from b where ln(p) >= 4.0 * ln(best)")
def _(spark, d):
    w = _words(spark, d)
    total = w.groupBy("src_phrase").agg(F.sum("num_occurrences").alias("t"))
    t = w.join(total, "src_phrase").select(F.col("src_phrase").alias("e"), F.col("tgt_phrase").alias("f"), (F.col("num_occurrences") / F.col("t")).alias("p"))
    return writers.beam_ttable(t).select("e", "f", F.round("logp", 9).alias("logp"))


# --- morphology -----------------------------------------------------------------------------------

_TAGS = ("agg.masch.sing", "sost.femm.plur", "v.imper.2p-Dat/Acc", "sost.masch.sing", "v.ind.pres.3s", "avv")
_FEATS = ("ADJ:pos+m+s", "NOUN-F:p", "VER:imp+2+p", "NOUN-M:s", "VER:ind+pres+3+s", "ADV")


def _lexicons(spark, d):
    """Lexicons from part names and types: the tags go by the number of the part."""
    part = fx.read_table(spark, d, "part")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % k + 1).cast("int"))
    src = part.select(F.col("p_partkey").alias("line"), pick(_TAGS, 6).alias("tag"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("form"))
    tgt = part.select(F.col("p_partkey").alias("line"), F.lower("p_type").alias("form"), pick(_FEATS, 6).alias("feat"))
    return src, tgt


_LEX = f"""with {fx.SQL_CATALOGUE},
tags as (select unnest([0, 1, 2, 3, 4, 5]) as k, unnest({list(_TAGS)}) as tag, unnest(['agg', 'sost', 'v', 'sost', 'v', 'avv']) as pos, unnest(['m', 'f', null, 'm', null, null]) as gender,
  unnest(['sing', 'plur', 'plur', 'sing', 'sing', null]) as number, unnest([null, null, 'imper', null, 'ind', null]) as mood, unnest([null, null, 2, null, 3, null])::int as person, unnest(['agg.masch.sing', 'sost.femm.plur', 'v.imper.2p', 'sost.masch.sing', 'v.ind.pres.3s', 'avv']) as base),
feats as (select unnest([0, 1, 2, 3, 4, 5]) as k, unnest({list(_FEATS)}) as feat, unnest(['ADJ', 'NOUN', 'VER', 'NOUN', 'VER', 'ADV']) as pos, unnest(['m', 'f', null, 'm', null, null]) as gender,
  unnest(['sing', 'plur', 'plur', 'sing', 'sing', null]) as number, unnest([null, null, 'imp', null, 'ind', null]) as mood, unnest([null, null, 2, null, 3, null])::int as person),
ls as (select p_partkey as line, lower(split_part(p_name, ' ', 1)) as form, tags.* from part join tags on k = p_partkey % 6),
lt as (select p_partkey as line, lower(p_type) as form, feats.* from part join feats on k = p_partkey % 6),
cand as (select distinct src_phrase, tgt_phrase, lower(trim(src_phrase)) as sf, lower(trim(tgt_phrase)) as tf from words_catalogue where direction = 0 and not regexp_matches(tgt_phrase, '\\s')),
ok as (select src_phrase, tgt_phrase, ls.line as sl, lt.line as tl, ls.base, lt.feat from cand join ls on ls.form = sf join lt on lt.form = tf where
  case when ls.pos = 'agg' then lt.pos in ('ADJ', 'VER') and ls.gender = lt.gender and ls.number = lt.number
       when ls.pos = 'sost' then lt.pos = 'NOUN' and ls.gender = lt.gender and ls.number = lt.number
       when ls.pos = 'v' then lt.pos = 'VER' and (ls.mood is null or lt.mood is null or case when ls.mood = 'imper' then 'imp' else ls.mood end = lt.mood)
         and (ls.person is null or lt.person is null or ls.person = lt.person) and (ls.number is null or lt.number is null or ls.number = lt.number) else false end),
wit as (select src_phrase, tgt_phrase, base as src_tag, feat as tgt_feat from (select *, row_number() over (partition by src_phrase, tgt_phrase order by sl, tl) as k from ok) where k = 1)
"""


@query("mor1_parse_src_tag", _LEX + "select line, base, pos, gender, number, mood, person from ls")
def _(spark, d):
    return _lexicons(spark, d)[0].select("line", M.parse_src_tag(F.col("tag")).alias("a")).select("line", "a.*")


@query("mor2_parse_tgt_feat", _LEX + "select line, feat, pos, gender, number, mood, person from lt")
def _(spark, d):
    return _lexicons(spark, d)[1].select("line", M.parse_tgt_feat(F.col("feat")).alias("b")).select("line", "b.*")


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(trim(w)), '^[^a-zàèéìòóù]+', ''), '[^a-zàèéìòóù]+$', ''), '^(l|un|una|lo|la|d|c|s|m|t)[''’]', '')"


@query("mor3_clean_tgt_token", f"with w as (select p_partkey, case when p_partkey % 3 = 0 then 'L''' || p_type || '!' else '\"' || p_type end as w from part) select p_partkey, {_CLEAN} as token from w")
def _(spark, d):
    w = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("L'"), "p_type", F.lit("!"))).otherwise(F.concat(F.lit('"'), "p_type"))
    return fx.read_table(spark, d, "part").select("p_partkey", M.clean_tgt_token(w).alias("token"))


@query("mor4_head_token", f"with w as (select p_partkey, split_part(p_type, ' ', 1) as w, p_partkey % 4 as k from part) select p_partkey, case when k < 3 then {_CLEAN} end as head from w")
def _(spark, d):
    word = F.split_part("p_type", F.lit(" "), F.lit(1))
    k = F.col("p_partkey") % 4
    phrase = F.when(k == 0, word).when(k == 1, F.concat(F.lit("La "), word)).when(k == 2, F.concat(F.lit("della la "), word)).otherwise(F.concat(F.lit("grande "), word))
    return fx.read_table(spark, d, "part").select("p_partkey", M.head_token(phrase).alias("head"))


@query("mor5_morph_pairs", _LEX + "select src_phrase, tgt_phrase, base as src_tag, feat as tgt_feat, min(sl) as src_line, min(tl) as tgt_line, count(*) as entries from ok group by 1, 2, 3, 4")
def _(spark, d):
    pairs = morphology.morph_pairs(fx.words_catalogue(spark, d), *_lexicons(spark, d))
    return pairs.select("src_phrase", "tgt_phrase", F.col("a.base").alias("src_tag"), F.col("b.feat").alias("tgt_feat"), "src_line", "tgt_line", "entries")


@query("mor6_morph_witness", _LEX + "select * from wit")
def _(spark, d):
    return morphology.morph_witness(morphology.morph_pairs(fx.words_catalogue(spark, d), *_lexicons(spark, d)))


@query("mor7_form_aligned", _LEX + "select * from wit")
def _(spark, d):
    return morphology.form_aligned(fx.words_catalogue(spark, d), *_lexicons(spark, d))


def _percent(part, total):
    tenths = f"((2000 * {part} + {total}) // (2 * {total}))::bigint"
    return f"({tenths} // 10)::varchar || '.' || ({tenths} % 10)::varchar || '%'"


_REPORT = (
    _LEX
    + f""",{fx.sql_table('words_catalogue', where='direction = 0')},
cl as (select *, case when total < 10 then 'below' when top_share >= 0.75 then 'sure' else 'dubious' end as class from tab where not regexp_matches(src, '\\s')),
ro as (select tab.*, top from tab join (select direction, src, string_agg(tgt || '(' || c || ')', '|' order by rank) filter (where rank <= 6) as top from tab_ranked group by 1, 2) using (direction, src) where total >= 2 and top_share >= 0.17),
co as (select ro.src as src, top_tgt as tgt, total, top_count, num_tgts, top, src_tag, tgt_feat, case when src_tag is null then 'robust only' else 'both' end as section from ro left join wit on src_phrase = src and tgt_phrase = top_tgt
  union all select src_phrase, tgt_phrase, null, null, null, null, src_tag, tgt_feat, 'form only' from wit where not exists (select 1 from ro where src = src_phrase and top_tgt = tgt_phrase)),
nums as (select 'overview' as report, 'counts' as section, unnest(range(6)) as line_no, unnest(['unique_src_considered', 'below_min_total', 'classified_total', 'sure_found', 'dubious_found', 'to_review']) as name,
    unnest([count(*), count_if(class = 'below'), count_if(class <> 'below'), count_if(class = 'sure'), count_if(class = 'dubious'), count_if(class <> 'sure')]) as v from cl
  union all select 'hidden selection', 'hidden counts', unnest(range(6)), unnest(['robust', 'form', 'both', 'only_robust', 'only_form', 'all']),
    unnest([count_if(section <> 'form only'), count_if(section <> 'robust only'), count_if(section = 'both'), count_if(section = 'robust only'), count_if(section = 'form only'), count(*)]) from co)
select report, section, line_no, '- ' || name || ': ' || v::bigint as text from nums
union all select 'overview', class, k, src || ' -> ' || top_tgt || ' (' || {_percent('top_count', 'total')} || ', total ' || total || ')' from (select *, row_number() over (partition by class order by total desc, src) as k from cl where class <> 'below') where k <= 25
union all select 'hidden selection', section, k, src || ' -> ' || tgt || case when total is not null then ' | conf=' || {_percent('top_count', 'total')} || ' (' || top_count || '/' || total || '), variants=' || num_tgts || ' | top: ' || top else '' end
  || case when src_tag is not null then ' | head: ' || lower(tgt) || ' [' || src_tag || '] = [' || tgt_feat || ']' else '' end
  from (select *, row_number() over (partition by section order by total desc nulls last, src, tgt) as k from co) where k <= 12"""
)


@query("snk8_render_report", _REPORT)
def _(spark, d):
    """Overview, hidden selection and both combined: robust pairs by a low bar, as part types are spread evenly."""
    words = fx.words_catalogue(spark, d)
    robust = tables.sure(tables.phrase_table(words.where("direction = 0")), 2, 0.17)
    return tables.combined_report(words, robust, morphology.form_aligned(words, *_lexicons(spark, d)))


@query("mor8_reduce_lexicon", _LEX + "select line, form from ls where form in (select sf from cand)")
def _(spark, d):
    words = fx.words_catalogue(spark, d).where("direction = 0 and not contains(tgt_phrase, ' ')").select(F.lower(F.trim("src_phrase")).alias("form"))
    return morphology.reduce_lexicon(_lexicons(spark, d)[0], words).select("line", "form")


# --- hidden phrases -------------------------------------------------------------------------------

_H = f"with {fx.SQL_CATALOGUE} "


@query("hid1_hide", _H + ", new as (select distinct project_id, src_phrase, tgt_phrase from catalogue where num_occurrences >= 2) select project_id, src_phrase, tgt_phrase, count(*) as n from (select project_id, src_phrase, tgt_phrase from hidden union all select * from new where not exists (select 1 from hidden h where h.src_phrase = new.src_phrase and h.tgt_phrase = new.tgt_phrase)) group by all")
def _(spark, d):
    out = hidden.hide(fx.hidden_entries(spark, d), fx.catalogue(spark, d).where("num_occurrences >= 2"))
    return out.groupBy(hidden.KEY).agg(F.count(F.lit(1)).alias("n"))


@query("hid1_unhide", _H + "select id from hidden where not exists (select 1 from catalogue c where c.src_phrase = hidden.src_phrase and c.tgt_phrase = hidden.tgt_phrase)")
def _(spark, d):
    return hidden.unhide(fx.hidden_entries(spark, d), fx.catalogue(spark, d)).select("id")


@query("hid2_dedupe_hidden", _H + "select min(id) as id, project_id, src_phrase, tgt_phrase from hidden group by 2, 3, 4")
def _(spark, d):
    return hidden.dedupe_hidden(fx.hidden_entries(spark, d))


@query("hid3_all_ignored", _H + "select project_id, src_phrase, tgt_phrase from hidden union select project_id, src_phrase, tgt_phrase from catalogue where ignore")
def _(spark, d):
    return hidden.all_ignored(fx.hidden_entries(spark, d), fx.catalogue(spark, d))


_VISIBLE = "vis as (select c.* from catalogue c where not exists (select 1 from hidden h where h.project_id = c.project_id and lower(h.src_phrase) = lower(c.src_phrase) and (h.tgt_phrase = '' or lower(h.tgt_phrase) = lower(c.tgt_phrase))))"


@query("hid4_visible", _H + f", {_VISIBLE} select src_phrase, tgt_phrase, direction, num_occurrences from vis")
def _(spark, d):
    return hidden.visible(fx.catalogue(spark, d), fx.hidden_entries(spark, d)).select("src_phrase", "tgt_phrase", "direction", "num_occurrences")


@query("hid5_apply_hidden", _H + "select src_phrase, tgt_phrase, direction, ignore or exists (select 1 from hidden h where lower(trim(h.src_phrase)) = lower(trim(c.src_phrase)) and (h.tgt_phrase = '' or lower(trim(h.tgt_phrase)) = lower(trim(c.tgt_phrase)))) as ignore from catalogue c")
def _(spark, d):
    return hidden.apply_hidden(fx.catalogue(spark, d), fx.hidden_entries(spark, d)).select("src_phrase", "tgt_phrase", "direction", "ignore")


@query("hid6_combination_rule")
def _(spark, d):
    h = fx.hidden_entries(spark, d)
    words = h.select("project_id", F.explode(F.split("src_phrase", " ")).alias("src_phrase"), F.lit("").alias("tgt_phrase")).distinct()
    return hidden.combination_rule(fx.catalogue(spark, d), words).select("src_phrase", "tgt_phrase", "direction", "ignore")


ORACLES["hid6_combination_rule"] = _H + """, hw as (select distinct lower(unnest(string_split(src_phrase, ' '))) as word from hidden),
tk as (select src_phrase, lower(unnest(string_split(src_phrase, ' '))) as word, len(string_split(src_phrase, ' ')) as n from (select distinct src_phrase from catalogue)),
al as (select tk.src_phrase, any_value(n) > 1 and bool_and(hw.word is not null) as gone from tk left join hw using (word) group by 1)
select c.src_phrase, c.tgt_phrase, c.direction, ignore or gone as ignore from catalogue c join al using (src_phrase)"""


@query("hid9_list_hidden", _H + "select * from hidden order by id desc limit 50")
def _(spark, d):
    return hidden.list_hidden(fx.hidden_entries(spark, d))


@query("qry1_browse_phrases", _H + f", {_VISIBLE}, v as (select * from vis where direction = 0), f as (select * from v where len(string_split(src_phrase, ' ')) >= 2 or len(string_split(tgt_phrase, ' ')) >= 2) select src_phrase, tgt_phrase, num_occurrences, (select count(*) from v) as total, (select count(*) from f) as filtered from f order by num_occurrences desc, src_phrase, tgt_phrase limit 50")
def _(spark, d):
    out = browse.browse_phrases(fx.catalogue(spark, d), fx.hidden_entries(spark, d), min_length=2)
    return out.select("src_phrase", "tgt_phrase", "num_occurrences", "total", "filtered")


@query("qry1_browse_search", _H + f", {_VISIBLE} select src_phrase, tgt_phrase, num_occurrences from vis where direction = 0 and (contains(lower(src_phrase), 'ing') or contains(lower(tgt_phrase), 'ing'))")
def _(spark, d):
    return browse.browse_filter(fx.catalogue(spark, d), fx.hidden_entries(spark, d), search="ING").select("src_phrase", "tgt_phrase", "num_occurrences")


@query("qry3_concordance", f"with {fx.SQL_OCC}, k as (select distinct row_id from occ where src_phrase = 'the' and tgt_phrase = 'the'), f as (select row_id from bitext where not deleted and list_contains(list_transform(src, lambda x: lower(x)), 'the') and list_contains(list_transform(tgt, lambda x: lower(x)), 'the') and row_id not in (select row_id from k)) select row_id, 'extracted' as origin from k union all select row_id, 'found' from f")
def _(spark, d):
    return browse.concordance(fx.bitext(spark, d), occ_of(spark, d), "the", "the").select("row_id", "origin")
