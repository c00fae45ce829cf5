"""URL filters by a path-template tree, with DataFrame functions only.

Rules come first: of the rules whose host is the url's or a parent domain and whose path begins the
url's, the longest decides. Urls without a rule are judged by their template:

1. Runs of digits in segments become ``{n}``; per host, urls of the same shape are counted with
   their labels. From here on the work is on shapes, not urls.
2. Level by level from the host down to the last segment, segments under one parent are branches. A
   parent with more than ``max_children`` branches turns those below ``rare`` of its urls into the
   wildcard ``*``, unless their labels differ from the parent's: by Chernoff's bound, which holds for
   few labels too, at the level of ``z`` divided by the number of branches.
3. Branches whose share of bad labels does not differ from their parent's by more than ``z``
   standard errors are similar and are merged into ``*`` as well. Of the others, those above and those
   below their parent's share are each sorted by their share; neighbours that do not differ by more than ``z``
   standard errors are a chain, and a chain whose first and last do not differ by more than that either is
   merged into a numbered group, ``{+1}`` or ``{-1}``. What is like no other keeps its name, as do branches without labels that are not rare, and only ones.
4. A template's purity is its share of good labels, smoothed by ``weight`` labels at its host's
   share, which itself is smoothed by the share of all urls. Templates below ``least_purity`` are
   rejected.

A path that is alone below its template is named at once. A hot host is spread: counting is combined
before the shuffle, and the joins deal hot keys over all tasks.

Defined results: urls that are null or have no ``://`` have an empty host and path; a host without
labels has the purity of all urls, and without any labels everything is allowed; unlabelled urls
count for branches only; rows that repeat are judged one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .common import ascii_lower, attach

#: Fixed values of the contract: action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """``struct<rule, action>`` of the longest rule that fits, else null. Rules are a short list: they
    stand in the plan."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")


def shape_of(path: Column) -> Column:
    """Segments with digits generalised; empty ones at either end are left out."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "[0-9]+", "{n}"), "/")


def divergence(q: Column, p: Column) -> Column:
    """Kullback and Leibler's, of two shares."""
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    return part(q, p) + part(1 - q, 1 - p)


def _differs_little(neg: Column, lab: Column, neg2: Column, lab2: Column, z: float) -> Column:
    """Two shares are within ``z`` standard errors of their difference; null where one has no labels."""
    pooled = (neg + neg2 + 1) / (lab + lab2 + 2)
    return F.abs(neg / F.nullif(lab, F.lit(0)) - neg2 / F.nullif(lab2, F.lit(0))) <= F.lit(z) * F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(lab, F.lit(0)) + 1 / F.nullif(lab2, F.lit(0))))


def _alike(branches: DataFrame, z: float) -> DataFrame:
    """``branches`` with ``name``: neighbours by share on the same side of their parent that do not
    differ are a chain, and a chain whose ends do not differ either is one group. Wildcards and unlabelled branches,
    which may be very many under a parent, are not sorted."""
    key = ["host", "template", "side"]
    along = Window.partitionBy(key).orderBy("share", "child")
    same = _differs_little(F.col("neg"), F.col("lab"), F.lag("neg").over(along), F.lag("lab").over(along), z)
    chains = branches.where("side != 0").withColumn("first", (~F.coalesce(same, F.lit(False))).cast("int"))
    chains = chains.withColumn("group", F.sum("first").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*key, "group").orderBy("share", "child").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [f(c).over(whole) for f in (F.first, F.last) for c in ("neg", "lab")]
    number = F.concat(F.lit("{"), F.when(F.col("side") > 0, "+").otherwise("-"), F.col("group"), F.lit("}"))
    merged = (F.count(F.lit(1)).over(whole) > 1) & F.coalesce(_differs_little(*ends, z), F.lit(False))
    named = chains.withColumn("name", F.when(merged, number).otherwise(F.col("child"))).drop("first", "group")
    rest = branches.where("side = 0").withColumn("name", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("child")))
    return named.unionByName(rest)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str = "bad",
    rules=RULES,
    max_children: int = 16,
    rare: float = 0.02,
    z: float = 1.96,
    weight: float = 5.0,
    least_purity: float = 0.5,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, purity``.

    ``bad_col`` is a boolean: true and false are labels, null is unlabelled.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{bad_col}`").alias("bad"))
    urls = written(urls.withColumn("segments", shape_of(F.col("path"))), "urls")
    counts = [F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("neg").alias("neg")]
    tree = (
        urls.groupBy("host", "segments")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.count_if("bad").alias("neg"))
        .withColumn("template", F.lit(""))
    )
    going, ended, depth = written(tree, "url-shapes"), [], 0
    while depth == 0 or not going.isEmpty():
        depth += 1
        going = going.withColumn("child", F.element_at("segments", depth))
        kids = written(going.groupBy("host", "template", "child").agg(*counts, F.count(F.lit(1)).alias("shapes")), "url-branches")
        parents = kids.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("pn"), F.sum("lab").alias("plab"), F.sum("neg").alias("pneg"), (F.sum("shapes") == 1).alias("alone")
        )
        parents = written(parents.withColumn("kids", F.col("k")), "url-parents")
        p = (F.col("pneg") + 1) / (F.col("plab") + 2)
        share = F.col("neg") / F.nullif("lab", F.lit(0))
        near = F.abs(share - F.col("pneg") / F.nullif("plab", F.lit(0))) <= F.lit(z) * F.sqrt(p * (1 - p) / F.nullif("lab", F.lit(0)))
        unlike = F.col("lab") * divergence(share, p) > F.log("k") + F.lit(z * z / 2)
        wild = (F.col("k") > 1) & (
            ((F.col("k") > max_children) & (F.col("n") < F.lit(rare) * F.col("pn")) & ~F.coalesce(unlike, F.lit(False))) | F.coalesce(near, F.lit(False))
        )
        side = F.when(wild | (F.col("lab") == 0), 0).when(share > F.col("pneg") / F.nullif("plab", F.lit(0)), 1).otherwise(-1)
        # A hot parent's branches, a hot shape's urls and a hot number's pages are dealt over all tasks.
        branches = attach(kids, parents, ["host", "template"], "kids").select("host", "template", "child", "alone", "lab", "neg", share.alias("share"), wild.alias("wild"), side.alias("side"))
        named = _alike(branches, z).select("host", "template", "child", "alone", "name")
        rest = F.array_join(F.slice("segments", F.lit(depth), F.size("segments")), "/")
        level = (
            going.join(named, ["host", "template", "child"])
            .withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("name"))))
            .withColumn("ended", F.col("alone") | (F.size("segments") <= depth))
            .drop("child", "name", "alone")
        )
        level = written(level, "url-templates")
        ended.append(level.where("ended").drop("ended"))
        going = level.where("not ended").drop("ended")
    tree = reduce(DataFrame.unionByName, ended)
    total = tree.agg(F.coalesce(F.sum("neg"), F.lit(0)), F.coalesce(F.sum("lab"), F.lit(0))).first()
    overall = F.lit(float(total[0]) / max(total[1], 1))
    hosts = tree.groupBy("host").agg(((F.sum("neg") + weight * overall) / (F.sum("lab") + F.lit(weight))).alias("host_bad"))
    templates = tree.groupBy("host", "template").agg(F.sum("neg").alias("tneg"), F.sum("lab").alias("tlab")).join(hosts, "host")
    templates = templates.select(
        "host", "template", (1 - (F.col("tneg") + F.lit(weight) * F.col("host_bad")) / (F.col("tlab") + F.lit(weight))).alias("purity")
    )
    judged = tree.select("host", "segments", "template", F.col("n").alias("urls")).join(templates, ["host", "template"])
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    return (
        attach(urls, written(judged, "url-judged"), ["host", "segments"], "urls")
        .withColumn("fit", rule)
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.action"), F.when(F.col("purity") < least_purity, "block").otherwise("allow")).alias("verdict"),
            "template", "purity",
        )
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad``: a url's first number in the path names the document that the page shows. Of
    sf0.1's 2,500 pages, 89 % hold the first 30 characters of that document's text as they are (2 % those
    of the document with the page's own number), and 959 get a label in this way. The labels there do
    not depend on the url, so no template of these pages is purer than chance; planted ones are
    tested."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")
    _, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("path", path).withColumn("number", number).drop("path")
    counts = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n")).join(known.withColumnRenamed("doc_id", "number"), "number")
    return attach(rows, written(counts, "url-labels"), ["number"], "n").select("page_id", "url", "bad")


def query_urls(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge_urls(labelled_pages(pages, labels))


def _sql() -> str:
    """The same tree in SQL, one step a level."""
    steps = "".join(
        f"""
c{d} as (select *, case when len(segments) >= {d} then segments[{d}] end as child from t{d - 1}),
k{d} as (select host, template, child, sum(n) as n, sum(lab) as lab, sum(neg) as neg from c{d} where child is not null group by 1, 2, 3),
q{d} as (select *, count(*) over w as k, sum(n) over w as pn, sum(lab) over w as plab, sum(neg) over w as pneg from k{d} window w as (partition by host, template)),
y{d} as (select *, k > 1 and ((k > 16 and n < 0.02::double * pn and not coalesce(lab * (case when neg > 0 then neg::double / lab * ln(neg::double / lab / pr) else 0 end
             + case when neg < lab then (1 - neg::double / lab) * ln((1 - neg::double / lab) / (1 - pr)) else 0 end) > ln(k::double) + 1.96::double * 1.96::double / 2, false))
             or coalesce(abs(neg::double / nullif(lab, 0) - pneg::double / nullif(plab, 0)) <= 1.96::double * sqrt(pr * (1 - pr) / nullif(lab, 0)), false)) as wild
           from (select *, (pneg + 1)::double / (plab + 2) as pr from q{d})),
s{d} as (select *, neg::double / nullif(lab, 0) as share, case when wild or lab = 0 then 0 when neg::double / lab > pneg::double / plab then 1 else -1 end as side from y{d}),
g{d} as (select *, sum(case when coalesce(abs(share - ls) <= 1.96::double * sqrt(po * (1 - po) * (1 / nullif(lab, 0)::double + 1 / nullif(ll, 0)::double)), false) then 0 else 1 end) over (partition by host, template, side order by share nulls first, child) as grp
         from (select *, lag(share) over v as ls, lag(lab) over v as ll, (neg + lag(neg) over v + 1)::double / (lab + lag(lab) over v + 2) as po from s{d} window v as (partition by host, template, side order by share nulls first, child))),
e{d} as (select *, count(*) over v as size, first_value(neg) over v as n1, first_value(lab) over v as l1, last_value(neg) over v as n2, last_value(lab) over v as l2
         from g{d} window v as (partition by host, template, side, grp order by share nulls first, child rows between unbounded preceding and unbounded following)),
x{d} as (select host, template, child, case when wild then '*' when side <> 0 and size > 1 and abs(n1::double / nullif(l1, 0) - n2::double / nullif(l2, 0)) <= 1.96::double * sqrt(((n1 + n2 + 1)::double / (l1 + l2 + 2)) * (1 - (n1 + n2 + 1)::double / (l1 + l2 + 2)) * (1 / nullif(l1, 0)::double + 1 / nullif(l2, 0)::double)) then '{{' || case when side > 0 then '+' else '-' end || grp::varchar || '}}' else child end as name from e{d}),
t{d} as (select c.host, c.segments, c.n, c.lab, c.neg, case when name is null then c.template else c.template || '/' || name end as template
         from c{d} c left join x{d} x on x.host = c.host and x.template = c.template and x.child = c.child),"""
        for d in (1, 2, 3)
    )
    return rf"""
with u0 as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
u1 as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u0),
labs as (select doc_id, max(quality = 0 or toxic = 1) as bad from labels group by doc_id),
u2 as (select page_id, host, path, bad,
              string_split(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[0-9]+', '{{n}}', 'g'), '/') as s
       from u1 left join labs on labs.doc_id = try_cast(regexp_extract(path, '([0-9]+)', 1) as bigint)),
u as (select page_id, host, path, bad, case when len(s) > 3 then [s[1], s[2], array_to_string(s[3:], '/')] else s end as segments from u2),
t0 as (select host, segments, count(*) as n, count(bad) as lab, coalesce(count_if(bad), 0) as neg, '' as template from u group by host, segments),{steps}
o as (select coalesce(sum(neg), 0)::double / greatest(coalesce(sum(lab), 0), 1) as overall from t3),
h as (select host, (sum(neg) + 5.0::double * any_value(overall)) / (sum(lab) + 5.0::double) as host_bad from t3 cross join o group by host),
p as (select t3.host, template, 1 - (sum(neg) + 5.0::double * any_value(host_bad)) / (sum(lab) + 5.0::double) as purity from t3 join h using (host) group by 1, 2),
r as (select u.*, t3.template, purity,
        case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
             when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
             when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
      from u join t3 using (host, segments) join p using (host, template))
select page_id, host, path, rule,
       case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null or purity < 0.5 then 'block' else 'allow' end as verdict,
       template, purity
from r
"""


SQL_URLS = _sql()
