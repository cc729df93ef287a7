"""Queries of runs, rules and languages. The lines of documents stand in for comment nodes, with gaps for code between."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import prose as P
from marginalia.operators import rules, runs
from marginalia.plans import sql as S
from marginalia.plans.registry import query, read
from marginalia.plans.text import DIRECTED, MARKED, doc_lines, doc_lines_sql
from marginalia.sources import languages


def nodes(spark, sf_dir, cases=MARKED):
    """Every line is a node. Counted from a place that each document has for itself, a line of 64 comes after a gap, one of 96
    goes on over two rows, ten of 60 are indented and one of 45 is trailing, so runs are short in some files, long in others."""
    own = doc_lines(spark, sf_dir, cases)
    at = F.col("pos") + F.col("doc_id")
    row = F.col("pos") + F.floor((F.col("pos") + F.col("doc_id") % 64) / 64) + F.floor((F.col("pos") + F.col("doc_id") % 96 + 46) / 96)
    return own.select(
        F.col("doc_id").alias("path"),
        row.alias("row"),
        (row + F.when(at % 96 == 49, 1).otherwise(0)).alias("end_row"),
        F.when(at % 60 >= 50, 2).otherwise(0).alias("col"),
        (at % 45 == 44).alias("trailing"),
        "raw",
    )


def nodes_sql(cases=MARKED) -> str:
    return f"""b as (select *, pos + (pos + doc_id % 64) // 64 + (pos + doc_id % 96 + 46) // 96 as row from {doc_lines_sql(cases)}),
n as (select doc_id as path, row, row + case when (pos + doc_id) % 96 = 49 then 1 else 0 end as end_row, case when (pos + doc_id) % 60 >= 50 then 2 else 0 end as col,
  (pos + doc_id) % 45 = 44 as "trailing", raw from b),
j as (select *, coalesce(not "trailing" and not lag("trailing") over w and lag(end_row) over w + 1 = row and lag(row) over w = lag(end_row) over w and row = end_row and lag(col) over w = col, false) as joins
  from n window w as (partition by path order by row, col)),
r as (select * exclude (joins), sum(case when joins then 0 else 1 end) over (partition by path order by row, col rows unbounded preceding) as run from j)"""


@query(f"with {nodes_sql()} select path, run::bigint as run, min(row) + 1 as line, count(*) as nodes, bool_or(\"trailing\") as \"trailing\" from r group by path, run")
def runs_grouped(spark, sf_dir):
    own = runs.with_runs(nodes(spark, sf_dir).drop("raw"))
    return own.groupBy("path", "run").agg((F.min("row") + 1).alias("line"), F.count("*").alias("nodes"), F.bool_or("trailing").alias("trailing"))


@query(f"with {nodes_sql()} select path, row, bool_and(row - before = 1) over (partition by path order by row rows unbounded preceding) as heads from (select *, lag(row, 1, -1) over (partition by path order by row) as before from r)")
def runs_heads(spark, sf_dir):
    own = nodes(spark, sf_dir).drop("raw")
    own = own.withColumn("before", F.lag("row", 1, -1).over(runs.order()))
    return runs.with_heads(own, F.col("row") - F.col("before") == 1).select("path", "row", "heads")


@query(f"with {nodes_sql()} select \"trailing\", count(distinct (path, run)) as runs, count(*) as nodes from r group by all")
def runs_trailing(spark, sf_dir):
    own = runs.with_runs(nodes(spark, sf_dir).drop("raw"))
    per = own.groupBy("path", "run", "trailing").agg(F.count("*").alias("n"))
    return per.groupBy("trailing").agg(F.count("*").alias("runs"), F.sum("n").alias("nodes"))


@query(f"""
with {nodes_sql()}, t as (select *, {S.strip('raw')} as s, {S.indented('raw')} as b from r)
select path, run::bigint as run, coalesce(string_agg(s, ' ' order by row) filter (where s <> ''), '') as text, md5(string_agg(b, chr(10) order by row)) as body from t group by path, run
""")
def runs_text_body(spark, sf_dir):
    own = runs.comments(runs.with_runs(nodes(spark, sf_dir)))
    return own.select("path", "run", "text", F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"with {nodes_sql(DIRECTED)} select path, run::bigint as run, bool_and({S.strip('raw')} = '' or {S.directive('raw')}) as pragma from r group by path, run")
def pragma_runs(spark, sf_dir):
    own = runs.comments(runs.with_runs(nodes(spark, sf_dir, DIRECTED)))
    return own.select("path", "run", runs.pragma(F.col("raw")).alias("pragma"))


@query(f"""
with {nodes_sql()}, k as (select path, run, min(row) + 1 as line from r group by path, run)
select path, line from k qualify row_number() over (partition by path order by line) <= 64
""")
def examined_cap(spark, sf_dir):
    own = runs.with_runs(nodes(spark, sf_dir).drop("raw")).groupBy("path", "run").agg((F.min("row") + 1).alias("line"))
    return runs.examined(own).select("path", "line")


@query(f"""
with l as (select doc_id as path, pos, raw, coalesce(sum(strlen(raw) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from {doc_lines_sql(MARKED)}),
s as (select doc_id as path, unnest(range(0, n_chars, 997)) as start from documents)
select distinct l.path, pos from l join s on l.path = s.path and l.start < s.start + 20 and s.start < l.start + strlen(raw)
""")
def span_overlap(spark, sf_dir):
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0))
    own = doc_lines(spark, sf_dir, MARKED).withColumn("start", start).select(F.col("doc_id").alias("path"), "pos", "start", (start + F.octet_length("raw")).alias("end"))
    spans = read(spark, sf_dir, "documents", F.col("doc_id").alias("path"), "n_chars").filter("n_chars > 0")
    spans = spans.select("path", F.explode(F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(997))).alias("start"))
    return runs.within(own, spans.withColumn("end", F.col("start") + 20)).select("path", "pos")


def pairs(spark, sf_dir):
    """doc_id, pos, text (a line as a comment) and under (the line after it, or its own words as a name)."""
    own = doc_lines(spark, sf_dir)
    after = F.lead("raw", 1, "").over(Window.partitionBy("doc_id").orderBy("pos"))
    return own.select("doc_id", "pos", F.col("raw").alias("text"), F.when(F.col("pos") % 2 == 0, F.replace("raw", F.lit(" "), F.lit("_"))).otherwise(after).alias("under"))


_PAIRS = f"(select doc_id, pos, raw as text, case when pos % 2 = 0 then replace(raw, ' ', '_') else lead(raw, 1, '') over (partition by doc_id order by pos) end as under from {doc_lines_sql()})"


def _echo_sql(words: str, names: str) -> str:
    return f"(len({words}) >= 2 and 2 * len(list_filter({words}, lambda w: list_contains({names}, w))) >= len({words}))"


@query(f"with p as (select doc_id, pos, {S.sentences('text')} as n, {S.content('text')} as words, {S.spelled('under')} as names from {_PAIRS}) select doc_id, pos from p where n <= 1 and {_echo_sql('words', 'names')}")
def echo_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).filter(rules.echoes(F.col("text"), P.spelled(F.col("under")))).select("doc_id", "pos")


@query(f"""
with p as (select doc_id, pos, {S.sentences('text')} as n, {S.content('text')} as words, {S.spelled('under')} as names from {_PAIRS})
select doc_id, pos from p where n <= 1 and len(words) >= 2 and ((pos % 3 = 0 and pos % 5 = 0) or len(list_filter(words, lambda w: list_contains(names, w))) > 0)
""")
def restate_pairs(spark, sf_dir):
    own = pairs(spark, sf_dir)
    return own.filter(rules.restates(F.col("text"), P.spelled(F.col("under")), F.col("pos") % 3 == 0, F.col("pos") % 5 == 0)).select("doc_id", "pos")


_PADDING = " The design is simple, easy and robust. It handles the {} value. Use the helper function to get the {} data."


def docs_as_declarations(spark, sf_dir):
    """doc_id, declaration (the first line) and text: all of it, and for two of three documents sentences that pad it."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("first", F.substring_index("text", "\n", 1))
    pad = F.replace(F.lit(_PADDING), F.lit("{}"), F.coalesce(P.first_field(F.col("first")), F.lit("")))
    text = F.when(F.col("doc_id") % 3 != 0, F.concat("text", pad)).otherwise(F.col("text"))
    return docs.select("doc_id", F.col("first").alias("declaration"), text.alias("text"))


_DECLARED = f"""(select doc_id, first as declaration, case when doc_id % 3 <> 0 then text || replace({S.q(_PADDING)}, '{{}}', coalesce(({S.fields('first')})[1], '')) else text end as text
  from (select doc_id, text, string_split(text, chr(10))[1] as first from documents))"""


def _hollow_sql() -> str:
    from marginalia.functions import lexicon as L

    rated, plain = S.among(L.EVALUATIVE), S.among(L.SCAFFOLD)
    return f"""d as (select doc_id, declaration, text, {S.spelled('declaration')} as names, {S.split('text')} as pieces, {S.sentences('text')} as n from {_DECLARED}),
e as (select doc_id, names, unnest(range(1, len(pieces) + 1)) as place, unnest(pieces) as s from d),
w as (select *, {S.content('s')} as words from e),
c as (select *, len(list_filter(words, lambda w: w in {rated})) as rating, len(list_filter(words, lambda w: w not in {rated} and not list_contains(names, w) and w not in {plain})) as novel from w),
h as (select doc_id, place::int as place, case when rating > 0 then 'assessment' else 'echo' end as why, s from c
  where place > 1 and not {S.structured('s')} and len(words) >= 3 and (novel = 0 or (rating >= 2 and novel < rating)) and (rating > 0 or not {S.eliminates('s', 'names')})),
f as (select *, count(*) over (partition by doc_id) as found from h)"""


@query(f"with {_hollow_sql()} select f.doc_id, place as \"at\", why, s as sentence, round(0.4 + 0.3 * found / n, 6) as score from f join d using (doc_id) where found >= 2")
def hollow_documents(spark, sf_dir):
    own = docs_as_declarations(spark, sf_dir)
    own = P.once(own, pieces=P.split(F.col("text")))
    found = P.once(own, found=P.hollow_sentences(F.col("pieces"), P.spelled(F.col("declaration")))).filter(F.size("found") >= 2)
    score = F.round(rules.hollow_score(F.size("found"), P.ended(F.col("pieces"))), 6)
    return found.select("doc_id", score.alias("score"), F.explode("found").alias("x")).select("doc_id", "x.at", "x.why", F.col("x.text").alias("sentence"), "score")


@query(f"""
with {_hollow_sql()}, g as (select doc_id, any_value(found) as found from f where found >= 2 group by doc_id),
v as (select d.doc_id, {S.notice('text')} as notice, {S.code('text')} as leftover, n <= 1 and {_echo_sql('words', 'names')} as echo, found, n
  from (select *, {S.content('text')} as words from d) d left join g using (doc_id))
select doc_id, case when leftover then 'leftover' when echo then 'echo' else 'hollow' end as class, case when leftover then 1.0 when echo then 0.95 else round(0.4 + 0.3 * found / n, 6) end::double as score
from v where not notice and (leftover or echo or found >= 2)
""")
def inspect_first_match(spark, sf_dir):
    own = docs_as_declarations(spark, sf_dir).filter(~P.notice(F.col("text")))
    names = P.spelled(F.col("declaration"))
    # What is code needs no sentences; of the rest they are found once for both other rules.
    own = P.once(own, code=P.code(F.col("text")))
    own = P.once(own, pieces=F.when(~F.col("code"), P.split(F.col("text"))))
    own = P.once(own, ended=P.ended(F.col("pieces")))
    hollow = P.hollow_sentences(F.col("pieces"), names)
    own = P.once(own, v=rules.inspect(F.col("code"), rules.echoes(F.col("text"), names, F.col("ended")), hollow, F.col("ended"))).filter("v is not null")
    return own.select("doc_id", "v.class", F.round("v.score", 6).alias("score"))


#: Paths for every branch of the lookup.
PATHS = [
    "cmd/main.go", "lib/app.PY", "web/x.Tsx", "Dockerfile", "build/Dockerfile.dev", "api.Dockerfile", "Makefile.local", "Makefile.md", "sub/GNUmakefile", "Containerfile",
    "chart/templates/_helpers.tpl", "conf/redis.j2", "main.tf", "rules.mk", "README.md", "noextension", ".bashrc", "a/b.c/d", "x.hpp", "deep/y.java", "z.rb", "w.rs", "v.php", "data.json",
]


def _lookup_sql() -> str:
    name, ext = "string_split(path, '/')[-1]", "case when contains(name, '.') then lower(regexp_extract(name, '\\.([^.]*)\\z', 1)) else '' end"
    by_name = " ".join(f"when name = {S.q(k)} then {S.q(v)}" for k, v in languages.BY_NAME.items())
    by_ext = " ".join(f"when ext = {S.q(k)} then {S.q(v)}" for k, v in languages.BY_EXTENSION.items())
    qualified = " ".join(f"when starts_with(name, {S.q(k + '.')}) or ends_with(name, {S.q('.' + k)}) then {S.q(languages.BY_NAME[k])}" for k in languages.QUALIFIED)
    paths = " union all ".join(f"select {S.q(p)} as path" for p in PATHS)
    return f"""with p as (select url as path from pages union all {paths}), n as (select path, {name} as name from p), e as (select *, {ext} as ext from n)
select path, case {by_name} {by_ext} when ext in {S.among(languages.FOREIGN)} then null {qualified} end as language from e"""


@query(_lookup_sql())
def language_lookup(spark, sf_dir):
    own = read(spark, sf_dir, "pages", F.col("url").alias("path"))
    literal = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in PATHS])).alias("path"))
    return own.unionByName(literal).select("path", languages.language(F.col("path")).alias("language"))
