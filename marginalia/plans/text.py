"""Queries of the prose functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import prose as P
from marginalia.plans import sql as S
from marginalia.plans.registry import query, read

#: Comment markers and the like, put before lines of plain prose by their place, so that the marker rules have work to do.
MARKED = [(0, 5, "// {}"), (0, 3, "# {}"), (1, 7, "  * {} */"), (2, 11, '"""{}"""'), (3, 13, "    /// {}  ")]
DIRECTED = [(0, 5, "// nolint: {}"), (0, 3, "#!{}"), (1, 7, "/* {{{}}} */"), (2, 11, "# Copyright {}"), (3, 13, "//go:{}"), (4, 17, "# https://{}")]
CODED = [(0, 5, "return {}"), (0, 3, "x = {}"), (1, 7, "(if {}"), (2, 11, "Fmt.Println: {}")]


def by_place(cases: list[tuple[int, int, str]], line: Column, pos: Column) -> Column:
    out = line
    for at, of, form in reversed(cases):
        before, after = form.format("\0").split("\0")
        out = F.when(pos % of == at, F.concat(F.lit(before), line, F.lit(after))).otherwise(out)
    return out


def by_place_sql(cases: list[tuple[int, int, str]]) -> str:
    arms = []
    for at, of, form in cases:
        before, after = form.format("\0").split("\0")
        arms.append(f"when pos % {of} = {at} then {S.q(before)} || line || {S.q(after)}")
    return "case " + " ".join(arms) + " else line end"


def doc_lines(spark: SparkSession, sf_dir: str, cases=()) -> DataFrame:
    """doc_id, pos (from 0) and raw, for each line of each document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return own.select("doc_id", "pos", by_place(list(cases), F.col("line"), F.col("pos")).alias("raw"))


def doc_lines_sql(cases=()) -> str:
    inner = "select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::int as pos from documents"
    return f"(select doc_id, pos, {by_place_sql(list(cases)) if cases else 'line'} as raw from ({inner}))"


@query(f"""
with n as (select {S.sentences('text')} as sentences from documents),
c as (select sentences::int as sentences, count(*) as documents from n where sentences > 0 group by 1)
select sentences, documents, round(100.0 * sum(documents) over (order by sentences) / sum(documents) over (), 6) as running_pct from c
""")
def sentence_length_distribution(spark, sf_dir):
    counts = read(spark, sf_dir, "documents", "text").select(P.sentences(F.col("text")).alias("sentences")).filter("sentences > 0")
    counts = counts.groupBy("sentences").agg(F.count("*").alias("documents"))
    # One row for each length: the windows run over as many rows as there are lengths, not over the documents.
    running = F.sum("documents").over(Window.orderBy("sentences")) / F.sum("documents").over(Window.partitionBy())
    return counts.withColumn("running_pct", F.round(100.0 * running, 6))


@query(f"select doc_id, md5({S.normalize('text')}) as normalized from documents")
def prose_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(P.normalize(F.col("text")).cast("binary")).alias("normalized"))


@query(f"select doc_id, pos, {S.strip('raw')} as stripped from {doc_lines_sql(MARKED)}")
def prose_strip_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir, MARKED).select("doc_id", "pos", P.strip(F.col("raw")).alias("stripped"))


@query(f"select doc_id, pos, {S.indented('raw')} as body from {doc_lines_sql(MARKED)}")
def prose_indented_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir, MARKED).select("doc_id", "pos", P.indented(F.col("raw")).alias("body"))


@query("""
with l as (select doc_id, pos, repeat(' ', 2 + (pos %% 3)::int) || raw as line from %s),
w as (select doc_id, min(len(line) - len(regexp_replace(line, '\\A[ \\t]+', ''))) filter (where trim(line) <> '') as shared from l group by doc_id)
select doc_id, md5(string_agg(case when shared > 0 and strlen(line) >= shared then substr(line, shared + 1) else line end, chr(10) order by pos)) as dedented
from l join w using (doc_id) group by doc_id
""" % doc_lines_sql())
def prose_dedent(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit(" "), 2 + i % 3), x)), "\n")
    return docs.select("doc_id", F.md5(P.dedent(text).cast("binary")).alias("dedented"))


@query(f"select doc_id, {S.notice('text')} as notice from documents")
def notice_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", P.notice(F.col("text")).alias("notice"))


@query(f"select doc_id, pos, raw from {doc_lines_sql(DIRECTED)} where {S.directive('raw')}")
def directive_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir, DIRECTED).filter(P.directive(F.col("raw")))


@query(f"select doc_id, count(*) as lines, count(*) filter (where {S.code('raw')}) as coded from {doc_lines_sql(CODED)} group by doc_id")
def code_shape(spark, sf_dir):
    own = doc_lines(spark, sf_dir, CODED)
    return own.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(P.code(F.col("raw")), 1)).alias("coded"))


@query(f"""
with s as (select conv_id, turn, {S.split('text')} as s from conversations)
select conv_id, turn, unnest(range(1, len(s) + 1))::int as at, unnest(s) as sentence from s
""")
def sentence_split(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.posexplode(P.split(F.col("text"))).alias("at", "sentence")).withColumn("at", F.col("at") + 1)


@query(f"select doc_id, {S.sentences('text')}::int as ended, len({S.split('text')})::int as pieces, md5(array_to_string(({S.split('text')})[1:3], '|')) as opening from documents")
def sentence_opening(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("pieces_", P.split(F.col("text")))
    opening = F.md5(F.array_join(P.opening(F.col("pieces_")), "|").cast("binary"))
    return docs.select("doc_id", P.sentences(F.col("text")).alias("ended"), F.size("pieces_").alias("pieces"), opening.alias("opening"))


@query(f"select conv_id, turn, array_to_string({S.content('text')}, ' ') as words from conversations")
def content_words(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.array_join(P.content(F.col("text")), " ").alias("words"))


_NAMES = "select p_partkey as id, 'part' as kind, p_name || 'HTTPServer_v2' || p_type as name from part union all select c_custkey, 'customer', replace(c_name, '#', 'OrderIDs') from customer"


@query(f"select id, kind, array_to_string({S.pieces('name')}, ' ') as pieces, array_to_string(list_sort({S.spelled('name')}), ' ') as spelled from ({_NAMES})")
def identifier_pieces(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.concat("p_name", F.lit("HTTPServer_v2"), "p_type").alias("name"))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.replace("c_name", F.lit("#"), F.lit("OrderIDs")).alias("name"))
    own = part.unionByName(customer)
    return own.select("id", "kind", F.array_join(P.pieces(F.col("name")), " ").alias("pieces"), F.array_join(F.array_sort(P.spelled(F.col("name"))), " ").alias("spelled"))


@query(f"select doc_id, ({S.site_key('text')})::varchar as key from documents")
def site_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", P.site_key(F.col("text")).cast("string").alias("key"))


@query(f"with k as (select {S.normalize('text')} as n, doc_id from documents) select min(doc_id) as first_doc, count(*) as copies from k group by n having count(*) > 1")
def duplicate_sites(spark, sf_dir):
    keys = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", P.site_key(F.col("text")).alias("key"))
    return keys.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1").drop("key")


_TAGGED = [(0, 5, "@param {}"), (0, 3, "{} :returns: x"), (1, 7, "- {}"), (2, 11, "see \\brief {}")]
_SENTENCES_SQL = f"(select item_id, unnest(range(len(s)))::int as pos, unnest(s) as line from (select item_id, {S.split('text')} as s from benchmark))"


def _benchmark_sentences(spark, sf_dir, cases):
    rows = read(spark, sf_dir, "benchmark", "item_id", "text")
    rows = rows.select("item_id", F.posexplode(P.split(F.col("text"))).alias("pos", "line"))
    return rows.select("item_id", "pos", by_place(cases, F.col("line"), F.col("pos")).alias("sentence"))


@query(f"select item_id, pos, {S.structured('sentence')} as structured from (select item_id, pos, {by_place_sql(_TAGGED)} as sentence from {_SENTENCES_SQL})")
def structured_sentences(spark, sf_dir):
    own = _benchmark_sentences(spark, sf_dir, _TAGGED)
    return own.select("item_id", "pos", P.structured(F.col("sentence")).alias("structured"))


_RULED = [(0, 5, "It must not {}"), (0, 3, "{} fails"), (1, 7, "O(n) {}"), (2, 11, "{} errors unless")]


@query(f"select item_id, pos, {S.eliminates('sentence', S.spelled(S.q('func MustFail(err error)')))} as eliminates from (select item_id, pos, {by_place_sql(_RULED)} as sentence from {_SENTENCES_SQL})")
def eliminating_sentences(spark, sf_dir):
    own = _benchmark_sentences(spark, sf_dir, _RULED)
    return own.select("item_id", "pos", P.eliminates(F.col("sentence"), P.spelled(F.lit("func MustFail(err error)"))).alias("eliminates"))


_OLD = [(0, 5, "Kept for {}"), (0, 3, "{} backwards-compatibility."), (1, 7, "For compatibility, {}"), (2, 11, "{} legacy callers")]


@query(f"select conv_id, pos, {S.compat('t')} as compat from (select conv_id, pos, {by_place_sql(_OLD)} as t from (select conv_id, turn as pos, text as line from conversations))")
def compat_phrases(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", F.col("turn").alias("pos"), "text")
    return rows.select("conv_id", "pos", P.compat(by_place(_OLD, F.col("text"), F.col("pos"))).alias("compat"))


@query("""
with n as (select page_id, regexp_extract_all(html, '(?s)<!--.*?-->') as nodes from pages)
select page_id, len(nodes)::int as nodes, md5(array_to_string(list_transform(nodes, lambda x: trim(x[5:-4])), '|')) as texts from n
""")
def comment_nodes_html(spark, sf_dir):
    nodes = F.regexp_extract_all("html", F.lit("(?s)(<!--.*?-->)"))
    texts = F.transform("nodes_", lambda x: F.trim(F.substring(x, F.lit(5), F.char_length(x) - 7)))
    own = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", nodes.alias("nodes_"))
    return own.select("page_id", F.size("nodes_").alias("nodes"), F.md5(F.array_join(texts, "|").cast("binary")).alias("texts"))
