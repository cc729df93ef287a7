"""Queries of the scanner over source text that is made from documents: each line a comment, code lines between."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as LX
from marginalia.operators import audit
from marginalia.operators import leftover as LO
from marginalia.plans import sql
from marginalia.plans.registry import query
from marginalia.plans.text import doc_lines, doc_lines_sql
from marginalia.sources import scan as S
from marginalia.sources import sinks

#: Language by doc_id % 6: its name, the mark of a comment, a code line.
KINDS = [("python", "# ", "x = 1"), ("go", "// ", "x := 1"), ("yaml", "# ", "key: 1"), ("bash", "# ", "x=1"), ("rust", "// ", "let x = 1;"), ("javascript", "// ", "let x = 1;")]

#: A statement around a text in the languages of which leftovers are known.
STATED = [("python", 'value = compute("{}")'), ("go", 'value := compute("{}")'), ("yaml", 'spec:\n  "{}": 1'), ("javascript", 'value = compute("{}");'), ("rust", 'let value = compute("{}");')]


def sources(spark, sf_dir):
    """path, language and content. Of every four lines of a document two are a comment of two lines, one stands beside code and
    one alone, after code that is commented out; lines of code come between, so four lines make eight."""
    own = doc_lines(spark, sf_dir).withColumn("k", (F.col("doc_id") % len(KINDS)).cast("int"))
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in KINDS]), F.col("k") + 1)
    at, end = F.col("pos") % 4, F.lit("\n")
    own_line = F.concat(pick(1), "raw")
    line = F.when(at == 0, own_line).when(at == 1, F.concat(own_line, end, pick(2))).when(at == 2, F.concat(pick(2), F.lit(" "), own_line))
    line = line.otherwise(F.concat(pick(1), pick(2), end, pick(2), end, own_line, end, pick(2)))
    own = own.select("doc_id", pick(0).alias("language"), F.struct("pos", line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    made = own.groupBy("doc_id", "language").agg(text.alias("text"))
    return made.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "language", F.col("text").cast("binary").alias("content"))


_MARK = "case doc_id % 6 when 1 then '// ' when 4 then '// ' when 5 then '// ' else '# ' end"
_CODE = "case doc_id % 6 " + " ".join(f"when {i} then '{c}'" for i, (_, _, c) in enumerate(KINDS)) + " end"


@query(
    f"""select 'doc' || doc_id as path, (8 * (pos // 4) + [0, 1, 3, 6][pos % 4 + 1])::int as row, regexp_replace({_MARK} || raw, '[\r]+\\z', '') as raw, pos % 4 = 2 as "trailing" from {doc_lines_sql()}
union all select 'doc' || doc_id, (8 * (pos // 4) + 4)::int, {_MARK} || {_CODE}, false from {doc_lines_sql()} where pos % 4 = 3"""
)
def scan_comments(spark, sf_dir):
    return S.scan(sources(spark, sf_dir)).filter("error is null").select("path", "row", "raw", "trailing")


@query(
    f"""with t as (select doc_id, pos, {_CODE} as code from {doc_lines_sql()} where pos % 4 = 3 and doc_id % 6 <> 3)
select 'doc' || doc_id as path, 8 * (pos // 4) + 5 as line, 'leftover' as class, 1.0::double as score, ({sql.site_key('code')})::varchar as key from t"""
)
def sweep_findings(spark, sf_dir):
    """The whole sweep. In these sources just the code that is commented out is to be found, but for bash, of whose code
    nothing is ever said; tests hold the sweep against fixtures of every rule."""
    return audit.judge(audit.comments(S.scan(sources(spark, sf_dir)), most=None)).select("path", "line", "class", F.round("score", 6).alias("score"), F.col("key").cast("string").alias("key"))


_BUILD = f"select doc_id, pos, case when pos % 3 = 0 then 'RUN ' || raw when pos % 3 = 1 then 'Run ' || raw else raw end as body from {doc_lines_sql()}"


@query(f"select doc_id, pos, coalesce((string_split(trim(body), ' '))[1] in {sql.among(LX.DOCKER)} and len(list_filter(regexp_split_to_array(body, '[\\s]+'), lambda w: w <> '')) > 1 and strlen(body) <= 16384, false) as code from ({_BUILD})")
def leftover_dockerfile(spark, sf_dir):
    own = doc_lines(spark, sf_dir)
    body = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("RUN "), "raw")).when(F.col("pos") % 3 == 1, F.concat(F.lit("Run "), "raw")).otherwise(F.col("raw"))
    own = own.select("doc_id", "pos", F.lit("dockerfile").alias("language"), body.alias("body"), F.lit("").alias("above"), F.lit(0).alias("col"))
    return LO.mark(own).select("doc_id", "pos", F.col("leftover").alias("code"))


_LETTERS = "regexp_replace(raw, '[^A-Za-z0-9 ]', '', 'g')"
_STATED = {i: "'" + form.replace("{}", "' || words || '").replace("\n", "' || chr(10) || '") + "'" for i, (_, form) in enumerate(STATED)}


@query(
    f"""with w as (select doc_id, pos, {_LETTERS} as words from {doc_lines_sql()}),
b as (select doc_id, pos, case doc_id % {len(STATED)} {" ".join(f"when {i} then {x}" for i, x in _STATED.items())} end as body from w)
select doc_id, pos, pos % 2 = 0 and strlen(body) <= {LX.PARSED_BYTES} as code from b"""
)
def leftover_statements(spark, sf_dir):
    """Of every two lines one is the text in a statement of the document's language, the other a sentence that quotes it."""
    own = doc_lines(spark, sf_dir).withColumn("words", F.regexp_replace("raw", "[^A-Za-z0-9 ]", ""))
    at = (F.col("doc_id") % len(STATED) + 1).cast("int")

    def around(form: str):
        before, after = form.split("{}")
        return F.concat(F.lit(before), "words", F.lit(after))

    stated = F.element_at(F.array(*[around(form) for _, form in STATED]), at)
    language = F.element_at(F.array(*[F.lit(name) for name, _ in STATED]), at)
    own = own.select("doc_id", "pos", language.alias("language"), F.when(F.col("pos") % 2 == 0, stated).otherwise(around("the notes say {} of this")).alias("body"), F.lit("").alias("above"), F.lit(0).alias("col"))
    return LO.mark(own).select("doc_id", "pos", F.col("leftover").alias("code"))


@query()
def harvest_sentences(spark, sf_dir):
    """Sentences of documentation in the sources above."""
    return sinks.harvest(audit.comments(S.scan(sources(spark, sf_dir))))
