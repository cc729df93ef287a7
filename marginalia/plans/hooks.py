"""Queries of the whole chain: write events to answers, and the sweep with a head that reads what the rules leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions import prose as P
from marginalia.functions import render as R
from marginalia.operators import audit, hook, rules
from marginalia.operators import head as H
from marginalia.plans import sql as S
from marginalia.plans.heads import LOW, head_sql, vectors
from marginalia.plans.registry import query, read
from marginalia.plans.sweeps import _CODE, _MARK, KINDS, sources
from marginalia.plans.text import doc_lines_sql
from marginalia.sources import payloads
from marginalia.sources import scan as SC

SUFFIX = ["py", "go", "yaml", "sh", "rs", "js"]


def written(spark, sf_dir):
    """path and content of the sources of sweeps, under names that tell their language."""
    own = sources(spark, sf_dir).withColumn("doc_id", F.substring("path", 4, 20).cast("long"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIX]), (F.col("doc_id") % len(SUFFIX) + 1).cast("int"))
    return own.select("doc_id", F.concat(F.lit("/w/src/"), "path", F.lit("."), suffix).alias("path"), "content")


def events(files):
    """One event for each file, as JSON: a Write; an Edit that put in the last code that is commented out, with the comment
    after it; a MultiEdit of one edit that changes nothing and one that commented code out. Sessions are shared by files."""
    k = (F.col("doc_id") % len(KINDS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in KINDS]), k)
    last = F.concat(pick(1), pick(2), F.lit("\n"), pick(2), F.lit("\n"), pick(1))
    lines = P.lines(F.col("content").cast("string"))
    # The eighth line of each group holds the text of a document's fourth line, if the document goes so far.
    groups = F.floor(F.size(lines) / 8)
    own = F.get(lines, (groups * 8 - 2).cast("int"))
    new = F.when(groups > 0, F.concat(last, F.substring(own, F.char_length(pick(1)) + 1, F.char_length(own)))).otherwise("")
    pair = lambda a, b: F.struct(a.alias("old_string"), b.alias("new_string"))
    kind = F.col("doc_id") % 3
    tool = F.when(kind == 0, "Write").when(kind == 1, "Edit").otherwise("MultiEdit")
    edits = F.when(kind == 2, F.array(pair(pick(2), pick(2)), pair(pick(1), F.concat(pick(1), pick(2)))))
    given = F.struct(F.col("path").alias("file_path"), F.when(kind == 1, new).alias("new_string"), edits.alias("edits"))
    cwd = F.when(F.col("doc_id") % 2 == 0, "/w").otherwise("")
    value = F.to_json(F.struct(F.concat(F.lit("s"), F.col("doc_id") % 40).alias("session_id"), tool.alias("tool_name"), cwd.alias("cwd"), given.alias("tool_input")))
    return files.select(F.col("doc_id").alias("write"), value.alias("value"))


def told(files):
    """What sessions were told before: of every seventh file the code that is commented out in it."""
    k = (F.col("doc_id") % len(KINDS) + 1).cast("int")
    code = F.element_at(F.array(*[F.lit(x[2]) for x in KINDS]), k)
    own = files.filter("doc_id % 7 = 0").select(F.concat(F.lit("s"), F.col("doc_id") % 40).alias("session"), "path", code.alias("code"))
    return own.select("session", "path", P.site_key(F.col("code")).alias("key"))


_REASON = S.q(rules.REASONS["leftover"])


@query(f"""
with c as (select doc_id, pos, raw, pos // 4 as g from {doc_lines_sql()} where pos % 4 = 3),
l as (select doc_id, max_by(raw, pos) as last from c group by doc_id),
t as (select doc_id, g, row_number() over (partition by doc_id order by g) as n from c join l using (doc_id)
  where doc_id % 6 <> 3 and doc_id % 7 <> 0 and (doc_id % 3 <> 1 or starts_with(raw, last))),
f as (select doc_id, string_agg('  line ' || (8 * g + 5) || '  ' || {_REASON} || chr(10), '' order by n) as lines, count(*) as found from t where n <= 3 group by doc_id),
n as (select *, case when doc_id % 2 = 0 then 'src/' else '' end || 'doc' || doc_id || '.' || ['py', 'go', 'yaml', 'sh', 'rs', 'js'][doc_id % 6 + 1] as name,
  exists (select 1 from documents d where d.doc_id % 7 = 0 and d.doc_id % 40 = f.doc_id % 40 and d.text is not null) as repeat from f)
select doc_id as write, 'PostToolUse' as event, 'Look at ' || name || ' again: these comments say what belongs elsewhere.' || chr(10) || chr(10) || lines || chr(10) ||
    case when repeat then {S.q(R.AGAIN)} else {S.q(R.FIRST)} end as context,
  found || case when found = 1 then ' comment in ' else ' comments in ' end || name || ' to look at again' as message from n
""")
def hook_findings(spark, sf_dir):
    """Payloads to answers. In these sources the code that is commented out is what a write adds to find, as in sweep_findings."""
    files = written(spark, sf_dir)
    memory = told(files)
    made = payloads.writes(payloads.payloads(events(files), keep=("write",)))
    answer = hook.answers(hook.review(made, files, memory), memory)
    parts = F.from_json("answer", "hookSpecificOutput struct<hookEventName: string, additionalContext: string>, systemMessage string")
    own = answer.select("write", parts.alias("a"))
    return own.select("write", F.col("a.hookSpecificOutput.hookEventName").alias("event"), F.col("a.hookSpecificOutput.additionalContext").alias("context"), F.col("a.systemMessage").alias("message"))


#: Class 2 of the vectors stands for restatements, all others for self-justification.
NAMES = "case when class = 2 then 'tautology' else 'compat' end"


def _runs_sql() -> str:
    """The comments of the sources: lines one and two of every four together, the third beside code, the code after it, the fourth."""
    node = f"{_MARK} || raw"
    return f"""l as (select doc_id, pos, pos // 4 as g, pos % 4 as k, {node} as node, {_CODE} as code, count(*) over (partition by doc_id) as size from {doc_lines_sql()}),
a as (select doc_id, 8 * g + case when k < 2 then 1 when k = 2 then 4 else 7 end as line, pos, node, code, k = 2 as beside, k = 3 or (k < 2 and size > g * 4 + 1) as above from l
  union all select doc_id, 8 * g + 5, pos, {_MARK} || code, code, false, true from l where k = 3),
r as (select doc_id, line, any_value(code) as code, any_value(beside) as beside, any_value(above) as above, coalesce(string_agg({S.strip('node')}, ' ' order by pos) filter ({S.strip('node')} <> ''), '') as text,
  string_agg({S.indented('node')}, chr(10) order by pos) as body, bool_and({S.strip('node')} = '' or {S.directive('node')}) as pragma from a group by doc_id, line),
e as (select * from (select *, row_number() over (partition by doc_id order by line) as nth from r where not pragma) where nth <= 64),
o as (select * exclude (pragma, nth), line % 8 = 5 and doc_id % 6 <> 3 as leftover from e where not {S.notice('body')})"""


@query(f"""
with {_runs_sql()},
p as (select *, {S.split('text')}[1:3] as pieces from o where not leftover),
u as (select doc_id, line, text, code, beside, above, -(len(pieces) - 1) * {L.PER_DRAW}::double as bias, unnest(range(len(pieces))) as place, unnest(pieces) as sentence from p),
v as (select *, (len(sentence) * 7 + place) % (select count(*) from embeddings) as vec_id from u),
h as (with {head_sql()} select vec_id, class, score, threshold from s join t using (class) where threshold is not null),
m as (select v.*, class, round(score - (threshold - bias), 9) as margin from v join h using (vec_id)),
b as (select doc_id, line, text, code, beside, above, {NAMES} as class, margin from m where margin > {L.CLEAR} qualify row_number() over (partition by doc_id, line order by margin desc, place, class) = 1),
k as (select *, {S.sentences('text')} <= 1 and len({S.content('text')}) >= 2 and len(list_filter({S.content('text')}, lambda w: list_contains({S.spelled('code')}, w))) > 0 as shares from b)
select 'doc' || doc_id as path, line, 'leftover' as class, 1.0::double as score, ({S.site_key('text')})::varchar as key from o where leftover
union all select 'doc' || doc_id, line, class, round(margin, 6), ({S.site_key('text')})::varchar from k where class <> 'tautology' or (above and not beside and shares)
""")
def sweep_judged(spark, sf_dir):
    """The sweep with a head: what no structural rule names is read by its sentences' vectors. A sentence's vector is one of the
    table of embeddings, chosen by its length and place."""
    table = vectors(spark, sf_dir)
    n = table.count()
    head = H.fit(table, LOW).withColumn("name", F.expr(NAMES))

    def embedded(rows):
        own = rows.withColumn("vec_id", (F.char_length("sentence") * 7 + F.col("at")) % n)
        return own.join(table.select("vec_id", "embedding"), "vec_id", "left")

    found = audit.judge(audit.comments(SC.scan(sources(spark, sf_dir))), head, embedded)
    return found.select("path", "line", "class", F.round("score", 6).alias("score"), F.col("key").cast("string").alias("key"))
