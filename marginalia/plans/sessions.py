"""Queries of sessions, edits, sinks and streams. Events stand for findings: a user is a session, the type a path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import prose as P
from marginalia.functions import render as R
from marginalia.operators import attribution as A
from marginalia.operators import memory as M
from marginalia.operators import rules
from marginalia.plans import sql as S
from marginalia.plans.registry import query, read
from marginalia.plans.text import doc_lines, doc_lines_sql
from marginalia.sources import payloads, templates

EVENTS = "e as (select event_id, user_id as session, event_type as path, props::json ->> '$.k' as key, value as score, ts from events)"


def events(spark, sf_dir):
    own = read(spark, sf_dir, "events", "event_id", F.col("user_id").alias("session"), F.col("event_type").alias("path"), "props", F.col("value").alias("score"), "ts")
    return own.withColumn("key", F.get_json_object("props", "$.k")).drop("props")


@query(f"with {EVENTS} select event_id, session, path, key from e where event_id % 4 = 3 and not exists (select 1 from e m where m.event_id % 4 <> 3 and m.session = e.session and m.path = e.path and m.key = e.key)")
def session_unseen(spark, sf_dir):
    own = events(spark, sf_dir).drop("score", "ts")
    return M.unseen(own.filter("event_id % 4 = 3"), own.filter("event_id % 4 <> 3")).select("event_id", "session", "path", "key")


@query(f"with {EVENTS} select session, path, event_id, rank from (select *, row_number() over (partition by session, path, ts::date order by score desc, event_id)::int as rank from e) where rank <= 3")
def session_budget(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return M.budget(own, ["session", "path", "day"], ["event_id"]).select("session", "path", "event_id", "rank")


@query(f"with {EVENTS} select session, bool_or(event_id % 7 = 0 and session % 3 = 0) as repeat from e group by session")
def session_repeat(spark, sf_dir):
    own = events(spark, sf_dir)
    memory = own.filter("event_id % 7 = 0 and session % 3 = 0")
    return M.repeat(own.select("session").distinct(), memory)


@query(f"""
with {EVENTS}, g as (select session, ts, coalesce(ts - lag(ts) over w >= interval 24 hours, true)::int as fresh from e window w as (partition by session order by ts)),
l as (select session, ts, sum(fresh) over (partition by session order by ts range unbounded preceding) as life from g)
select session, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last, count(*) as writes from l group by session, life
""")
def session_expiry(spark, sf_dir):
    own = M.lives(events(spark, sf_dir).select("session", "ts"))
    return own.select("session", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "writes")


@query(f"with {EVENTS} select session, event_id from (select *, row_number() over (partition by session order by ts, event_id) - 1 as held from e) where held <= 20")
def session_cap(spark, sf_dir):
    return M.remembered(events(spark, sf_dir), ["ts", "event_id"], 20).select("session", "event_id")


@query(f"with {EVENTS}, k as (select session, path, key from e group by all) select session, path, key from k")
def stream_session_memory(spark, sf_dir):
    from marginalia.shared import scratch_dir
    from marginalia.streaming.memory import fading_sightings, write_stream

    table = read(spark, sf_dir, "events")
    # All that is there is one batch: what lies in the table in whatever order is never late.
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]")
    found = stream.select(F.col("user_id").alias("session"), F.col("event_type").alias("path"), F.get_json_object("props", "$.k").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = write_stream(fading_sightings(found).drop("ts"), f"{base}/out", f"{base}/checkpoint")
    running.awaitTermination()
    return spark.read.schema("session bigint, path string, key string").parquet(f"{base}/out")


def turns(spark, sf_dir):
    """conv_id, turn, old (the turn before) and new, which begins and ends as it does."""
    own = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    own = own.withColumn("old", before).filter("old is not null")
    n = F.char_length("old")
    return own.select("conv_id", "turn", "old", F.concat(F.substring("old", F.lit(1), F.floor(n / 2).cast("int")), "text", F.substring("old", (F.floor(n * 0.75) + 1).cast("int"), n)).alias("new"))


_TURNS = r"""b as (select conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as text from conversations),
l as (select *, lag(text) over (partition by conv_id order by turn) as old from b),
t as (select conv_id, turn, old, substr(old, 1, len(old) // 2) || text || substr(old, floor(len(old) * 0.75)::int + 1) as new from l where old is not null),
p as (select *, least(len(old), len(new)) as n, len(list_filter(range(1, least(len(old), len(new)) + 1), lambda k: old[1:k] = new[1:k])) as prefix from t),
s as (select *, len(list_filter(range(1, n - prefix + 1), lambda k: right(old, k) = right(new, k))) as suffix from p)"""


@query(f"with {_TURNS} select conv_id, turn, prefix::int as prefix, suffix::int as suffix from s")
def edit_shared(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", A.shared(F.col("old"), F.col("new")).alias("s")).select("conv_id", "turn", "s.prefix", "s.suffix")


@query(f"with {_TURNS} select conv_id, turn, 3 + prefix as start, 3 + len(new) - suffix as \"end\" from s where prefix + suffix < len(new) union all select conv_id, turn, 4 + len(new) + prefix, 4 + 2 * len(new) - suffix from s where prefix + suffix < len(new)")
def edit_narrow(spark, sf_dir):
    own = turns(spark, sf_dir).withColumn("source", F.concat(F.lit("ab\n"), F.col("new"), F.lit("\n"), F.col("new")))
    own = own.withColumns({"s": A.shared(F.col("old"), F.col("new")), "at": A.locate(F.col("source"), F.col("new"))})
    return own.select("conv_id", "turn", F.explode(A.narrow(F.col("at"), F.col("s.prefix"), F.col("s.suffix"))).alias("x")).select("conv_id", "turn", "x.start", "x.end")


@query("""
with l as (select doc_id, unnest(range(0, strlen(text) // 50 + 1)) as k, text from documents),
n as (select doc_id, (len(string_split(text, 'the ')) - 1) as n from documents)
select doc_id, least(n, 64)::int as places from n
""")
def edit_locate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(A.locate(F.col("text"), F.lit("the "))).alias("places"))


@query(f"""
with l as (select doc_id, pos, case when pos % 3 = 0 then '{{{{ ' || raw || ' }}}}' when pos % 7 = 5 then '{{{{ ' || raw else raw end as line, pos % 3 = 0 as hidden, raw from {doc_lines_sql()})
select doc_id, strlen(string_agg(line, chr(10) || chr(10) order by pos))::int as bytes,
  md5(string_agg(case when hidden and not contains(raw, '}}}}') then repeat(' ', strlen(line)) else line end, chr(10) || chr(10) order by pos)) as masked from l where raw <> '' group by doc_id
""")
def template_blank(spark, sf_dir):
    own = doc_lines(spark, sf_dir).filter("raw <> ''")
    line = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("{{ "), "raw", F.lit(" }}"))).when(F.col("pos") % 7 == 5, F.concat(F.lit("{{ "), "raw")).otherwise(F.col("raw"))
    text = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))
    out = text.select("doc_id", templates.mask(F.col("text")).alias("masked"))
    return out.select("doc_id", F.octet_length("masked").alias("bytes"), F.md5("masked").alias("masked"))


_FOUND = f"(select doc_id, pos, case when {S.code('raw')} then 'leftover' when {S.compat('raw')} then 'phrase' else 'echo' end as class, {S.sentences('raw')} as n from {doc_lines_sql()})"


def findings(spark, sf_dir):
    """doc_id, pos, class, score and reason, for every line."""
    own = doc_lines(spark, sf_dir)
    name = F.when(P.code(F.col("raw")), "leftover").when(P.compat(F.col("raw")), "phrase").otherwise("echo")
    own = own.select("doc_id", "pos", name.alias("class"), (1.0 / (1 + P.sentences(F.col("raw")))).alias("score"))
    reason = F.create_map(*[F.lit(x) for kv in rules.REASONS.items() for x in kv])
    return own.withColumn("reason", reason[F.col("class")])


_REASON = "case class " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in rules.REASONS.items()) + " end"


@query(f"select printf('doc%d:%d%s%s%s%.3f%s%s', doc_id, pos + 1, chr(9), class, chr(9), 1.0 / (1 + n), chr(9), {_REASON}) as line from {_FOUND}")
def sweep_tsv(spark, sf_dir):
    f = findings(spark, sf_dir)
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return f.select(R.tsv(path, F.col("pos") + 1, F.col("class"), F.col("score"), F.col("reason")).alias("line"))


@query(f"""
with k as (select *, row_number() over (partition by doc_id order by 1.0 / (1 + n) desc, pos) as rank, {_REASON} as reason from {_FOUND}),
g as (select doc_id, string_agg('  line ' || (pos + 1) || '  ' || reason || chr(10), '' order by rank) as lines, count(*) as n from k where rank <= 3 group by doc_id)
select doc_id, 'Look at doc' || doc_id || ' again: these comments say what belongs elsewhere.' || chr(10) || chr(10) || lines || chr(10) ||
  case when doc_id % 2 = 0 then {S.q(R.AGAIN)} else {S.q(R.FIRST)} || case when doc_id % 3 = 0 then '' else chr(10) || chr(10) || 'See AGENTS.md.' end end as report,
  n || case when n = 1 then ' comment in doc' else ' comments in doc' end || doc_id || ' to look at again' as summary from g
""")
def report_text(spark, sf_dir):
    top = M.budget(findings(spark, sf_dir), ["doc_id"], ["pos"])
    own = top.groupBy("doc_id").agg(F.collect_list(F.struct("rank", (F.col("pos") + 1).alias("line"), "reason")).alias("found"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    anchor = F.when(F.col("doc_id") % 3 != 0, "AGENTS.md")
    return own.select("doc_id", R.report(name, F.col("found"), F.col("doc_id") % 2 == 0, anchor).alias("report"), R.summary(F.size("found"), name).alias("summary"))


@query(f"select doc_id, pos, '{{\"at\":\"2020-01-01T00:00:00Z\",\"file\":\"doc' || doc_id || '\",\"line\":' || (pos + 1) || ',\"class\":\"' || class || '\",\"score\":1}}' as log from {_FOUND}")
def log_json(spark, sf_dir):
    own = findings(spark, sf_dir)
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return own.select("doc_id", "pos", R.log_line(F.lit("2020-01-01T00:00:00Z"), path, F.col("pos") + 1, F.col("class"), F.lit(1)).alias("log"))


@query("select event_id, 's' || user_id as session, 'src/' || event_type || '.go' as path, case when event_type like '%e%' then 'Edit' else 'Write' end as tool from events where event_id % 5 <> 0")
def payload_source(spark, sf_dir):
    own = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    tool = F.when(F.col("event_type").contains("e"), "Edit").otherwise("Write")
    text = F.format_string('{"session_id":"s%d","tool_name":"%s","cwd":"%d","tool_input":{"file_path":"src/%s.go"}}', "user_id", tool, "event_id", "event_type")
    value = F.when(F.col("event_id") % 10 == 0, "{not json").when(F.col("event_id") % 5 == 0, F.replace(text, F.lit("tool_name"), F.lit("tool"))).otherwise(text)
    found = payloads.payloads(own.select(value.alias("value")))
    return found.select(F.col("cwd").cast("bigint").alias("event_id"), F.col("session_id").alias("session"), F.col("tool_input.file_path").alias("path"), F.col("tool_name").alias("tool"))


@query(r"""
with p as (select page_id, url, case when page_id % 4 = 0 then '' when page_id % 4 = 1 then 'http:' else regexp_extract(url, '^https?://[^/]*', 0) end as cwd from pages)
select page_id, regexp_replace(case when cwd <> '' and starts_with(url, cwd || '/') then substr(url, len(cwd) + 2) else string_split(url, '/')[-1] end, '[\x00-\x1f\x7f]', '', 'g') as shown from p
""")
def display_paths(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    cwd = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, "http:").otherwise(F.regexp_extract("url", "^https?://[^/]*", 0))
    return pages.select("page_id", R.display(F.col("url"), cwd).alias("shown"))


@query("select page_id from pages where strlen(html) <= 2097152")
def readable_files(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "html").filter(F.octet_length("html") <= 2 << 20).select("page_id")


@query(f"with {EVENTS}, k as (select distinct path || key as name from e) select name, lower(to_base(({S.site_key('name')} // 4294967296)::bigint, 36)) as high from k")
def memory_files(spark, sf_dir):
    own = events(spark, sf_dir).select(F.concat("path", "key").alias("name")).distinct()
    high = F.floor(P.site_key(F.col("name")) / F.lit(4294967296).cast("decimal(11,0)"))
    return own.select("name", M.base36(high).alias("high"))
