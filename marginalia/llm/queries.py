"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, dartminhash, linededup, mixing, quality, sharding, topk, toxicity, warc
from marginalia.llm.common import short_batches
from marginalia.ship import ship

SHARDS = 16
#: Target weights of the sources; any other source, and rows without one, share the weight 1.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, **{f"src{i}": 1 for i in range(4, 20)}}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels")), ["doc_id"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shuffle(docs, SHARDS, seed=20)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.render(turns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", topk.whole("embedding").alias("v"))
    return topk.top_k_of_rows(rows, F.col("vec_id") % 50 == 0, 5)


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_classes(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.schedule(docs, WEIGHTS, order=["doc_id"])
    return mixed.withColumnsRenamed({"mix_slot": "slot", "mix_release": "release", "mix_deadline": "deadline"})


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality, op2_sharding, op3_warc, op4_line_dedup, op5_chat, op6_toxicity, op7_top_k, op8_dartminhash, op9_mixing, op10_bpe]
    return {f.__name__: f for f in own}


_OP4 = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
l as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i from d where text is not null),
w as (select doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
e as (select doc_id, i, coalesce(sum(n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from w
  union all select doc_id, max(i) + 1, sum(n) from w group by doc_id),
m as (select doc_id, i,
  min(i) over (partition by doc_id order by before range between 50 following and unbounded following) as later,
  max(i) over (partition by doc_id order by before range between unbounded preceding and 50 preceding) as earlier from e),
r as (select doc_id, i as s, later as t from m where later is not null union select doc_id, earlier, i from m where earlier is not null),
c as (select r.doc_id, r.s, r.t, md5(array_to_string(list_transform(d.parts[r.s + 1 : r.t], lambda x: md5(x)), '')) as content from r join d using (doc_id)),
g as (select *, row_number() over (partition by t - s, content order by doc_id, s) as nth from c),
x as (select distinct doc_id, unnest(range(s, t)) as i from g where nth > 1),
k as (select w.doc_id, string_agg(w.line, chr(10) order by w.i) filter (where x.i is null) as kept, count(x.i) as gone, count(*) as n_lines
  from w left join x using (doc_id, i) group by w.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.kept, '') end as text, coalesce(k.n_lines, 0) as n_lines, coalesce(k.gone, 0) as n_removed from d left join k using (doc_id)
"""

_OP5 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m as (select *, row_number() over o as k, lag(role, 1, '') over o as before,
  case role when 'system' then '<s>[SYS]  [/SYS]' when 'user' then '<s>[INST]  [/INST]' when 'assistant' then '<s>[OUT] </s>' else '<s>[ROLE ] ' || replace(role, '', '\e') || ' [/ROLE]' end as marks,
  len(text) + len(text) - len(replace(text, '', '')) + 2 * (len(regexp_extract_all(text, '</?s>|\[/?(INST|SYS)\]|\[/?ROLE\]|\[OUT\]'))) as escaped
  from t window o as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(len(marks) + escaped)::bigint as formatted_chars,
  bool_and((before = '' and k = 1 and role in ('system', 'user')) or (before = 'system' and role = 'user') or (before = 'user' and role = 'assistant') or (before = 'assistant' and role = 'user')) as valid
from m group by conv_id
"""

_OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

_OP3 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
g as (select digest, max(page_id) as largest from p where n >= 1000 group by digest)
select p.page_id, n as payload_bytes, p.digest as payload_digest, case when p.page_id < largest then 'revisit' else 'response' end as record_type,
  case when p.page_id < largest then largest end as refers_to from p left join g on g.digest = p.digest and n >= 1000
"""


_OP8 = r"""
with recursive n as (select text, min(doc_id) as node from documents where text is not null group by text),
w as (select node, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from n),
s as (select node, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as x from w where len(w) > 0),
c as (select node, count(*) as n from s group by node),
p as (select a.node as a, b.node as b, count(*) as m from s a join s b on a.x = b.x and a.node < b.node group by a.node, b.node),
e as (select a, b from p join c ca on ca.node = a join c cb on cb.node = b where m >= 0.8 * (ca.n + cb.n - m)),
f as (select a, b from e union all select b, a from e),
reach as (select node, node as other from n union select reach.node, f.b from reach join f on f.a = reach.other),
k as (select node, min(other) as class_id from reach group by node),
d as (select doc_id, coalesce(class_id, doc_id) as class_id, documents.text is null as none from documents left join n on n.text = documents.text left join k using (node))
select doc_id, class_id, case when none then 1 else count(*) over (partition by class_id) end as class_size, none or doc_id = class_id as kept from d
"""

_CLASS = "case when source in (" + ", ".join(f"'{s}'" for s in WEIGHTS) + ") then source else '*' end"
_WEIGHT = "case x " + " ".join(f"when '{s}' then {w}" for s, w in WEIGHTS.items()) + " else 1 end"
_OP9 = f"""
with recursive c as (select {_CLASS} as s, count(*) as n from documents group by 1),
g as (select list(s order by s) as names, list(n order by s) as n from c),
w as (select names, n, list_transform(names, lambda x: ({_WEIGHT})::bigint) as w from g),
r as (
  select 0::bigint as pos, 0::bigint as base, n as remain, list_transform(n, lambda x: 0::bigint) as got, list_transform(n, lambda x: x > 0) as act, 0::bigint as pick, 0::bigint as nth, 0::bigint as rel, 0::bigint as due from w
  union all
  select case when ok then pos + 1 else pos end, case when ok then base else pos end,
    case when ok then list_transform(remain, lambda x, i: case when i = p.i then x - 1 else x end) else remain end,
    case when ok then list_transform(got, lambda x, i: case when i = p.i then x + 1 else x end) else list_transform(got, lambda x: 0::bigint) end,
    case when ok then act else list_transform(remain, lambda x: x > 0) end,
    case when ok then p.i else 0 end, case when ok then n[p.i] - remain[p.i] else -1 end, base + got[p.i] * total // w[p.i], base + p.due
  from (select *, remain[p.i] > 0 as ok from (select *, list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when act[i] and got[i] * total < (pos - base + 1) * w[i]
      then {{'due': ((got[i] + 1) * total + w[i] - 1) // w[i], 'i': i}} end), lambda x: x is not null))[1] as p
    from (select r.*, w.w, w.n, list_sum(list_transform(range(1, len(w.w) + 1), lambda i: case when act[i] then w.w[i] else 0 end))::bigint as total from r, w where list_sum(remain) > 0)))
),
slots as (select names[pick] as s, nth, pos - 1 as slot, rel, due from r, w where pick > 0),
d as (select doc_id, source, {_CLASS} as s, row_number() over (partition by {_CLASS} order by doc_id) - 1 as nth from documents)
select doc_id, source, slot, rel as release, due as deadline from d join slots using (s, nth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3, "op4_line_dedup": _OP4, "op5_chat": _OP5, "op7_top_k": _OP7, "op8_dartminhash": _OP8, "op9_mixing": _OP9}
