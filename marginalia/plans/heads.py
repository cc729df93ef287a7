"""Queries of the head over the table of embeddings: label 0 is the contracts, 1 to 9 are classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.operators import head as H
from marginalia.plans.registry import query, read

#: At the shipped precision most classes of these vectors are silent; the judging queries use one at which all speak.
LOW = 0.3
PRECISIONS, WINDOWS, CLEARS, BIASES, STEPS = [0.3, 0.5, 0.7, 0.85], [0.01, 0.02, 0.05], [0.005, 0.02, 0.04], [0.0, 0.03, 0.06], [0.0, 0.005, 0.02]


def head_sql(precision: float = LOW, window: float = L.WINDOW, fit: str = "true") -> str:
    return f"""f as (select * from embeddings where {fit}),
x as (select label, unnest(range(len(embedding))) as k, unnest(embedding)::double as v from f),
c as (select label, k, avg(v) as v from x group by label, k),
e as (select label, list(v order by k) as v from c group by label),
g as (select p.label as class, list_transform(range(1, len(p.v) + 1), lambda i: p.v[i] - n.v[i]) as v from e p, e n where n.label = 0 and p.label <> 0),
d as (select class, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) as direction from g),
s as (select vec_id, label, class, round(list_sum(list_transform(range(1, len(direction) + 1), lambda i: embedding[i]::double * direction[i])), 9) as score from f, d),
o as (select *, (label = class)::int as r from s),
w as (select *, sum(r) over (partition by class order by score desc) as hits, avg(r) over (partition by class order by score desc) as precise,
  avg(r) over (partition by class order by score range between {window} preceding and {window} following) as band from o),
t as (select class, min(score) filter (where hits > 0 and precise >= {precision} and band >= {precision}) as threshold from w group by class)"""


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


@query(f"with {head_sql()} select label, k::int as k, round(v, 6) as value from c")
def centroids(spark, sf_dir):
    return H.centroids(vectors(spark, sf_dir)).select("label", F.posexplode("centroid").alias("k", "v")).select("label", "k", F.round("v", 6).alias("value"))


@query(f"with {head_sql()} select class, unnest(range(len(direction)))::int as k, round(unnest(direction), 6) as value from d")
def directions(spark, sf_dir):
    return H.directions(vectors(spark, sf_dir)).select("class", F.posexplode("direction").alias("k", "v")).select("class", "k", F.round("v", 6).alias("value"))


@query(f"with {head_sql()} select vec_id, class, round(score, 6) as score from s")
def class_scores(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return H.scores(rows, H.directions(rows), ["vec_id"]).withColumn("score", F.round("score", 6))


@query(f"with {head_sql(L.PRECISION)} select class, threshold is not null as speaks, round(threshold, 6) as threshold from t")
def head_cut(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return H.fit(rows).select("class", F.col("threshold").isNotNull().alias("speaks"), F.round("threshold", 6).alias("threshold"))


def _grid_sql(of: str, values: list[float]) -> str:
    made = (f"select {v}::double as {of}, class, round(threshold, 6) as threshold from (with {head_sql(**{of: v})} select * from t)" for v in values)
    return " union all ".join(made)


@query(_grid_sql("precision", PRECISIONS))
def calibrate_precision(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    own = H.measured(H.scores(rows, H.directions(rows), ["label"]), [L.WINDOW])
    found = own.groupBy("class").agg(F.array(*[F.struct(F.lit(p).alias("precision"), F.round(H.threshold(p), 6).alias("threshold")) for p in PRECISIONS]).alias("g"))
    return found.select("class", F.inline("g")).select("precision", "class", "threshold")


@query(_grid_sql("window", WINDOWS).replace("::double as window,", '::double as "window",'))
def calibrate_window(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    own = H.measured(H.scores(rows, H.directions(rows), ["label"]), WINDOWS)
    found = own.groupBy("class").agg(F.array(*[F.struct(F.lit(w).alias("window"), F.round(H.threshold(LOW, i), 6).alias("threshold")) for i, w in enumerate(WINDOWS)]).alias("g"))
    return found.select("class", F.inline("g")).select("window", "class", "threshold")


_NEAREST = """m as (select s.*, round(score - (threshold - {bias}), 9) as margin from s join t using (class) where threshold is not null),
n as (select vec_id, label, class, margin from m where margin > {clear} qualify row_number() over (partition by vec_id order by margin desc, class) = 1)"""


def _scored(spark, sf_dir, fit: str = "true", judged: str = "true"):
    rows = vectors(spark, sf_dir)
    return H.scores(rows.filter(judged), H.fit(rows.filter(fit), LOW), ["vec_id", "label"])


@query(f"with {head_sql()}, {_NEAREST.format(bias=0.0, clear=L.CLEAR)} select vec_id, class, round(margin, 6) as margin from n")
def nearest_class(spark, sf_dir):
    return H.nearest(_scored(spark, sf_dir), ["vec_id"], F.lit(0.0)).select("vec_id", "class", F.round("margin", 6).alias("margin"))


_BIAS = "((case when vec_id // 3 % 2 = 0 then 0.03 else 0 end)::double - 2 * {step}::double)"


@query(f"""with {head_sql()}, {_NEAREST.format(bias=_BIAS.format(step=L.PER_DRAW), clear=L.CLEAR)}
select vec_id // 3 as comment, class, round(margin, 6) as margin from n qualify row_number() over (partition by vec_id // 3 order by margin desc, vec_id) = 1""")
def judge_comments(spark, sf_dir):
    own = _scored(spark, sf_dir).withColumn("comment", F.floor(F.col("vec_id") / 3))
    bias = H.allowance(F.col("comment") % 2 == 0, F.lit(3))
    read_ = H.nearest(own, ["comment", "vec_id"], bias)
    return H.judge(read_, "comment", "vec_id").withColumn("margin", F.round("margin", 6))


@query(" union all ".join(f"select {c}::double as clear, {b}::double as bias, (select count(*) from (with {head_sql()}, {_NEAREST.format(bias=b, clear=c)} select * from n where label = class)) as caught, (select count(*) from (with {head_sql()}, {_NEAREST.format(bias=b, clear=c)} select * from n where label = 0)) as nudged" for c in CLEARS for b in BIASES))
def clear_bias_grid(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("clear"), F.lit(b).alias("bias")) for c in CLEARS for b in BIASES])).alias("g")).select("g.*")
    own = _scored(spark, sf_dir).withColumnRenamed("class", "class").join(F.broadcast(grid))
    read_ = H.nearest(own, ["clear", "bias", "vec_id", "label"], F.col("bias"), F.col("clear"))
    found = read_.groupBy("clear", "bias").agg(F.count(F.when(F.col("label") == F.col("class"), 1)).alias("caught"), F.count(F.when(F.col("label") == 0, 1)).alias("nudged"))
    return F.broadcast(grid).join(found, ["clear", "bias"], "left").na.fill(0, ["caught", "nudged"])


@query(" union all ".join(f"select {s}::double as step, count(distinct vec_id // 3) as named from (with {head_sql()}, {_NEAREST.format(bias=_BIAS.format(step=s), clear=L.CLEAR)} select * from n)" for s in STEPS))
def per_draw_grid(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step"))
    own = _scored(spark, sf_dir).withColumn("comment", F.floor(F.col("vec_id") / 3)).join(F.broadcast(grid))
    read_ = H.nearest(own, ["step", "comment", "vec_id"], H.allowance(F.col("comment") % 2 == 0, F.lit(3), F.col("step")))
    return grid.join(read_.groupBy("step").agg(F.countDistinct("comment").alias("named")), "step", "left").na.fill(0, ["named"])


@query(f"""
with h as (select *, row_number() over (partition by label order by vec_id) % 2 as half from embeddings),
a as (with {head_sql().split(chr(10) + "s as")[0].rstrip(",").replace("from embeddings where true", "from h where half = 0 or label = 0")} select * from d),
b as (with {head_sql().split(chr(10) + "s as")[0].rstrip(",").replace("from embeddings where true", "from h where half = 1 or label = 0")} select * from d)
select class, round(list_sum(list_transform(range(1, len(a.direction) + 1), lambda i: a.direction[i] * b.direction[i])), 6) as cosine from a join b using (class)
""")
def stability_halves(spark, sf_dir):
    return H.stability(vectors(spark, sf_dir), "vec_id").withColumn("cosine", F.round("cosine", 6))


_HELD = f"""with {head_sql(fit="vec_id % 2 = 0").replace("0.0 as", "0.0 as")},
q as (select vec_id, label, class, round(list_sum(list_transform(range(1, len(direction) + 1), lambda i: embedding[i]::double * direction[i])), 9) as score from embeddings, d where vec_id % 2 = 1),
m as (select q.*, round(score - threshold, 9) as margin from q join t using (class) where threshold is not null),
n as (select vec_id, class from m where margin > {L.CLEAR} qualify row_number() over (partition by vec_id order by margin desc, class) = 1),
v as (select y.label, coalesce(n.class, -1) as verdict from embeddings y left join n using (vec_id) where y.vec_id % 2 = 1)"""


def _held(spark, sf_dir):
    rows = vectors(spark, sf_dir).filter("vec_id % 2 = 1").select("vec_id", "label")
    read_ = H.nearest(_scored(spark, sf_dir, "vec_id % 2 = 0", "vec_id % 2 = 1"), ["vec_id"], F.lit(0.0))
    return rows.join(read_, "vec_id", "left").select("label", F.coalesce("class", F.lit(-1)).alias("verdict"))


@query(f"{_HELD} select label, verdict, count(*) as n from v group by label, verdict")
def heldout_confusion(spark, sf_dir):
    return _held(spark, sf_dir).groupBy("label", "verdict").agg(F.count("*").alias("n"))


@query(f"""{_HELD}, k as (select unnest(range(1, 10))::int as class)
select class, round(count(*) filter (where verdict = class and label = class) / nullif(count(*) filter (where verdict = class), 0), 6) as precision,
  round(count(*) filter (where verdict = class and label = class) / nullif(count(*) filter (where label = class), 0), 6) as recall from k, v group by class""")
def heldout_precision(spark, sf_dir):
    classes = spark.range(1, 10).select(F.col("id").cast("int").alias("class"))
    counts = _held(spark, sf_dir).groupBy("label", "verdict").agg(F.count("*").alias("n"))
    fires, is_, both = F.col("verdict") == F.col("class"), F.col("label") == F.col("class"), F.lit(True)
    total = lambda c: F.sum(F.when(c & both, F.col("n")).otherwise(0))
    own = F.broadcast(classes).join(counts).groupBy("class").agg(total(fires & is_).alias("hit"), total(fires).alias("fired"), total(is_).alias("there"))
    return own.select("class", F.round(F.try_divide("hit", "fired"), 6).alias("precision"), F.round(F.try_divide("hit", "there"), 6).alias("recall"))


@query(f"{_HELD} select round(avg((verdict = -1)::int), 6) as left_alone, count(*) as contracts from v where label = 0")
def contract_left_alone(spark, sf_dir):
    own = _held(spark, sf_dir).filter("label = 0")
    return own.agg(F.round(F.avg((F.col("verdict") == -1).cast("int")), 6).alias("left_alone"), F.count("*").alias("contracts"))


@query("""
select 0 as part, item_id as ord, text, '' as label from benchmark union all select 1, doc_id, text, 'document' from documents
""")
def exemplar_union(spark, sf_dir):
    one = read(spark, sf_dir, "benchmark", F.lit(0).alias("part"), F.col("item_id").alias("ord"), "text", F.lit("").alias("label"))
    two = read(spark, sf_dir, "documents", "doc_id", "text")
    return one.unionByName(two.select(F.lit(1).alias("part"), F.col("doc_id").alias("ord"), "text", F.lit("document").alias("label")))


@query("select item_id as ord, text from benchmark b where not exists (select 1 from benchmark m where m.text = b.text and m.item_id % 3 = 0)")
def heldout_difference(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark", F.col("item_id").alias("ord"), "text")
    return rows.join(rows.filter("ord % 3 = 0").select("text"), "text", "left_anti").select("ord", "text")
