"""Thresholds against a plain loop, and that no frame slides over a class."""

import random

from pyspark.sql import functions as F

from marginalia.operators import head as H


def plain(rows, precision, window):
    out = {}
    for c in {k for _, k, _ in rows}:
        own = [(s, lab == c) for lab, k, s in rows if k == c and s is not None]
        good = []
        for s, _ in own:
            up, near = [r for t, r in own if t >= s], [r for t, r in own if s - window <= t <= s + window]
            if sum(up) and sum(up) / len(up) >= precision and sum(near) / len(near) >= precision:
                good.append(s)
        out[c] = min(good, default=None)
    return out


def test_thresholds(spark):
    r = random.Random(5)
    # Many equal scores, ends of windows that meet scores and stretches exactly, wide and negative values.
    rows = [(r.randrange(4), c, r.choice([r.randrange(-40, 40) / 64, round(r.uniform(-1, 1), 2), r.uniform(-30, 30)])) for c in (1, 2, 3) for _ in range(300)]
    rows += [(1, 1, None), (2, 2, None), (4, 4, None), (5, 5, 0.25), (0, 6, 0.5)]
    df = spark.createDataFrame(rows, "label int, class int, score double")
    for precision, window in [(0.3, 0.0625), (0.5, 0.02), (0.26, 1.0), (0.9, 0.01)]:
        assert {x["class"]: x.threshold for x in H.cut(df, precision, window).collect()} == plain(rows, precision, window)
    many = H.measured(df, [0.0625, 1.0]).groupBy("class").agg(H.threshold(0.3, 0).alias("a"), H.threshold(0.26, 1).alias("b"))
    a, b = plain(rows, 0.3, 0.0625), plain(rows, 0.26, 1.0)
    assert {x["class"]: (x.a, x.b) for x in many.collect()} == {c: (a[c], b[c]) for c in a}


def test_plan_has_no_sliding_frame(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "label int, class int, score double")
    plan = H.cut(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in plan
    assert H.cut(df.withColumn("g", F.lit(1)), by=["g", "class"]).columns == ["g", "class", "threshold"]
