import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.operators import audit
from weft.operators.sessions import recent_searches


@pytest.mark.parametrize(
    "passed, options, rate, status",
    [
        ([True] * 10, {}, "100%", "PASS"),
        ([True] * 9 + [False], {}, "90%", "PARTIAL"),
        ([True] * 7 + [False], dict(tolerated=1, digits=1, otherwise="FAIL"), "87.5%", "PASS"),
        ([True] * 6 + [False] * 2, dict(tolerated=1, digits=1, otherwise="FAIL"), "75.0%", "FAIL"),
    ],
)
def test_summary(spark, passed, options, rate, status):
    checks = spark.createDataFrame([(p,) for p in passed], "passed boolean")
    row = audit.check_summary(checks, **options).first()
    assert (row["pass_rate"], row["status"], row["total"]) == (rate, status, len(passed))


def test_latency_percentile(spark):
    times = [30.0, 30.0, 40.0, 223.0]
    row = audit.latency_summary(spark.createDataFrame([(t,) for t in times], "ms double"), "ms").first()
    assert (row["queries"], row["mean_latency"], row["p95_latency"]) == (4, 80.75, 195.55)


def test_accuracy(spark):
    kinds = ("over_price", "under_price", "wrong_category", "wrong_gender")
    df = spark.createDataFrame([(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0)], ", ".join(f"{k} long" for k in kinds))
    assert audit.filter_accuracy(df, F.count(F.lit(1))).first()["accuracy_pct"] == 33.33
    assert audit.filter_accuracy(df.limit(0), F.count(F.lit(1))).first()["accuracy_pct"] == 100.0


def test_covers(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    right = spark.createDataFrame([("b",), ("c",)], "v string")
    assert sorted(map(tuple, audit.covers(left, right, "v").collect())) == [("a", "left"), ("c", "right")]
    assert audit.covers(left, left, "v").count() == 0


def test_recent_searches(spark):
    texts = ["jeans", "hello", "shirts", "jeans", " tops ", "skirts", "coats", "dresses", "tops"]
    rows = [(1, q, dt.datetime(2024, 1, 1, 0, i)) for i, q in enumerate(texts)]
    rows += [(2, "123", dt.datetime(2024, 1, 1))]
    log = spark.createDataFrame(rows, "user_id int, raw_query string, ts timestamp")
    got = [(r["user_id"], r["raw_query"]) for r in recent_searches(log).orderBy("user_id", "place").collect()]
    # 'jeans' keeps its first place, so five later texts push it out
    assert got == [(1, q) for q in ("dresses", "coats", "skirts", "tops", "shirts")]
