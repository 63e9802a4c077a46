"""Aggregates: NULL keys, order statistics, large and skewed groups."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablecraft.functions.aggs import Agg, agg_column, latest_value
from tablecraft.operators import aggregation as ag
from tablecraft.operators import attach as attaching
from tablecraft.operators.attach import attach, keep_matching


def test_null_key_gets_null_aggregate(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 7.0)], "g string, v double")
    assert rows(ag.aggregate_back(df, [("g", [Agg("sum", "v", "s")])]), "v") == [("a", 1.0, 4.0), ("a", 3.0, 4.0), (None, 7.0, None)]


def test_aggregates_of_a_field_listed_twice_join_once(spark):
    df = spark.createDataFrame([("a", "x", 1)], "g string, h string, v int")
    out = ag.aggregate_back(df, [("g", [Agg("sum", "v", "s")]), ("h", [Agg("max", "v", "m")]), ("g", [Agg("len", "v", "n")])])
    assert out.columns == ["g", "h", "v", "s", "n", "m"]


def test_n_unique_counts_null_once(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 1)], "g string, v int")
    assert rows(ag.aggregate_by(df, "g", [("n_unique", "v", "n")]), "g") == [("a", 3), ("b", 1)]


def test_quantiles_match_python(spark):
    random.seed(1)
    data = [("hot" if i % 3 else f"g{i % 40}", float(random.randint(0, 500)) / 4) for i in range(6000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    got = {r["g"]: (r["m"], r["q"]) for r in ag.exact_quantiles(df, "g", [Agg("median", "v", "m"), Agg("quantile", "v", "q", q=0.9)]).collect()}
    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g)
        assert got[g][0] == pytest.approx(statistics.median(values))
        pos = 0.9 * (len(values) - 1)
        low = values[int(pos)]
        high = values[min(int(pos) + 1, len(values) - 1)]
        assert got[g][1] == pytest.approx(low + (high - low) * (pos - int(pos)))


def test_quantile_of_group_without_values_is_null(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 2.0), (None, 4.0)], "g string, v double")
    out = ag.aggregate_by(df, "g", [("median", "v", "m"), ("len", "v", "n")])
    assert sorted(rows(out), key=str) == sorted([("a", None, 1), ("b", 2.0, 1), (None, 4.0, 1)], key=str)


def test_skew_and_kurtosis_are_population_forms(spark):
    values = [1.0, 2.0, 2.0, 9.0]
    mu = sum(values) / 4
    m2, m3, m4 = (sum((v - mu) ** k for v in values) / 4 for k in (2, 3, 4))
    r = spark.createDataFrame([(v,) for v in values], "v double").agg(agg_column(Agg("skew", "v", "s")), agg_column(Agg("kurtosis", "v", "k"))).first()
    assert r["s"] == pytest.approx(m3 / m2 ** 1.5) and r["k"] == pytest.approx(m4 / m2 ** 2 - 3)


def test_specs_that_cannot_be_computed_are_refused():
    for bad in (Agg("first", "v", "x"), Agg("corr", "v", "x"), Agg("mode", "v", "x")):
        with pytest.raises(ValueError):
            agg_column(bad)


def test_latest_value_skips_null(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "v string, t int")
    assert df.agg(latest_value(F.col("v"), F.col("t"))).first()[0] == "x"


def test_chart_counts_null_label_and_bad_number(spark, rows):
    df = spark.createDataFrame([("a", "2"), ("a", "x"), (None, None)], "x string, y string")
    assert rows(ag.chart_series(df, "x", "y", "avg"), "label") == [("a", 1.0), ("null", 0.0)]


@pytest.mark.parametrize("limit, hot", [(10**9, 100), (0, 100), (0, 10**9)])
@pytest.mark.parametrize("null_safe", [True, False])
def test_attach_gives_the_same_rows_on_all_ways(spark, monkeypatch, limit, hot, null_safe):
    monkeypatch.setattr(attaching, "HOT_ROWS", hot)
    # A third of the rows share one key and some keys are NULL; more groups than hot keys.
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700).alias("k"), "id")
    groups = df.groupBy("k").agg(F.sum("id").alias("s"), F.max("id").alias("m"))
    got = attach(df, groups, ["k"], null_safe, broadcast_bytes=limit)
    assert got.columns == ["k", "id", "s", "m"]
    want = {r["k"]: (r["s"], r["m"]) for r in groups.collect()}
    found = got.collect()
    assert len(found) == 6000
    for r in found:
        assert (r["s"], r["m"]) == (want[r["k"]] if r["k"] is not None or null_safe else (None, None))


def test_attach_spreads_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(attaching, "HOT_ROWS", 5000)
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in attach(df, groups, ["k"], broadcast_bytes=0)
                 .groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)


def test_attach_moves_no_rows_when_groups_are_few(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = attach(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_attach_to_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    none = spark.createDataFrame([], "k int, n int")
    assert [tuple(r) for r in attach(df, none, ["k"]).collect()] == [(1, "a", None)]
    assert attach(df.limit(0), none, ["k"], broadcast_bytes=-1).collect() == []
    assert ag.aggregate_back(df.filter("k > 5"), [("v", [Agg("median", "k", "m")])]).collect() == []


def test_keep_matching(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    values = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    assert rows(keep_matching(df, values, "k")) == [(2, "b")]
