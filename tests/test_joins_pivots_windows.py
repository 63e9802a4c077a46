"""Joins, pivots and window operators on literal frames, and the shape of their plans."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecraft.operators import attach as attaching
from tablecraft.operators import joins as jn
from tablecraft.operators import ordering as od
from tablecraft.operators import pivots as pv
from tablecraft.operators import windows as wn
from tablecraft.operators.logs import health_pivot
from tablecraft.operators.joins import ForeignKey
from tablecraft.operators.similarity import similar


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_table_keeps_unmatched_rows_and_null_keys(spark):
    parent = spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, n string")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 9), (13, None)], "id int, pid int")
    wide = jn.wide_table({"p": parent, "c": child}, [ForeignKey("c", ("pid",), "p", ("id",))])
    assert wide.columns == ["p_id", "p_n", "c_id", "c_pid"]
    want = parent.join(child, parent["id"] == child["pid"], "full")
    assert sorted(wide.collect(), key=str) == sorted(want.collect(), key=str)


def test_wide_table_over_several_columns_and_self_reference(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "y", 1)], "k int, s string, boss int")
    b = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "ak int, as string, v int")
    fks = [ForeignKey("a", ("boss",), "a", ("k",)), ForeignKey("b", ("ak", "as"), "a", ("k", "s"))]
    wide = jn.wide_table({"a": a, "b": b}, fks)
    want = a.join(b, (a["k"] == b["ak"]) & (a["s"] == b["as"]), "full")
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("order", [["c", "o", "l", "p"], ["l", "p", "c", "o"], ["p", "o", "c", "l"], ["o", "c", "p", "l"]])
def test_wide_table_equals_full_outer_chain(spark, order):
    c = spark.range(8).selectExpr("id as ck")
    o = spark.range(20).selectExpr("id as ok", "case when id % 7 = 0 then null else id % 11 end as ck")
    p = spark.range(5).selectExpr("id as pk")
    li = spark.range(60).selectExpr("id as lk", "id % 25 as ok", "nullif(id % 6, 4) as pk")
    fks = [ForeignKey("o", ("ck",), "c", ("ck",)), ForeignKey("l", ("ok",), "o", ("ok",)), ForeignKey("l", ("pk",), "p", ("pk",))]
    frames = {"c": c, "o": o, "l": li, "p": p}
    wide = jn.wide_table({n: frames[n] for n in order}, fks).select("c_ck", "o_ok", "o_ck", "l_lk", "l_ok", "l_pk", "p_pk")
    names = {n: f.select(*[F.col(x).alias(f"{n}_{x}") for x in f.columns]) for n, f in frames.items()}
    want = (names["c"].join(names["o"], F.col("o_ck") == F.col("c_ck"), "full").join(names["l"], F.col("l_ok") == F.col("o_ok"), "full")
            .join(names["p"], F.col("l_pk") == F.col("p_pk"), "full")).select(wide.columns)
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("sizes", [(3000, 200), (200, 3000)])
def test_children_that_multiply_are_dealt_out(spark, monkeypatch, sizes):
    for name, value in {"HOT_ROWS": 1000, "TASK_ROWS": 10_000, "BLOCK_ROWS": 64}.items():
        monkeypatch.setattr(jn, name, value, raising=False)
    parent = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id int")
    # Key 1 is hot and stands twice in the parent, 2 has children on one side only, 9 is no parent.
    left, right = [spark.range(n).selectExpr("id as v", f"cast(case when id = 5 then null when id < 4 then 9 when id < 7 then {k} else 1 end as int) as k")
                   for n, k in zip(sizes, (2, 4))]
    fks = [ForeignKey("a", ("k",), "p", ("id",)), ForeignKey("b", ("k",), "p", ("id",))]
    wide = jn.wide_table({"p": parent, "a": left, "b": right}, fks)
    names = {n: f.select(*[F.col(x).alias(f"{n}_{x}") for x in f.columns]) for n, f in (("p", parent), ("a", left), ("b", right))}
    want = names["p"].join(names["a"], F.col("a_k") == F.col("p_id"), "full").join(names["b"], F.col("b_k") == F.col("p_id"), "full").select(wide.columns)
    assert wide.exceptAll(want).isEmpty() and want.exceptAll(wide).isEmpty()
    per_task = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) > 1_000_000 and max(per_task) < 60_000
    # One side's values stand in runs, so that files of the product stay small.
    big = "a_v" if sizes[0] > sizes[1] else "b_v"
    runs = wide.rdd.mapPartitions(lambda rows: [sum(1 for _ in itertools.groupby(r[big] for r in rows))]).sum()
    assert runs < sum(per_task) / 30


def test_null_child_keys_are_spread(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        parent = spark.range(500).selectExpr("if(id = 0, null, id) as k", "id % 3 as s", "cast(id as string) as name")
        child = spark.range(20000).selectExpr("id", "if(id % 2 = 0, null, id % 600) as k", "if(id % 5 = 0, null, id % 3) as s")
        for keys in (("k",), ("k", "s")):
            wide = jn.wide_table({"p": parent, "c": child}, [ForeignKey("c", keys, "p", keys)])
            p, c = [f.select(*[F.col(x).alias(f"{n}_{x}") for x in f.columns]) for n, f in (("p", parent), ("c", child))]
            on = [F.col(f"c_{k}") == F.col(f"p_{k}") for k in keys]
            want = p.join(c, on, "full").select(wide.columns)
            assert wide.exceptAll(want).isEmpty() and want.exceptAll(wide).isEmpty()
            per_task = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
            assert max(per_task) < sum(per_task) / 4
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_table_without_path_is_an_error(spark):
    with pytest.raises(ValueError, match="no foreign key path"):
        jn.wide_table({"a": spark.range(1), "b": spark.range(1)}, [])


def test_hot_child_key_is_split_at_run_time(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        parent = spark.range(200).selectExpr("id as k", "cast(id as string) as name")
        child = spark.range(60000).repartition(6).selectExpr("id", "case when id % 2 = 0 then 3 else id % 200 end as k", "md5(string(id)) as pad")
        wide = jn.wide_table({"p": parent, "c": child}, [ForeignKey("c", ("k",), "p", ("k",))])
        # The 100 parents with an even key have no child.
        assert wide.count() == 60100
        joined = wide.select("c_id", "c_pad", "p_name")
        joined.collect()
        assert "isSkew=true" in executed(joined) or "skew=true" in executed(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_related_query_leaves_out_unrelated(spark):
    a, b, z = spark.range(3).selectExpr("id as k"), spark.range(2).selectExpr("id as ak", "id as v"), spark.range(1)
    out = jn.related_query({"a": a, "z": z, "b": b}, [ForeignKey("b", ("ak",), "a", ("k",))])
    assert out.columns == ["a_k", "b_ak", "b_v"] and out.count() == 3


def test_pivot_counts_null_and_text_as_zero(spark, rows):
    df = spark.createDataFrame([("a", "x", "2"), ("a", None, "bad"), (None, "x", None)], "r string, c string, v string")
    long = pv.pivot_long(df, ["r"], ["c"], ["v"])
    got = {(r["level"], r["r"], r["col_key"]): (r["sum"], r["count"], r["max"]) for r in long.collect()}
    assert got[(0, None, "TOTAL")] == (2.0, 3, 2.0)
    assert got[(1, "a", "N/A")] == (0.0, 1, 0.0) and got[(1, "N/A", "x")] == (0.0, 1, 0.0)
    avg = long.filter("level = 0 and col_key = 'TOTAL'").select(pv.pivot_measure("avg")).first()[0]
    assert avg == pytest.approx(2 / 3)


def test_pivot_is_one_expand_over_aggregated_cells(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    plan = executed(pv.pivot_long(o, ["o_orderstatus", "o_orderpriority"], [], ["o_totalprice"]))
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Expand") == 1
    # The expansion reads aggregated cells: an aggregate lies below it.
    assert "Aggregate" in plan[plan.index("Expand"):]


def test_pivot_wide_orders_keys_and_fills_missing(spark):
    df = spark.createDataFrame([("b", "y", 1), ("a", "x", 2)], "r string, c string, v int")
    wide = pv.pivot_wide(pv.pivot_long(df, ["r"], ["c"], ["v"]), ["r"])
    assert wide.columns == ["level", "r", "x", "y", "TOTAL"]
    assert [tuple(r) for r in wide.collect()] == [(0, None, 2.0, 1.0, 3.0), (1, "a", 2.0, 0.0, 2.0), (1, "b", 0.0, 1.0, 1.0)]


def test_pivot_wide_with_two_fields(spark):
    df = spark.createDataFrame([("a", "x", 2, 5)], "r string, c string, v int, w int")
    wide = pv.pivot_wide(pv.pivot_long(df, ["r"], ["c"], ["v", "w"]), ["r"], "count")
    assert wide.columns == ["level", "r", "x_v", "x_w", "TOTAL_v", "TOTAL_w"]


def test_shown_columns_come_from_the_same_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    source = spark.range(100).selectExpr("concat('r', id % 3) as r", "concat('c', id % 4) as c", "id as v").mapInArrow(counted, "r string, c string, v long")
    wide = pv.pivot_wide(pv.pivot_long(source, ["r"], ["c"], ["v"]), ["r"])
    assert wide.count() == 4 and wide.columns == ["level", "r", "c0", "c1", "c2", "c3", "TOTAL"] and seen.value == 100
    flat = pv.pivot_export(pv.pivot_long(source, ["r"], ["c"], ["v"]), ["r"], str(tmp_path / "out"))
    assert flat.count() == 4 and seen.value == 200
    logs = source.selectExpr("r as pipeline_id", "c as log_level")
    assert health_pivot(logs).orderBy("pipeline_id").first().asDict() == {"pipeline_id": "r0", "c0": 9, "c1": 8, "c2": 8, "c3": 9} and seen.value == 300


def test_heat_counts_missing_cells_as_zero(spark):
    df = spark.createDataFrame([("a", "x", 4), ("b", "y", 2), ("b", "x", 8)], "r string, c string, v int")
    heat = {(r["r"], r["col_key"]): r["heat"] for r in pv.pivot_heat(pv.pivot_long(df, ["r"], ["c"], ["v"])).collect()}
    assert heat[("a", "x")] == 0.0 and heat[(None, "x")] == 1.0
    assert heat[("b", "y")] == 1.0 and heat[("a", "TOTAL")] is None


def test_empty_filter_list_keeps_all(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "c string, n int")
    assert pv.filter_in(df, {"c": [], "n": [], "z": ["q"]}).count() == 2
    assert pv.filter_in(df, {"c": ["a"]}).count() == 1
    assert pv.filter_in(df, {"n": [2]}).count() == 1


def test_calc_field_null_and_division(spark, rows):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (4.0, 0.0)], "a double, b double")
    assert rows(pv.calc_field(df, "c", "a + b").select("c")) == [(1.0,), (2.0,), (4.0,)]
    assert rows(pv.calc_field(df, "c", "try_divide(a, b)").select("c")) == [(0.0,), (0.0,), (0.0,)]


def test_latest_by_limits_rows_before_the_shuffle(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    plan = executed(wn.latest_by(o, ["o_custkey"], "o_orderdate", "o_orderkey"))
    assert plan.count("WindowGroupLimit") >= 2


def test_step_lag_of_a_null_group(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:40"), (3, "2024-01-01 05:00:00"), (4, "2024-01-01 05:00:00")],
                               "id int, t string").select("id", F.to_timestamp("t").alias("t"), F.lit(None).cast("string").alias("g"))
    got = {r["id"]: r["step_seconds"] for r in wn.step_lag(df, "t", ["g"], ["id"]).collect()}
    assert got == {1: None, 2: 30.0, 3: 17960.0, 4: 0.0}
    assert wn.step_lag(df.limit(0), "t", ["g"], ["id"]).count() == 0


@pytest.mark.parametrize("by", [["u"], ["u", "f"], []])
def test_step_lag_agrees_with_a_window(spark, sf, by):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "case when user_id < 60 then null else user_id end as u", "if(user_id % 2 = 0, double('NaN'), 1.5D) as f",
        "if(event_id % 11 = 0, null, timestamp(date_trunc('day', ts))) as ts")
    over = Window.partitionBy(*by).orderBy("ts", "event_id")
    want = e.withColumn("s", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(over))) / F.lit(1e6))
    assert sorted(map(str, wn.step_lag(e, "ts", by, ["event_id"], "s").collect())) == sorted(map(str, want.collect()))


def test_step_lag_spreads_a_group_of_one_time(spark):
    df = spark.range(8000).selectExpr("id", "'g' as g", "timestamp('2024-01-01') as t").repartition(3)
    lagged = wn.step_lag(df, "t", ["g"], ["id"])
    assert {r["n"] for r in lagged.groupBy("step_seconds").agg(F.count("*").alias("n")).collect()} == {1, 7999}
    sizes = lagged.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 2500
    assert executed(lagged).count("Exchange hashpartitioning") == 0


@pytest.mark.parametrize("offset", [0, 3, 995, 996, 1990, 1999, 5000])
def test_pages_agree_with_a_row_number(spark, offset):
    df = spark.range(2000).select((F.lit(4000) - F.col("id") * 2).alias("k"), "id").repartition(7)
    want = sorted(r["k"] for r in df.collect())[offset:offset + 10]
    for shallow in (0, 10_000):
        got = [(r["k"], r["rn"]) for r in wn.page_rows(df, ["k"], offset, 10, shallow).collect()]
        assert got == [(k, offset + i + 1) for i, k in enumerate(want)]


def test_page_needs_a_key(spark):
    with pytest.raises(ValueError):
        wn.page_rows(spark.range(1), [], 0, 1)


def test_min_max_scale_of_equal_values_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 4.0), ("b", 1.0)], "g string, v double")
    got = sorted((r["g"], r["v"], r["scaled"]) for r in wn.min_max_scale(df, "v", ["g"]).collect() if r["g"] == "b")
    assert got == [("b", 0.0, 0.0), ("b", 1.0, 0.25), ("b", 4.0, 1.0)]


def test_range_slice_is_inclusive_and_pushed_down(spark, sf):
    df = spark.createDataFrame([("2024-01-01 23:59:59",), ("2024-01-03 23:59:59",), ("2024-01-04 00:00:00",), (None,)], "t string")
    df = df.select(F.to_timestamp("t").alias("t"))
    assert od.range_slice(df, "t", "2024-01-01", "2024-01-03").count() == 2
    e = spark.read.parquet(f"{sf}/events.parquet")
    plan = executed(od.range_slice(e, "ts", "2024-01-10", "2024-01-12", ["event_id"]))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_range_profile_matches_names_that_contain_ts(spark):
    df = spark.createDataFrame([("a", 1, 2)], "products string, order_date int, n int")
    assert od.range_profile(df).columns == ["row_count", "min_products", "min_order_date", "max_products", "max_order_date"]


def test_similar_is_a_top_k(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)] + [(99, None)], "id int, embedding array<float>")
    near = similar(df, [0.0, 0.0], k=4, cutoff=5.0)
    assert [(r["id"], r["_distance"]) for r in near.collect()] == [(0, 0.0), (1, 1.0), (2, 4.0)]
    assert "TakeOrderedAndProject" in executed(near)
    assert [r["id"] for r in similar(df, [1.0, 0.0], 2, None, "dot").collect()] == [9, 8]
    with pytest.raises(ValueError):
        similar(df, [1.0], metric="hamming")
