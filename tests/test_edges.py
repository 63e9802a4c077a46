"""Edge cases: null keys, name clashes, open ranges, nested group values, plans that must stay linear."""

import pytest
from pyspark.sql import functions as F

from tablecraft.functions.aggs import Agg
from tablecraft.operators import aggregation as ag
from tablecraft.operators import attach as attaching
from tablecraft.operators import catalog as ct
from tablecraft.operators import joins as jn
from tablecraft.operators import logs as lg
from tablecraft.operators import ordering as od
from tablecraft.operators import pivots as pv
from tablecraft.operators import windows as wn
from tablecraft.operators.relations import table_hierarchy
from tablecraft.plans.recipe import Aggregate, Dedup, Filter, apply_recipe, preview_recipe
from tablecraft.sinks.export import normalise_nested
from tablecraft.sources.files import read_files
from tablecraft.sources.sql import run_sql


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("siblings", range(1, 7))
def test_wide_table_scans_grow_with_the_tables(spark, siblings):
    parent = spark.createDataFrame([(i,) for i in range(4)], "id int")
    frames, fks, want = {"p": parent}, [], parent.select(F.col("id").alias("p_id"))
    for n in range(siblings):
        child = spark.createDataFrame([(10 * n, n % 4), (10 * n + 1, 9), (10 * n + 2, None)], "v int, k int")
        frames[f"c{n}"] = child
        fks.append(jn.ForeignKey(f"c{n}", ("k",), "p", ("id",)))
        named = child.select(F.col("v").alias(f"c{n}_v"), F.col("k").alias(f"c{n}_k"))
        want = want.join(named, F.col("p_id") == F.col(f"c{n}_k"), "full")
    wide = jn.wide_table(frames, fks)
    scans = plan_of(wide).count("LogicalRDD")
    assert scans <= 4 * siblings
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, want.select(wide.columns).collect()), key=str)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_list_aggregates_are_measured(spark, limit):
    df = spark.range(3000).selectExpr("id % 3 as g", "id as v")
    groups = df.groupBy("g").agg(F.collect_list("v").alias("vs"), F.max(F.col("v").cast("string").cast("binary")).alias("b"))
    assert groups.agg(attaching.estimated_bytes(groups)).first()[0] > 8 * 3000
    got = attaching.attach(df, groups, ["g"], broadcast_bytes=limit)
    assert got.count() == 3000 and {len(r["vs"]) for r in got.select("vs").collect()} == {1000}


@pytest.mark.parametrize("hot_rows", [10, 10**9])
@pytest.mark.parametrize("hot_bytes", [0, 1 << 30])
def test_hot_keys_at_both_sides_of_the_switch(spark, monkeypatch, hot_rows, hot_bytes):
    monkeypatch.setattr(attaching, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(attaching, "BROADCAST_BYTES", hot_bytes)
    limit = 0
    df = spark.range(300).selectExpr("nullif(if(id % 3 = 0, 1, id), 5) as k", "id")
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    got = {(r["k"], r["n"]) for r in attaching.attach(df, groups, ["k"], broadcast_bytes=limit).collect()}
    assert got == {(r["k"], r["n"]) for r in groups.collect()}
    counted = groups.withColumn("rows", F.col("n"))
    assert {(r["k"], r["n"]) for r in attaching.attach(df, counted, ["k"], broadcast_bytes=limit, rows="rows").collect()} == got
    loose = attaching.attach(df, groups, ["k"], null_safe=False, broadcast_bytes=limit)
    assert loose.count() == 300 and loose.filter("k is null").select("n").distinct().collect() == [(None,)]


@pytest.mark.parametrize("offset", [0, 2, 3, 4, 700, 1990])
def test_deep_pages_with_null_keys(spark, offset):
    rows = [(None, i) for i in range(4)] + [(i, i) for i in range(4, 2000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    whole = [r["v"] for r in df.orderBy("k", "v").collect()]
    for order in (["k", "v"], ["v"]):
        got = [(r["v"], r["rn"]) for r in wn.page_rows(df, order, offset, 7, shallow=0).collect()]
        assert got == [(v, offset + i + 1) for i, v in enumerate(whole[offset:offset + 7])]
    single = wn.page_rows(df, ["k"], offset, 7, shallow=0).collect()
    assert [r["k"] for r in single] == [rows[v][0] for v in whole[offset:offset + 7]]


def test_nested_records_with_equal_names(spark):
    df = spark.createDataFrame([(1, [(7, [(70, "x")]), (8, [])])], "id int, lines array<struct<id int, parts array<struct<id int, lines_pos string>>>>")
    tables = normalise_nested(df, "t", ["id"])
    assert [r.asDict() for r in tables["t__lines"].orderBy("id").collect()] == [
        {"_parent_id": 1, "lines_pos": 0, "id": 7}, {"_parent_id": 1, "lines_pos": 1, "id": 8}]
    assert [r.asDict() for r in tables["t__lines__parts"].collect()] == [
        {"_parent_id": 1, "_parent_lines_pos": 0, "parts_pos": 0, "id": 70, "lines_pos": "x"}]


def test_preview_of_row_steps_after_an_aggregate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, v int")
    steps = [Aggregate("g", Agg("mean", "v", "mean_v")), Filter("v >= mean_v"), Dedup(("mean_v",), ("v",))]
    assert [tuple(r) for r in preview_recipe(df, steps, 1, ["v"]).collect()] == [("a", 3, 2.0), ("b", 5, 5.0)]
    assert preview_recipe(df, steps, 2).count() == 2 == apply_recipe(df, steps).count()


def test_a_single_table_is_not_unrelated(spark):
    edges = spark.createDataFrame([("a", "b")], "source_table string, target_table string")
    for picked, want in ((["z"], []), (["z", "a"], ["a", "z"]), (["a", "b", "z"], ["z"]), ([], [])):
        tables = spark.createDataFrame([(p,) for p in picked], "table_name string")
        assert sorted(r[0] for r in jn.unrelated(tables, edges).collect()) == want


def test_open_ranges_and_unknown_measures(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert od.range_slice(df, "d", None, "2024-01-04").count() == 1 == od.range_slice(df, "d", "2024-01-04").count()
    assert od.range_slice(df, "d").count() == 3
    with pytest.raises(ValueError):
        pv.pivot_measure("middle")
    with pytest.raises(ValueError):
        ag.chart_series(df, "d", "d", "middle")
    assert ag.chart_series(spark.range(70), "id", "id", "none", limit=None).count() == 70


def test_sql_leaves_views_as_they_were(spark):
    spark.range(3).createOrReplaceTempView("kept")
    out = run_sql(spark, "SELECT count(*) AS n FROM kept JOIN gone USING (id)", {"kept": spark.range(9), "gone": spark.range(5)})
    assert out.first()["n"] == 5 and spark.table("kept").count() == 3
    assert "gone" not in {t.name for t in spark.catalog.listTables()}


def test_reports_stop_at_as_of(spark):
    rows = [("n", "p", "e1", "2024-01-02 00:00:00", "INFO"), ("n", "p", "e2", "2024-01-09 00:00:00", "ERROR")]
    logs = spark.createDataFrame(rows, "namespace string, pipeline_id string, execution_id string, timestamp string, log_level string")
    logs = logs.withColumns({"timestamp": F.to_timestamp("timestamp"), "message": F.lit("m"), "extra_data": F.lit(None).cast("string")})
    assert [r[0] for r in lg.execution_ids(logs, "n", "2024-01-03").collect()] == ["e1"]
    assert lg.volume_histogram(logs, 300, 100, "2024-01-03").count() == 1
    assert lg.filter_logs(logs, {"days_back": 3}, "2024-01-03").count() == 1
    assert {r["failed_count"] for r in lg.run_status(logs, "n", "2024-01-03").collect()} == {0}


def test_catalog_diff_within_a_pipeline(spark):
    shape = "pipeline string, table_name string, original_column_name string, data_type string, column_version int, is_deleted int, description string"
    old = spark.createDataFrame([("a", "t", "c", "int", 2, 0, "kept"), ("b", "t", "c", "text", 1, 0, "other")], shape)
    now = spark.createDataFrame([("a", "t", "c", "bigint"), ("b", "t", "c", "text"), ("b", "u", "x", "int")],
                                "pipeline string, table_name string, original_column_name string, data_type string")
    assert sorted(map(tuple, ct.catalog_diff(old, now).collect())) == [("a", "t", "c", "bigint", 3, 0), ("b", "u", "x", "int", 1, 0)]
    whole = ct.catalog_diff(old, now, whole_rows=True)
    assert whole.columns == old.columns and old.unionByName(whole).count() == 4
    assert sorted((r["pipeline"], r["description"]) for r in whole.collect()) == [("a", "kept"), ("b", None)]


def test_hierarchy_ends_when_nothing_is_reached(spark):
    edges = spark.createDataFrame([("sale_a", "x_b")], "source_table string, target_table string")
    tables = spark.createDataFrame([("sale_a",)], "table_name string")
    assert [r["table_name"] for r in table_hierarchy(edges, tables, "sale").collect()] == ["x_b"]


def test_partition_folders_are_columns_and_are_skipped(spark, tmp_path):
    spark.range(10).withColumn("d", F.col("id") % 5).write.partitionBy("d").parquet(str(tmp_path / "t"))
    df = read_files(spark, str(tmp_path / "t"), "part-.parquet", "parquet", partitioned=True).filter("d = 3")
    assert sorted(r["id"] for r in df.collect()) == [3, 8]
    assert "PartitionFilters: [isnotnull(d" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_rows_are_read_twice_to_attach_their_groups(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(attaching, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(attaching, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(attaching.attach, "__defaults__", (True, 0, None, None))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.range(400).selectExpr("if(id % 3 = 0, 1, id) as k", "id").mapInArrow(counted, "k long, id long")
    flagged = wn.any_in_group(df, F.col("id") == 3, ["k"], "three")
    assert flagged.filter("three").count() == 135 and seen.value <= 800
    before = seen.value
    back = ag.aggregate_back(df, [("k", [Agg("max", "id", "top")])])
    assert back.columns == ["k", "id", "top"] and back.filter("top = 399").count() == 135 and seen.value - before <= 800
