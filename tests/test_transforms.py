"""Transforms on literal frames: NULL, empty and tie cases."""

import pytest
from pyspark.sql import functions as F

from tablecraft.functions import scalars
from tablecraft.functions.aggs import Agg
from tablecraft.operators import transforms as tf
from tablecraft.plans import recipe as rc


def test_casing_leaves_other_modes(spark, rows):
    df = spark.createDataFrame([("aB",), (None,)], "c string")
    assert rows(df.select(scalars.casing("c", "UPPER"))) == [("AB",), (None,)]
    assert rows(df.select(scalars.casing("c", "title"))) == [("aB",), (None,)]


def test_split_null_missing_piece_and_literal_separator(spark, rows):
    df = spark.createDataFrame([(1, "a.b"), (2, None), (3, "x")], "k int, c string")
    out = df.select("k", *scalars.split_to("c", ".", ["p", "q"]))
    assert rows(out, "k") == [(1, "a", "b"), (2, "UNKNOWN", None), (3, "x", None)]


def test_case_set_new_and_existing_field(spark, rows):
    df = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z")], "n int, c string")
    assert rows(df.select(scalars.case_set("c", "n > 3", "'big'"))) == [("x",), ("big",), ("z",)]
    assert rows(df.select(scalars.case_set("d", "n > 3", "'big'", is_new=True))) == [(None,), ("big",), (None,)]


def test_convert_gives_null_for_bad_text(spark, rows):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "c string")
    assert rows(df.select(scalars.convert("c", "int"))) == [(7,), (None,), (None,)]
    dates = spark.createDataFrame([("2024-02-03",), ("nope",)], "c string")
    assert [r[0] and r[0].isoformat() for r in dates.select(scalars.convert("c", "date")).collect()] == ["2024-02-03T00:00:00", None]
    assert df.select(scalars.convert("c", "float")).dtypes == [("c", "double")]


def test_column_steps_see_input_values_only(spark, rows):
    df = spark.createDataFrame([(2, 10)], "a int, b int")
    out = rc.apply_recipe(df, [rc.Calculate("a", "a + 1"), rc.Calculate("b", "a * 100")])
    assert rows(out) == [(3, 200)]


def test_column_set_twice_is_refused(spark):
    df = spark.createDataFrame([(2,)], "a int")
    with pytest.raises(ValueError, match="more than once"):
        rc.apply_recipe(df, [rc.Calculate("a", "a + 1"), rc.Calculate("a", "a + 2")])


def test_steps_are_applied_by_group_whatever_their_order(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "g string, n int")
    steps = [rc.Drop(("n",)), rc.Filter("twice > 3"), rc.Calculate("twice", "n * 2"), rc.Aggregate("g", Agg("sum", "n", "total"))]
    out = rc.apply_recipe(df, steps)
    assert out.columns == ["g", "total", "twice"]
    assert rows(out, "g") == [("a", 6, 10), ("b", 2, 4)]


def test_recipe_is_one_projection(spark, sf):
    steps = [rc.Calculate("x", "o_orderkey + o_custkey"), rc.Casing("o_orderstatus", "LOWER"), rc.Split("o_orderpriority", "-", ("p", "q")),
             rc.CaseSet("o_totalprice", "o_custkey > 1", "0")]
    out = rc.apply_recipe(spark.read.parquet(f"{sf}/orders.parquet"), steps)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_recipes_of_all_tables_are_applied(spark):
    made = rc.apply_recipes({"a": spark.range(4), "b": spark.range(4), "c": spark.range(2)},
                            {"a": [rc.Filter("id > 1")], "b": [rc.Filter("id > 2")]})
    assert {n: df.count() for n, df in made.items()} == {"a": 2, "b": 1, "c": 2}


def test_dedup_keeps_first_by_order(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "g string, n int")
    assert rows(tf.dedup(df, ["g"], [F.col("n")]), "n") == [("a", 1), (None, 4)]


def test_search_treats_null_as_empty(spark, rows):
    df = spark.createDataFrame([("Ab", None), (None, "xb"), ("c", "c")], "p string, q string")
    assert len(rows(tf.search_rows(df, "B"))) == 2
    assert rows(tf.search_rows(df, "b", "p")) == [("Ab", None)]
    assert tf.search_rows(df, "") is df


def test_stringify_key_only_changes_floats(spark):
    df = spark.createDataFrame([(1.5, 2)], "a double, b int")
    assert tf.stringify_key(df, "a").dtypes[0] == ("a", "string")
    assert tf.stringify_key(df, "b") is df


def test_add_column_position(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tf.add_column(df, "n", at=1).columns == ["a", "n", "b"]
    assert tf.add_column(df, "n").columns == ["a", "b", "n"]


def test_encode_binary(spark, rows):
    df = spark.createDataFrame([(b"hi", "x"), (None, "y")], "a binary, b string")
    assert rows(tf.encode_binary(df)) == [("aGk=", "x"), (None, "y")]
