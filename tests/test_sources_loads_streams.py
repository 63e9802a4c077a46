"""Sources, loads, streams and the embedded in-process database."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablecraft.checks import sql as user_sources
from tablecraft.functions.aggs import Agg
from tablecraft.operators.joins import ForeignKey, wide_table
from tablecraft.plans.recipe import Aggregate, Dedup, Drop, Filter, apply_counted
from tablecraft.session import list_names, scratch_path
from tablecraft.sinks import export, loads
from tablecraft.sources import databases, files, payloads
from tablecraft.sources.counts import load_delta, with_counts
from tablecraft.sources.sql import from_parts, read_parts
from tablecraft.streaming import streams


def test_file_glob():
    assert files.file_glob("orders.csv") == "orders*.csv"
    assert files.file_glob("a.b.csv") == "a.b*.csv"


def test_anonymous_and_corrupt_options(spark):
    with pytest.raises(ValueError):
        files.read_files(spark, "/x", "a.parquet", "parquet", ignore_corrupt=True)
    assert "Anonymous" in files.S3_ANONYMOUS["fs.s3a.aws.credentials.provider"]


def test_file_schemas_reports_unreadable_files(spark):
    base = scratch_path(spark, "schemas")
    spark.range(2).write.parquet(f"{base}/good")
    spark.createDataFrame([("junk",)], "v string").coalesce(1).write.text(f"{base}/bad")
    spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1).write.option("header", True).csv(f"{base}/c")
    got = [(r["file"].rpartition(".")[2], r["column"], r["type"]) for r in files.file_schemas(spark, base, "part-*").collect()]
    assert ("parquet", "id", "bigint") in got and ("csv", "a", "int") in got and ("txt", None, None) in got


def test_file_schemas_of_all_kinds_in_one_job(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.csv").write_text("x,big,name,day\n1,5000000000,n,2024-01-02\n2,1,,2024-01-03\n")
    (tmp_path / "b.jsonl").write_text('{"z": 1, "a": "t"}\n{"z": 2.5, "m": {"k": [true]}}\n')
    (tmp_path / "c.json").write_text('[{"q": 1},\n {"q": null, "p": "s"}]')
    (tmp_path / "d.parquet").write_bytes(b"PAR1 not at all")
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.bin").write_bytes(b"\x00")
    spark.createDataFrame([(1, [1.5], None)], "i int, l array<float>, t timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "h"))
    found = files.file_schemas(spark, str(tmp_path), "*.*")
    got = {}
    for r in found.orderBy("file", "position").collect():
        got.setdefault(r["file"].rpartition("/")[2].rpartition(".")[2 if "part-" in r["file"] else 0], []).append((r["column"], r["type"]))
    assert got == {"a": [("x", "int"), ("big", "bigint"), ("name", "string"), ("day", "date")], "b": [("a", "string"), ("m", "struct<k:array<boolean>>"), ("z", "double")],
                   "c": [("p", "string"), ("q", "bigint")], "d": [(None, None)], "f": [(None, None)], "g": [(None, None)],
                   "parquet": [("i", "int"), ("l", "array<float>"), ("t", "timestamp_ntz")]}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_errors_that_are_not_of_the_format_are_raised(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")

    def lost(path):
        raise ConnectionError("lost")
    with pytest.raises(Exception, match="lost"):
        files.file_schemas(spark, str(tmp_path), "*.csv", lost).collect()


def test_payload_selector_and_single_objects(spark):
    df = spark.createDataFrame([('{"d": [{"a": 1}, {"a": 2}]}',), ('{"d": []}',), ("oops",), ('{"d": {"a": 3}}',)], "payload string")
    assert sorted(r["a"] for r in payloads.explode_payloads(df, "a int", "d").collect()) == [1, 2, 3]
    plain = spark.createDataFrame([('[{"a": 1}]',), ('{"a": 2}',), ("oops",), (None,)], "payload string")
    assert sorted(r["a"] for r in payloads.explode_payloads(plain, "a int").collect()) == [1, 2]


def test_rejected_payloads_have_a_reason(spark):
    texts = ['{"d": [{"a": 1}]}', '{"d": []}', "oops", '{"e": 1}', None, '{"d": 5}', "", "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = {r["i"]: r["reason"] for r in payloads.rejected_payloads(df, "a int", "d", keep=("i",)).collect()}
    assert got == {2: "no JSON", 3: "nothing under d", 4: "no text", 5: "no records", 6: "no JSON", 7: "nothing under d"}
    report = payloads.page_report(df, "a int", "d").first().asDict()
    assert report == {"pages": 8, "read": 1, "empty": 1, "rejected": 6, "records": 1}
    plain = {r["i"] for r in payloads.rejected_payloads(df, "a int", keep=("i",)).collect()}
    assert plain == {2, 4, 6} and payloads.explode_payloads(df, "a int").count() == 4


def test_user_sources_are_read_in_tasks(spark):
    import os
    driver = os.getpid()

    def read(part):
        assert os.getpid() != driver
        yield {"k": part, "v": "dict"}
        yield (part + 100, "tuple")
        yield {"k": part + 200}
    df = read_parts(spark, read, range(5), "k long, v string")
    assert df.rdd.getNumPartitions() == 5
    target = scratch_path(spark, "parts")
    from_parts(spark, read, range(5), "k long, v string", target, ["k"], "1")
    out = from_parts(spark, read, [3, 7], "k long, v string", target, ["k"], "2")
    assert out.count() == 18 and out.filter("_load_id = '2'").count() == 6 and out.filter("v IS NULL").count() == 6
    assert read_parts(spark, read, [], "k long, v string").count() == 0


def test_ranges_of_parquet_files_are_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_ROWS", 700, raising=False)
    pq.write_table(pa.table({"k": list(range(10_000)), "v": [f"v{i}" for i in range(10_000)]}), tmp_path / "a.parquet", row_group_size=450)
    pq.write_table(pa.table({"k": list(range(10_000, 10_300)), "v": [None] * 300}, schema=pa.schema({"k": pa.int64(), "v": pa.string()})), tmp_path / "b.parquet")
    pq.write_table(pa.table({"k": pa.array([], pa.int64()), "v": pa.array([], pa.string())}), tmp_path / "c.parquet")
    parts = files.parquet_ranges(str(tmp_path))
    assert len(parts) == 16 and all(len(groups) <= 3 for _, _, groups, _, _ in parts)
    got = [[b for b in files.read_range(p, ["k"])] for p in parts]
    assert [k for part in got for b in part for k in b.column(0).to_pylist()] == list(range(10_300))
    assert max(sum(b.num_rows for b in part) for part in got) == 700 and got[0][0].schema.names == ["k"]
    assert files.parquet_ranges(str(tmp_path / "c.parquet")) == []


def test_user_source_does_not_read_whole_files(spark, sf, tmp_path, monkeypatch):
    orders = pq.read_table(f"{sf}/orders.parquet")
    pq.write_table(orders, tmp_path / "orders.parquet", row_group_size=100)

    def whole(*args, **kwargs):
        raise AssertionError("a whole file was read")
    monkeypatch.setattr(pq, "read_table", whole)
    taken = []
    monkeypatch.setattr(user_sources.us, "from_parts", lambda spark, read, parts, *rest: taken.append((read, parts)))
    user_sources.u1_parts(spark, str(tmp_path))
    read, parts = taken[0]
    rows = [r for p in parts for r in read(p)]
    assert len(parts) == 8 and rows == [
        {"o_orderkey": r["o_orderkey"], "o_custkey": r["o_custkey"], "priority": r["o_orderpriority"].upper()}
        for r in orders.select(["o_orderkey", "o_custkey", "o_orderpriority"]).to_pylist()]


def test_counts_of_a_recipe(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "v int, g int")
    out, counts = apply_counted(df, [Aggregate("g", Agg("max", "v", "top")), Filter("v > 9"), Dedup(("g",)), Drop(("top",))])
    assert out.count() == 4
    assert [tuple(r.values()) for r in counts.report()] == [("filter", 40, 30, -10), ("dedup", 30, 4, -26), ("drop", 4, 4, 0), ("recipe", 40, 4, -36)]


def test_counts_of_a_load(spark):
    rows_in, seen = with_counts(spark.range(10), "in")
    rows_out, kept = with_counts(rows_in.filter("id > 6"), "out")
    rows_out.write.format("noop").mode("overwrite").save()
    assert load_delta(seen, kept) == {"rows_in": 10, "rows_out": 3, "rows_changed": -7}


def test_embedded_database_round_trip(spark):
    url = "jdbc:derby:memory:shop;create=true"
    df = spark.range(100).selectExpr("id as ID", "concat('n', id) as NAME", "id / 4.0D as PRICE")
    databases.write_table(df, url, "ITEMS", "overwrite", connections=2)
    tables = databases.read_tables(spark, url, ["ITEMS", "APP.ITEMS"], ["PRICE", None], {"ITEMS": ("ID", 4)})
    assert set(tables) == {"ITEMS", "APP_ITEMS"}
    assert tables["ITEMS"].rdd.getNumPartitions() == 4 and tables["ITEMS"].count() == 100
    assert dict(tables["ITEMS"].dtypes)["PRICE"] == "string"
    sql = databases.sql_over_jdbc(spark, url, "SELECT COUNT(*) AS N FROM ITEMS WHERE PRICE > 20")
    assert sql.first()["N"] == 19
    plan = tables["APP_ITEMS"].filter("ID < 5").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *LessThan(ID,5)]" in plan


def test_merge_rewrites_only_files_with_replaced_keys(spark):
    target = scratch_path(spark, "files")
    rows = spark.range(100_000).selectExpr("id", "'old' as v", "uuid() as filler")
    loads.merge_load(spark, target, rows, ["id"], "1", file_bytes=200_000)
    before = loads.read_state(spark, target).files
    assert len(before) > 16 and loads.load_report(spark, target) == loads.LoadReport(100_000, 100_000, 0, 0, 0, len(before))
    # 100 near keys, of which 50 are new
    batch = spark.range(40_000, 40_050).union(spark.range(200_000, 200_050)).selectExpr("id", "'new' as v")
    out = loads.merge_load(spark, target, batch, ["id"], "2", file_bytes=200_000)
    after, report = loads.read_state(spark, target).files, loads.load_report(spark, target)
    gone = set(before) - set(after)
    assert 1 <= len(gone) <= 2 and report.files_rewritten == len(gone) and (report.rows_in, report.rows_replaced) == (100, 50)
    assert out.count() == 100_050 and out.filter("v = 'new'").count() == 100 and out.filter("v = 'old' and _load_id = '1'").count() == 99_950


def test_merge_of_new_keys_rewrites_nothing(spark):
    target = scratch_path(spark, "new")
    loads.merge_load(spark, target, spark.range(1000).selectExpr("id", "'a' as v"), ["id"], "1")
    before = loads.read_state(spark, target).files
    out = loads.merge_load(spark, target, spark.range(5000, 5010).selectExpr("id", "'b' as v"), ["id"], "2")
    assert set(before) < set(loads.read_state(spark, target).files) and out.count() == 1010


@pytest.mark.parametrize("limit", [0, 10**9])
def test_many_merges_keep_one_row_per_key(spark, monkeypatch, limit):
    monkeypatch.setattr(loads, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(loads, "SMALL_FILES", 3)
    target = scratch_path(spark, "many")
    for n in range(5):
        out = loads.merge_load(spark, target, spark.range(n * 10, n * 10 + 30).selectExpr("id", f"{n} as n"), ["id"], str(n), file_bytes=300)
    got = sorted((r["id"], r["n"]) for r in out.collect())
    assert got == [(i, min(i // 10, 4)) for i in range(70)]


def test_small_files_are_joined_on_load(spark, monkeypatch):
    monkeypatch.setattr(loads, "SMALL_FILES", 4)
    monkeypatch.setattr(loads, "KEEP_VERSIONS", 4)
    for pk in (None, ["id"]):
        target = scratch_path(spark, "small")
        for n in range(12):
            out = loads.merge_load(spark, target, spark.range(n * 5, n * 5 + 5).coalesce(1), pk, str(n))
        assert sorted(r["id"] for r in out.collect()) == list(range(60)) and len(loads.read_state(spark, target).files) <= 5
        assert sorted({r["_load_id"] for r in out.collect()}, key=int) == [str(n) for n in range(12)]
        # files of the first versions were deleted by the eighth load
        assert not [n for n in list_names(spark, f"{target}/data") if n.startswith("v1-")]


def test_the_better_row_stays(spark):
    target, kind = scratch_path(spark, "better"), "k int, at int, v string"
    best = [F.col("at").desc()]
    loads.merge_load(spark, target, spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (None, 1, "n")], kind), ["k"], "1", best)
    late = spark.createDataFrame([(1, 4, "older"), (1, 3, "oldest"), (2, 6, "newer"), (3, 0, "c"), (None, 0, "n")], kind)
    out = loads.merge_load(spark, target, late, ["k"], "2", best, keep_better=True)
    assert sorted(map(tuple, out.select("k", "at", "v").collect()), key=str) == sorted(
        [(1, 5, "a"), (2, 6, "newer"), (3, 0, "c"), (None, 1, "n"), (None, 0, "n")], key=str)


def test_merge_is_repeatable_and_survives_type_changes(spark):
    target = scratch_path(spark, "types")
    loads.merge_load(spark, target, spark.createDataFrame([(1, 10), (2, 20)], "id int, v int"), ["id"], "1")
    batch = spark.createDataFrame([(2, "x", True)], "id bigint, v string, w boolean")
    for _ in range(2):
        out = loads.merge_load(spark, target, batch, ["id"], "2")
    assert sorted(tuple(r) for r in out.select("id", "v", "w").collect()) == [(1, "10", None), (2, "x", True)]


def test_old_versions_can_be_dropped(spark):
    target = scratch_path(spark, "drop")
    for n in range(4):
        loads.merge_load(spark, target, spark.range(n, n + 2).selectExpr("id", f"{n} as n"), ["id"], str(n))
    want = sorted(map(tuple, loads.read_target(spark, target).collect()))
    dropped = loads.drop_old_versions(spark, target, keep=1)
    assert dropped and loads.drop_old_versions(spark, target, keep=1) == []
    assert sorted(map(tuple, loads.read_target(spark, target).collect())) == want
    spark.range(1).write.parquet(f"{target}/data/v9-merged")
    assert loads.drop_old_versions(spark, target, keep=1) == []


def test_empty_batches(spark):
    target, none = scratch_path(spark, "empty"), spark.createDataFrame([], "id int, v string")
    assert loads.merge_load(spark, target, none, ["id"], "0").count() == 0
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    loads.merge_load(spark, target, one, ["id"], "1")
    assert [tuple(r) for r in loads.merge_load(spark, target, none, ["id"], "2").collect()] == [(1, "a", "1")]


def test_append_then_merge(spark):
    target = scratch_path(spark, "mixed")
    loads.merge_load(spark, target, spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), None, "1")
    out = loads.merge_load(spark, target, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"], "2")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "a"), (2, "c")]
    assert loads.replace_load(spark, target, spark.createDataFrame([(9, "z")], "id int, v string"), "3").count() == 1


def test_unfinished_load_is_invisible(spark):
    target = scratch_path(spark, "atomic")
    loads.merge_load(spark, target, spark.createDataFrame([(1, "a")], "id int, v string"), ["id"], "1")
    # Files of a load that never listed its version.
    spark.createDataFrame([(1, "half", "2")], "id int, v string, _load_id string").write.parquet(f"{target}/data/v2-merged")
    assert [r["v"] for r in loads.read_target(spark, target).collect()] == ["a"]
    out = loads.merge_load(spark, target, spark.createDataFrame([(1, "b")], "id int, v string"), ["id"], "2")
    assert [r["v"] for r in out.collect()] == ["b"]


def test_reading_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        loads.read_target(spark, scratch_path(spark, "none"))


def test_late_parent_gives_a_second_wide_row(spark):
    target, fks = scratch_path(spark, "late"), [ForeignKey("c", ("pid",), "p", ("id",))]
    child = spark.createDataFrame([(10, 1, "1")], "id int, pid int, _load_id string")
    none = spark.createDataFrame([], "id int, _load_id string")
    loads.wide_load(spark, target, {"p": none, "c": child}, fks, ["1"])
    parent = spark.createDataFrame([(1, "2")], "id int, _load_id string")
    out = loads.wide_load(spark, target, {"p": parent, "c": child}, fks, ["2"])
    assert sorted(((r["p_id"], r["c_id"]) for r in out.collect()), key=str) == [(1, 10), (None, 10)]


def test_refresh_equals_filter_of_the_whole_wide_table(spark):
    mark = "case when id % {} = 0 then '2' else '1' end as _load_id"
    tables = {
        "c": spark.range(10).selectExpr("id as ck", mark.format(9)),
        "o": spark.range(40).selectExpr("id as ok", "nullif(id % 12, 3) as ck", mark.format(17)),
        "l": spark.range(90).selectExpr("id as lk", "id % 45 as ok", "id % 7 as pk", mark.format(31)),
        "p": spark.range(6).selectExpr("id as pk", mark.format(5))}
    fks = [ForeignKey("o", ("ck",), "c", ("ck",)), ForeignKey("l", ("ok",), "o", ("ok",)), ForeignKey("l", ("pk",), "p", ("pk",))]
    got = loads.refresh_wide(tables, fks, ["2", "7"])
    whole = wide_table(tables, fks)
    marks = [c for c in whole.columns if c.endswith("_load_id")]
    want = whole.filter(" or ".join(f"{m} = '2'" for m in marks)).drop(*marks)
    assert got.columns == want.columns and want.count() > 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_table_names():
    assert loads.table_name("main.order items") == "main_order_items"
    assert loads.table_name("sales*.csv") == "sales__csv"


def test_nested_lists_of_lists(spark):
    df = spark.createDataFrame([(1, [([1, 2], "x"), ([], "y")]), (2, None)], "id int, items array<struct<n: array<int>, s: string>>")
    tables = export.normalise_nested(df, "t", ["id"])
    assert set(tables) == {"t", "t__items", "t__items__n"}
    assert sorted(tuple(r) for r in tables["t__items"].collect()) == [(1, 0, "x"), (1, 1, "y")]
    assert sorted(tuple(r) for r in tables["t__items__n"].collect()) == [(1, 0, 0, 1), (1, 0, 1, 2)]


def test_csv_values_are_quoted(spark):
    path = scratch_path(spark, "quoted")
    export.export_csv(spark.createDataFrame([(1, 'say "hi", ok', None)], "a int, b string, c string").coalesce(1), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['"a","b","c"', '"1","say ""hi"", ok",""']


def test_drain_continues_where_it_stopped(spark):
    folder, sink, marks = (scratch_path(spark, n) for n in ("in", "out", "marks"))
    spark.range(5).write.parquet(folder)
    stream = spark.readStream.schema("id bigint").parquet(folder)
    streams.drain(stream, sink, marks)
    spark.range(5, 8).write.mode("append").parquet(folder)
    streams.drain(stream, sink, marks)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(8))


def test_stream_merge_replay_is_harmless(spark):
    folder, target = scratch_path(spark, "in"), scratch_path(spark, "target")
    spark.range(6).selectExpr("id % 3 as k", "id as v").write.parquet(folder)
    stream = spark.readStream.schema("k bigint, v bigint").parquet(folder)
    for _ in range(2):  # a fresh checkpoint replays all rows
        streams.stream_merge(stream, target, ["k"], scratch_path(spark, "marks"), [F.col("v").desc()])
    assert sorted((r["k"], r["v"]) for r in loads.read_target(spark, target).collect()) == [(0, 3), (1, 4), (2, 5)]


def test_older_rows_of_later_micro_batches_lose(spark):
    folder, target = scratch_path(spark, "in"), scratch_path(spark, "target")
    for n, rows in enumerate([[(1, 7), (2, 1)], [(1, 5), (2, 2), (3, 0)], [(1, 6), (2, 0)]]):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
    stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(folder)
    streams.stream_merge(stream, target, ["k"], scratch_path(spark, "marks"), [F.col("v").desc()])
    assert loads.read_state(spark, target).version == 3
    assert sorted((r["k"], r["v"]) for r in loads.read_target(spark, target).collect()) == [(1, 7), (2, 2), (3, 0)]
