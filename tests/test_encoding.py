"""Rows as text, fingerprints, numbered levels, and reports that are read back."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from evalspark.functions import encoding as C
from evalspark.operators import features as X
from evalspark.operators.order import level_numbers, numbered
from evalspark.sources import examples as ex
from evalspark.sources.sinks import read_reports, write_report, write_reports


def text_of(spark, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(C.row_text(spark.createDataFrame([], f"v {kind}")).alias("t")).first().t


@pytest.mark.parametrize("value, kind, text", [
    (None, "int", "n"), (-5, "bigint", "i:2:-5"), (True, "boolean", "b:4:true"), ("é:1", "string", "s:4:é:1"), ("", "string", "s:0:"),
    (0.5, "double", f"f:23:0.{2**61}.0"), (-0.25, "float", f"f:24:-1.{3 * 2**60}.0"), (2.0**60, "double", f"f:19:{2**60}"),
    (1e300, "double", "f:7:1.0E300"), (float("nan"), "double", "f:3:NaN"), (0.0, "double", "f:5:0.0.0"), (-0.0, "double", "f:5:0.0.0"),
    (decimal.Decimal("1.50"), "decimal(9,2)", "i:4:1.50"), (datetime.date(2024, 2, 29), "date", "d:10:2024-02-29"),
    (bytearray(b"\x01\xff"), "binary", "x:4:01ff"), ([1, None], "array<int>", "a:6:i:1:1n"), ({"a": None, "b": "x"}, "struct<a: int, b: string>", "r:6:ns:1:x"),
])
def test_values_as_text(spark, value, kind, text):
    assert text_of(spark, value, kind) == text


def test_different_rows_have_different_texts(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("n", "ab"), ("s:2:ab", None), (None, None), ("a", None), (None, "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C.row_text(df)).distinct().count() == len(rows)
    near = [0.1, 0.1 + 2**-56, 1e-20, 2e-20, 1e-30, 0.0, 0.30000000000000004, 0.3, 1e-7, 9007199254740994.0, 9007199254740996.0, 2.0**62, -(2.0**63), 1e19]
    df = spark.createDataFrame([(x,) for x in near], "x double")
    assert df.select(C.row_text(df)).distinct().count() == len(set(near))


def test_a_map_is_refused(spark):
    with pytest.raises(ValueError, match="map"):
        C.row_text(spark.createDataFrame([], "x map<string, int>"))


def test_ids_do_not_depend_on_the_order_of_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert {r.id for r in ex.content_id(df).collect()} == {r.id for r in ex.content_id(df.select("y", "x")).collect()}


def test_fingerprint_changes_with_any_row_and_nothing_else(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    first = tuple(C.fingerprint(df).head())
    assert tuple(C.fingerprint(df.repartition(13).orderBy(F.rand())).head()) == first
    others = [df.where("id <> 5"), df.unionAll(df.where("id = 5")), df.withColumn("s", F.when(F.col("id") == 5, "x").otherwise(F.col("s"))), df.limit(0)]
    assert len({first, *(tuple(C.fingerprint(o).head()) for o in others)}) == 5
    assert C.fingerprint(df.limit(0)).head().n_rows == 0


def test_positions_are_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("z"))
    got = numbered(df, ["g", F.col("x").desc()]).collect()
    assert [r.position for r in sorted(got, key=lambda r: (r.g, -r.x))] == list(range(1, 5001))
    assert numbered(df.limit(0), ["x"]).count() == 0
    assert sorted(r.position for r in numbered(df, ["g"]).collect()) == list(range(1, 5001))


def test_a_million_levels_are_numbered(spark):
    df = spark.range(1_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("c"))
    got = level_numbers(df.unionAll(df).unionAll(spark.sql("SELECT CAST(NULL AS STRING)")), "c")
    wrong = got.selectExpr("number", "level", "lag(level) OVER (PARTITION BY number DIV 10000 ORDER BY number) AS before").where("before >= level")
    assert got.agg(F.count("*"), F.min("number"), F.max("number"), F.count_distinct("number")).head() == (1_000_000, 0, 999_999, 1_000_000)
    assert wrong.count() == 0


def test_encoded_categories_are_one_block_each(spark):
    rows = [(1, 0, "b", "u", 0.5), (2, 1, "a", None, 1.5), (3, 0, None, "u", 2.5), (4, 1, "c", "v", 3.5)]
    df = spark.createDataFrame(rows, "id int, label int, c string, d string, x double")
    got = {r.id: r.f for r in X.encode(df).select("id", F.expr("features").alias("v")).select("id", F.udf(lambda v: v.toArray().tolist(), "array<double>")("v").alias("f")).collect()}
    assert got == {1: [0.5, 0, 1, 0, 1, 0], 2: [1.5, 1, 0, 0, 0, 0], 3: [2.5, 0, 0, 0, 1, 0], 4: [3.5, 0, 0, 1, 0, 1]}


def test_unknown_levels_have_no_place(spark):
    known = level_numbers(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    got = X.place_levels(spark.createDataFrame([("b",), ("z",), (None,)], "c string"), ["c"], {"c": known})
    assert {r.c: r.c__place for r in got.collect()} == {"b": 1, "z": None, None: None}


TABLE = "name string, x double, n bigint, parts array<struct<rank: int, v: double>>"


@pytest.mark.parametrize("fmt", ["json", "parquet", "csv"])
def test_a_finished_run_is_read_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([('a, "b"', 0.1, 1, [(1, 0.5)]), ("c", None, None, [])], TABLE)
    for run in ("one", "two"):
        write_reports({"t": df, "none": df.limit(0)}, str(tmp_path), run, fmt)
    got = read_reports(spark, str(tmp_path), "one", {"t": df.schema, "none": df.schema})
    assert got["none"].count() == 0
    rows = {r.name: r for r in got["t"].collect()}
    assert (rows['a, "b"'].x, rows['a, "b"'].n, rows["c"].x) == (0.1, 1, None)
    parts = rows['a, "b"'].parts
    assert json.loads(parts) == [{"rank": 1, "v": 0.5}] if fmt == "csv" else [tuple(p) for p in parts] == [(1, 0.5)]


def test_an_unfinished_or_changed_run_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, 1, [])], TABLE)
    with pytest.raises(ValueError, match="not finished"):
        read_reports(spark, str(tmp_path), "one", {"t": df.schema})
    write_reports({"t": df}, str(tmp_path), "one")
    write_report(df, str(tmp_path / "t"), "two")
    with pytest.raises(ValueError, match="not finished"):
        read_reports(spark, str(tmp_path), "two", {"t": df.schema})
    with pytest.raises(ValueError, match="other"):
        read_reports(spark, str(tmp_path), "one", {"t": df.schema, "other": df.schema})
    write_report(df.withColumn("x", F.lit(0.2)), str(tmp_path / "t"), "one")
    with pytest.raises(ValueError, match="not what was written"):
        read_reports(spark, str(tmp_path), "one", {"t": df.schema})
