"""Scalar functions and metadata against values worked out by hand."""

import json

from pyspark.sql import functions as F

from debitage.functions import metrics as R
from debitage.functions import scalars as X
from debitage.operators import annotations as A


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_units(spark):
    to = lambda v, a, b, p=1: X.converted(F.lit(v), F.lit(a).cast("string"), F.lit(b), p)
    got = one(spark, to(5.0, "raw", "mm"), to(2.0, "cm", "raw"), to(1.0, "in", "cm"), to(3.0, "m", "um"), to(7.0, "ell", "cm"), to(2.0, "cm", "mm", 2), to(1.5, "mm", "mm", 2), to(4.0, None, "mm"))
    assert [round(x, 9) for x in got] == [5.0, 20.0, 2.54, 3e6, 0.7, 200.0, 1.5, 4.0]


def test_fixed_digits_follow_the_exact_value(spark):
    got = one(spark, X.fixed(F.lit(1.005), 2), X.fixed(F.lit(0.125), 2), X.fixed(F.lit(-2.5), 0), X.fixed(F.lit(2.345), 2), X.fixed(F.lit(8.345), 2), X.fixed(F.lit(1234567.0), 1))
    assert got == ("1.00", "0.13", "-3", "2.35", "8.35", "1234567.0")  # 2.345 and 8.345 lie over their decimal forms
    shown = lambda v, u, p=1: X.with_symbol(F.lit(v), F.lit(u), p)
    assert one(spark, shown(1.0, "um"), shown(1.0, "raw"), shown(2.0, "m"), shown(1.5, "in", 2), shown(3.0, "ell")) == ("1.0 μm", "1.00", "2.0000 m", "1.500 in²", "3.00")


def test_colour_maps(spark):
    got = one(spark, *(X.hex_colour(X.colour(n, F.lit(t))) for n, t in (("blueRed", 0.0), ("viridis", 1.0), ("turbo", 2.0), ("coolwarm", 0.5), ("no such map", -1.0), ("plasma", 0.1))))
    assert got == ("#3b4dbf", "#fce824", "#d63026", "#dedede", "#3b4dbf", "#3c0498")


def test_names_and_escapes(spark):
    assert one(spark, X.clean_name(F.lit("  \t\x01 a\x02b ﻿")), X.clean_name(F.lit(None).cast("string")), F.length(X.clean_name(F.lit("x" * 300)))) == (" ab", "", 200)
    assert one(spark, X.html_escape(F.lit("<a b=\"c\" d='e'>& ")), X.attribute_escape(F.lit("<\"'>&"))) == ("&lt;a b=\"c\" d='e'&gt;&amp;&nbsp;", "&lt;&quot;&#39;&gt;&amp;")
    assert one(spark, X.preview(F.lit("x" * 81)), X.preview(F.lit("x" * 80)), X.preview(F.lit("y" * 61), 60)) == ("x" * 77 + "...", "x" * 80, "y" * 57 + "...")


def test_parsed_values(spark):
    texts = ["", " ", "true", "TRUE", "12", "-.5", "0x10", "0b101", "1e3", "[1]", '{"a":1}', "{a}", "null", '"q"', "1 2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(X.parsed_value(F.col("t"))).alias("v")).orderBy("i").collect()
    assert [json.loads(r["v"]) for r in got] == ["", 0, True, "TRUE", 12, -0.5, 16, 5, 1000, [1], {"a": 1}, "{a}", "null", '"q"', "1 2"]


def test_times(spark):
    rows = [("createdAt", 946684800000), ("createdAt", 946684799999), ("updatedAt", 1704067200000), ("count", 1704067200000), ("exportedAt", 4102444800001)]
    got = spark.createDataFrame(rows, "key string, number long").select(X.is_time(F.col("key"), F.col("number")), X.shows_time(F.col("key"), F.col("number"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, True), (False, False), (False, False)]
    assert A.known_times(spark.createDataFrame(rows, "key string, number long")).count() == 3


def test_metadata_splits_and_combines(spark):
    rows = [("m", "author", "J"), ("m", "annotation-metadata", '{"annotator":"K","n":{"a":1}}'), ("m", "state-metadata", "text"), ("m", "evaluation", "7"), ("n", "annotation", "x")]
    split = A.split_metadata(spark.createDataFrame(rows, "mesh_id string, key string, value string"))
    assert sorted(tuple(r) for r in split.collect()) == [("m", "annotator", "K", "annotation"), ("m", "author", "J", "mesh"), ("m", "evaluation", "7", "annotation"), ("m", "n", '{"a":1}', "annotation"), ("n", "annotation", "x", "mesh")]
    got = {(r["mesh_id"], r["key"]): r["value"] for r in A.combine_metadata(split).collect()}
    assert set(got) == {("m", "author"), ("m", "annotation-metadata"), ("n", "annotation")}
    assert json.loads(got["m", "annotation-metadata"]) == {"annotator": "K", "n": {"a": 1}, "evaluation": 7}


def test_flattening_has_no_depth_limit(spark):
    deep = '{"d":' * 50 + '{"leaf": null, "list": [{"x": 1}], "none": {}}' + "}" * 50
    got = A.flatten_metadata(spark.createDataFrame([("m", deep), ("n", "{}"), ("o", "[1]"), ("p", None)], "mesh_id string, json string")).collect()
    assert sorted(tuple(r) for r in got) == [("m", "d." * 50 + "leaf", "null"), ("m", "d." * 50 + "list", '[{"x":1}]')]


def test_metadata_csv(spark):
    mesh = spark.createDataFrame([("m", '{"a": {"b": "x, y"}, "q": "say \\"hi\\""}')], "mesh_id string, json string")
    notes = spark.createDataFrame([("m", '{"c": null}')], "mesh_id string, json string")
    files = spark.createDataFrame([("m", None)], "mesh_id string, source_file string")
    r = A.metadata_csv(mesh, notes, files, F.lit("now")).first()
    assert r["header"] == "a.b,q,annotation.c,exportedAt,sourceFile"
    assert r["row"] == '"x, y","say ""hi""",,now,'


def test_report_headers_name_the_unit(spark):
    regions = spark.createDataFrame([("m", 0, 5, 2.0, 3.0)], "mesh_id string, scar_id int, vertex_count long, surface_area double, max_dimension double")
    r = R.report(regions, "surface_area", F.lit("cm"), "mm").first().asDict()
    assert r == {"mesh_id": "m", "rank": 1, "vertex_count": 5, "surface_area_mm2": 200.0, "max_dimension_mm": 30.0}


def test_history_keeps_the_newest_acts(spark):
    ops = [("m", i, "act") for i in range(130)] + [("m", 130 + i, "undo") for i in range(3)] + [("m", 133, "redo")]
    rows = A.history_states(spark.createDataFrame(ops, "mesh_id string, seq long, op string").repartition(3)).orderBy("position").collect()
    assert [r["seq"] for r in rows] == [*range(30, 130)] and [r["undone"] for r in rows] == [False] * 98 + [True] * 2
