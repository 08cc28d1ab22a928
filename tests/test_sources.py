"""Sources and sinks against plain Python."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from skerry.sources import tables


def put(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_csv_forms(spark, tmp_path):
    path = put(tmp_path / "a.csv", b'\xef\xbb\xbfid,name,x\n1,"a, b",2.5\n2,"say ""hi""",\n', "wb")
    rows = tables.csv(spark, path, "id int, name string, x double").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a, b", 2.5), (2, 'say "hi"', None)]
    text = tables.csv_strings(spark, path)
    assert text.columns == ["id", "name", "x"] and [r.x for r in text.orderBy("id").collect()] == ["2.5", None]
    assert text.select(tables.coerced("id", "int").alias("i"), tables.coerced("name").alias("n")).collect()[0].n is None
    bad = put(tmp_path / "b.csv", "id,name,x\none,b,c\n")
    with pytest.raises(Exception):  # noqa: B017  strict reading of a wrong type
        tables.csv(spark, bad, "id int, name string, x double").collect()
    assert tables.csv(spark, bad, "id int, name string, x double", strict=False).collect()[0].id is None


def test_optional_takes_the_first_that_exists(spark, tmp_path):
    there = put(tmp_path / "b.csv", "id\n7\n")
    assert tables.optional(spark, [str(tmp_path / "none.csv"), there], "id int").collect()[0].id == 7
    empty = tables.optional(spark, [str(tmp_path / "none.csv")], "id int")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_geojson_of_three_shapes(spark, tmp_path):
    point = lambda x: {"type": "Point", "coordinates": [x, 0]}
    put(tmp_path / "a.json", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point(1)}, {"type": "Feature", "geometry": point(2)}]}))
    put(tmp_path / "b.json", json.dumps({"type": "Feature", "geometry": point(3)}))
    put(tmp_path / "c.json", json.dumps(point(4)))
    got = sorted(json.loads(r.geometry)["coordinates"][0] for r in tables.geojson_geometries(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 4]


def test_checksum_audit(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("x.bin", b"abc"), ("y.bin", b""), ("z.txt", b"no")):
        put(tmp_path / "d" / name, text, "wb")
    files = tables.checksums(spark, str(tmp_path / "d"), "*.bin").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")
    assert {r.name: (r.bytes, r.sha256) for r in files.collect()} == {"x.bin": (3, hashlib.sha256(b"abc").hexdigest()), "y.bin": (0, hashlib.sha256(b"").hexdigest())}
    listed = put(tmp_path / "sums.txt", f"{hashlib.sha256(b'abc').hexdigest()}  x.bin\n\n{'0' * 64}  y.bin\n{'1' * 64}  gone file.bin\n")
    want = tables.checksum_lines(spark, listed)
    state = want.join(files.withColumnRenamed("sha256", "found"), "name", "left").where("found IS NULL OR found <> sha256")
    assert {r.name: r.found is None for r in state.collect()} == {"y.bin": False, "gone file.bin": True}


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, None, 0.5)], "id int, t string, x double")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.csv(spark, str(tmp_path / "csv"), "id int, t string, x double").collect())) == sorted(map(tuple, df.collect()))
    tables.write_json_record(df, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {"id": 2, "t": None, "x": 0.5} in lines
    tables.write_text(spark.createDataFrame([("b",), ("a",)], "value string").coalesce(1), str(tmp_path / "text"))
    (part,) = [f for f in os.listdir(tmp_path / "text") if f.startswith("part")]
    assert open(tmp_path / "text" / part).read() == "b\na\n"


def test_masked_bands(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, -9999.0, -9999.5, -1e31, float("nan"), None, -5.0)], "v double")
    kept = lambda out: sorted(r.v for r in out.collect() if r.v is not None)
    assert kept(tables.masked_band(df, "v", -9999.0)) == [-5.0, 1.0]
    assert kept(tables.masked_band(df, "v", -9999.0, relative=False)) == [-9999.5, -5.0, 1.0]
    assert kept(tables.masked_band(df, "v", -9999.0, tolerance=1e-3, floor=0.0)) == [1.0]


def test_union_by_name(spark):
    out = tables.union_by_name([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")])
    assert sorted(map(tuple, out.collect())) == [(1, None), (2, "x")]
