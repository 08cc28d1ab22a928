"""Reading tables: typed CSV, JSON and text sources, optional paths, checksums; and the sinks that mirror them."""

from __future__ import annotations

import atexit
import fnmatch
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (with globs) exists in whichever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A CSV with a header and the schema given; a byte order mark is no part of the first name."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="FAILFAST" if strict else "PERMISSIVE", multiLine=False, escape='"')


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; cast with ``coerced``."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def coerced(col: str, kind: str = "double") -> Column:
    """The value, or null where it is none of that kind."""
    return F.col(col).try_cast(kind)


def optional(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that exists, as CSV, else an empty table."""
    found = next((p for p in paths if exists(spark, p)), None)
    return csv(spark, found, schema) if found else spark.createDataFrame([], schema)


def masked_band(df: DataFrame, value: str, nodata: float | None, relative: bool = True, tolerance: float | None = None, floor: float = -1e30) -> DataFrame:
    """Raster cells in long form: values at nodata (or near it: by ``tolerance``, else relatively) and below ``floor`` become null."""
    v = F.col(value)
    bad = (v < floor) | F.isnan(v)
    if nodata is not None:
        near = tolerance if tolerance is not None else max(abs(nodata) * 1e-4, 1e-3) if relative else 0.0
        bad |= F.abs(v - nodata) < near if near else v == nodata
    return df.withColumn(value, F.when(~F.coalesce(bad, F.lit(True)), v))


def geojson_geometries(spark: SparkSession, path: str) -> DataFrame:
    """One geometry (as JSON text) a row from FeatureCollections, Features or bare geometries."""
    raw = spark.read.text(path, wholetext=True)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = F.coalesce(F.get_json_object("value", "$.geometry"), F.col("value"))
    return raw.select(F.explode(F.coalesce(F.transform(features, lambda f: F.get_json_object(f, "$.geometry")), F.array(one))).alias("geometry"))


def _empty_files(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Files of no bytes, which Spark's scans leave out; names match ``glob``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and fnmatch.fnmatchcase(f.getPath().getName(), glob):
            out.append(f.getPath().toString())
    return out


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 of the files under a folder, in it and below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    full = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame([(f,) for f in _empty_files(spark, path, glob)], "path string")
    return full.unionByName(empty.select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(b""), 256).alias("sha256")))


def checksum_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of digest, two spaces, name."""
    parts = F.split(F.rtrim("value"), "  ", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("sha256"), parts[1].alias("name"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite", escape='"')


def write_json_record(df: DataFrame, path: str) -> None:
    """Each row as one JSON line with nulls written out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Few lines in their order, as one file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the session's shared folder and read back: cuts the lineage of loops, survives lost executors.

    The folder is ``spark.checkpoint.dir``; only local sessions may do without, with a temporary one.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skerry-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under the paths: name, size and time of change of each."""
    seen = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
        while listed.hasNext():
            f = listed.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def stored(spark: SparkSession, name: str, made_from: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of the shared folder for what ``made_from`` identifies: written once, read by every later step and session."""
    path = f"{_shared(spark)}/{name}-{made_from}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
