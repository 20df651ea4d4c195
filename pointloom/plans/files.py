"""Segmentation of files, one cloud each and all in one plan, and the command line for it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.params import SegmentationParams
from pointloom.plans.segmentation import LABELS, segment
from pointloom.plans.storage import written
from pointloom.sources.las import Header, LasSource
from pointloom.sources.points import SUFFIX, discover, original_columns, read_delimited, separator, write_delimited


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a LAS, Parquet or delimited text file; written once, so that point ids hold."""
    if path.lower().endswith((".las", ".laz")):
        spark.dataSource.register(LasSource)
        return written(spark.read.format("las").load(path))
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    return written(read_delimited(spark, path))


def write_labelled(spark: SparkSession, path: str, labelled: DataFrame, out: str) -> str:
    """Writes a file's labelled points, in the kind that the file is, to a folder below ``out``; returns that folder."""
    stem, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
    to = f"{out}/{stem}{SUFFIX}.{kind}"
    if kind.lower() == "las":
        head = Header.read(path)
        said = lambda numbers: ",".join(map(repr, numbers))
        ordered = labelled.repartitionByRange("point_id").sortWithinPartitions("point_id")
        ordered.write.format("las").option("format", head.format).option("scale", said(head.scale)).option("offset", said(head.offset)).mode("append").save(to)
    elif kind.lower() == "parquet":
        labelled.write.parquet(to)
    else:
        line = spark.read.text(path).head()[0]
        fields, header = original_columns(line, labelled.columns)
        write_delimited(labelled, to, header, separator(line), fields)
    return to


def segment_file(spark: SparkSession, path: str, out: str, params: SegmentationParams | None = None) -> str:
    """Labels one file and writes it; returns the folder."""
    return _segment_files(spark, [path], out, params)[0]


def segment_folder(spark: SparkSession, folder: str, out: str, params: SegmentationParams | None = None) -> list[str]:
    """Labels the files of a folder, all in one plan, and writes each; returns the folders."""
    return _segment_files(spark, discover(spark, folder), out, params)


def _segment_files(spark: SparkSession, paths: list[str], out: str, params: SegmentationParams | None) -> list[str]:
    if not paths:
        return []
    tables = {path: read_points(spark, path) for path in paths}
    clouds = None
    for path, points in tables.items():
        own = points.select(F.lit(path).alias("cloud_id"), F.col("point_id").cast("bigint").alias("point_id"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
        clouds = own if clouds is None else clouds.unionByName(own)
    labels = written(segment(clouds, params).select(F.col("cloud_id").alias("_path"), F.col("point_id").alias("_id"), *LABELS))
    made = []
    for path, points in tables.items():
        own = labels.where(F.col("_path") == path).drop("_path")
        made.append(write_labelled(spark, path, points.join(own, F.col("point_id") == F.col("_id"), "left").drop("_id"), out))
    return made


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Label the point files of a folder.")
    parser.add_argument("folder")
    parser.add_argument("out")
    for name, kind in SegmentationParams.__annotations__.items():
        if kind in ("float", "int", "str"):
            parser.add_argument(f"--{name.replace('_', '-')}", type={"float": float, "int": int, "str": str}[kind])
    parser.add_argument("--isolate-outliers", action="store_true", default=None)
    given = {k: v for k, v in vars(parser.parse_args(args)).items() if v is not None}
    folder, out = given.pop("folder"), given.pop("out")
    for path in segment_folder(SparkSession.builder.getOrCreate(), folder, out, SegmentationParams(**given)):
        print(path)


if __name__ == "__main__":
    main()
