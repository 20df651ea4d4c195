"""Point files: delimited text in, Parquet and delimited text out, and small table operators on points."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates two fields: a mark, with blanks around it, or blanks alone. Between two marks is an empty field.
SEPARATORS = r" *[;,\t] *| +"
#: Where labelled copies are written; they are never read as input.
SUFFIX = "_segmented"


class PointFileError(ValueError):
    """A point file that can't be read, with the reason."""


def discover(spark: SparkSession, folder: str, pattern: str = "*.{csv,txt,las,laz}") -> list[str]:
    """Paths of the point files directly in a folder, through Spark's file systems, without labelled copies.

    Compressed files (laz) are among them, so that reading says that they need a codec, rather than passing them over.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").toLocalIterator()
    return [r["path"] for r in rows if SUFFIX not in r["path"].rsplit("/", 1)[-1]]


def sniff(line: str) -> list[str] | None:
    """The header's names, or None if the first line is data. A leading // or # is dropped."""
    line = line.strip()
    if not line:
        raise PointFileError("the first line is empty")
    bare = re.sub(r"^(//|#)\s*", "", line)
    fields = re.split(SEPARATORS, bare)
    if bare == line:
        try:
            float(next(f for f in fields if f))
            return None
        except (ValueError, StopIteration):
            pass
    return [f or f"col{i + 1}" for i, f in enumerate(fields)]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """cloud_id (the file), point_id (ascending in the file), x, y, z and the other fields as text.

    x, y and z are found by name in any case, or are the first three of a file without header, whose fields are col1, col2, ...
    """
    first = spark.read.text(path).head(1)
    if not first:
        raise PointFileError("the file is empty")
    names = sniff(first[0][0])
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("point_id"), F.col("_metadata.file_path").alias("cloud_id"), "value")
    lines = lines.where(F.length(F.trim("value")) > 0)
    if names is None:
        names = [f"col{i + 1}" for i in range(len(re.split(SEPARATORS, first[0][0].strip())))]
        xyz = [0, 1, 2]
        if len(names) < 3:
            raise PointFileError("fewer than three fields")
    else:
        lines = lines.where(F.col("value") != first[0][0])
        lower = [n.lower() for n in names]
        if any(a not in lower for a in "xyz"):
            raise PointFileError(f"no x, y and z among {names}")
        xyz = [lower.index(a) for a in "xyz"]
    fields = F.transform(F.split(F.trim("value"), SEPARATORS), lambda f: F.nullif(f, F.lit("")))
    rest = [(i, n) for i, n in enumerate(names) if i not in xyz]
    rows = lines.withColumn("_f", fields)
    return rows.select("cloud_id", "point_id", *(F.get("_f", F.lit(i)).cast("double").alias(a) for i, a in zip(xyz, "xyz")), *(F.get("_f", F.lit(i)).alias(n) for i, n in rest))


def separator(first_line: str) -> str:
    """The mark between the first two fields of a line, or a blank."""
    marks = re.findall(SEPARATORS, re.sub(r"^(//|#)\s*", "", first_line.strip()))
    return marks[0].strip(" ") or " " if marks else ","


def original_columns(first_line: str, columns: list[str]) -> tuple[list[tuple[str, str]], bool]:
    """The fields of a file as (column read, name in the file), with the labels after them, and whether the file has a header."""
    names = sniff(first_line)
    fields = names or [f"col{i + 1}" for i in range(len(re.split(SEPARATORS, first_line.strip())))]
    lower = [n.lower() for n in fields]
    places = {lower.index(a) if names else i: a for i, a in enumerate("xyz")}
    own = [(places.get(i, n), n) for i, n in enumerate(fields)]
    return own + [(c, c) for c in columns if c not in {"cloud_id", "point_id"} | {a for a, _ in own}], names is not None


def write_delimited(points: DataFrame, path: str, header: bool = True, sep: str = ",", fields: list[tuple[str, str]] | None = None) -> None:
    """One sorted text folder, labels after the other columns. ``fields``: the columns to write, and their names.

    A null is an empty field, or NaN between blanks, where an empty field would be none.
    """
    ordered = points.repartitionByRange("point_id").sortWithinPartitions("point_id")
    if fields is not None:
        ordered = ordered.select(*(F.col(f"`{c}`").alias(n) for c, n in fields))
    ordered.write.option("header", header).option("sep", sep).option("nullValue", "NaN" if sep == " " else "").csv(path)


def range_filter(points: DataFrame, field: str, low: float, high: float) -> DataFrame:
    return points.where(F.col(field).between(low, high))


def global_shift(points: DataFrame, mode: str | tuple[float, float, float] = "auto") -> DataFrame:
    """Coordinates moved towards zero: by given amounts, by the first point, or (auto) by the cloud's minimum rounded down to hundreds."""
    if isinstance(mode, tuple):
        by = {a: F.lit(-float(d)) for a, d in zip("xyz", mode)}
        return points.withColumns({a: F.col(a) - by[a] for a in "xyz"})
    if mode == "first":
        one = points.groupBy("cloud_id").agg(F.min_by(F.struct("x", "y", "z"), "point_id").alias("_s"))
    else:
        one = points.groupBy("cloud_id").agg(F.struct(*((F.floor(F.min(a) / 100) * 100).cast("double").alias(a) for a in "xyz")).alias("_s"))
    return points.join(one, "cloud_id").withColumns({a: F.col(a) - F.col(f"_s.{a}") for a in "xyz"}).select(*points.columns)


def distinct_labels(points: DataFrame, label: str = "final_segs") -> DataFrame:
    return points.select(label).distinct()


def export_graph(vertices: DataFrame, edges: DataFrame, prefix: str) -> None:
    """Vertices and edges as text folders, for inspection."""
    vertices.write.option("header", True).csv(f"{prefix}_vertices")
    edges.write.option("header", True).csv(f"{prefix}_edges")
