"""Reading and writing of the engine's file formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTS = "array<array<double>>"


def bbox_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose bbox struct meets the box (x0, y0, x1, y1).

    The comparisons are on plain nested fields, so that they reach the Parquet
    reader and whole row groups are skipped by their statistics.
    """
    x0, y0, x1, y1 = map(float, box)
    rows = spark.read.parquet(path).where((F.col("bbox.xmax") >= x0) & (F.col("bbox.xmin") <= x1) & (F.col("bbox.ymax") >= y0) & (F.col("bbox.ymin") <= y1))
    return rows.select(*columns) if columns else rows


def _features(spark: SparkSession, path: str, properties: str, coordinates: str) -> DataFrame:
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    return rows.where("geometry is not null").select("properties.*", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("raw"))


def _points(line):
    return F.transform(line, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def geojson_lines(spark: SparkSession, path: str, properties: str = "category string, street string") -> DataFrame:
    """The properties and `line` of each line; multi-lines give a row for each part, lines of fewer than two points none."""
    rows = _features(spark, path, properties, POINTS)
    parts = F.when(F.col("kind") == "LineString", F.array(F.from_json("raw", POINTS))).when(F.col("kind") == "MultiLineString", F.from_json("raw", f"array<{POINTS}>"))
    return rows.withColumn("line", F.explode(parts)).withColumn("line", _points(F.col("line"))).where(F.size("line") >= 2).drop("kind", "raw")


def geojson_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The properties, `rings` (the first of each part bounds it) and the area of each polygon; multi-polygons keep their parts together."""
    from slopewise.functions import geometry

    rows = _features(spark, path, properties, POINTS)
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("raw", f"array<{POINTS}>"))).when(F.col("kind") == "MultiPolygon", F.from_json("raw", f"array<array<{POINTS}>>"))
    rings = F.transform(F.flatten("parts"), _points)
    outer = F.transform("parts", lambda p: _points(F.get(p, F.lit(0))))
    rows = rows.withColumn("parts", parts).where("parts is not null").withColumn("rings", rings).withColumn("outer", outer)
    holes = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geometry.area(r))
    bounds = F.aggregate("outer", F.lit(0.0), lambda s, r: s + geometry.area(r))
    return rows.withColumn("area", 2 * bounds - holes).drop("kind", "raw", "parts", "outer")


def write_geojson(rows: DataFrame, path: str, geometry: str, kind: str = "LineString") -> None:
    """One feature a line (newline-delimited GeoJSON), written in parallel; geometry is an array of (x, y)."""
    properties = [c for c in rows.columns if c != geometry]
    pairs = F.transform(F.col(geometry), lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    shape = F.struct(F.lit(kind).alias("type"), (F.array(pairs) if kind == "Polygon" else pairs[0] if kind == "Point" else pairs).alias("coordinates"))
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, drop: tuple[str, ...] = ("geometry", "line", "rings")) -> None:
    """CSV with a header and without geometry columns."""
    rows.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, near: tuple[str, str] | None = None) -> None:
    """Zstandard Parquet; with near, two columns of 16-bit cells, rows are laid out in Z-order, so that boxes touch few row groups."""
    from slopewise.functions import geometry

    if near is not None:
        rows = rows.withColumn("__z", geometry.morton(F.col(near[0]), F.col(near[1]))).repartitionByRange("__z").sortWithinPartitions("__z").drop("__z")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at the path, made and written there first if it is missing or force is set."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if force or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grid_tiles(spark: SparkSession, path: str, schema: StructType | str = "r long, c long, z double") -> DataFrame:
    """A raster as one cell table, from CSV tiles under the path; of cells that several tiles hold the smallest height counts."""
    return spark.read.schema(schema).option("header", True).csv(path).groupBy("r", "c").agg(F.min("z").alias("z"))


def facility_union(streets: DataFrame, trails: DataFrame, status: tuple[str, ...] = ("INSVC", "PLNRECON")) -> DataFrame:
    """Street facilities in service with the trails, whose category is TRAIL."""
    return streets.where(F.col("status").isin(*status)).drop("status").unionByName(trails.withColumn("category", F.lit("TRAIL")), allowMissingColumns=True)


#: What the engine reads: name, what it holds, format, and whether it must be there.
DATASETS = (
    ("segments", "road pieces with connectors, flags and access rules", "parquet", True),
    ("hoods", "neighbourhood polygons", "geojson", True),
    ("raster", "ground heights", "cell tiles", True),
    ("bikeways", "bicycle facilities", "geojson", False),
    ("places", "named places with categories and trust", "parquet", False),
    ("addresses", "numbers on streets", "parquet", False),
    ("features", "mapped features with outlines", "parquet", False),
)


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "name string, holds string, format string, required boolean")
