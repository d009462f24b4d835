"""The metadata table and the images that it names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "image_id string, scale_id string, scale string"
#: Extensions tried for an id without one, in this order.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as text, further columns kept; none where the file is missing."""
    try:
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def validate(metadata: DataFrame) -> list[str]:
    """What is wrong with the metadata: missing columns, or no row."""
    wrong = [f"column {c} is missing" for c in ("image_id", "scale") if c not in metadata.columns]
    return wrong + (["no row"] if not wrong and metadata.isEmpty() else [])


def missing_folders(spark: SparkSession, data_dir: str) -> list[str]:
    """What is wrong with the data folder: it, or its folder of images, is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))
    return next(([f"{p} is missing"] for p in (data_dir, f"{data_dir}/images") if not there(p)), [])


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and length of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def resolve_images(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """metadata with path: the file of the exact name, else the first that an extension makes; null if there is none.

    A file is filed under the ids that it can be of, which are two at most.
    """
    tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(e).alias("ext")) for k, e in enumerate(("", *EXTENSIONS))])
    own = files.select("name", "path", F.explode(F.filter(tried, lambda t: F.endswith(F.col("name"), t["ext"]))).alias("t"))
    hits = own.select(F.expr("left(name, length(name) - length(t.ext))").alias("image_id"), "path", F.col("t.rank").alias("rank"))
    best = hits.groupBy("image_id").agg(F.min_by("path", "rank").alias("path"))
    return metadata.join(best, "image_id", "left")


def artefacts(images: DataFrame, files: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """images (image_id) with a column for each suffix: the file of the id's stem and that suffix, or null."""
    out = images.withColumn("__stem", F.regexp_replace("image_id", "\\.[^.]*$", ""))
    for name, suffix in suffixes.items():
        own = files.select(F.col("name").alias(f"__{name}"), F.col("path").alias(name))
        out = out.join(own, F.concat("__stem", F.lit(suffix)) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out.drop("__stem")
