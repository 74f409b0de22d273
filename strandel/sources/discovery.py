"""Scene discovery: which files of a folder tree hold a scene's mask, image and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, folder, scene_id (grandparent__parent) of the files under `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    parts = F.split("path", "/")
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.concat_ws("__", F.element_at(parts, -3), F.element_at(parts, -2)).alias("scene_id"))


def best_match(files: DataFrame, patterns: list[str]) -> DataFrame:
    """folder, path: in each folder the file of the earliest SQL pattern, the first by name among equals."""
    rank = F.coalesce(*[F.when(F.col("path").like(p), F.lit(k)) for k, p in enumerate(patterns)])
    w = Window.partitionBy("folder").orderBy("_rank", "path")
    return files.withColumn("_rank", rank).filter("_rank is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("folder", "path")


def require(found: DataFrame, folders: DataFrame) -> DataFrame:
    """`found`, once every folder of `folders` has a match; raises with the first that has none."""
    missing = folders.join(found, "folder", "left_anti").take(1)
    if missing:
        raise FileNotFoundError(f"no matching file in {missing[0]['folder']}")
    return found
