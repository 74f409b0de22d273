"""Tables behind the figures of a measured scene, and the counters of its record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.functions.geometry import colour_share


def overlay_table(bundles: DataFrame, labelled: int = 12) -> DataFrame:
    """Every measured instance with its place in the colour range (5th to 95th percentile of its scene's
    widths) and whether it is labelled: the `labelled` longest of a scene, by design of the figure."""
    scene = Window.partitionBy("scene_id")
    ends = F.percentile("median", F.array(F.lit(0.05), F.lit(0.95))).over(scene)
    ranked = bundles.filter("median is not null").withColumn("_e", ends).withColumn("_k", F.row_number().over(scene.orderBy(F.desc("n"), "iid")))
    return ranked.select("scene_id", "iid", "median", "n", "quality", colour_share(F.col("median"), F.col("_e")[0], F.col("_e")[1]).alias("colour"), (F.col("_k") <= labelled).alias("labelled"))


def width_table(bundles: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Instances by width in each scene, with the true width beside where truth(scene_id, iid, true_width) is given."""
    rows = bundles.select("scene_id", "iid", "median", "mad", "ci_low", "ci_high", "quality").withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.col("median").desc_nulls_last(), "iid")))
    return rows if truth is None else rows.join(truth, ["scene_id", "iid"], "left").withColumn("error", F.col("median") - F.col("true_width"))


def quality_counts(bundles: DataFrame) -> DataFrame:
    """Instances of each quality by scene, and over all scenes in the row without one."""
    return bundles.rollup("scene_id").agg(*[F.count_if(F.col("quality") == q).alias(q) for q in ("good", "weak", "none")])
