"""Sparse multilabel encoding: overlapping instances as one row of compressed arrays a scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def encode(instance_pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene_id, shape, ids, indptr, indices: row-major places of each instance, in id order."""
    flat = instance_pixels.join(scenes, "scene_id").select("scene_id", "iid", (F.col("r").cast("long") * F.col("width") + F.col("c")).alias("at")).distinct()
    own = flat.groupBy("scene_id", "iid").agg(F.array_sort(F.collect_list("at")).alias("own"))
    whole = own.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("iid", "own"))).alias("all"))
    sizes = F.transform("all", lambda x: F.size(x["own"]).cast("long"))
    ends = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    out = whole.select("scene_id", F.transform("all", lambda x: x["iid"].cast("long")).alias("ids"), ends.alias("indptr"), F.flatten(F.transform("all", lambda x: x["own"])).alias("indices"))
    return out.join(scenes, "scene_id").select("scene_id", F.array(F.col("height").cast("long"), F.col("width").cast("long")).alias("shape"), "ids", "indptr", "indices")


def decode(encoded: DataFrame) -> DataFrame:
    """scene_id, iid, r, c from the compressed arrays."""
    rows = encoded.select("scene_id", "shape", "indptr", "indices", F.posexplode("ids").alias("k", "iid"))
    own = F.slice("indices", (F.element_at("indptr", F.col("k") + 1) + 1).cast("int"), (F.element_at("indptr", F.col("k") + 2) - F.element_at("indptr", F.col("k") + 1)).cast("int"))
    flat = rows.select("scene_id", F.col("shape")[1].alias("w"), "iid", F.explode(own).alias("at"))
    return flat.select("scene_id", F.col("iid").cast("int").alias("iid"), F.floor(F.col("at") / F.col("w")).cast("int").alias("r"), (F.col("at") % F.col("w")).cast("int").alias("c"))


def offsets(sizes: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """start, end: running places of parts laid end to end."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - F.col(size))


def layers(arm_pixels: DataFrame, node_pixels: DataFrame, chains: DataFrame, node_arms: DataFrame) -> DataFrame:
    """scene_id, iid, r, c: each chain's arms and the crossings they touch; a pixel may be in several layers.

    arm_pixels(scene_id, aid, r, c), node_pixels(scene_id, nid, r, c), chains(scene_id, iid, aid), node_arms(scene_id, nid, aid).
    """
    own = chains.join(arm_pixels, ["scene_id", "aid"]).select("scene_id", "iid", "r", "c")
    touched = chains.join(node_arms, ["scene_id", "aid"]).select("scene_id", "iid", "nid").distinct()  # arms of a chain share crossings
    shared = touched.join(node_pixels, ["scene_id", "nid"]).select("scene_id", "iid", "r", "c")
    return own.unionByName(shared).distinct()


def emitted(chains: DataFrame, arms: DataFrame, stubs: DataFrame, least_px: int = 6) -> DataFrame:
    """scene_id, iid, chain_id, aid without single short arms whose both ends are free; ids are given afterwards.

    arms(scene_id, aid, n_px), stubs(scene_id, aid, node)."""
    free = stubs.groupBy("scene_id", "aid").agg(F.count("node").alias("held"))
    facts = chains.join(arms, ["scene_id", "aid"]).join(free, ["scene_id", "aid"]).groupBy("scene_id", "chain_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_px").alias("px"), F.max("held").alias("held"))
    kept = facts.filter(~((F.col("n") == 1) & (F.col("px") < least_px) & (F.col("held") == 0))).withColumn("iid", F.row_number().over(Window.partitionBy("scene_id").orderBy("chain_id")))
    return chains.join(kept.select("scene_id", "chain_id", "iid"), ["scene_id", "chain_id"])
