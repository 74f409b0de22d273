"""Scenes to instances: sparse masks in, overlapping instance layers out, one kernel run a scene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.config import GroupRule
from strandel.kernels import skeleton as k

ARMS = "scene_id string, aid int, seq int, r int, c int"
INSTANCES = "scene_id string, iid int, r int, c int"
AXES = "scene_id string, iid int, seq int, r double, c double"


def raster(part: pd.DataFrame) -> np.ndarray:
    """Dense mask of one scene's pixels (r, c, height, width)."""
    out = np.zeros((int(part.height.iloc[0]), int(part.width.iloc[0])), bool)
    out[part.r.to_numpy(int), part.c.to_numpy(int)] = True
    return out


def solved(mask: np.ndarray, rule: GroupRule) -> tuple[k.Scene, dict[int, int], list[list[int]]]:
    scene = k.decompose(mask, rule)
    links, found = k.solve(scene, rule)
    return scene, links, k.emitted(scene, found, rule.min_isolated_px)


def _each_scene(pixels: DataFrame, scenes: DataFrame, run, schema: str) -> DataFrame:
    joined = pixels.select("scene_id", "r", "c").join(scenes.select("scene_id", "height", "width"), "scene_id")
    return joined.groupBy("scene_id").applyInPandas(run, schema)


def instances(pixels: DataFrame, scenes: DataFrame, rule: GroupRule = GroupRule()) -> DataFrame:
    """scene_id, iid, r, c: a pixel may belong to several instances; ids start at 1 in each scene."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scene, _, found = solved(raster(part), rule)
        rows = [(key[0], i, *p) for i, chain in enumerate(found, 1) for p in sorted(k.layer(scene, chain, rule.include_nodes))]
        return pd.DataFrame(rows, columns=["scene_id", "iid", "r", "c"])

    return _each_scene(pixels, scenes, run, INSTANCES)


def axes(pixels: DataFrame, scenes: DataFrame, rule: GroupRule = GroupRule()) -> DataFrame:
    """scene_id, iid, seq, r, c: the ordered axis of every instance."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scene, links, found = solved(raster(part), rule)
        rows = [(key[0], i, n, float(p[0]), float(p[1])) for i, chain in enumerate(found, 1) for n, p in enumerate(k.chain_axis(scene, links, chain))]
        return pd.DataFrame(rows, columns=["scene_id", "iid", "seq", "r", "c"])

    return _each_scene(pixels, scenes, run, AXES)


def arms(pixels: DataFrame, scenes: DataFrame, rule: GroupRule = GroupRule()) -> DataFrame:
    """scene_id, aid, seq, r, c: the arms between crossings, each from tip to tip."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scene = k.decompose(raster(part), rule)
        return pd.DataFrame([(key[0], a, n, *p) for a, path in enumerate(scene.paths) for n, p in enumerate(path)], columns=["scene_id", "aid", "seq", "r", "c"])

    return _each_scene(pixels, scenes, run, ARMS)


def fragments(pixels: DataFrame, scenes: DataFrame, least: int = 6, spur: int = 3) -> DataFrame:
    """scene_id, frag_id, r, c: the pieces that scores are counted over."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = k.fragments(raster(part), least, spur)
        r, c = np.nonzero(found)
        return pd.DataFrame({"scene_id": key[0], "frag_id": found[r, c], "r": r, "c": c})

    return _each_scene(pixels, scenes, run, "scene_id string, frag_id int, r int, c int")


def score(pixels: DataFrame, scenes: DataFrame, truth: DataFrame, found: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Agreement of two sets of instances (scene_id, iid, r, c) over the scene's fragments."""
    from strandel.operators.agreement import assign_fragments, pairwise_agreement

    pieces = fragments(pixels, scenes) if pieces is None else pieces
    a = assign_fragments(pieces, truth).withColumnRenamed("iid", "t")
    b = assign_fragments(pieces, found).withColumnRenamed("iid", "f")
    both = a.join(b, ["scene_id", "frag_id"]).select("scene_id", "frag_id", F.nullif("t", F.lit(0)).alias("t"), F.nullif("f", F.lit(0)).alias("f"))
    return pairwise_agreement(both, ["scene_id"], "frag_id", "t", "f")
