"""Grouping with appearance: at crossings whose pairing is a close call, grey values join the costs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandel.config import GroupRule, JointRule
from strandel.functions.geometry import APPEARANCE_FLOOR, APPEARANCE_INTERCEPT, APPEARANCE_WEIGHTS
from strandel.kernels import matching, raster, skeleton
from strandel.plans.group import INSTANCES


def appearance(image: np.ndarray, level: np.ndarray, edges: np.ndarray, frame: skeleton.Frame, rule: JointRule) -> tuple[float, float] | None:
    """Median brightness over the background and median edge, a short way into the arm."""
    if not frame.reliable:
        return None
    back = np.linspace(rule.skip_px, rule.skip_px + rule.window_px, rule.n_samples)
    r, c = (frame.tip[k] - back * frame.tangent[k] for k in (0, 1))
    return float(np.median(raster.sample(image, r, c) - raster.sample(level, r, c))), float(np.median(raster.sample(edges, r, c)))


def difference(a: tuple[float, float] | None, b: tuple[float, float] | None, noise: float) -> float | None:
    """Cost in nats of two arms looking different; None where either is unknown."""
    if a is None or b is None:
        return None
    scale = noise if math.isfinite(noise) and noise > 1e-6 else APPEARANCE_FLOOR
    z = APPEARANCE_INTERCEPT + sum(w * math.tanh(abs(x - y) / scale) for w, x, y in zip(APPEARANCE_WEIGHTS, a, b, strict=True))
    loss = lambda v: max(-v, 0.0) + math.log1p(math.exp(-abs(v)))
    return loss(z) - loss(APPEARANCE_INTERCEPT)


def cost_of(stubs: list[int], pairs: list[tuple[int, int]], costs: dict, prices: dict) -> float:
    """Costs of the pairs and prices of the stubs left alone."""
    taken = {s for p in pairs for s in p}
    return sum(costs[p] for p in pairs) + sum(prices[s] for s in stubs if s not in taken)


def margins(stubs: list[int], pairs: list[tuple[int, int]], costs: dict, prices: dict) -> dict[tuple[int, int], float]:
    """For each chosen pair, how much dearer the best pairing without it is."""
    base, out = cost_of(stubs, pairs, costs, prices), {}
    for p in pairs:
        others = {k: v for k, v in costs.items() if k != p}
        out[p] = cost_of(stubs, matching.best_pairs(others, prices), others, prices) - base
    return out


def blender(image: np.ndarray, rule: JointRule, report: dict | None = None):
    """Costs for `skeleton.solve`: unchanged where every chosen pair is clear, or the weight is 0."""
    level, _, noise = raster.background(image)
    edges = raster.gradient(image)
    counts = report if report is not None else {}

    def blend(stubs: list[int], costs: dict, prices: dict, frames: list[skeleton.Frame]) -> dict:
        if rule.lambda_appearance <= 0 or len(stubs) < 2:
            return costs
        chosen = matching.best_pairs(costs, prices)
        unclear = {s for p, m in margins(stubs, chosen, costs, prices).items() if m < rule.margin_threshold for s in p}
        if not unclear:
            return costs
        looks = {s: appearance(image, level, edges, frames[s], rule) for s in stubs}
        out = dict(costs)
        for a, b in costs:
            more = difference(looks[a], looks[b], noise) if a in unclear or b in unclear else None
            if more is not None:
                out[a, b] += rule.lambda_appearance * more
                counts["n_edges_blended"] = counts.get("n_edges_blended", 0) + 1
        counts["n_flipped"] = counts.get("n_flipped", 0) + (matching.best_pairs(out, prices) != chosen)
        return out

    return blend


def joint_instances(pixels: DataFrame, greys: DataFrame, rule: GroupRule = GroupRule(), joint: JointRule = JointRule()) -> DataFrame:
    """scene_id, iid, r, c as `group.instances` gives them, with appearance at unclear crossings."""

    def run(key: tuple, part: pd.DataFrame, grey: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(grey):
            return pd.DataFrame(columns=["scene_id", "iid", "r", "c"])
        h, w = int(grey.height.iloc[0]), int(grey.width.iloc[0])
        mask = np.zeros((h, w), bool)
        mask[part.r, part.c] = True
        scene = skeleton.decompose(mask, rule)
        _, found = skeleton.solve(scene, rule, blender(np.asarray(grey.grey.iloc[0], float).reshape(h, w), joint))
        rows = [(key[0], i, *p) for i, chain in enumerate(skeleton.emitted(scene, found, rule.min_isolated_px), 1) for p in sorted(skeleton.layer(scene, chain, rule.include_nodes))]
        return pd.DataFrame(rows, columns=["scene_id", "iid", "r", "c"])

    return pixels.groupBy("scene_id").cogroup(greys.groupBy("scene_id")).applyInPandas(run, INSTANCES)
