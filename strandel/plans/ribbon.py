"""Instances drawn again as clean ribbons along their axes, and ribbons that coincide made one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandel.config import GroupRule, RibbonRule
from strandel.kernels import raster, skeleton
from strandel.plans.group import INSTANCES, raster as dense
from strandel.plans.group import solved


def polyline(points: np.ndarray, rule: RibbonRule) -> np.ndarray:
    """Gaps filled, resampled at equal steps, smoothed with both ends in place."""
    if len(points) < 2:
        return points
    steps = np.hypot(*np.diff(points, axis=0).T)
    s = np.concatenate(([0.0], np.cumsum(steps)))
    if s[-1] < 2.0:
        return points
    if rule.draw_bridges:  # filling a gap at equal steps and resampling are one interpolation
        u = np.arange(0.0, s[-1] + 1e-9, rule.resample_px)
    else:
        inside = np.searchsorted(s, np.arange(0.0, s[-1] + 1e-9, rule.resample_px), "right") - 1
        u = np.arange(0.0, s[-1] + 1e-9, rule.resample_px)[steps[np.minimum(inside, len(steps) - 1)] <= 1.6]
    line = np.stack([np.interp(u, s, points[:, k]) for k in (0, 1)], 1)
    width = max(3, int(round(rule.smooth_window)) | 1)
    if len(line) < 3 or rule.smooth_window <= 1:
        return line
    wide = np.pad(line, ((width // 2, width // 2), (0, 0)), mode="edge")
    out = np.stack([np.convolve(wide[:, k], np.full(width, 1 / width), "valid") for k in (0, 1)], 1)
    out[0], out[-1] = line[0], line[-1]
    return out


def taper(line: np.ndarray, places: np.ndarray, widths: np.ndarray, fallback: float, smooth_px: float) -> np.ndarray:
    """A width for every point of the line from its cuts, by relative arclength; constant under four cuts."""
    if len(places) < 4 or len(line) < 2:
        return np.full(len(line), fallback)
    order = np.argsort(places, kind="stable")
    s, w = places[order], widths[order]
    gap = float(np.median(np.diff(s))) or 1.0
    sigma = min(max(1.0, smooth_px / max(1e-6, gap)), max(1.0, len(w) / 3))
    half = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    soft = np.convolve(np.pad(w, half, mode="edge"), taps / taps.sum(), "valid")
    u = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
    return np.interp(u / max(u[-1], 1e-9), (s - s[0]) / max(1e-6, s[-1] - s[0]), soft)


def render(shape: tuple[int, int], line: np.ndarray, width: float | np.ndarray, extra: set | None = None, clip: np.ndarray | None = None, corridor: float = 1.5) -> np.ndarray:
    """Pixels within half the width of the line; clipped to a mask but for a narrow corridor on the line."""
    out = np.zeros(shape, bool)
    if not len(line):
        return out
    r, c = (np.clip(np.round(line[:, k]).astype(int), 0, shape[k] - 1) for k in (0, 1))
    out[r, c] = True
    half = np.zeros(shape)
    half[r, c] = 0.5 * np.broadcast_to(width, len(line))
    for p in extra or ():
        out[p] = True
        half[p] = half[p] or 0.5 * float(np.median(width))
    far, at_r, at_c = raster.distance(out)
    grown = out | (far <= half[at_r, at_c]) if np.max(width) > 1 else out
    return grown if clip is None else (grown & clip) | (grown & (far <= corridor))


def absorb(layers: dict[int, np.ndarray], share: float, least: int) -> tuple[dict[int, np.ndarray], list[tuple[int, int, float]]]:
    """Layers that overlap by `share` of the smaller one join the larger, the largest first; and the log."""
    if share <= 0:
        return layers, []
    left, log = {k: m.copy() for k, m in layers.items()}, []
    order = sorted(left, key=lambda k: -int(left[k].sum()))
    for k, a in enumerate(order):
        if a not in left:
            continue
        for b in order[k + 1 :]:
            if b in left:
                both = int((left[a] & left[b]).sum())
                part = both / max(1, min(int(left[a].sum()), int(left[b].sum())))
                if both >= least and part >= share:
                    left[a] |= left.pop(b)
                    log.append((b, a, part))
    return left, log


def ribbons(pixels: DataFrame, scenes: DataFrame, widths: DataFrame, rule: GroupRule = GroupRule(), ribbon: RibbonRule = RibbonRule()) -> DataFrame:
    """scene_id, iid, r, c of the ribbons; widths(scene_id, iid, width, cut_s, cut_width), the last two for tapering.

    An instance without a width takes the median of its scene."""
    joined = pixels.select("scene_id", "r", "c").join(scenes.select("scene_id", "height", "width"), "scene_id")

    def run(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["scene_id", "iid", "r", "c"])
        mask = dense(part)
        scene, links, found = solved(mask, rule)
        own = {int(r.iid): r for r in known.itertuples()}
        have = [r.width for r in own.values() if r.width == r.width and r.width is not None]
        usual, out = float(np.median(have)) if have else 8.0, {}
        for iid, chain in enumerate(found, 1):
            line = polyline(np.asarray(skeleton.chain_axis(scene, links, chain), float), ribbon)
            row = own.get(iid)
            w = float(row.width) if row is not None and row.width == row.width and row.width is not None else usual
            width: float | np.ndarray = float(np.clip(w, ribbon.min_width_px, ribbon.max_width_px))
            if ribbon.taper and row is not None and row.cut_s is not None:
                width = np.clip(taper(line, np.asarray(row.cut_s), np.asarray(row.cut_width), w, ribbon.taper_smooth_px), ribbon.min_width_px, ribbon.max_width_px)
            nodes = {p for a in chain for s in (2 * a, 2 * a + 1) if scene.node[s] is not None for p in scene.node_pixels[scene.node[s]]} if ribbon.keep_node_pixels else None
            out[iid] = render(mask.shape, line, width, nodes, mask if ribbon.clip_to_mask else None, ribbon.bridge_dilate_px)
        kept, _ = absorb({k: m for k, m in out.items() if m.any()}, ribbon.absorb_thr, ribbon.absorb_min_px)
        rows = [(key[0], k, int(r), int(c)) for k, m in sorted(kept.items()) for r, c in zip(*np.nonzero(m), strict=True)]
        return pd.DataFrame(rows, columns=["scene_id", "iid", "r", "c"])

    return joined.groupBy("scene_id").cogroup(widths.groupBy("scene_id")).applyInPandas(run, INSTANCES)
