"""Width and brightness of instances, from perpendicular cuts through the image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.config import GroupRule, SampleRule
from strandel.kernels import raster, skeleton
from strandel.kernels.profile import CutRule, measure_all
from strandel.operators import robust, sequence
from strandel.plans.group import solved

CUTS = "scene_id string, iid int, seq int, s double, width double, amplitude double, offset double, r double, c double, reason string"


def _resampled(points: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Unit-step places, their normals, and where the normals are sure."""
    s = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))))
    if len(points) < 2 or s[-1] < 2.0:
        return None
    u = np.arange(0.0, s[-1] + 1e-9)
    at = np.stack([np.interp(u, s, points[:, k]) for k in (0, 1)], 1)
    half = int(4 * max(0.6, sigma) + 0.5)
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / max(0.6, sigma)) ** 2)
    wide = np.pad(at, ((half, half), (0, 0)), mode="edge")
    soft = np.stack([np.convolve(wide[:, k], taps / taps.sum(), "valid") for k in (0, 1)], 1)
    d = np.gradient(soft, axis=0)
    size = np.hypot(*d.T)
    d = d / np.maximum(size, 1e-9)[:, None]
    return at, np.stack([-d[:, 1], d[:, 0]], 1), size > 1e-9


def _runs(points: np.ndarray, longest: float) -> list[np.ndarray]:
    """Stretches between jumps over `longest`; shorter jumps are filled at steps of at most 1."""
    out, part = [], [points[:1]]
    for a, b in zip(points[:-1], points[1:], strict=True):
        d = float(np.hypot(*(b - a)))
        if d > longest:
            out.append(np.vstack(part))
            part = []
        elif d > sequence.BRIDGE_OVER:
            n = int(np.ceil(d))
            part.append(a + (b - a) * (np.arange(1, n) / n)[:, None])
        part.append(b[None])
    return [*out, np.vstack(part)]


def scene_cuts(mask: np.ndarray, grey: np.ndarray, rule: GroupRule, sampling: SampleRule, cutting: CutRule) -> list[tuple]:
    """(iid, seq, s, width, amplitude, offset, r, c, reason) of every cut tried in a scene."""
    scene, links, found = solved(mask, rule)
    level, sure, noise = raster.background(grey)
    nodes = np.zeros(mask.shape, bool)
    for pix in scene.node_pixels:
        for p in pix:
            nodes[p] = True
    clear = raster.distance(nodes)[0] if nodes.any() else np.full(mask.shape, 1e6)
    rows, places, normals = [], [], []
    for iid, chain in enumerate(found, 1):
        base, seq = 0.0, 0
        for run in _runs(np.asarray(skeleton.chain_axis(scene, links, chain), float), sampling.join_px):
            sampled = _resampled(run, sampling.tangent_sigma)
            if sampled is None:
                continue
            at, normal, valid = sampled
            tried = np.arange(0, len(at), max(1, round(sampling.cut_step)))
            near = np.round(at[tried]).astype(int)
            tried = tried[valid[tried] & ((near >= 0) & (near < mask.shape)).all(1)]
            rows.append(np.stack([np.full(len(tried), iid), seq + np.arange(len(tried)), base + tried], 1))
            places.append(at[tried])
            normals.append(normal[tried])
            seq += len(tried)
            base += len(at) - 1 + 10.0  # farther than neighbours are compared, so runs never mix
    if not rows:
        return []
    row, place, normal = np.concatenate(rows), np.concatenate(places), np.concatenate(normals)
    r, c = np.round(place).astype(int).T
    far = clear[r, c] >= sampling.node_clear_px
    seen = measure_all(grey, level[r, c][far], noise, place[far], normal[far], cutting, sure[r, c][far])
    value = {k: np.full(len(row), np.nan) for k in ("width", "amplitude", "offset")}
    reason = np.full(len(row), "near_crossing", object)
    reason[far] = seen["reason"]
    for k, v in value.items():
        v[far] = seen[k]
    value["width"][reason != "ok"] = np.nan
    known = lambda x: None if np.isnan(x) else float(x)
    return [(int(i), int(q), float(t), *(known(value[k][n]) for k in value), *map(float, place[n]), reason[n]) for n, (i, q, t) in enumerate(row)]


def cuts(pixels: DataFrame, greys: DataFrame, rule: GroupRule = GroupRule(), sampling: SampleRule = SampleRule(), cutting: CutRule = CutRule()) -> DataFrame:
    """All cuts of all scenes; greys(scene_id, height, width, grey). A scene is one task's unit."""

    def run(key: tuple, mask_part: pd.DataFrame, grey_part: pd.DataFrame) -> pd.DataFrame:
        if not len(mask_part) or not len(grey_part):
            return pd.DataFrame(columns=[x.split()[0] for x in CUTS.split(", ")])
        h, w = int(grey_part.height.iloc[0]), int(grey_part.width.iloc[0])
        mask = np.zeros((h, w), bool)
        mask[mask_part.r, mask_part.c] = True
        rows = scene_cuts(mask, np.asarray(grey_part.grey.iloc[0], np.float32).reshape(h, w), rule, sampling, cutting)
        return pd.DataFrame([(key[0], *x) for x in rows], columns=[x.split()[0] for x in CUTS.split(", ")])

    return pixels.groupBy("scene_id").cogroup(greys.groupBy("scene_id")).applyInPandas(run, CUTS)


def bundles(found: DataFrame, sampling: SampleRule = SampleRule()) -> DataFrame:
    """Statistics of each instance's cuts: level, spread, effective size, noise, excursion, step, interval, refusals.

    The cap on widths comes from the scene's own median and is joined back by a window."""
    keys = ["scene_id", "iid"]
    good = robust.under_cap(found.filter("reason = 'ok'"), ["scene_id"], "width", sampling.scene_width_cap)
    kept = good.filter("not over_cap")
    stats = robust.spread(kept, keys, "width", sampling.min_cuts).withColumn("quality", robust.quality_label("n", "median", "mad", sampling.weak_min_cuts, sampling.weak_max_mad))
    light = kept.groupBy(*keys).agg(F.percentile("amplitude", 0.5).alias("brightness_p50"), F.percentile("amplitude", 0.9).alias("brightness_p90"))
    noise = sequence.noise_split(kept, keys, "s", "width")
    sized = sequence.effective_size(kept, keys, "width").select(*keys, "n_eff")
    marked = kept.join(noise.select(*keys, "sigma_noise"), keys)
    peak = sequence.excursion(marked, keys, "width", "sigma_noise").select(*keys, F.col("z").alias("excursion_z"), F.col("width").alias("excursion_width"))
    jump = sequence.largest_step(kept, keys, "s", "width")
    interval = robust.median_interval(kept, keys, "width", "seq", sampling.block, sampling.n_boot, sampling.boot_min_cuts)
    refused = robust.refusals(found.filter("reason <> 'ok'").select(*keys, "reason").unionByName(good.filter("over_cap").select(*keys, F.lit("wider_than_scene").alias("reason"))), keys)
    out = found.select(*keys).distinct().join(stats, keys, "left")
    for more in (light, noise.select(*keys, "sigma_noise", "sigma_real"), sized, peak, jump, interval, refused):
        out = out.join(more, keys, "left")
    return out.withColumn("standard_error", 1.2533 * F.col("mad") / F.sqrt("n_eff"))
