"""Tuning of the grouping on annotated scenes: random search, then steps along single parameters."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.config import GroupRule
from strandel.operators.agreement import micro_f1
from strandel.plans.group import solved
from strandel.kernels import skeleton

# The ranges that tuning may use.
RANGES = {
    "bridge_px": (0, 5), "absorb_free_px": (0, 5), "join_px": (0, 30), "window_local": (8, 60), "window_chain": (20, 120), "min_quadratic": (6, 40),
    "j_w_direct": (0, 3), "j_w_turn": (0, 3), "j_w_kappa": (0, 3), "j_unmatched": (0.1, 2), "gap_max_len": (10, 200), "g_w_turn": (0, 3), "g_w_len": (0, 1),
    "g_w_kappa": (0, 2), "g_unmatched": (0.05, 1.5), "gap_max_theta": (0.1, 1.2), "gap_max_phi": (0.05, 1.2),
}


@dataclasses.dataclass(frozen=True)
class TuneRule:
    budget: int = 300
    random_share: float = 0.6
    top_k: int = 8
    val_share: float = 0.34
    min_val_pairs: int = 200
    seed: int = 0
    first_step: float = 0.4
    last_step: float = 0.05


def _held(name: str, value: float) -> float:
    low, high = RANGES[name]
    value = min(max(value, low), high)
    return int(round(value)) if isinstance(getattr(GroupRule(), name), int) else float(value)


def drawn(rng: np.random.Generator) -> dict[str, float]:
    """One configuration: log-uniform where the range starts above 0, uniform where it does not."""
    return {n: _held(n, float(np.exp(rng.uniform(np.log(a), np.log(b)))) if a > 0 else float(rng.uniform(a, b))) for n, (a, b) in RANGES.items()}


def tile_scenes(pixels: DataFrame, scenes: DataFrame, truth: DataFrame, grid: tuple[int, int] = (2, 2), least_px: int = 200, least_instances: int = 2, least_instance_px: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pixels, scenes and truth(scene_id, iid, r, c) of the tiles of a grid, as scenes of their own.

    Tiles with too little foreground, or with too few instances of some size, are left out."""
    from strandel.operators.pixels import tile

    name = F.concat_ws("#", "scene_id", "tile_r", "tile_c")
    cut_px = tile(pixels, scenes, grid).withColumn("scene_id", name).select("scene_id", "r", "c")
    cut_gt = tile(truth, scenes, grid).withColumn("scene_id", name).select("scene_id", "iid", "r", "c")
    full = cut_px.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_px)
    known = cut_gt.groupBy("scene_id", "iid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_instance_px).groupBy("scene_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least_instances)
    kept = full.join(known, "scene_id", "left_semi").select("scene_id")
    part = lambda k: F.element_at(F.split("scene_id", "#"), k)
    size = lambda k, n, s: (F.floor((part(k).cast("int") + 1) * F.col(s) / n) - F.floor(part(k).cast("int") * F.col(s) / n)).cast("int").alias(s)
    whole = scenes.select(F.col("scene_id").alias("_of"), "height", "width")
    cut_scenes = kept.join(whole, F.regexp_replace("scene_id", "#[0-9]+#[0-9]+$", "") == F.col("_of")).select("scene_id", size(-2, grid[0], "height"), size(-1, grid[1], "width"))
    return cut_px.join(kept, "scene_id", "left_semi"), cut_scenes, cut_gt.join(kept, "scene_id", "left_semi")


def assigned(pieces: dict[int, set], layers: dict[int, set], least_share: float = 0.3, reach: int = 6) -> dict[int, int]:
    """`agreement.assign_fragments` for one scene in memory: fragment -> instance, 0 for none."""
    flat: dict = {}
    for i in sorted(layers, key=lambda i: (-len(layers[i]), i)):
        for p in layers[i]:
            flat.setdefault(p, i)
    around = sorted((y * y + x * x, y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if y * y + x * x <= reach * reach)
    out = {}
    for f, px in pieces.items():
        hits = {i: len(px & layer) for i, layer in layers.items()}
        top = min(hits, key=lambda i: (-hits[i], i), default=0)
        if top and hits[top] >= least_share * len(px):
            out[f] = top
            continue
        near = [next((flat[r + y, c + x] for _, y, x in around if (r + y, c + x) in flat), 0) for r, c in px]
        near = [i for i in near if i]
        out[f] = min(set(near), key=lambda i: (-near.count(i), i), default=0)
    return out


def trial_f1(counts: DataFrame) -> DataFrame:
    """trial, f1 over the scenes together; 0 for a trial that failed on any."""
    broken = counts.groupBy("trial").agg(F.max("failed").alias("broken"))
    return micro_f1(counts, ["trial"]).join(broken, "trial").select("trial", F.when(F.col("broken"), 0.0).otherwise(F.col("f1")).alias("f1"))


#: Trials that one task runs on a scene that it holds.
TRIALS_A_TASK = 16


def trial_counts(pixels: DataFrame, scenes: DataFrame, votes: DataFrame, trials: list[dict]) -> DataFrame:
    """trial, scene_id, tp, fp, fn, failed of every trial on every scene.

    A task holds a scene and runs a share of the trials on it, so pixels move once a share, not once a
    trial. votes(scene_id, frag_id, r, c, gt): fragments with their true instance, worked out once.
    """
    shares = -(-len(trials) // TRIALS_A_TASK)
    columns = lambda df, names: df.groupBy("scene_id").agg(F.collect_list(F.struct(*names)).alias("x")).select("scene_id", *[F.col(f"x.{c}").alias(f"{names[0]}_{c}") for c in names])
    held = columns(pixels.select("scene_id", "r", "c"), ["r", "c"]).join(scenes.select("scene_id", "height", "width"), "scene_id").join(columns(votes, ["gt", "frag_id", "r", "c"]), "scene_id")
    work = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(0, shares - 1))))).repartition("scene_id", "share")
    names = ["trial", "scene_id", "tp", "fp", "fn", "failed"]

    def pairs(groups: np.ndarray) -> float:
        n = np.unique(groups, axis=0, return_counts=True)[1].astype(float)
        return float((n * (n - 1) / 2).sum())

    def counted(mask: np.ndarray, pieces: dict, truth: dict, trial: dict) -> tuple[float, float, float]:
        scene, _, found = solved(mask, dataclasses.replace(GroupRule(), **trial))
        pred = assigned(pieces, {i: skeleton.layer(scene, chain) for i, chain in enumerate(found, 1)})
        both = np.array([(truth[f] or -f, pred[f] or -f) for f in truth], int).reshape(-1, 2)
        tp = pairs(both)
        return tp, pairs(both[:, 1]) - tp, pairs(both[:, 0]) - tp

    def run(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                mask = np.zeros((row.height, row.width), bool)
                mask[np.asarray(row.r_r, int), np.asarray(row.r_c, int)] = True
                truth = dict(zip(row.gt_frag_id, row.gt_gt, strict=True))
                pieces: dict = {f: set() for f in truth}
                for f, r, c in zip(row.gt_frag_id, row.gt_r, row.gt_c, strict=True):
                    pieces[f].add((r, c))
                out = []
                for k in range(row.share, len(trials), shares):
                    try:
                        out.append((k, row.scene_id, *counted(mask, pieces, truth, trials[k]), False))
                    except Exception:  # any failure counts against the trial
                        out.append((k, row.scene_id, 0.0, 0.0, 0.0, True))
                yield pd.DataFrame(out, columns=names)

    return work.mapInPandas(run, "trial int, scene_id string, tp double, fp double, fn double, failed boolean")


def tune(pixels: DataFrame, scenes: DataFrame, votes: DataFrame, rule: TuneRule = TuneRule(), base: GroupRule = GroupRule()) -> dict:
    """The best configuration found, its scores on both folds, and the trials in order."""
    ids = sorted(r["scene_id"] for r in scenes.select("scene_id").collect())  # one name an annotated scene
    rng = np.random.default_rng(rule.seed)
    order = rng.permutation(len(ids))
    n_val = max(1, round(len(ids) * rule.val_share))
    val = [ids[k] for k in order[:n_val]]
    fold = lambda df, own: df.filter(F.col("scene_id").isin(val) if own else ~F.col("scene_id").isin(val))

    def scored(trials: list[dict], own: bool) -> list[float]:
        counts = trial_counts(fold(pixels, own), fold(scenes, own), fold(votes, own), trials)
        found = {r["trial"]: r["f1"] for r in trial_f1(counts).collect()}  # one number a trial
        return [found.get(k, 0.0) for k in range(len(trials))]

    start = {n: getattr(base, n) for n in RANGES}
    tried = [start, *(drawn(rng) for _ in range(max(4, int(rule.budget * rule.random_share))))]
    train = scored(tried, False)
    finalists = sorted(range(1, len(tried)), key=lambda k: (-train[k], k))[: rule.top_k]
    checked = scored([start, *(tried[k] for k in finalists)], True)
    best, best_val, at, at_train = start, checked[0], start, train[0]
    for k, v in zip(finalists, checked[1:], strict=True):
        if v > best_val:
            best, best_val, at, at_train = tried[k], v, tried[k], train[k]
    trace, spent, step = [(t, "random", s) for t, s in zip(tried, train, strict=True)], len(tried), rule.first_step
    while step > rule.last_step and spent < rule.budget:
        around = [at | {n: _held(n, at[n] * (1 + way * step) if at[n] else way * step)} for n in RANGES for way in (1, -1)]
        around = [t for t in around if t != at][: rule.budget - spent]
        values = scored(around, False) if around else []
        spent += len(around)
        trace += [(t, "step", s) for t, s in zip(around, values, strict=True)]
        top = max(range(len(values)), key=lambda k: (values[k], -k), default=None)
        if top is None or values[top] <= at_train:
            step /= 2
            continue
        at, at_train = around[top], values[top]
        v = scored([at], True)[0]
        if v > best_val:
            best, best_val = at, v
    return {"accept": best_val > checked[0], "params": best, "changed": {n: v for n, v in best.items() if v != start[n]}, "val_base": checked[0], "val_best": best_val, "trace": trace, "val_scenes": val}
