"""Over and under: crossings, image evidence, one consistent order, layers and compact heights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.config import DepthRule
from strandel.functions.geometry import abstain_threshold, decision_threshold
from strandel.kernels import ordering
from strandel.kernels.raster import gradient, robust_sigma, sample
from strandel.operators import sequence, spatial
from strandel.session import cut

HITS = "scene_id string, i int, j int, x double, y double"
EVIDENCE = HITS + ", score double, p_over double, feat_intensity double, feat_sharpness double, feat_floored double, reason int, raw_over int"
SOLVED = "scene_id string, iid int, position int, layer int, stack_level int, z double, radius double"


def crossings(centrelines: DataFrame, rule: DepthRule = DepthRule()) -> DataFrame:
    """scene_id, i, j, x, y: meetings of densified centrelines; hits of a pair within merge_px are one."""
    dense = sequence.densify(centrelines, ["scene_id", "iid"], 2.0)
    hits = spatial.crossing_segments(spatial.segments(dense, ["scene_id"], "iid"), ["scene_id"], "iid", 4.0)
    rows = hits.select("scene_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "ki", "kj", "x", "y")
    return spatial.merged_hits(rows, ["scene_id", "i", "j"], ["ki", "kj"], rule.merge_px)


def _normals(line: np.ndarray) -> np.ndarray:
    d = np.gradient(line, axis=0)
    return np.stack([-d[:, 1], d[:, 0]], 1) / np.maximum(np.hypot(*d.T), 1e-9)[:, None]


def _edge_level(edges: np.ndarray, points: np.ndarray, normals: np.ndarray, radius: float) -> float:
    """Median of the gradient on both edges of a rod; on its axis a ridge has none."""
    sides = np.concatenate([points + radius * normals, points - radius * normals])
    return float(np.median(sample(edges, sides[:, 1], sides[:, 0]))) if len(sides) else math.nan


def evidence_of(image: np.ndarray, a: np.ndarray, b: np.ndarray, at: tuple[float, float], rule: DepthRule, radii: tuple[float, float] = (5.0, 5.0), edges: np.ndarray | None = None) -> dict:
    """Features and signed score of one crossing (positive: the first is on top); x is the column.

    The edge channel asks of each rod how far its edges at the crossing differ from its own beside it:
    those of the rod on top go on, those of the other are painted over.
    """
    core = rule.core_px if rule.core_mode == "flat" else max(rule.core_px, 1.1 * sum(radii) / 2 + 2)
    window = max(rule.window_px, 3 * core)
    out: dict = {"score": None, "p_over": None, "feat_intensity": None, "feat_sharpness": None, "feat_floored": None, "reason": None}
    cores, flanks, changed, beside = [], [], [], []
    for line, radius in ((a, radii[0]), (b, radii[1])):
        s = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
        away = np.abs(s - s[np.argmin(np.hypot(line[:, 0] - at[0], line[:, 1] - at[1]))])
        values = sample(image, line[:, 1], line[:, 0])
        inside, outside = away <= core, (away > core) & (away <= window)
        cores.append(values[inside])
        flanks.append(values[outside])
        if edges is not None and outside.any():
            normals = _normals(line)
            own = _edge_level(edges, line[outside], normals[outside], radius)
            here = _edge_level(edges, line[inside], np.broadcast_to(normals[outside][0], (int(inside.sum()), 2)), radius)
            beside.append(own)
            changed.append(abs(here - own))
    if min(map(len, flanks)) < rule.min_flank_px or not sum(map(len, cores)):
        return out | {"reason": 1}
    middle = float(np.median(np.concatenate(cores)))
    m_i, m_j = (float(np.median(f)) for f in flanks)
    sigma = robust_sigma(np.concatenate([f - np.median(f) for f in flanks]))
    top = abs(middle - m_j) - abs(middle - m_i)
    intensity = top / max(abs(m_i - m_j), 0.02)
    floored = top / max(abs(m_i - m_j), 2 * sigma, 1e-12)
    known = len(changed) == 2 and np.isfinite(changed).all()
    sharp = (changed[1] - changed[0]) / max(0.02, sum(beside)) if known else 0.0
    if rule.scoring == "noise_floored":
        score, sharp = rule.w_intensity * floored, None
    elif edges is None:
        raise ValueError(f"{rule.scoring} needs the gradient image")
    elif rule.scoring == "winsorized_linear":
        score = rule.w_intensity * intensity + rule.w_sharpness * min(1.0, max(-1.0, sharp))
    else:
        score = rule.w_intensity * math.tanh(intensity) + rule.w_sharpness * math.tanh(sharp)
    return out | {"score": score, "p_over": 1 / (1 + math.exp(-score)), "feat_intensity": intensity, "feat_sharpness": sharp, "feat_floored": floored}


def with_evidence(found: DataFrame, centrelines: DataFrame, greys: DataFrame, rule: DepthRule = DepthRule(), radii: DataFrame | None = None) -> DataFrame:
    """The crossings with features, score and the side that the image puts on top (null: it cannot tell).

    radii(scene_id, iid, radius) serve the rules that look beside an axis; the default radius stands in."""
    dense = sequence.densify(centrelines, ["scene_id", "iid"], 2.0)
    lined = dense.groupBy("scene_id", "iid").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("line"))
    sized = lined.withColumn("radius", F.lit(None).cast("double")) if radii is None else lined.join(radii.select("scene_id", "iid", F.col("radius").cast("double").alias("radius")), ["scene_id", "iid"], "left")
    lines = sized.groupBy("scene_id").agg(F.collect_list(F.struct("iid", "line", F.coalesce("radius", F.lit(float(rule.default_radius_px))).alias("radius"))).alias("lines"))
    scenes = lines.join(greys, "scene_id")
    threshold = decision_threshold(rule.scoring, rule.abstain_score, rule.abstain_band)
    names = [x.split()[0] for x in EVIDENCE.split(", ")]

    def run(key: tuple, part: pd.DataFrame, scene: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=names)
        rows = part[["scene_id", "i", "j", "x", "y"]].to_dict("records")
        if not len(scene) or not rule.use_image_evidence:
            return pd.DataFrame([r | {"reason": 2} for r in rows], columns=names)
        row = scene.iloc[0]
        image = np.asarray(row.grey, float).reshape(int(row.height), int(row.width))
        line = {x["iid"]: np.array([(p["x"], p["y"]) for p in x["line"]]) for x in row.lines}
        size = {x["iid"]: float(x["radius"]) for x in row.lines}
        edges = None if rule.scoring == "noise_floored" else gradient(image)
        for r in rows:
            r |= evidence_of(image, line[r["i"]], line[r["j"]], (r["x"], r["y"]), rule, (size[r["i"]], size[r["j"]]), edges)
            if r["score"] is not None and abs(r["score"]) >= threshold:
                r["raw_over"] = r["i"] if r["score"] > 0 else r["j"]
        return pd.DataFrame(rows, columns=names)

    own = found.select(*[F.col(c).alias(c) for c in ("scene_id", "i", "j", "x", "y")])  # columns of its own, as both sides come from the centrelines
    return own.groupBy("scene_id").cogroup(scenes.groupBy("scene_id")).applyInPandas(run, EVIDENCE)


def abstain_again(found: DataFrame, band: float | None = None, rule: DepthRule | None = None) -> DataFrame:
    """The same crossings decided anew, by a rule's own threshold or by a band around a probability of one half.

    The two differ in unit, so exactly one must be given. Without a score the held log-odds decide; a
    place in the order and a flip from an earlier decision no longer hold and are cleared.
    """
    if (band is None) == (rule is None):
        raise TypeError("give exactly one of band and rule")
    threshold = abstain_threshold(band) if rule is None else decision_threshold(rule.scoring, rule.abstain_score, rule.abstain_band)
    p = F.when(F.col("p_over").isNotNull(), F.least(F.greatest(F.col("p_over"), F.lit(1e-6)), F.lit(1 - 1e-6)))
    known = lambda c: F.when(~F.isnan(c), c)
    score = F.coalesce(known(F.col("score")), known(F.log(p / (1 - p))))
    out = found.withColumn("raw_over", F.when(F.abs(score) >= threshold, F.when(score > 0, F.col("i")).otherwise(F.col("j"))))
    return out.withColumn("over", F.lit(None).cast("int")).withColumn("flipped", F.lit(False))


def stacked(found: DataFrame, shapes: DataFrame, rule: DepthRule = DepthRule()) -> DataFrame:
    """position, layer, stack level and height of every instance; shapes(scene_id, iid, radius).

    Both arrangements of the undecided pairs are costed and the thinner film is taken."""

    def run(key: tuple, ids_part: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(int(x) for x in ids_part.iid)
        radii = {int(i): float(r) for i, r in zip(ids_part.iid, ids_part.radius, strict=True) if r == r}
        pairs = [(int(i), int(j), None if o != o else int(o), s) for i, j, o, s in zip(part.i, part.j, part.raw_over, part.score, strict=True)]
        under = lambda i, j, o: j if o == i else i
        order = ordering.global_order(ids, [(o, under(i, j, o), abs(s)) for i, j, o, s in pairs if o is not None], rule.ordering, rule.exact_max_nodes)
        position = order["position"]
        settled = [(i, j, (i if position[i] < position[j] else j) if o is not None else None) for i, j, o, _ in pairs]
        decided = [(o, under(i, j, o)) for i, j, o in settled if o is not None]
        layer = ordering.path_levels(ids, decided)
        best = None
        compact = [ordering.compact_order(ids, settled)[0]] if rule.undecided_order == "compact" else []
        for place in [position, *compact]:
            relations = [(o, under(i, j, o)) if o is not None else ((i, j) if place[i] < place[j] else (j, i)) for i, j, o in settled]
            z, _ = ordering.heights(ids, relations, radii, place, rule.z_gap_px, rule.default_radius_px)
            r = {x: radii.get(x, rule.default_radius_px) for x in ids}
            film = max(z[x] + r[x] for x in ids) - min(z[x] - r[x] for x in ids)
            if best is None or film < best[0] - 1e-9:
                best = (film, place, z, ordering.path_levels(ids, relations))
        _, place, z, levels = best
        return pd.DataFrame([(key[0], x, place[x], layer[x], levels[x], z[x], radii.get(x, rule.default_radius_px)) for x in ids], columns=["scene_id", "iid", "position", "layer", "stack_level", "z", "radius"])

    return shapes.groupBy("scene_id").cogroup(found.groupBy("scene_id")).applyInPandas(run, SOLVED)


def measured_radii(centrelines: DataFrame, greys: DataFrame, found: DataFrame, rule: DepthRule = DepthRule(), step: float = 3.0, margin: float = 4.0, least: int = 5) -> DataFrame:
    """scene_id, iid, radius, n_cuts, quality, imputed: half the median width of cuts away from crossings.

    Instances with fewer than `least` cuts take the scene's median, or the default."""
    from strandel.kernels import profile, raster
    from strandel.operators import robust

    axis = sequence.unit_normals(sequence.densify(centrelines, ["scene_id", "iid"], step), ["scene_id", "iid"])
    marks = found.select("scene_id", F.explode(F.array("i", "j")).alias("iid"), F.col("x").alias("mx"), F.col("y").alias("my"))
    clear = spatial.away_from(axis, marks, ["scene_id", "iid"], 2.2 * rule.default_radius_px + margin)

    def run(key: tuple, part: pd.DataFrame, scene: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(scene):
            return pd.DataFrame(columns=["scene_id", "iid", "width"])
        h, w = int(scene.height.iloc[0]), int(scene.width.iloc[0])
        image = np.asarray(scene.grey.iloc[0], float).reshape(h, w)
        level, sure, noise = raster.background(image)
        place, normal = part[["y", "x"]].to_numpy(float), part[["ny", "nx"]].to_numpy(float)
        near = np.round(place).astype(int)
        inside = ((near >= 0) & (near < (h, w))).all(1)
        r, c = near[inside].T
        seen = profile.measure_all(image, level[r, c], noise, place[inside], normal[inside], trusted=sure[r, c])
        ok = seen["reason"] == "ok"
        return pd.DataFrame({"scene_id": key[0], "iid": part.iid.to_numpy()[inside][ok], "width": seen["width"][ok]})

    cuts = clear.groupBy("scene_id").cogroup(greys.groupBy("scene_id")).applyInPandas(run, "scene_id string, iid int, width double")
    stats = robust.spread(cuts, ["scene_id", "iid"], "width", least)
    known = centrelines.select("scene_id", "iid").distinct().join(stats.select("scene_id", "iid", F.col("n").alias("n_cuts"), "median", "mad"), ["scene_id", "iid"], "left")
    quality = F.when(F.col("median").isNull(), "none").when((F.col("n_cuts") >= 12) & (F.col("mad") < 0.25 * F.col("median")), "good").otherwise("weak")
    sized = known.withColumn("quality", quality).withColumn("radius", F.greatest(F.col("median"), F.lit(0.5)) / 2 if rule.radius_mode == "measured" else F.lit(rule.default_radius_px))
    out = robust.impute_by_median(sized, ["scene_id"], "radius", rule.default_radius_px) if rule.radius_fallback == "median" else sized.withColumn("imputed", F.col("radius").isNull()).fillna({"radius": rule.default_radius_px})
    return out.select("scene_id", "iid", "radius", "n_cuts", "quality", "imputed")


def run_scenes(centrelines: DataFrame, greys: DataFrame, rule: DepthRule = DepthRule(), radii: DataFrame | None = None, instance_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """crossings, instances, violations and a report of every scene.

    Contacts (strokes that overlap without crossing) constrain heights where clear_grazing_overlaps is
    set, or where grazing_evidence decides them. What feeds several tables is cut, so that the kernels
    run once whichever tables are written. instance_map(scene_id, iid, other) names the instances of
    another numbering; instances then carry it as `mapped`."""
    found = cut(crossings(centrelines, rule))
    shapes = cut(measured_radii(centrelines, greys, found, rule)) if radii is None else radii
    seen = cut(with_evidence(found, centrelines, greys, rule, shapes).withColumn("grazing", F.lit(False)))
    dense = sequence.densify(centrelines, ["scene_id", "iid"], 2.0).select("scene_id", "iid", "x", "y")
    widest = shapes.agg(F.max("radius")).first()[0] or rule.default_radius_px  # one number
    near = spatial.closest_contacts(dense, shapes.select("scene_id", "iid", "radius"), ["scene_id"], "iid", widest, rule.z_gap_px, rule.default_radius_px, found.select("scene_id", "i", "j").distinct())
    contacts = cut(near.select("scene_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "x", "y"))
    if rule.grazing_evidence:
        touched = with_evidence(contacts, centrelines, greys, rule, shapes)
    else:
        blank = [x.split() for x in EVIDENCE.split(", ")[5:]]
        touched = contacts.select("*", *[F.lit(3 if n == "reason" else None).cast(t).alias(n) for n, t in blank])
    touched = touched.withColumn("grazing", F.lit(True))
    bound = seen.unionByName(touched if rule.clear_grazing_overlaps else touched.filter("raw_over is not null"))
    solved = cut(stacked(bound.drop("grazing"), shapes.select("scene_id", "iid", "radius"), rule))
    place = lambda t: solved.select("scene_id", F.col("iid").alias(t), F.col("position").alias(f"_p{t}"))
    final = bound.join(place("i"), ["scene_id", "i"]).join(place("j"), ["scene_id", "j"])
    over = F.when(F.col("raw_over").isNotNull(), F.when(F.col("_pi") < F.col("_pj"), F.col("i")).otherwise(F.col("j")))
    final = final.withColumn("over", over).withColumn("flipped", F.coalesce(F.col("over") != F.col("raw_over"), F.lit(False))).drop("_pi", "_pj")
    pairs = seen.select("scene_id", "i", "j").union(contacts.select("scene_id", "i", "j")).distinct()
    broken = spatial.clearance_violations(pairs, solved.select("scene_id", "iid", "z", "radius"), ["scene_id"], rule.z_gap_px, default_radius=rule.default_radius_px)
    report = final.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("raw_over").isNull()).alias("n_abstained"), F.count_if("flipped").alias("n_flipped")).join(broken.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_interpenetrating")), "scene_id", "left").fillna({"n_interpenetrating": 0})
    named = solved if instance_map is None else solved.join(instance_map.select("scene_id", "iid", F.col("other").alias("mapped")), ["scene_id", "iid"], "left")
    return {"crossings": final, "instances": named, "violations": broken, "report": report}
