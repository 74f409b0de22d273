"""Strict configuration: every value has a field, unknown names are refused, text is converted by type."""

from __future__ import annotations

import dataclasses
import functools
from pathlib import Path
from typing import Any

import yaml

from strandel.kernels.profile import CutRule

TUNED_MARK = "strandel_tuned"


@dataclasses.dataclass(frozen=True)
class GroupRule:
    """Grouping of a mask into instances."""

    spur_px: int = 3
    bridge_px: int = 5
    absorb_free_px: int = 2
    join_px: int = 14
    window_local: float = 24.0
    window_chain: float = 55.0
    min_quadratic: float = 18.0
    n_rounds: int = 8
    anneal_start: float = 0.85
    break_rings: bool = False
    j_w_direct: float = 0.6
    j_w_turn: float = 1.2
    j_chord_floor: float = 4.0
    j_w_kappa: float = 1.0
    j_unmatched: float = 0.62
    j_gap_relief: float = 0.0
    gap_max_len: float = 85.0
    g_w_direct: float = 0.2
    g_w_turn: float = 1.0
    g_w_len: float = 0.15
    g_len_scale: float = 60.0
    g_chord_floor: float = 3.0
    g_w_kappa: float = 0.5
    g_unmatched: float = 0.3
    gap_max_theta: float = 0.4
    gap_max_phi: float = 0.28
    kappa_scale: float = 30.0
    min_isolated_px: int = 6
    include_nodes: bool = True


@dataclasses.dataclass(frozen=True)
class DepthRule:
    """Over/under evidence, order and heights."""

    merge_px: float = 8.0
    window_px: float = 22.0
    core_px: float = 7.5
    core_mode: str = "flat"
    min_flank_px: int = 6
    scoring: str = "noise_floored"
    w_intensity: float = 2.0
    w_sharpness: float = 1.0
    abstain_band: float = 0.15
    abstain_score: float = 0.40
    use_image_evidence: bool = True
    exact_max_nodes: int = 14
    ordering: str = "hybrid"
    undecided_order: str = "compact"
    radius_mode: str = "measured"
    radius_fallback: str = "median"
    default_radius_px: float = 5.0
    z_gap_px: float = 0.0
    clear_grazing_overlaps: bool = False
    grazing_evidence: bool = False


@dataclasses.dataclass(frozen=True)
class JointRule:
    """Appearance blended into ambiguous crossings."""

    lambda_appearance: float = 1.5
    margin_threshold: float = 0.15
    skip_px: float = 1.5
    window_px: float = 6.0
    n_samples: int = 6


@dataclasses.dataclass(frozen=True)
class SampleRule:
    """Cuts along an instance and their statistics."""

    cut_step: float = 2.0
    node_clear_px: float = 6.0
    tangent_sigma: float = 3.0
    join_px: float = 8.0
    min_cuts: int = 3
    block: int = 5
    n_boot: int = 2000
    boot_min_cuts: int = 8
    scene_width_cap: float = 2.0
    weak_min_cuts: int = 12
    weak_max_mad: float = 0.6


@dataclasses.dataclass(frozen=True)
class RibbonRule:
    """Rendering of instances as ribbons."""

    smooth_window: float = 9.0
    resample_px: float = 1.0
    min_width_px: float = 3.0
    max_width_px: float = 40.0
    absorb_thr: float = 0.0
    absorb_min_px: int = 40
    draw_bridges: bool = True
    keep_node_pixels: bool = False
    clip_to_mask: bool = False
    bridge_dilate_px: float = 1.5
    taper: bool = False
    taper_smooth_px: float = 25.0


CHOICES = {
    "core_mode": ("flat", "radius_scaled"), "scoring": ("noise_floored", "winsorized_linear", "weight_of_evidence"), "ordering": ("hybrid", "exact"),
    "undecided_order": ("compact", "global"), "radius_mode": ("measured", "fixed"), "radius_fallback": ("median", "default"),
}
SECTIONS = {"group": GroupRule, "depth": DepthRule, "joint": JointRule, "sample": SampleRule, "cut": CutRule, "ribbon": RibbonRule}


def _as(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes") if isinstance(value, str) else bool(value)
    return type(like)(value)


def build(section: str, overrides: dict[str, Any] | list[str] | None = None):
    """The rule of a section with overrides (a map, or NAME=VALUE texts); unknown names and choices raise."""
    kind = SECTIONS[section]
    if isinstance(overrides, list):
        overrides = dict(x.split("=", 1) for x in overrides)
    base = kind()
    for name in overrides or {}:
        if name not in {f.name for f in dataclasses.fields(kind)}:
            raise SystemExit(f"{section} has no parameter {name}")
    rule = dataclasses.replace(base, **{k: _as(v, getattr(base, k)) for k, v in (overrides or {}).items()})
    for name, allowed in CHOICES.items():
        if hasattr(rule, name) and getattr(rule, name) not in allowed:
            raise SystemExit(f"{name} must be one of {', '.join(allowed)}")
    return rule


@functools.lru_cache(maxsize=8)
def load(path: str) -> dict[str, Any]:
    """Rules of every section of a YAML file; nested groups are flattened and a name may stand once."""
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if unknown := set(raw) - set(SECTIONS):
        raise SystemExit(f"unknown sections: {', '.join(sorted(unknown))}")
    return {s: build(s, flatten(raw.get(s) or {})) for s in SECTIONS}


# The published set of grouping parameters.
PUBLISHED_GROUP = {
    "spur_px": 3, "bridge_px": 5, "absorb_free_px": 2, "join_px": 14, "window_local": 24.0, "window_chain": 55.0, "min_quadratic": 18, "n_rounds": 8, "anneal_start": 0.85,
    "j_w_direct": 0.6, "j_w_turn": 1.2, "j_chord_floor": 4.0, "j_w_kappa": 1.0, "j_unmatched": 0.62, "j_gap_relief": 0.0, "gap_max_len": 85.0, "g_w_direct": 0.2, "g_w_turn": 1.0,
    "g_w_len": 0.15, "g_len_scale": 60.0, "g_chord_floor": 3.0, "g_w_kappa": 0.5, "g_unmatched": 0.3, "gap_max_theta": 0.4, "gap_max_phi": 0.28, "kappa_scale": 30.0, "break_rings": False,
}
#: What chooses the pixels that are given out, not how they are grouped.
_OUTPUT = {"min_isolated_px", "include_nodes"}


def check_published(rule: GroupRule | None = None) -> None:
    """Raises with every grouping parameter that differs from the published set, or that only one of both has."""
    live = dataclasses.asdict(rule or GroupRule())
    moved = {k: (v, live.get(k)) for k, v in PUBLISHED_GROUP.items() if k not in live or float(live[k]) != float(v)}
    extra = sorted(set(live) - set(PUBLISHED_GROUP) - _OUTPUT)
    if moved or extra:
        raise AssertionError(f"grouping parameters differ from the published ones: changed {moved}, new {extra}")


def flatten(section: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in section.items():
        for k, v in (flatten(value) if isinstance(value, dict) else {name: value}).items():
            if k in out:
                raise SystemExit(f"{k} stands twice")
            out[k] = v
    return out


def write_tuned(path: str, rule: GroupRule, base: GroupRule, notes: dict[str, Any]) -> None:
    """Only the values that moved, with where they come from."""
    moved = {f.name: getattr(rule, f.name) for f in dataclasses.fields(rule) if getattr(rule, f.name) != getattr(base, f.name)}
    Path(path).write_text(yaml.safe_dump({TUNED_MARK: True, "notes": notes, "group": moved}, sort_keys=False), encoding="utf-8")


def apply_tuned(base: GroupRule, path: str, explicit: dict[str, Any] | None = None) -> GroupRule:
    """`base` with a tuned file over it; explicit overrides win over both."""
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or not raw.get(TUNED_MARK):
        raise SystemExit(f"{path} is not a tuned configuration")
    return build("group", dataclasses.asdict(base) | (raw.get("group") or {}) | (explicit or {}))
