"""Scalar geometry and evidence expressions (columns in, column out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Angle between unit vectors, the dot product held to [-1, 1]."""
    return F.acos(F.greatest(F.least(ux * vx + uy * vy, F.lit(1.0)), F.lit(-1.0)))


def segment_meeting(ax: Column, ay: Column, rx: Column, ry: Column, bx: Column, by: Column, sx: Column, sy: Column) -> tuple[Column, Column, Column, Column]:
    """How far along each of two segments, from (ax, ay) by (rx, ry) and from (bx, by) by (sx, sy), their lines meet, and where; null if they are parallel."""
    cross, qx, qy = rx * sy - ry * sx, bx - ax, by - ay
    det = F.when(F.abs(cross) >= 1e-12, cross)
    t, u = (qx * sy - qy * sx) / det, (qx * ry - qy * rx) / det
    return t, u, ax + t * rx, ay + t * ry


def link_cost(length: Column, theta: Column, phi_a: Column, phi_b: Column, kappa_a: Column, kappa_b: Column, *, w_direct: float, w_turn: float, w_len: float, len_scale: float, chord_floor: float, w_kappa: float, kappa_scale: float) -> Column:
    """Cost of joining two outward frames: direction, turn onto the chord, length and bending."""
    trust = F.least(F.lit(1.0), length / chord_floor) if chord_floor > 0 else F.lit(1.0)
    return w_direct * theta + w_turn * trust * (phi_a + phi_b) + w_len * length / len_scale + w_kappa * F.abs(kappa_a + kappa_b) * kappa_scale


def floored_feature(core: Column, flank_i: Column, flank_j: Column, sigma: Column) -> Column:
    """How much nearer the core is to flank i than to flank j, in units no smaller than the noise."""
    return (F.abs(core - flank_j) - F.abs(core - flank_i)) / F.greatest(F.abs(flank_i - flank_j), 2 * sigma, F.lit(1e-12))


RULES = ("noise_floored", "winsorized_linear", "weight_of_evidence")


def combine_channels(intensity: Column, sharpness: Column, floored: Column, rule: str = "noise_floored", w_intensity: float = 2.0, w_sharpness: float = 1.0) -> Column:
    """Signed score of one crossing by one of RULES, odd in its features; null where a feature is missing."""
    if rule == "noise_floored":
        return w_intensity * floored
    if rule == "winsorized_linear":
        return w_intensity * intensity + w_sharpness * F.least(F.greatest(sharpness, F.lit(-1.0)), F.lit(1.0))
    if rule == "weight_of_evidence":
        return w_intensity * F.tanh(intensity) + w_sharpness * F.tanh(sharpness)
    raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")


def abstain_threshold(band: float) -> float:
    """Score at which the probability leaves the band around one half."""
    b = min(max(band, 0.0), 0.499999)
    return math.log((0.5 + b) / (0.5 - b))


def decision_threshold(rule: str = "noise_floored", abstain_score: float = 0.4, abstain_band: float = 0.15) -> float:
    return abstain_score if rule == "noise_floored" else abstain_threshold(abstain_band)


def decide(score: Column, i: Column, j: Column, threshold: float) -> Column:
    """The instance on top, or null where the score is too small to tell."""
    return F.when(F.abs(score) >= threshold, F.when(score > 0, i).otherwise(j))


# Logistic weights of the two appearance differences, and the intercept.
APPEARANCE_WEIGHTS = (-2.5814, -1.0127)
APPEARANCE_INTERCEPT = 1.3926
APPEARANCE_FLOOR = 0.02


def appearance_cost(intensity_gap: Column, sharpness_gap: Column, noise: Column) -> Column:
    """Cost in nats of two arms' appearance differing: 0 for none; null where a difference is unknown."""
    scale = F.when(noise.isNotNull() & ~F.isnan(noise) & (noise > 1e-6), noise).otherwise(APPEARANCE_FLOOR)
    z = APPEARANCE_WEIGHTS[0] * F.tanh(F.abs(intensity_gap) / scale) + APPEARANCE_WEIGHTS[1] * F.tanh(F.abs(sharpness_gap) / scale) + APPEARANCE_INTERCEPT
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0)) - math.log1p(math.exp(-APPEARANCE_INTERCEPT))


def image_reach(row: Column, col: Column, n_row: Column, n_col: Column, height: Column, width: Column, want: float, margin: float = 1.0) -> Column:
    """How far a profile can go both ways along a normal before it leaves the image."""

    def side(p: Column, d: Column, size: Column) -> Column:
        top = size - 1 - margin
        return F.when(F.abs(d) < 1e-9, F.lit(want)).otherwise(F.least((F.when(d > 0, top - p).otherwise(p - margin)) / F.abs(d), (F.when(d > 0, p - margin).otherwise(top - p)) / F.abs(d)))

    return F.greatest(F.lit(0.0), F.least(F.lit(want), side(row, n_row, height), side(col, n_col, width)))


def width_to_diameter(width: Column) -> Column:
    """Identity with a floor of half a pixel; null stays null."""
    return F.when(width.isNotNull() & ~F.isnan(width), F.greatest(width, F.lit(0.5)))


def colour_share(value: Column, low: Column, high: Column) -> Column:
    """Place of a value in a colour range, 0 to 1."""
    return F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
