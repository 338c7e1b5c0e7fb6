"""Weights of interferograms from coherence, and masks of their phases, before a network inversion."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coherence is taken within these ends, so that weights are finite.
LOW, HIGH = 1e-3, 1 - 1e-3
#: Steps of the table over coherence, and of the integral over a turn.
STEPS, TURN = 400, 2000
#: Looks up to which the density is summed up; for more, the variance is that of the Cramer-Rao bound.
MOST_LOOKS = 32


def phase_density(coherence: np.ndarray, looks: int, phase: np.ndarray) -> np.ndarray:
    """Density of the phase about its mean: coherence by phase. The multilook density, its hypergeometric function by
    Euler's transformation, whose series ends or falls fast."""
    g, n = coherence[:, None], float(looks)
    b = g * np.cos(phase)[None, :]
    z = b * b
    total, term = np.ones_like(z), np.ones_like(z)
    for k in range(60 + 4 * looks):
        term = term * ((0.5 - n + k) * (k - 0.5) / ((0.5 + k) * (k + 1))) * z
        total = total + term
    head = np.exp(lgamma(n + 0.5) - lgamma(n)) / (2 * np.sqrt(np.pi)) * b
    return np.maximum(0, (head + total / (2 * np.pi)) * ((1 - g * g) / (1 - z)) ** n / np.sqrt(1 - z))


def phase_variance(coherence: np.ndarray, looks: int) -> np.ndarray:
    """Variance of the phase in square radians, by integration over a turn."""
    g = np.clip(np.asarray(coherence, float), LOW, HIGH)
    if looks > MOST_LOOKS:
        return np.minimum((1 - g * g) / (2 * looks * g * g), np.pi**2 / 3)
    phase = (np.arange(TURN) + 0.5) / TURN * 2 * np.pi - np.pi
    p = phase_density(g, looks, phase)
    return (p * phase**2).sum(1) / p.sum(1)


def variance_of(coherence: Column, looks: int) -> Column:
    """phase_variance() of a column, between the steps of a table that goes along with the plan."""
    table = F.array(*(F.lit(float(v)) for v in phase_variance(np.linspace(0, 1, STEPS + 1), looks)))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coherence)) * STEPS
    k = F.least(F.floor(at), F.lit(STEPS - 1)).cast("int")
    low, high = F.get(table, k), F.get(table, k + 1)
    return low + (high - low) * (at - k)


def weight_of(coherence: Column, kind: str, looks: int) -> Column:
    """var: the inverse of the phase's variance; fim: Fisher information; coh: coherence; no: 1. Null where coherence is."""
    g = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), coherence))
    known = {"var": lambda: 1 / variance_of(coherence, looks), "fim": lambda: 2.0 * looks * g * g / (1 - g * g), "coh": lambda: g, "no": lambda: F.lit(1.0)}
    if kind not in known:
        raise ValueError(f"no weights of kind {kind}: one of {', '.join(known)}")
    return F.when(coherence.isNotNull(), known[kind]())


def weighted(pixels: DataFrame, kind: str = "var", looks: int = 8) -> DataFrame:
    """pixels (row, col, phase, coherence arrays over pairs) with their weights; a pair without coherence has no phase."""
    both = pixels.withColumn("weight", F.transform("coherence", lambda c: F.coalesce(weight_of(c, kind, looks), F.lit(0.0))))
    return both.withColumn("phase", F.zip_with("phase", "coherence", lambda p, c: F.when(c.isNotNull(), p)))


def masked(pixels: DataFrame, threshold: float | None = None, water: DataFrame | None = None, shadow: DataFrame | None = None, least: int = 1) -> DataFrame:
    """pixels (row, col, phase, coherence) that an inversion may use.

    threshold: phases of pairs whose mask value (coherence) is under it are null. water: (row, col, valid), only pixels with
    1 stay. shadow: (row, col, shadow), pixels with a value other than 0 go. least: phases that a pixel needs.
    """
    if threshold is not None:
        pixels = pixels.withColumn("phase", F.zip_with("phase", "coherence", lambda p, c: F.when(c >= threshold, p)))
    pixels = pixels.where(F.size(F.filter("phase", lambda p: p.isNotNull() & ~F.isnan(p))) >= least)
    if water is not None:
        pixels = pixels.join(water.where("valid = 1").select("row", "col"), ["row", "col"], "left_semi")
    if shadow is not None:
        pixels = pixels.join(shadow.where("shadow != 0").select("row", "col"), ["row", "col"], "left_anti")
    return pixels


def coherent(inverted: DataFrame, least: float) -> DataFrame:
    """Rows of pixels whose temporal coherence reaches ``least``."""
    return inverted.where(F.col("coherence") >= least)
