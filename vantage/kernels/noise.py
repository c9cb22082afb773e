"""Correlated terrain error and Monte Carlo visibility; one ray must fit in a task, rays are independent."""

from __future__ import annotations

import numpy as np


#: samples drawn at a time, and draws held at a time
STEP, HELD = 32, 1 << 17


def steps(s: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """(share of the value before, share of a fresh draw) at each of the sorted places."""
    keep = np.exp(-np.diff(s, prepend=s[:1]) / length)
    fresh = np.sqrt(1 - keep * keep)
    if len(fresh):
        keep[0], fresh[0] = 0.0, 1.0
    return keep, fresh


def correlated(s: np.ndarray, length: float, draws: int, rng: np.random.Generator) -> np.ndarray:
    """``draws`` fields of unit variance at the sorted places ``s``, with correlation exp(-distance / length).

    The process is Markov, so each value is drawn given the one before it: exact at uneven places, and without a grid.
    """
    keep, fresh = steps(s, length)
    out = rng.standard_normal((len(s), draws)) * fresh[:, None]
    for before, (now, share) in zip(out[:-1], zip(out[1:], keep[1:], strict=True), strict=True):
        now += share * before
    return out.T


def seen_shares(excess: np.ndarray, fraction: np.ndarray, s: np.ndarray, sigma: float, length: float, eye_sd: float, draws: int, seeds: np.ndarray) -> np.ndarray:
    """Share of draws, for each of ``seeds``, in which no sample stands above the line: ``excess`` is its height over it, ``fraction`` how far the eye's height shifts the line there.

    Seeds of one ray are drawn side by side, some samples at a time; one whose draws have all met a sample above the line needs no more.
    """
    keep, fresh = steps(s, length)
    out = np.zeros(len(seeds))
    many = max(HELD // (STEP * draws), 1)
    for begin in range(0, len(seeds), many):
        rngs = [np.random.default_rng(int(seed)) for seed in seeds[begin : begin + many]]
        eye = np.stack([rng.standard_normal(draws) for rng in rngs]) * eye_sd
        free, before, left = np.ones(eye.shape, bool), np.zeros(eye.shape), np.arange(len(rngs))
        for i in range(0, len(s), STEP):
            fields = np.empty((min(STEP, len(s) - i), len(left), draws))
            for j, n in enumerate(left):
                fields[:, j] = rngs[n].standard_normal((len(fields), draws))
            fields *= fresh[i : i + STEP, None, None]
            for share, now in zip(keep[i : i + STEP], fields, strict=True):
                now += share * before
                before = now
            fields = fields * sigma
            fields += excess[i : i + STEP, None, None]
            fields -= eye * fraction[i : i + STEP, None, None]
            free &= (fields <= 0).all(axis=0)
            some = free.any(axis=1)
            if not some.all():
                left, free, eye, before = left[some], free[some], eye[some], before[some]
                if not len(left):
                    break
        out[begin + left] = free.mean(axis=1)
    return out


def seen_share(excess: np.ndarray, fraction: np.ndarray, s: np.ndarray, sigma: float, length: float, eye_sd: float, draws: int, seed: int) -> float:
    """``seen_shares`` of one seed."""
    return float(seen_shares(excess, fraction, s, sigma, length, eye_sd, draws, np.array([seed]))[0])


def visibility_probability(excess: np.ndarray, fraction: np.ndarray, s: np.ndarray, sigma: float, length: float, eye_sd: float, draws: int, seed: int) -> float:
    """``seen_share`` where six standard deviations on either side do not decide without drawing; only samples that may touch are drawn."""
    sd = np.sqrt(sigma**2 + (eye_sd * fraction) ** 2)
    if np.all(excess + 6 * sd <= 0):
        return 1.0
    if np.any(excess - 6 * sd > 0):
        return 0.0
    near = np.flatnonzero(excess + 6 * sd > 0)
    near = near[np.argsort(s[near], kind="stable")]
    return seen_share(excess[near], fraction[near], s[near], sigma, length, eye_sd, draws, seed)
