"""Sight lines from one viewer to many targets: all samples of a ray are made and reduced in the task that has the target.

A sample costs eight transcendental functions and two dot products for each lamp, and none becomes a row, so runs at a sampling of
metres need no shuffle.  Memory is bounded by ``CHUNK`` samples; a ray has a few thousand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from . import noise

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
R_SPHERE = 6371000.0
CHUNK = 1 << 18


class MissingTerrain(ValueError):
    """A sample has no ground height."""


@dataclass(frozen=True)
class Sampling:
    """Distances along a ray (metres): fine within ``zone`` of both ends, coarse between, none nearer than the skips."""

    skip_near: float = 5.0
    skip_far: float = 3.0
    zone: float = 3000.0
    fine: float = 2.0
    coarse: float = 5.0

    def distances(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, number of the ray) of all samples; the midpoint where the skips leave nothing.  A distance may come twice."""
        end = total - self.skip_far
        short = end <= self.skip_near
        count = lambda x, step: np.where(short, 0, np.maximum(np.ceil(x / step), 0)).astype(np.int64)
        parts = [
            (count(np.minimum(self.zone, end) - self.skip_near, self.fine), np.full(len(total), self.skip_near), self.fine),
            (count(np.minimum(self.zone, end - self.skip_near), self.fine), end, -self.fine),
            (count(total - 2 * self.zone, self.coarse), np.full(len(total), self.zone), self.coarse),
            (short.astype(np.int64), total / 2, 0.0),
        ]
        ray, s = [], []
        for n, first, step in parts:
            own = np.repeat(np.arange(len(total)), n)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            ray.append(own)
            s.append(first[own] + step * nth)
        order = np.argsort(np.concatenate(ray), kind="stable")
        return np.concatenate(s)[order], np.concatenate(ray)[order]


@dataclass(frozen=True)
class Viewer:
    lon: float
    lat: float
    height: float  # of the eye

    def ecef(self) -> np.ndarray:
        return _ecef(np.radians(self.lon), np.radians(self.lat), self.height)

    def normal(self) -> np.ndarray:
        return _normal(np.radians(self.lon), np.radians(self.lat))


def _normal(lo, la) -> np.ndarray:
    return np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def _ecef(lo, la, h) -> np.ndarray:
    n = A / np.sqrt(1 - E2 * np.sin(la) ** 2)
    up = _normal(lo, la)
    return np.array([(n + h) * up[0], (n + h) * up[1], (n * (1 - E2) + h) * up[2]])


@dataclass
class Ray:
    """The samples of some targets: for each lamp, distance along the chord ``s`` and height over it ``y``, and the targets' own values."""

    first: np.ndarray  # place of each target's first sample
    ray: np.ndarray  # target of each sample
    ground: np.ndarray  # distance along the ground
    s: np.ndarray
    y: np.ndarray
    d: list[np.ndarray]
    up: list[np.ndarray]
    radius: np.ndarray
    curves: dict[int, np.ndarray] = field(default_factory=dict)

    def each(self, values: np.ndarray) -> np.ndarray:
        """A target's value at each of its samples."""
        return np.repeat(values, np.diff(self.first, append=len(self.ray)))

    def highest(self, values: np.ndarray) -> np.ndarray:
        """Largest value of each target; not a number where a sample has none."""
        return np.maximum.reduceat(values, self.first)

    def _curve(self, i: int) -> np.ndarray:
        """How much a ray to lamp i sinks at each sample for a refraction coefficient of one."""
        if i not in self.curves:
            out = self.each(self.d[i])
            out -= self.s[i]
            out *= self.s[i]
            out /= self.each(2 * self.radius)
            self.curves[i] = out
        return self.curves[i]

    def critical(self, i: int, raised: np.ndarray | None = None) -> np.ndarray:
        """The refraction coefficient at which each sample touches the line to lamp i; ``raised``: metres added to the ground."""
        return (self.y[i] if raised is None else self.y[i] + raised) / self._curve(i)

    def excess(self, i: int, k: float) -> np.ndarray:
        return self.y[i] - k * self._curve(i)


def rays(lon: np.ndarray, lat: np.ndarray, viewer: Viewer, lamps, surface: Callable, sampling: Sampling = Sampling(), strict: bool = False) -> Iterator[tuple[slice, Ray]]:  # noqa: B008
    """(targets, their samples) piece by piece.  ``surface(lon, lat)`` gives heights, not a number where it has none; ``strict`` then raises."""
    lo, la, lo0, la0 = np.radians(lon), np.radians(lat), math.radians(viewer.lon), math.radians(viewer.lat)
    u, v = np.sin((la - la0) / 2), np.sin((lo - lo0) / 2)
    dist = 2 * R_SPHERE * np.arcsin(np.sqrt(u * u + np.cos(la0) * np.cos(la) * v * v))
    az = np.arctan2(np.sin(lo - lo0) * np.cos(la), np.cos(la0) * np.sin(la) - np.sin(la0) * np.cos(la) * np.cos(lo - lo0))
    mean = (la + la0) / 2
    m = A * (1 - E2) / (1 - E2 * np.sin(mean) ** 2) ** 1.5
    n = A / np.sqrt(1 - E2 * np.sin(mean) ** 2)
    radius = 1 / (np.cos(az) ** 2 / m + np.sin(az) ** 2 / n)
    own_up, eye, eye_up = _normal(lo, la), viewer.ecef(), viewer.normal()
    ground = surface(lon, lat)
    # unit vectors of the viewer and of the direction it looks in: a point of the ray is between them
    east, north = np.array([-math.sin(lo0), math.cos(lo0), 0.0]), np.array([-math.sin(la0) * math.cos(lo0), -math.sin(la0) * math.sin(lo0), math.cos(la0)])
    ahead = np.sin(az)[None, :] * east[:, None] + np.cos(az)[None, :] * north[:, None]
    frames = []
    for lamp in lamps:
        chord = _ecef(lo, la, ground + lamp) - eye[:, None]
        d = np.sqrt((chord**2).sum(0))
        along = chord / d
        top = own_up + eye_up[:, None]
        above = top - (top * along).sum(0) * along
        above /= np.sqrt((above**2).sum(0))
        frames.append((d, along, above, (own_up * above).sum(0)))
    per_ray = np.maximum(dist / sampling.coarse + 4 * sampling.zone / sampling.fine, 1)
    piece = (np.cumsum(per_ray) // CHUNK).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(lon)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        s, ray = sampling.distances(dist[a:b])
        first = np.searchsorted(ray, np.arange(b - a))
        angle = s / R_SPHERE
        c, q = np.cos(angle), np.sin(angle)
        per = np.diff(first, append=len(s))
        x, y, z = (c * eye_up[j] + q * np.repeat(ahead[j, a:b], per) for j in range(3))
        h = surface(np.degrees(np.arctan2(y, x)), np.degrees(np.arcsin(z)))
        if strict and not np.isfinite(h).all():
            raise MissingTerrain(f"{int((~np.isfinite(h)).sum())} samples have no ground height")
        big = A / np.sqrt(1 - E2 * z * z)
        point = np.stack([(big + h) * x - eye[0], (big + h) * y - eye[1], (big * (1 - E2) + h) * z - eye[2]])
        axes = np.concatenate([np.stack([f[w][:, a:b] for f in frames]) for w in (1, 2)])  # along and above for each lamp, by target
        axes = np.ascontiguousarray(axes.transpose(2, 0, 1))
        dots = np.empty((2 * len(frames), len(s)))
        for t, (begin, end) in enumerate(zip(first, np.append(first[1:], len(s)), strict=True)):
            np.matmul(axes[t], point[:, begin:end], out=dots[:, begin:end])
        yield slice(a, b), Ray(first, ray, s, dots[: len(frames)], dots[len(frames) :], [f[0][a:b] for f in frames], [f[3][a:b] for f in frames], radius[a:b])


def probability(ray: Ray, k: float, sigma: float, length: float, eye_sd: float, draws: int, seeds: np.ndarray | None = None, place: np.ndarray | None = None) -> np.ndarray:
    """Chance that each target is seen under ground and eye errors: six standard deviations decide most, the others are drawn.

    Without ``draws`` those are not a number, and the result has a value for each ray; else one for each target, with its own seed:
    ``place`` says which ray it has, in ascending order.
    """
    excess, d = ray.excess(0, k), ray.each(ray.d[0])
    fraction = (d - ray.s[0]) / d
    sd = np.sqrt(sigma**2 + (eye_sd * fraction) ** 2)
    high, low = ray.highest(excess + 6 * sd), ray.highest(excess - 6 * sd)
    unsure = (high > 0) & (low <= 0)
    out = np.where(np.isnan(high) | unsure, np.nan, np.where(low > 0, 0.0, 1.0))
    if not draws:
        return out
    out = out[place]
    ends = np.append(ray.first[1:], len(excess))
    for t in np.flatnonzero(unsure):
        own = np.arange(ray.first[t], ends[t])
        own = own[excess[own] + 6 * sd[own] > 0]
        own = own[np.argsort(ray.ground[own], kind="stable")]
        a, b = np.searchsorted(place, [t, t + 1])
        out[a:b] = noise.seen_shares(excess[own], fraction[own], ray.ground[own], sigma, length, eye_sd, draws, seeds[a:b])
    return out
