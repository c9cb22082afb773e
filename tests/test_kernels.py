import math

import numpy as np
import pytest

from vantage.kernels import fit, geodesic, noise, raster, raytrace, sightline


def test_geodesic_known_and_round_trip():
    az, d = geodesic.inverse(0.0, 0.0, 0.0, 1.0)
    assert abs(d - 110574.389) < 0.01 and abs(az) < 1e-9
    assert geodesic.inverse(5.0, 5.0, 5.0, 5.0)[1] == pytest.approx(0)
    rng = np.random.default_rng(1)
    lon, lat, az, d = rng.uniform(-180, 180, 500), rng.uniform(-80, 80, 500), rng.uniform(0, 360, 500), rng.uniform(10, 160_000, 500)
    x, y = geodesic.direct(lon, lat, az, d)
    a, e = geodesic.inverse(lon, lat, x, y)
    assert np.max(np.abs(e - d)) < 1e-4 and np.max(np.abs((a - az + 540) % 360 - 180)) < 1e-5


@pytest.mark.parametrize("length", [20.0, 70.0])
def test_correlated_field_statistics(length):
    s = np.concatenate([np.arange(0, 1000, 2.0), np.arange(1000, 5000, 5.0)])
    f = noise.correlated(s, length, 4000, np.random.default_rng(0))
    assert abs(f.std() - 1) < 0.02 and abs(f.mean()) < 0.02
    lag = int(np.searchsorted(s, length))
    assert abs(np.mean(f[:, 0] * f[:, lag]) - math.exp(-s[lag] / length)) < 0.06
    at = int(np.searchsorted(s, 1000.0))  # across the change of spacing
    assert abs(np.mean(f[:, at - 3] * f[:, at + 3]) - math.exp(-(s[at + 3] - s[at - 3]) / length)) < 0.06


def test_monte_carlo_bounds_and_eye_only_normal():
    s, one = np.array([100.0, 200.0]), np.ones(2)
    assert noise.visibility_probability(np.array([-9.0, -9.0]), one, s, 0.1, 20.0, 0.1, 50, 1) == 1
    assert noise.visibility_probability(np.array([9.0, -9.0]), one, s, 0.1, 20.0, 0.1, 50, 1) == 0
    p = noise.visibility_probability(np.array([0.1, -9.0]), one, s, 0.0, 20.0, 0.2, 20000, 3)
    assert abs(p - 0.5 * (1 + math.erf(-0.5 / math.sqrt(2)))) < 0.02
    again = noise.visibility_probability(np.array([0.1, -9.0]), one, s, 0.0, 20.0, 0.2, 20000, 3)
    assert p == again


def test_sampling_distances_equal_plain_lists():
    sampling = sightline.Sampling()
    for total in (3.0, 7.9, 9.0, 500.0, 2999.0, 3004.5, 5990.0, 6000.1, 17_123.4):
        end = total - 3
        if end <= 5:
            expected = {total / 2}
        else:
            near, far = np.arange(5, min(3000, end), 2), end - np.arange(0, min(3000, end - 5), 2)
            mid = np.arange(3000, total - 3000, 5) if total > 6000 else np.zeros(0)
            expected = {x for x in np.concatenate([near, far, mid]).tolist() if 5 <= x <= end}
        s, ray = sampling.distances(np.array([total, 800.0]))
        assert set(s[ray == 0].tolist()) == expected
        assert sorted(set(ray.tolist())) == [0, 1]


def test_missing_terrain_is_not_free_sight():
    viewer = sightline.Viewer(-103.88, 30.27, 1501.6)
    lon, lat = np.array([-103.95, -103.90]), np.array([30.2, 30.25])
    flat = lambda x, y: np.full(np.shape(x), 1400.0)
    hole = lambda x, y: np.where((y < 30.24) & (y > 30.23), np.nan, 1400.0)
    of = lambda surface, **k: np.concatenate([r.highest(r.critical(0)) for _, r in sightline.rays(lon, lat, viewer, (0.66,), surface, **k)])
    assert np.isfinite(of(flat)).all()
    assert np.isnan(of(hole)).tolist() == [True, False]
    with pytest.raises(sightline.MissingTerrain):
        of(hole, strict=True)


def test_mosaic_takes_the_first_tile_with_data():
    fine = raster.Tile("1M_a", -104.0, 30.1, 0.01, -0.01, np.array([[1.0, 2.0, 3.0], [4.0, np.nan, 6.0], [7.0, 8.0, 9.0]]))
    coarse = raster.Tile("13_b", -105.0, 31.0, 0.1, -0.1, np.full((20, 20), 100.0))
    mosaic = raster.Mosaic([fine, coarse])
    lon, lat = np.array([-103.9875, -103.98, -104.5, -90.0]), np.array([30.0949, 30.084, 30.5, 30.0])
    z, source = mosaic.sample(lon, lat)
    assert source.tolist() == [1, 1, 1, -1] and z[2] == 100 and np.isnan(z[3])
    solid = raster.Mosaic([raster.Tile("1M_a", -104.0, 30.1, 0.01, -0.01, np.arange(9.0).reshape(3, 3)), coarse])
    z, source = solid.sample(np.array([-103.985, -103.99, -104.2]), np.array([30.085, 30.09, 30.2]))
    assert source.tolist() == [0, 0, 1] and z == pytest.approx([4.0, 2.0, 100.0])
    part = coarse.window(-104.05, 30.2, -103.95, 30.4)
    assert part.z.shape == (2, 2) and part.bounds == pytest.approx((-104.1, 30.2, -103.9, 30.4))
    assert np.isnan(fine.sample(np.array([-103.984]), np.array([30.094]))[0])  # a neighbour without data


def test_ray_in_constant_gradient_is_a_parabola():
    angles = np.linspace(-0.002, 0.002, 401)
    s = np.array([0.0, 20000.0])
    end, _ = raytrace.trace(angles, s, np.zeros(2) - 1000, 20000, raytrace.profile("lapse", -0.0065, 0), eye=1000.0)
    bend = 7.87e-7 * 85000 / 290**2 * (9.80665 / 287.05 - 0.0065)
    assert np.allclose(end, angles * 20000 - bend * 20000**2 / 2, atol=1e-6)
    end, blocked = raytrace.trace(angles, s, np.zeros(2), 20000, raytrace.profile("stable", 8.0, 30.0), eye=1.6, curvature=1 / 6371000)
    assert blocked.any() and len(raytrace.images(angles, end, blocked, 1.2)) >= 1


def test_layered_profiles_of_any_number_of_layers():
    p = raytrace.layered([(0.0, 0.12), (10.0, -0.02), (40.0, -0.0065), (200.0, 0.0)])
    assert p(np.array([-1.0, 0.0, 9.9, 10.0, 39.0, 40.0, 199.0, 200.0, 900.0])).tolist() == [0.12, 0.12, 0.12, -0.02, -0.02, -0.0065, -0.0065, 0.0, 0.0]


def test_camera_fit_and_homography():
    true = (200.0, 1.0, 2.0, 1500.0)
    az, el = np.array([190, 195, 200, 205, 210.0]), np.array([0, 1, 2, 0.5, 1.5])
    u, v = fit.project(az, el, true)
    best, rms = fit.camera_fit(u, v, az, el, (202.0, 0.0, 0.0, 1400.0))
    assert rms < 0.01 and np.allclose(best, true, atol=(0.01, 0.01, 0.05, 1))
    h = fit.homography(true, (203.0, 0.5, -1.0, 1200.0)) @ np.array([u, v, np.ones(5)])
    assert np.allclose(h[:2] / h[2], fit.project(az, el, (203.0, 0.5, -1.0, 1200.0)), atol=1e-6)


def test_rings_components_and_simplification():
    rings = fit.cell_rings({(x, y) for x in range(3) for y in range(3)} - {(1, 1)})
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True)) / 2
    assert sorted(area(r) for r in rings) == [-1, 9]
    assert fit.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2.0]]), 0.1).tolist() == [0, 2, 3]
    assert fit.without_collinear([(0, 0), (1, 0), (2, 0), (2, 1)]) == [(0, 0), (2, 0), (2, 1)]
    m = np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]], bool)
    assert fit.label_components(m).max() == 3
    image = np.zeros((20, 20))
    image[5:7, 8:10] = 50
    x, y, _, n = fit.detect_spots(image)[0]
    assert (x, y, n) == (8.5, 5.5, 4)
    flow = fit.flow_accumulation(np.arange(9, dtype=float).reshape(3, 3))
    assert flow[0, 0] == 9


def test_draws_side_by_side_equal_single_ones():
    rng = np.random.default_rng(5)
    for n, height in ((1, -0.5), (32, -1.5), (90, -1.5), (90, 2.0)):
        s, excess, fraction = np.sort(rng.uniform(0, 900, n)), height + rng.normal(size=n) * 0.4, np.linspace(1, 0, n)
        plain = []
        for seed in range(7):
            one = np.random.default_rng(seed)
            eye = one.standard_normal(200) * 0.15
            ground = noise.correlated(s, 70.0, 200, one) * 0.56
            plain.append(float(np.mean((excess + ground - eye[:, None] * fraction <= 0).all(axis=1))))
        assert noise.seen_shares(excess, fraction, s, 0.56, 70.0, 0.15, 200, np.arange(7)).tolist() == plain
