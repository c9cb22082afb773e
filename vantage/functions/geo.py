"""Geodesy and camera geometry as column expressions; all of them stay in whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
R_SPHERE = 6371000.0


def wrap(x) -> Column:
    """An angle into -180 ... 180 (exclusive)."""
    return F.pmod(x + 540.0, F.lit(360.0)) - 180.0


def norm360(x) -> Column:
    return F.pmod(x, F.lit(360.0))


def prime_vertical(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(A) / F.sqrt(1 - E2 * s * s)


def meridional(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(A * (1 - E2)) / F.pow(1 - E2 * s * s, F.lit(1.5))


def normal_section_radius(lat: Column, az: Column) -> Column:
    """Euler's radius of curvature in the direction ``az``."""
    c, s = F.cos(F.radians(az)), F.sin(F.radians(az))
    return 1 / (c * c / meridional(lat) + s * s / prime_vertical(lat))


def ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    n, la, lo = prime_vertical(lat), F.radians(lat), F.radians(lon)
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - E2) + h) * F.sin(la)


def normal(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Unit normal of the ellipsoid."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def enu_basis(lon: Column, lat: Column):
    la, lo = F.radians(lat), F.radians(lon)
    east = (-F.sin(lo), F.cos(lo), F.lit(0.0))
    north = (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la))
    return east, north, normal(lon, lat)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Distance on the sphere, metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((q - p) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * R_SPHERE * F.asin(F.sqrt(u * u + F.cos(p) * F.cos(q) * v * v))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial azimuth on the sphere, degrees 0 ... 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return norm360(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))))


def spherical_direct(lon, lat, az, s) -> tuple[Column, Column]:
    """(lon, lat) reached from a point along an azimuth."""
    p, a, d = F.radians(lat), F.radians(az), s / R_SPHERE
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    lo = F.radians(lon) + F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(lo), F.degrees(q)


def local_offsets_km(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Equirectangular offsets from a reference point."""
    return (lon - lon0) * 111.32 * math.cos(math.radians(lat0)), (lat - lat0) * 110.57


def azimuthal_equidistant(az, d) -> tuple[Column, Column]:
    return d * F.sin(F.radians(az)), d * F.cos(F.radians(az))


def utm_constants() -> dict[str, float]:
    """What the inverse projection needs of the ellipsoid: second eccentricity, scale of the meridian arc, factors of the footpoint latitude's series."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    return {
        "ep": E2 / (1 - E2), "scale": A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256), "f2": 3 * e1 / 2 - 27 * e1**3 / 32, "f4": 21 * e1**2 / 16 - 55 * e1**4 / 32, "f6": 151 * e1**3 / 96, "f8": 1097 * e1**4 / 512,
    }


def utm_inverse(e, n, zone: int = 13) -> tuple[Column, Column]:
    """(lon, lat) of UTM coordinates, northern hemisphere: the textbook series to the sixth power of the distance from the meridian."""
    c = utm_constants()
    ep, mu = c["ep"], n / 0.9996 / c["scale"]
    phi = mu + sum((c[f"f{i}"] * F.sin(i * mu) for i in (2, 4, 6, 8)), F.lit(0.0))
    c1, t1, n1, r1 = ep * F.cos(phi) * F.cos(phi), F.tan(phi) * F.tan(phi), prime_vertical(F.degrees(phi)), meridional(F.degrees(phi))
    d = (e - 500000.0) / (n1 * 0.9996)
    power = lambda k: F.pow(d, F.lit(float(k)))
    lat = phi - n1 * F.tan(phi) / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep) * power(4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep - 3 * c1 * c1) * power(6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * power(3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep + 24 * t1 * t1) * power(5) / 120) / F.cos(phi)
    return F.degrees(lon) + (6.0 * zone - 183.0), F.degrees(lat)


def local_plane(lon1, lat1, lon2, lat2) -> tuple[Column, Column]:
    """(distance, azimuth) by the radii at the mean latitude; the plane's azimuth holds at the midpoint, half the meridian convergence takes it to the start."""
    mean = (lat1 + lat2) / 2
    north, east = F.radians(lat2 - lat1) * meridional(mean), F.radians(lon2 - lon1) * prime_vertical(mean) * F.cos(F.radians(mean))
    return F.sqrt(north * north + east * east), norm360(F.degrees(F.atan2(east, north)) - (lon2 - lon1) * F.sin(F.radians(mean)) / 2)


def rotation(a, b, g) -> list[list[Column]]:
    """Rows of the matrix that turns by ``a`` about z, ``b`` about x, ``g`` about y (degrees), applied from the right."""
    one, none = F.lit(1.0), F.lit(0.0)
    (ca, sa), (cb, sb), (cg, sg) = ((F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (a, b, g))
    z, x, y = [[ca, -sa, none], [sa, ca, none], [none, none, one]], [[one, none, none], [none, cb, -sb], [none, sb, cb]], [[cg, none, sg], [none, one, none], [-sg, none, cg]]
    times = lambda m, n: [[dot(row, [n[k][j] for k in range(3)]) for j in range(3)] for row in m]
    return times(times(z, x), y)


def device_screen(az, el, a, b, g, d_az, d_el, focal) -> tuple[Column, Column]:
    """Offsets (right, down) on a device's screen of a direction, by its angles and calibration offsets; null behind it."""
    east, up = F.radians(norm360(az - d_az)), F.radians(el - d_el)
    world = [F.cos(up) * F.sin(east), F.cos(up) * F.cos(east), F.sin(up)]
    m = rotation(a, b, g)
    own = [dot([m[k][j] for k in range(3)], world) for j in range(3)]
    ahead = -own[2]
    return F.when(ahead > 0.02, focal * own[0] / ahead), F.when(ahead > 0.02, -focal * own[1] / ahead)


def star_place(ra_hours, dec, seconds, lon: float, lat: float) -> tuple[Column, Column]:
    """(az, el) of a star, ``seconds`` after 2000-01-01 12:00 UTC: the hour angle from mean sidereal time."""
    hour = F.radians(norm360(280.46061837 + 360.98564736629 * (seconds / 86400.0) + lon - ra_hours * 15))
    d, p = F.radians(dec), math.radians(lat)
    az = F.atan2(-F.cos(d) * F.sin(hour), F.sin(d) * math.cos(p) - F.cos(d) * math.sin(p) * F.cos(hour))
    return norm360(F.degrees(az)), F.degrees(F.asin(F.sin(d) * math.sin(p) + F.cos(d) * math.cos(p) * F.cos(hour)))


#: sixteen points, clockwise from north
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def compass_name(az: Column) -> Column:
    at = F.pmod(F.floor(norm360(az) / 22.5 + 0.5), F.lit(16)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), at)


def pinhole(az, el, az0, el0, roll, focal) -> tuple[Column, Column]:
    """Pixel offsets (right, down) of a direction in a camera; null behind it."""
    d, e, e0 = F.radians(wrap(az - az0)), F.radians(el), F.radians(el0)
    x, z = F.cos(e) * F.sin(d), F.sin(e) * F.sin(e0) + F.cos(e) * F.cos(e0) * F.cos(d)
    y = F.sin(e) * F.cos(e0) - F.cos(e) * F.sin(e0) * F.cos(d)
    u, v, r = focal * x / z, -focal * y / z, F.radians(roll)
    return F.when(z > 0, u * F.cos(r) - v * F.sin(r)), F.when(z > 0, u * F.sin(r) + v * F.cos(r))


def unproject(u, v, az0, el0, roll, focal) -> tuple[Column, Column]:
    """(az, el) of a pixel offset: the inverse of ``pinhole``."""
    r, e0 = F.radians(roll), F.radians(el0)
    a, b = u * F.cos(r) + v * F.sin(r), -u * F.sin(r) + v * F.cos(r)
    x, y, z = a / focal, -b / focal, F.lit(1.0)
    north, up = z * F.cos(e0) - y * F.sin(e0), z * F.sin(e0) + y * F.cos(e0)
    return norm360(az0 + F.degrees(F.atan2(x, north))), F.degrees(F.atan2(up, F.sqrt(x * x + north * north)))


def equivalent_focal_px(f35, width, height) -> Column:
    """Focal length in pixels of a 35 mm equivalent, by the diagonal."""
    return f35 * F.sqrt(width * width + height * height) / 43.2666


def mrad_to_deg(m) -> Column:
    return F.degrees(F.atan(m / 1000.0))


#: millimetres of a focal plane's resolution unit, by its code
PLANE_UNITS = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}


def focal_plane_px(mm, resolution, unit: Column) -> Column:
    """Focal length in pixels from millimetres and pixels per unit; an unknown unit counts as inches."""
    size = F.lit(PLANE_UNITS[2])
    for code, value in PLANE_UNITS.items():
        size = F.when(unit == code, value).otherwise(size)
    return mm * resolution / size


def axis_angle(label: Column) -> Column:
    """Degrees of an axis label such as 5L, 2.5U, H or V: left and down are negative, H and V are 0."""
    size, side = F.regexp_extract(label, r"^([0-9.]*)", 1), F.substring(label, -1, 1)
    degrees = F.coalesce(F.nullif(size, F.lit("")).cast("double"), F.lit(0.0))
    return F.when(side.isin("H", "V"), 0.0).when(side.isin("L", "D"), 0.0 - degrees).otherwise(degrees)
