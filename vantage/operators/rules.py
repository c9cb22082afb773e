"""Classification rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Refraction class bounds, half-open (low, high]
REFRACTION_BOUNDS = [(0.0, "k1"), (0.07, "k2"), (0.13, "k3"), (0.25, "k4"), (0.5, "k5")]


def visibility_class(p: Column, kc_grass: Column, k: Column) -> Column:
    """v: surely seen even over grass; h: surely hidden; x: unknown; m: else.  Later rules override."""
    base = F.when((p >= 0.95) & (kc_grass <= k), "v").otherwise("m")
    return F.when(p.isNull(), "x").when(p <= 0.05, "h").otherwise(base)


def class_at(k: Column, kc: Column, stored: Column, standard: float = 0.13) -> Column:
    """Class at any refraction: the stored one at the standard coefficient, else visible if k is enough, hidden if not."""
    return F.when(F.abs(k - standard) < 1e-9, stored).when(kc <= k, "v").otherwise("h")


def refraction_bin(k: Column) -> Column:
    out = F.lit("k6")
    for bound, name in reversed(REFRACTION_BOUNDS):
        out = F.when(k <= bound, name).otherwise(out)
    return out


def lighting_class(spec: Column) -> Column:
    """Reads a lighting specification: chapters count for editions L to N of the circular only, by precedence."""
    edition = F.regexp_extract(spec, r"70/7460-1([A-Z])", 1)
    chapters = F.regexp_extract_all(F.split(spec, r"\(").getItem(0), F.lit(r"(\d+)"), F.lit(1))
    # Chapter -> kind, in order of precedence
    kinds = [("10", "adls"), ("9", "dual_high"), ("8", "dual"), ("7", "white_high"), ("6", "white"), ("5", "red")]
    named = F.coalesce(*[F.when(F.array_contains(chapters, c), name) for c, name in kinds], F.lit("lit"))
    return F.when(spec.isNull() | (F.trim(spec).isin("", "None")), "none").when(edition.isin("L", "M", "N"), named).otherwise("lit")


# Words that tell the kind of evidence, in order, and those of weak sources
EVIDENCE = [("photo", "photo|video"), ("instrument", "instrument|campaign|measurement|triangul|spectro"), ("press", "newspaper|magazine|tv|press|print")]
WEAK = "single|uncited|unverified|fan|weak|hearsay|third-hand"


def evidence_kind(text: Column) -> Column:
    """Kind of evidence by its words, eyewitness if none tells."""
    low, out = F.lower(text), F.lit("eyewitness")
    for kind, words in reversed(EVIDENCE):
        out = F.when(low.rlike(words), kind).otherwise(out)
    return out


def weak_source(status: Column) -> Column:
    return F.coalesce(F.lower(status).rlike(WEAK), F.lit(False))


def _by_bound(x: Column, bounds: list, last: str, below=lambda x, b: x < b) -> Column:
    """The name of the first bound that ``x`` is below, else ``last``."""
    out = F.lit(last)
    for bound, name in reversed(bounds):
        out = F.when(below(x, bound), name).otherwise(out)
    return out


# Forecast classes of k, phases of the moon by angle (degrees), words for magnitudes
FORECAST = [(0.13, "normal"), (0.5, "mild"), (1.0, "strong")]
PHASES = ["New moon", "Waxing crescent", "First quarter", "Waxing gibbous", "Full moon", "Waning gibbous", "Last quarter", "Waning crescent"]
BRIGHTNESS = [(-1.0, "as bright as the brightest stars"), (1.5, "like a bright star"), (4.0, "like a modest star"), (6.0, "faint, near the naked-eye limit")]


def forecast_class(k: Column) -> Column:
    return _by_bound(k, FORECAST, "duct")


def moon_phase(angle: Column) -> Column:
    """Eighths of the circle, centred on 0, 45, 90 ... degrees."""
    at = F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in PHASES]), at + 1)


def brightness_words(m: Column) -> Column:
    return _by_bound(m, BRIGHTNESS, "too faint to see", lambda x, b: x <= b)


def search_width(how: Column) -> Column:
    """Half-width in degrees by the method of measurement."""
    return F.when(how.isin("photo", "skyfinder"), 1).when(how == "landmark", 2).when(how == "compass", 3).otherwise(6)


def sky_state(sun: Column, moon: Column, lit: Column) -> Column:
    """By the heights of sun and moon and the moon's lit share."""
    return F.when(sun > -6, "civil").when(sun > -18, "twilight").when((moon > 0) & (lit > 0.12), "moon").otherwise("dark")


def shown_airfield(kind: Column, old: Column, listed: Column) -> Column:
    """Kind of an airfield that may be shown: historic, a balloon port, or open and on the official list; null for others."""
    historic = (kind == "closed") & old
    shown = historic | (kind == "balloonport") | ((kind != "closed") & listed)
    return F.when(shown, F.when(historic, "historic").when(kind == "balloonport", "balloon").when(kind == "heliport", "heliport").otherwise("airfield"))


# Railway owners' labels
RAIL = {"UP": "Union Pacific (Sunset Route)", "TXPF": "Texas Pacifico (ex-South Orient)"}


def rail_label(owner: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, label in RAIL.items():
        out = F.when(owner == code, label).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    """Order of analysed pictures: explained, explained in part, open, other, not analysed."""
    return F.when(verdict.isNull(), 9).when(verdict == "explained", 0).when(verdict.startswith("explained"), 1).when(verdict == "can't tell", 2).otherwise(3)


def old_class(cls: Column) -> Column:
    return F.when(cls == "v", "vis").when(cls == "m", "marg").when(cls == "h", "hid")


def kml_colour(rgb: Column, alpha: str = "ff") -> Column:
    """#rrggbb in the byte order of placemark files: alpha, blue, green, red."""
    return F.concat(F.lit(alpha), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2))


def bearing_verdict(el: Column, skyline: Column, rate: Column, known: Column, az: Column) -> Column:
    """What a direction means: null data first, then above the skyline, then how often lights are expected."""
    return (
        F.when((az < 150) | (az > 300), "outside")
        .when(el > skyline, "above")
        .when(rate.isNull() & ~known, "quiet")
        .when(rate >= 10, "busy")
        .when(rate >= 0.1, "occasional")
        .when(known, "fixed")
        .otherwise("quiet")
    )


def source_weight(cls: Column) -> Column:
    return F.when(cls == "v", 1.0).when(cls == "m", 0.5).otherwise(0.0)


def locus_lower_bound(kc: Column, cls: Column) -> Column:
    return F.greatest(F.when(cls.isin("v", "m"), F.least(kc, F.lit(0.13))).otherwise(kc), F.lit(0.0))


def light_verdict(aligned: Column, star: Column, far: Column, sigma: Column, el: Column, skyline: Column, rate: Column, hidden_road: Column) -> Column:
    """Verdict on a light in a picture; the first rule that holds decides."""
    return (
        F.when(~aligned, "unaligned")
        .when(star, "star")
        .when(far, "far-off-source")
        .when(sigma > 3, "uncertain")
        .when(el > skyline, "above-skyline")
        .when(rate >= 1, "explained-traffic")
        .when(rate > 0, "possible-traffic")
        .when(hidden_road, "hidden-road")
        .otherwise("unexplained")
    )
