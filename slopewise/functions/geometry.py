"""Column expressions over lines, held as arrays of (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def legs(line: Column) -> Column:
    """Lengths between neighbouring points."""
    return F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def length(line: Column) -> Column:
    return F.aggregate(legs(line), F.lit(0.0), lambda total, leg: total + leg)


def along(line: Column, distance: Column) -> Column:
    """The point of a line at a distance from its start, held to the line's ends."""
    start = F.struct(F.lit(0.0).alias("left"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    wanted = F.greatest(distance.cast("double"), F.lit(0.0))

    def step(s: Column, i: Column) -> Column:
        p, q = F.get(line, i), F.get(line, i + 1)
        leg = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        share = F.when(leg > 0, F.least((wanted - s["left"]) / leg, F.lit(1.0))).otherwise(F.lit(0.0))
        inside = wanted >= s["left"]
        return F.struct((s["left"] + leg).alias("left"), F.when(inside, p["x"] + (q["x"] - p["x"]) * share).otherwise(s["x"]).alias("x"), F.when(inside, p["y"] + (q["y"] - p["y"]) * share).otherwise(s["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def sample_count(length: Column, spacing: float = 5.0, least: int = 3) -> Column:
    return F.greatest(F.lit(least), F.ceil(length / spacing).cast("int") + 1)


def densify(length: Column, spacing: float = 5.0, least: int = 3) -> Column:
    """Equally spaced distances from 0 to the length."""
    n = sample_count(length, spacing, least)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: length * i / (n - 1))


def area(ring: Column) -> Column:
    """Unsigned area of a closed ring by the shoelace formula."""
    terms = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def _signed(ring: Column, term) -> Column:
    """Sum of a term of (p, q, cross product) over the legs of a ring."""
    parts = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: term(p, q, p["x"] * q["y"] - q["x"] * p["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, t: s + t)


def centroid(ring: Column) -> Column:
    """(x, y) of a closed ring's centre of mass; null for a ring without area."""
    twice = _signed(ring, lambda p, q, c: c)
    at = lambda c: F.when(twice != 0, _signed(ring, lambda p, q, w: (p[c] + q[c]) * w) / (3 * twice))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def representative(ring: Column) -> Column:
    """A point that lies in the ring for certain: the middle of the widest stretch of the ring along the line half-way up."""
    ys = F.transform(ring, lambda p: p["y"])
    level = (F.array_min(ys) + F.array_max(ys)) / 2
    cross = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda p, q: F.when((p["y"] > level) != (q["y"] > level), (q["x"] - p["x"]) * (level - p["y"]) / (q["y"] - p["y"]) + p["x"]),
    )
    xs = F.array_sort(F.filter(cross, lambda x: x.isNotNull()))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("wide"), ((F.get(xs, 2 * k + 1) + F.get(xs, 2 * k)) / 2).alias("x")))
    best = F.when(F.size(xs) >= 2, F.array_max(pairs)["x"])
    return F.struct(best.alias("x"), level.alias("y"))


def repaired(ring: Column) -> Column:
    """A ring closed, without points that repeat the one before; null if less than a triangle is left."""
    once = F.filter(ring, lambda p, i: (i == 0) | (F.get(ring, i - 1) != p))
    shut = F.when(F.element_at(once, 1) == F.element_at(once, -1), once).otherwise(F.concat(once, F.slice(once, 1, 1)))
    return F.when(F.size(ring) > 0, F.when(F.size(shut) >= 4, shut))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the ring's legs."""
    crossings = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda p, q: F.when((p["y"] > y) != (q["y"] > y), F.when(x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"], 1).otherwise(0)).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda n, c: n + c) % 2 == 1


def gap(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a straight piece."""
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    return F.hypot(x - x0 - t * dx, y - y0 - t * dy)


def bearing_difference(a: Column, b: Column) -> Column:
    """Angle between two undirected bearings, 0 to pi / 2."""
    return F.abs(F.pmod(a - b + math.pi / 2, F.lit(math.pi)) - math.pi / 2)


def spread_bits(v: Column) -> Column:
    """Moves bit i of a 16-bit number to bit 2 i."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Z-order key of two 16-bit cell numbers."""
    return spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(spread_bits(y.cast("long")), 1))


def transverse_mercator(lon: Column, lat: Column, central: float = -123.0) -> tuple[Column, Column]:
    """Easting and northing in metres on the GRS 80 ellipsoid, zone width six degrees, by the series of Snyder (1987)."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - central)
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(phi) ** 2)
    t, c = F.tan(phi) ** 2, F.lit(ep2) * F.cos(phi) ** 2
    big = lam * F.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = k0 * n * (big + (1 - t + c) * big**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * big**5 / 120) + 500_000.0
    y = k0 * (m + n * F.tan(phi) * (big**2 / 2 + (5 - t + 9 * c + 4 * c**2) * big**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * big**6 / 720))
    return x, y


def geographic(x: Column, y: Column, central: float = -123.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place on the plane of transverse_mercator, by Krueger's series to the third order."""
    a, f, scale = 6378137.0, 1 / 298.257222101, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    north, east = y / (scale * radius), (x - 500_000.0) / (scale * radius)
    xi, eta = north, east
    for k, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * k * north) * F.cosh(2 * k * east)
        eta = eta - b * F.cos(2 * k * north) * F.sinh(2 * k * east)
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    lat = conformal
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * conformal)
    return central + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The points of a line that Douglas and Peucker's method keeps; both ends always."""
    keep, work = {0, len(points) - 1}, [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        far, at = tolerance, -1
        whole = math.hypot(bx - ax, by - ay)
        for k in range(a + 1, b):
            x, y = points[k]
            gap = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / whole if whole else math.hypot(x - ax, y - ay)
            if gap > far:
                far, at = gap, k
        if at >= 0:
            keep.add(at)
            work += [(a, at), (at, b)]
    return [p for k, p in enumerate(points) if k in keep]


def part(line: Column, a: Column, b: Column) -> Column:
    """The piece of a line between two shares of its length: both cut points and the points between them.

    The line should be a column of its own, as it is read several times.
    """
    whole = length(line)
    upto = F.transform(F.sequence(F.lit(1), F.size(line)), lambda k: F.aggregate(F.slice(legs(line), 1, k - 1), F.lit(0.0), lambda s, leg: s + leg))
    inner = F.filter(F.zip_with(line, upto, lambda p, d: F.struct(p["x"].alias("x"), p["y"].alias("y"), d.alias("d"))), lambda p: (p["d"] > a * whole) & (p["d"] < b * whole))
    return F.concat(F.array(along(line, a * whole)), F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(along(line, b * whole)))
