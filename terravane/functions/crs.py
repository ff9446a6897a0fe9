"""Map projections as column formulas (G1-G3): UTM by a Krueger series, Albers equal area, and their inverses.

Constants are those of the public EPSG registry.  NAD83 and WGS84 longitudes and latitudes are taken as equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoids: semi-major axis, inverse flattening.
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10_000_000.0
LONLAT, ALBERS_CODES = {4326, 4269}, {5070, 102039}
ALBERS = {"lat0": 23.0, "lon0": -96.0, "sp1": 29.5, "sp2": 45.5}


def utm_zone(lon: Column) -> Column:
    """Zone of a longitude; the meridian between two zones belongs to the eastern one."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def _series(inverse_f: float) -> tuple[float, float, list[float], list[float]]:
    f = 1 / inverse_f
    n = f / (2 - f)
    radius = 1 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, alpha, beta


#: Names a part of a formula; where it makes a column of it, the formula's parts are worked out once and plans stay small.
Let = Callable[[str, Column], Column]


def _inline(name: str, value: Column) -> Column:
    return value


class Steps:
    """A DataFrame that takes the named parts of formulas as columns, each in a projection of its own."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, []

    def __call__(self, name: str, value: Column) -> Column:
        name = f"_{len(self.names)}_{name}"
        self.names.append(name)
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def done(self, **columns: Column) -> DataFrame:
        """The DataFrame with the results, which come out of a generator: a later filter on them is not written out as a formula of the inputs."""
        kept = [c for c in self.df.columns if c not in columns and c not in self.names]
        return self.df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def to_utm(lon: Column, lat: Column, zone: Column, let: Let = _inline) -> tuple[Column, Column]:
    """Easting and northing in a northern zone."""
    a, inv = WGS84
    n, radius, alpha, _ = _series(inv)
    ecc = 2 * math.sqrt(n) / (1 + n)
    dlon = let("dlon", F.radians(lon - (zone * 6 - 183)))
    s = let("s", F.sin(F.radians(lat)))
    t = let("t", F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s)))
    xi, eta = let("xi", F.atan2(t, F.cos(dlon))), let("eta", F.atanh(F.sin(dlon) / F.sqrt(1 + t * t)))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * a * radius
    return UTM_EAST + k * x, k * y


def from_utm(east: Column, north: Column, zone: Column, let: Let = _inline) -> tuple[Column, Column]:
    """Longitude and latitude of a northern zone's coordinates."""
    a, inv = WGS84
    n, radius, _, beta = _series(inv)
    k = UTM_SCALE * a * radius
    xi, eta = let("xi", north / k), let("eta", (east - UTM_EAST) / k)
    xp, ep = xi, eta
    for j, c in enumerate(beta, 1):
        xp = xp - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    xp, ep = let("xp", xp), let("ep", ep)
    chi = let("chi", F.asin(F.sin(xp) / F.cosh(ep)))
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(ep), F.cos(xp))), F.degrees(lat)


def _q(s: float, e: float) -> float:
    return (1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))


def _albers() -> tuple[float, float, float, float, float]:
    a, inv = GRS80
    e = math.sqrt(2 / inv - 1 / inv**2)
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
    q = lambda d: _q(math.sin(math.radians(d)), e)
    m1, m2, q1, q2 = m(ALBERS["sp1"]), m(ALBERS["sp2"]), q(ALBERS["sp1"]), q(ALBERS["sp2"])
    n = (m1**2 - m2**2) / (q2 - q1)
    c = m1**2 + n * q1
    return a, e, n, c, a / n * math.sqrt(c - n * q(ALBERS["lat0"]))


def to_albers(lon: Column, lat: Column, let: Let = _inline) -> tuple[Column, Column]:
    a, e, n, c, rho0 = _albers()
    s = let("s", F.sin(F.radians(lat)))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = let("rho", a / n * F.sqrt(c - n * q))
    theta = let("theta", n * F.radians(lon - ALBERS["lon0"]))
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def from_albers(x: Column, y: Column, let: Let = _inline) -> tuple[Column, Column]:
    a, e, n, c, rho0 = _albers()
    rho2 = let("rho2", x * x + (rho0 - y) * (rho0 - y))
    q = (c - rho2 * n * n / (a * a)) / n
    qp = _q(1.0, e)
    beta = let("beta", F.asin(q / qp))
    e2 = e * e
    lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
    return ALBERS["lon0"] + F.degrees(F.atan2(x, rho0 - y)) / n, F.degrees(lat)


def _code(crs: str) -> int:
    code = int(crs.rsplit(":", 1)[-1])
    if code in LONLAT or code in ALBERS_CODES or 1 <= code - 32600 <= 60 or 1 <= code - 32700 <= 60:
        return code
    raise ValueError(f"unsupported reference system {crs}")


def project(crs: str, lon: Column, lat: Column, let: Let = _inline) -> tuple[Column, Column]:
    """Coordinates in a supported reference system, from longitude and latitude."""
    code = _code(crs)
    if code in LONLAT:
        return lon, lat
    if code in ALBERS_CODES:
        return to_albers(lon, lat, let)
    east, north = to_utm(lon, lat, F.lit(code % 100), let)
    return east, north + UTM_SOUTH if code > 32700 else north


def unproject(crs: str, x: Column, y: Column, let: Let = _inline) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in a supported reference system."""
    code = _code(crs)
    if code in LONLAT:
        return x, y
    if code in ALBERS_CODES:
        return from_albers(x, y, let)
    return from_utm(x, y - UTM_SOUTH if code > 32700 else y, F.lit(code % 100), let)


def moved(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with the columns x and y taken from one reference system to another (G1)."""
    if source == target:
        return df
    let = Steps(df)
    lon, lat = unproject(source, F.col(x), F.col(y), let)
    east, north = project(target, let("lon", lon), let("lat", lat), let)
    return let.done(**{x: east, y: north})


def moved_each(df: DataFrame, systems: list[str], column: str, other: str, back: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with x and y taken from the system that ``column`` names, one of ``systems``, to ``other``, or with ``back`` the other way.

    Zones differ in a number only, so whatever the systems are, there is one formula for each of three kinds.
    """
    let = Steps(df)
    codes = {_code(k) for k in systems} - {_code(other)}
    if not codes:
        return df
    code = let("code", F.substring_index(F.col(column), ":", -1).cast("int"))
    px, py = F.col(x), F.col(y)
    south = F.when(code > 32700, UTM_SOUTH).otherwise(0.0)
    if back:
        lon, lat = unproject(other, px, py, let)
        px, py = let("lon", lon), let("lat", lat)
    kinds = []
    if codes & LONLAT:
        kinds.append((code.isin(*LONLAT), (px, py)))
    if codes & ALBERS_CODES:
        kinds.append((code.isin(*ALBERS_CODES), to_albers(px, py, let) if back else from_albers(px, py, let)))
    if codes - LONLAT - ALBERS_CODES:
        zone = code % 100
        if back:
            east, north = to_utm(px, py, zone, let)
            kinds.append((code > 32600, (east, north + south)))
        else:
            kinds.append((code > 32600, from_utm(px, py - south, zone, let)))
    px, py = (F.coalesce(*(F.when(is_kind, v[i]) for is_kind, v in kinds)) for i in (0, 1))
    if not back:
        px, py = project(other, let("lon", px), let("lat", py), let)
    same = F.col(column) == other
    return let.done(**{x: F.when(same, F.col(x)).otherwise(px), y: F.when(same, F.col(y)).otherwise(py)})
