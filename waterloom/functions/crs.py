"""Projected <-> geographic coordinates as column expressions.

Transverse Mercator uses the sixth-order series in the third flattening (Krueger 1912, as
tabulated by Karney 2011); the conformal conic is the one-standard-parallel form (Snyder 1987,
pp. 107-109).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported systems. The conic definition is local to the network files and has
# no datum shift.
UTM_ZONES = {"EPSG:32630": 30, "EPSG:32631": 31, "EPSG:32632": 32}
CONIC = {
    "EPSG:3405": {
        "a": 6378249.145, "rf": 293.4663, "lat": 36.0, "lon": 2.7,
        "k0": 0.999625544, "x0": 500135.0, "y0": 300090.0,
    }
}
CODES = sorted(UTM_ZONES) + sorted(CONIC)

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_K0, _X0 = 0.9996, 500000.0
_n2, _n3, _n4, _n5, _n6 = (_N**k for k in range(2, 7))
_RECT = _A / (1 + _N) * (1 + _n2 / 4 + _n4 / 64 + _n6 / 256)
# Series coefficients, forward then inverse.
_ALPHA = [
    _N / 2 - 2 * _n2 / 3 + 5 * _n3 / 16 + 41 * _n4 / 180 - 127 * _n5 / 288 + 7891 * _n6 / 37800,
    13 * _n2 / 48 - 3 * _n3 / 5 + 557 * _n4 / 1440 + 281 * _n5 / 630 - 1983433 * _n6 / 1935360,
    61 * _n3 / 240 - 103 * _n4 / 140 + 15061 * _n5 / 26880 + 167603 * _n6 / 181440,
    49561 * _n4 / 161280 - 179 * _n5 / 168 + 6601661 * _n6 / 7257600,
    34729 * _n5 / 80640 - 3418889 * _n6 / 1995840,
    212378941 * _n6 / 319334400,
]
_BETA = [
    _N / 2 - 2 * _n2 / 3 + 37 * _n3 / 96 - _n4 / 360 - 81 * _n5 / 512 + 96199 * _n6 / 604800,
    _n2 / 48 + _n3 / 15 - 437 * _n4 / 1440 + 46 * _n5 / 105 - 1118711 * _n6 / 3870720,
    17 * _n3 / 480 - 37 * _n4 / 840 - 209 * _n5 / 4480 + 5569 * _n6 / 90720,
    4397 * _n4 / 161280 - 11 * _n5 / 504 - 830251 * _n6 / 7257600,
    4583 * _n5 / 161280 - 108847 * _n6 / 3991680,
    20648693 * _n6 / 638668800,
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _conformal(tau: Column, e: float) -> Column:
    """Tangent of the conformal latitude from the tangent of the latitude."""
    def turned(root: Column) -> Column:
        sigma = F.sinh(F.lit(e) * F.atanh(F.lit(e) * tau / root))
        return _let(sigma, lambda s: tau * F.sqrt(1 + s * s) - s * root)

    return _let(F.sqrt(1 + tau * tau), turned)


def _latitude_tangent(conformal: Column, e: float, steps: int = 3) -> Column:
    """Inverse of :func:`_conformal` by Newton steps (three reach double precision).

    Each step is bound through a one-element array so the expression stays linear in size.
    """
    def step(tau: Column, aim: Column) -> Column:
        return _let(_conformal(tau, e), lambda forward: tau + (
            (aim - forward)
            / F.sqrt(1 + forward * forward)
            * (1 + F.lit(1 - e * e) * tau * tau)
            / (F.lit(1 - e * e) * F.sqrt(1 + tau * tau))
        ))

    return _let(conformal, lambda aim: F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), aim / F.lit(1 - e * e), lambda tau, _: step(tau, aim)
    ))


def _utm_forward(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    lam = F.radians(lon - F.lit(float(zone * 6 - 183)))
    t = _conformal(F.tan(F.radians(lat)), _E)
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_X0) + F.lit(_K0 * _RECT) * east, F.lit(_K0 * _RECT) * north


def _utm_inverse(x: Column, y: Column, zone: int) -> Column:
    def series(spot: Column) -> Column:
        xi, eta = spot["xi"], spot["eta"]
        xi0, eta0 = xi, eta
        for j, b in enumerate(_BETA, 1):
            xi0 = xi0 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta0 = eta0 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct(xi0.alias("xi"), eta0.alias("eta"))

    def angles(s: Column) -> Column:
        sinh_eta, cos_xi = s["sinh_eta"], s["cos_xi"]
        conformal = s["sin_xi"] / F.sqrt(sinh_eta * sinh_eta + cos_xi * cos_xi)
        lat = F.degrees(F.atan(_latitude_tangent(conformal, _E)))
        lon = F.degrees(F.atan2(sinh_eta, cos_xi)) + F.lit(float(zone * 6 - 183))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    spot = F.struct((y / F.lit(_K0 * _RECT)).alias("xi"),
                    ((x - F.lit(_X0)) / F.lit(_K0 * _RECT)).alias("eta"))
    return _let(_let(_let(spot, series), lambda s: F.struct(
        F.sinh(s["eta"]).alias("sinh_eta"), F.cos(s["xi"]).alias("cos_xi"),
        F.sin(s["xi"]).alias("sin_xi"))), angles)


def _conic_constants(p: dict) -> tuple[float, float, float, float, float]:
    f = 1 / p["rf"]
    e = math.sqrt(f * (2 - f))
    phi = math.radians(p["lat"])
    n = math.sin(phi)
    con = e * n
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - con) / (1 + con)) ** (e / 2)
    m = math.cos(phi) / math.sqrt(1 - con * con)
    big_f = m / (n * t**n)
    rho0 = p["a"] * p["k0"] * big_f * t**n
    return e, n, big_f, rho0, p["a"] * p["k0"]


def _conic_forward(lon: Column, lat: Column, p: dict) -> tuple[Column, Column]:
    e, n, big_f, rho0, ak = _conic_constants(p)
    phi = F.radians(lat)
    con = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - con) / (1 + con), F.lit(e / 2))
    rho = F.lit(ak * big_f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(p["lon"]))
    return F.lit(p["x0"]) + rho * F.sin(theta), F.lit(p["y0"] + rho0) - rho * F.cos(theta)


def _conic_inverse(x: Column, y: Column, p: dict) -> Column:
    e, n, big_f, rho0, ak = _conic_constants(p)

    def angles(s: Column) -> Column:
        dx, dy = s["dx"], s["dy"]
        rho = F.sqrt(dx * dx + dy * dy)
        # the conformal latitude is pi/2 - 2 atan(t); its tangent is (1 - t^2) / (2 t)
        lat = _let(F.pow(rho / F.lit(ak * big_f), F.lit(1 / n)), lambda t: F.degrees(
            F.atan(_latitude_tangent((1 - t * t) / (2 * t), e))))
        lon = F.degrees(F.atan2(dx, dy)) / F.lit(n) + F.lit(p["lon"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return _let(F.struct((x - F.lit(p["x0"])).alias("dx"),
                         (F.lit(rho0 + p["y0"]) - y).alias("dy")), angles)


def to_lonlat(x: Column, y: Column, code: str = "EPSG:32631") -> Column:
    """Struct {lon, lat} in degrees from projected coordinates."""
    if code in UTM_ZONES:
        return _utm_inverse(x, y, UTM_ZONES[code])
    if code in CONIC:
        return _conic_inverse(x, y, CONIC[code])
    raise ValueError(f"unknown coordinate system {code!r}; known: {', '.join(CODES)}")


def from_lonlat(lon: Column, lat: Column, code: str = "EPSG:32631") -> Column:
    """Struct {x, y} in projected units from degrees."""
    if code in UTM_ZONES:
        x, y = _utm_forward(lon, lat, UTM_ZONES[code])
    elif code in CONIC:
        x, y = _conic_forward(lon, lat, CONIC[code])
    else:
        raise ValueError(f"unknown coordinate system {code!r}; known: {', '.join(CODES)}")
    return F.struct(x.alias("x"), y.alias("y"))
