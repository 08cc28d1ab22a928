"""Numeric column expressions with the semantics the evaluation operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up after a nudge, so that a last-bit difference in a sum does not move a tie."""
    return F.round(x + F.lit(1e-9), digits)


def not_nan(x: Column) -> Column:
    """NaN as null: aggregates then skip it."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def digitize(x: Column, cuts: Column) -> Column:
    """How many of the cuts are at most x."""
    return F.size(F.filter(cuts, lambda c: c <= x))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def cell_area_km2(lat: Column, d_lon: float, d_lat: float) -> Column:
    import math

    side = math.pi / 180 * EARTH_KM
    return F.lit(d_lon * side) * F.lit(d_lat * side) * F.abs(F.cos(F.radians(lat)))


def squared_distance(a: Column, b: Column) -> Column:
    """Between two arrays of doubles of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def hash_order(id_: Column, seed: int) -> Column:
    """A seeded order of whole numbers that any engine can repeat: a multiplicative hash modulo 2 ** 32.

    Of the number only its rest by 2 ** 32 counts, in two halves, so that no product passes 64 bits.
    """
    rest = F.pmod(id_.cast("long"), F.lit(4294967296))
    high, low = F.shiftright(rest, 16), rest.bitwiseAND(F.lit(65535))
    return F.pmod(high * F.lit(2654435761) % F.lit(65536) * F.lit(65536) + low * F.lit(2654435761) + F.lit(seed * 40503), F.lit(4294967296))
