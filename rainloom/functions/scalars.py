"""Scalar column expressions: transforms, clipping, units, distances, losses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients and the mean Earth radius in km.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
EARTH_RADIUS_KM = 6371.0


def floor_at(x: Column, low: float) -> Column:
    """Lower bound that keeps NULL (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def to_log(x: Column) -> Column:
    return F.log1p(x)


def from_log(x: Column) -> Column:
    """Inverse of :func:`to_log`, never below zero."""
    return floor_at(F.expm1(x), 0.0)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column scales to 0."""
    return F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), F.lit(0.0))


def min_max_inverse(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def standard(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std).when(x.isNotNull(), F.lit(0.0))


def standard_inverse(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(273.15)


def hectopascal(pascal: Column) -> Column:
    return pascal / F.lit(100.0)


def millimetres(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    """Magnus form, in percent."""
    def pressure(t: Column) -> Column:
        return F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t))

    return F.lit(100.0) * pressure(dew_c) / pressure(temp_c)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL if a coordinate is."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def cyclic(ordinal: Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    """Sine and cosine of ``ordinal`` on a circle of ``period`` units."""
    angle = F.lit(2 * math.pi * harmonic) * ordinal / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def wet(x: Column, threshold: float) -> Column:
    """1 above the threshold, 0 otherwise, NULL stays NULL."""
    return (x > F.lit(float(threshold))).cast("int")


def gate(amount: Column, probability: Column, threshold: float = 0.4) -> Column:
    """Amount where the wet probability is strictly above the threshold, else 0."""
    return F.when(probability > F.lit(float(threshold)), amount).otherwise(F.lit(0.0))


def weighted_square_error(actual: Column, predicted: Column, alpha: float = 3.0) -> Column:
    error = actual - predicted
    return (F.lit(1.0) + F.lit(float(alpha)) * actual * actual) * error * error


def log_loss(label: Column, probability: Column, eps: float = 1e-7) -> Column:
    p = clip(probability, eps, 1 - eps)
    return -(label * F.log(p) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - p))


def pinball(actual: Column, predicted: Column, quantile: float) -> Column:
    error = actual - predicted
    return F.greatest(F.lit(quantile) * error, F.lit(quantile - 1.0) * error)


def percent_of(x: Column, base: Column) -> Column:
    return F.when(base != 0, x / base * F.lit(100.0))
