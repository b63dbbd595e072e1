"""Angles, pseudorapidity and approximate equality as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi


def wrap_periodic(value: Column, start: float, span: float) -> Column:
    """``value`` moved into [start, start + span); unchanged where it lies there already."""
    diff = value - F.lit(start)
    return F.when((diff >= 0) & (diff < span), value).otherwise(value - F.lit(span) * F.floor(diff / F.lit(span)).cast("double"))


def wrap_phi(phi: Column) -> Column:
    return wrap_periodic(phi, -PI, TWO_PI)


def wrap_theta(theta: Column) -> Column:
    return wrap_periodic(theta, 0.0, TWO_PI)


def wrap_phi_theta(phi: Column, theta: Column) -> tuple[Column, Column]:
    """Both angles in their nominal ranges; theta beyond pi is reflected and turns phi by pi."""
    theta = wrap_theta(theta)
    over = theta > PI
    return wrap_phi(F.when(over, phi + PI).otherwise(phi)), F.when(over, TWO_PI - theta).otherwise(theta)


def has_direction(theta: Column) -> Column:
    """False at the poles, where phi has no meaning."""
    return ~((theta <= 0) | (theta >= PI))


def radius(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def eta_to_theta(eta: Column) -> Column:
    return 2 * F.atan(F.exp(-eta))


def theta_to_eta(theta: Column) -> Column:
    return -F.ln(F.tan(theta / 2))


def same_scalar(a: Column, b: Column, uncertainty: float) -> Column:
    """The difference is at most ``uncertainty`` times the mean magnitude."""
    return F.abs(a - b) <= F.lit(uncertainty) * ((F.abs(a) + F.abs(b)) / 2)


def to_pi(phi: Column) -> Column:
    """Turned into [-pi, pi]."""
    turned = phi - TWO_PI * F.floor((phi + PI) / TWO_PI).cast("double")
    return F.when((phi >= -PI) & (phi <= PI), phi).otherwise(turned)


def same_angle(a: Column, b: Column, uncertainty: float) -> Column:
    """As ``same_scalar``, for the smaller arc between the angles and their mean direction."""
    diff = to_pi(a - b)
    return F.abs(diff) <= F.lit(uncertainty) * F.abs(to_pi(b + diff / 2))
