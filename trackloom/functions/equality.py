"""Equality of objects within a relative uncertainty, as column expressions over structs.

Scalars agree if they differ by at most ``uncertainty`` times their mean magnitude; surfaces, outcomes, states
and counts must be equal; lists must have equal elements in equal order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import same_angle, same_scalar


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _scalars(a: Column, b: Column, names: tuple[str, ...], uncertainty: float) -> Column:
    return _all([same_scalar(a[n], b[n], uncertainty) for n in names])


def same_measurement(a: Column, b: Column, uncertainty: float) -> Column:
    return (a["surface_link"] == b["surface_link"]) & _scalars(a, b, ("loc0", "loc1", "var0", "var1"), uncertainty)


def same_spacepoint(a: Column, b: Column, uncertainty: float) -> Column:
    return _scalars(a, b, ("x", "y", "z"), uncertainty)


def same_seed(a: Column, b: Column, uncertainty: float) -> Column:
    """Seeds as structs of three space points: bottom, middle, top."""
    return _all([same_spacepoint(a[n], b[n], uncertainty) for n in ("bottom", "middle", "top")])


def same_parameters(a: Column, b: Column, uncertainty: float) -> Column:
    """Bound track parameters: surface, local position, direction, q/p and time."""
    return (
        (a["surface_link"] == b["surface_link"])
        & _scalars(a, b, ("loc0", "loc1", "qop", "time"), uncertainty)
        & same_angle(a["phi"], b["phi"], uncertainty)
        & same_angle(a["theta"], b["theta"], uncertainty)
    )


def same_track_state(a: Column, b: Column, uncertainty: float) -> Column:
    """State word, the three chi2, filtered and smoothed parameters, and the measurement."""
    return (
        (a["state"] == b["state"])
        & _scalars(a, b, ("filtered_chi2", "smoothed_chi2", "backward_chi2"), uncertainty)
        & same_parameters(a["filtered"], b["filtered"], uncertainty)
        & same_parameters(a["smoothed"], b["smoothed"], uncertainty)
        & same_measurement(a["measurement"], b["measurement"], uncertainty)
    )


def same_track(a: Column, b: Column, uncertainty: float, success: int = 1) -> Column:
    """Outcome, parameters, ndf, holes and measurements in their order; chi2 and p-value only of successful fits."""
    links = F.forall(F.zip_with(a["links"], b["links"], lambda x, y: F.coalesce(same_measurement(x, y, uncertainty), F.lit(False))), lambda ok: ok)
    return (
        (a["fit_outcome"] == b["fit_outcome"])
        & same_parameters(a["params"], b["params"], uncertainty)
        & same_scalar(a["ndf"], b["ndf"], uncertainty)
        & ((a["fit_outcome"] != success) | _scalars(a, b, ("chi2", "pval"), uncertainty))
        & (a["n_holes"] == b["n_holes"])
        & (F.size(a["links"]) == F.size(b["links"]))
        & links
    )
