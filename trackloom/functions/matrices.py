"""Subspaces, masked inverses, covariances and particle properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# PDG number to mass in GeV and charge; further numbers are unknown (0).
PARTICLES = {11: (0.00051099891, -1), -11: (0.00051099891, 1), 13: (0.1056583755, -1), -13: (0.1056583755, 1), 211: (0.13957039, 1), -211: (0.13957039, -1)}


def known_pdg(pdg: Column) -> Column:
    return F.when(pdg.isin(*PARTICLES), pdg).otherwise(F.lit(0))


def pdg_charge(pdg: Column) -> Column:
    return F.when(pdg.isin(-11, -13, 211), 1).when(pdg.isin(11, 13, -211), -1)


def charge_conjugate(pdg: Column) -> Column:
    return F.when(known_pdg(pdg) != 0, -pdg).otherwise(F.lit(0))


def corrected_hypothesis(pdg: Column, qop: Column) -> Column:
    """The hypothesis whose charge has the sign of ``qop``."""
    return F.when(pdg_charge(pdg) * qop > 0, pdg).otherwise(charge_conjugate(pdg))


def projector(subspace: tuple[int, ...], size: int) -> np.ndarray:
    """Rows that pick ``subspace`` from ``size`` parameters; its transpose expands again."""
    out = np.zeros((len(subspace), size))
    out[np.arange(len(subspace)), list(subspace)] = 1
    return out


def masked_inverse(a: Column, b: Column, c: Column, d: Column, dim: Column) -> tuple[Column, Column, Column, Column]:
    """Inverse of ((a, b), (c, d)); for one dimension only of a, zeros elsewhere."""
    det = F.nullif(a * d - b * c, F.lit(0.0))
    one = dim == 1
    zero = F.lit(0.0)
    return F.when(one, 1 / F.nullif(a, zero)).otherwise(d / det), F.when(one, zero).otherwise(-b / det), F.when(one, zero).otherwise(-c / det), F.when(one, zero).otherwise(a / det)


def inflate(cov: np.ndarray, factor: float) -> np.ndarray:
    """Diagonals scaled, everything else zero."""
    n = cov.shape[-1]
    return np.einsum("...ii->...i", cov)[..., None] * np.eye(n) * factor


def regularize(cov: np.ndarray, floor: float = -0.01) -> tuple[np.ndarray, np.ndarray]:
    """Covariances with negative diagonals made positive, and whether none was below ``floor``."""
    diag = np.einsum("...ii->...i", cov)
    ok = (diag >= floor).all(-1)
    out = cov.copy()
    i = np.arange(cov.shape[-1])
    out[..., i, i] = np.abs(diag)
    return out, ok


def line_sign(is_line: Column, loc0: Column) -> Column:
    """Sign of the observation of the first coordinate: a drift radius is positive on either side of its wire."""
    return F.when(is_line & (loc0 < 0), -1).otherwise(1)
