"""Dense least squares of small systems in NumPy, with the checks of their matrices."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

MAX_CONDITION = 1e10


class AdjustmentError(ValueError):
    """An adjustment that can't be carried out."""


class SingularMatrixError(AdjustmentError):
    pass


class InsufficientObservationsError(AdjustmentError):
    pass


class WeightError(AdjustmentError):
    pass


class IllConditionedWarning(UserWarning):
    pass


@dataclass(frozen=True)
class Stability:
    rank: int
    condition: float
    singular: bool
    ill_conditioned: bool


def stability(n: np.ndarray) -> Stability:
    """Rank and condition of a square matrix. Singular: the rank is short (a determinant says nothing on large chains)."""
    n = np.asarray(n, float)
    if n.ndim != 2 or n.shape[0] != n.shape[1]:
        raise ValueError("the matrix isn't square")
    rank = int(np.linalg.matrix_rank(n)) if n.size else 0
    cond = float(np.linalg.cond(n)) if n.size else 1.0
    return Stability(rank, cond, rank < len(n), cond > MAX_CONDITION)


def _invert(n: np.ndarray) -> np.ndarray:
    s = stability(n)
    if s.singular:
        raise SingularMatrixError("the normal matrix is singular")
    if s.ill_conditioned:
        warnings.warn(f"condition {s.condition:.3g}", IllConditionedWarning, stacklevel=3)
    return np.linalg.inv(n)


def linear_adjustment(a: np.ndarray, observed: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray | float]:
    """V = A X - L under weights P: x, v, n, qxx, sigma0, std_errors."""
    a, observed, p = np.asarray(a, float), np.asarray(observed, float), np.asarray(p, float)
    rows, cols = a.shape
    if observed.shape != (rows,) or p.shape != (rows, rows):
        raise ValueError("dimensions differ")
    if (np.diag(p) <= 0).any():
        raise WeightError("weights must be positive")
    if rows <= cols:
        raise InsufficientObservationsError(f"{rows} observations of {cols} unknowns")
    n = a.T @ p @ a
    q = _invert(n)
    x = q @ a.T @ p @ observed
    v = a @ x - observed
    sigma = float(np.sqrt(v @ p @ v / (rows - cols)))
    return {"x": x, "v": v, "n": n, "qxx": q, "sigma0": sigma, "std_errors": sigma * np.sqrt(np.diag(q))}


def conditional_adjustment(b: np.ndarray, w: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray | float]:
    """B v + w = 0 under weights P: correlates k, v, n, sigma0 over the number of conditions."""
    b, w, p = np.asarray(b, float), np.asarray(w, float), np.asarray(p, float)
    if b.shape[1] <= b.shape[0]:
        raise InsufficientObservationsError(f"{b.shape[1]} observations in {b.shape[0]} conditions")
    pinv = np.linalg.inv(p)
    n = b @ pinv @ b.T
    k = -_invert(n) @ w
    v = pinv @ b.T @ k
    return {"k": k, "v": v, "n": n, "sigma0": float(np.sqrt(v @ p @ v / len(w)))}
