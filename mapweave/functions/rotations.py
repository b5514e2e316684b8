"""Rotations and rigid poses as numpy arrays, for use inside tasks: many at once, row by row."""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    """The matrices of the cross products with vectors (n, 3)."""
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def exp(v: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors (n, 3)."""
    a = np.linalg.norm(v, axis=1)[:, None, None]
    s = skew(v)
    first = np.sinc(a / np.pi)
    second = 0.5 * np.sinc(a / (2 * np.pi)) ** 2
    return np.eye(3) + first * s + second * (s @ s)


def log(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotations (n, 3, 3), of length up to pi; for half turns either sign."""
    w = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1) / 2
    sine, cosine = np.linalg.norm(w, axis=1), (np.trace(r, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sine, cosine)
    plain = w * np.where(sine > 1e-8, angle / np.maximum(sine, 1e-300), 1.0)[:, None]
    # Near a half turn the axis is a column of (r + r') / 2 - cos, the longest.
    b = (r + r.transpose(0, 2, 1)) / 2 - np.clip(cosine, -1, 1)[:, None, None] * np.eye(3)
    k = np.argmax(np.einsum("nii->ni", b), 1)
    axis = b[np.arange(len(r)), :, k]
    axis = axis / np.maximum(np.linalg.norm(axis, axis=1), 1e-300)[:, None]
    axis = axis * np.where(np.einsum("ni,ni->n", axis, w) < 0, -1.0, 1.0)[:, None]
    return np.where(((cosine < -0.9) & (sine < 0.3))[:, None], axis * angle[:, None], plain)


def inverse_right_jacobian(v: np.ndarray) -> np.ndarray:
    """What a small turn on the right changes of the rotation vector ``v`` (n, 3)."""
    a, s = np.linalg.norm(v, axis=1), skew(v)
    small = a < 1e-4
    safe = np.where(small, 1.0, a)
    factor = np.where(small, 1 / 12, 1 / safe**2 - (1 + np.cos(safe)) / (2 * safe * np.where(np.abs(np.sin(safe)) < 1e-12, 1e-12, np.sin(safe))))
    return np.eye(3) + s / 2 + factor[:, None, None] * (s @ s)


def orthonormal(r: np.ndarray) -> np.ndarray:
    """The nearest rotations to matrices (n, 3, 3)."""
    u, _, vt = np.linalg.svd(r)
    u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    return u @ vt
