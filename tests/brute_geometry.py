"""Shapes of one cloud or curve in plain numpy, to hold the Spark operators against."""

import numpy as np

POINTS = 800
VIEW_AXES = {"cor": ((0, 1.0), (2, 1.0)), "sag": ((1, 1.0), (2, 1.0)), "axial": ((0, 1.0), (1, -1.0))}


def canonical_pose(xyz: np.ndarray, least: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centre, rotation): the long axis by principal components, pointing up; the left axis
    projected off it; the third their cross product."""
    if len(xyz) < least:
        raise ValueError(f"{len(xyz)} points, fewer than {least}")
    centre = xyz.mean(0)
    _, s, axes = np.linalg.svd(xyz - centre, full_matrices=False)
    if s[0] <= 0:
        raise ValueError("points coincide")
    up = axes[0] * (1.0 if axes[0, 2] >= 0 else -1.0)
    left = np.array([1.0, 0, 0]) - up[0] * up
    if np.linalg.norm(left) < 1e-9:
        raise ValueError("long axis lies left to right")
    left /= np.linalg.norm(left)
    return centre, np.stack([left, np.cross(up, left), up])


def project(xyz: np.ndarray, view: str) -> np.ndarray:
    return np.stack([xyz[:, i] * sign for i, sign in VIEW_AXES[view]], 1)


def signed_area(xy: np.ndarray) -> float:
    x, y = xy.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def counter_clockwise(xy: np.ndarray) -> np.ndarray:
    return xy if signed_area(xy) >= 0 else xy[::-1]


def even_points(xy: np.ndarray, n: int = POINTS) -> np.ndarray:
    """n points at equal arc lengths of a closed curve."""
    closed = np.vstack([xy, xy[:1]])
    length = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(closed, axis=0), axis=1))])
    if length[-1] <= 0:
        raise ValueError("curve without length")
    at = np.arange(n) * length[-1] / n
    return np.stack([np.interp(at, length, closed[:, i]) for i in (0, 1)], 1)


def smooth(xy: np.ndarray, window: int = 15, degree: int = 2) -> np.ndarray:
    """Local polynomial smoothing of a closed curve."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    kernel = np.linalg.pinv(basis)[0]
    return sum(k * np.roll(xy, half - i, axis=0) for i, k in enumerate(kernel))


def fourier(xy: np.ndarray, order: int) -> np.ndarray:
    """Elliptic Fourier coefficients a, b, c, d of orders 1 to order (the published sums over
    a closed polygon)."""
    step = np.diff(np.vstack([xy, xy[:1]]), axis=0)
    dt = np.maximum(np.linalg.norm(step, axis=1), 1e-12)
    t = np.concatenate([[0], np.cumsum(dt)])
    n = np.arange(1, order + 1)[:, None]
    phase = 2 * np.pi * n * t[None, :] / t[-1]
    scale = t[-1] / (2 * n**2 * np.pi**2)
    dcos, dsin = np.diff(np.cos(phase), axis=1), np.diff(np.sin(phase), axis=1)
    return np.concatenate([scale * ((step[:, i] / dt)[None, :] * w).sum(1, keepdims=True) for i in (0, 1) for w in (dcos, dsin)], 1)


def normalised(coefficients: np.ndarray, area: float, keep_size: bool = False) -> np.ndarray:
    """Coefficients free of rotation and starting point, and of size (root of the area) unless kept."""
    a, b, c, d = coefficients[0]
    theta = 0.5 * np.arctan2(2 * (a * b + c * d), a * a + c * c - b * b - d * d)
    out = np.empty_like(coefficients)
    for i, (a, b, c, d) in enumerate(coefficients, 1):
        turn = np.array([[np.cos(i * theta), -np.sin(i * theta)], [np.sin(i * theta), np.cos(i * theta)]])
        out[i - 1] = (np.array([[a, b], [c, d]]) @ turn).ravel()
    psi = np.arctan2(out[0, 2], out[0, 0])
    back = np.array([[np.cos(psi), np.sin(psi)], [-np.sin(psi), np.cos(psi)]])
    out = np.stack([(back @ m.reshape(2, 2)).ravel() for m in out])
    return out if keep_size else out / np.sqrt(area)


def reconstruct(coefficients: np.ndarray, n: int = POINTS) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / n
    k = np.arange(1, len(coefficients) + 1)[:, None] * t[None, :]
    a, b, c, d = (coefficients[:, [i]] for i in range(4))
    return np.stack([(a * np.cos(k) + b * np.sin(k)).sum(0), (c * np.cos(k) + d * np.sin(k)).sum(0)], 1)


def standard_outline(xy: np.ndarray, n: int = POINTS, window: int = 15) -> np.ndarray:
    """Counter-clockwise, even, smooth, starting at the top, the rightmost on ties, centred."""
    xy = counter_clockwise(smooth(even_points(counter_clockwise(xy), n), window))
    top = np.flatnonzero(np.isclose(xy[:, 1], xy[:, 1].max()))
    xy = np.roll(xy, -int(top[xy[top, 0].argmax()]), axis=0)
    return xy - xy.mean(0)
