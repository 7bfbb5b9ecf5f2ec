"""Where the light of a pixel at one time lies at another: scene maps on pixel grids.

NumPy kernels for tasks that hold whole frames; ``functions.geometry`` says the same in
columns for rows of rays. Pixel centres are at half-integers, sky axes point right and up.
A pose is a time, a field angle and a disc centre; its members may be numbers or arrays
that broadcast against the grid, so a block of frames is mapped at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from framewright import constants as C
from framewright.functions import kernels as K
from framewright.functions.geometry import Globe, Rings

# --- fixed values: layers that move together or not at all ---------------------------
LIMB_TAPER_MU = 0.4
RING_CLEAR_PX = (4.0, 14.0)
RING_EDGE_PX = (4.0, 12.0)
RING_FADE_PER_SHIFT = 6.0
# --- fixed values: displacement fields -----------------------------------------------
INVERSE_STEPS = 8
INVERSE_RESIDUAL_PX = 0.01
LEAST_JACOBIAN = 0.25
EXPOSURE_NODES = 5


@dataclass(frozen=True)
class Pose:
    t: float | np.ndarray
    angle: float | np.ndarray
    cx: float | np.ndarray
    cy: float | np.ndarray

    def moved(self, dx, dy) -> Pose:
        return replace(self, cx=self.cx + dx, cy=self.cy + dy)


@dataclass(frozen=True)
class Scene:
    """What moves: a globe that spins, rings that turn with it, and the field as a whole."""

    globe: Globe | None = None
    rings: Rings | None = None
    field: bool = True
    limb_power: float = 0.0

    @property
    def edge_on(self) -> bool:
        return self.rings is not None and abs(self.globe.normal[2]) < C.EDGE_ON_MU

    def turn(self, src: Pose, ref: Pose):
        """Angle of spin from ``src`` to ``ref``, in the sense of body axes."""
        return self.globe.rate * (src.t - ref.t) if self.globe is not None else 0.0

    def still(self, src: Pose, ref: Pose) -> bool:
        return not np.any(self.turn(src, ref)) and not (self.field and np.any(np.asarray(src.angle) != ref.angle))


def grid(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices((height, width), dtype=float)
    return x + 0.5, y + 0.5


def _rotated(sx, sy, angle):
    c, s = np.cos(angle), np.sin(angle)
    return c * sx - s * sy, s * sx + c * sy


def _smoothstep(u):
    u = np.clip(u, 0.0, 1.0)
    return u * u * (3.0 - 2.0 * u)


def near_side(globe: Globe, sx, sy):
    """(x, y, z, hit, mu, steep) of the near side in pole axes that do not spin; mu is the emission cosine."""
    a2, c2 = 1 / globe.radius**2, 1 / globe.polar**2
    dx, dz = math.cos(globe.latitude), math.sin(globe.latitude)
    qx, qy, qz = globe.to_body(sx, sy, 0.0)
    qa, qb = dx * dx * a2 + dz * dz * c2, 2 * (qx * (dx * a2) + qz * (dz * c2))
    disc = qb * qb - 4 * qa * ((qx * qx + qy * qy) * a2 + qz * qz * c2 - 1)
    depth = (np.sqrt(np.maximum(disc, 0.0)) - qb) / (2 * qa)
    x, z = qx + depth * dx, qz + depth * dz
    toward = x * (dx * a2) + z * (dz * c2)
    steep = np.maximum(np.hypot(np.hypot(x, qy) * a2, z * c2), 1e-30)
    hit = (disc >= 0) & (toward >= -1e-12)
    return x, qy, z, hit, np.where(hit, np.maximum(toward / steep, 0.0), 0.0), steep


def _spun(globe: Globe, x, y, z, steep, turn):
    """Sky place and emission cosine (below zero: far side) of pole-axis points after a turn."""
    x, y = _rotated(x, y, turn)
    gx, gy, _ = globe.to_observer(x, y, z)
    toward = x * (math.cos(globe.latitude) / globe.radius**2) + z * (math.sin(globe.latitude) / globe.polar**2)
    return gx, gy, toward / steep


def _limb_gain(mu_to, mu_from, power: float):
    return (np.maximum(mu_to, C.LIMB_MU_FLOOR) / np.maximum(mu_from, C.LIMB_MU_FLOOR)) ** power


def ring_share(scene: Scene, sx, sy, turn):
    """How far (0 to 1) light at a sky offset turns with the rings.

    It fades out at the ring edges, and towards the places where the globe covers or shades the rings,
    over a length that grows with the distance moved, so that the fade never folds the image.
    """
    globe, rings = scene.globe, scene.rings
    nx, ny, nz = globe.normal
    bx, by, _ = globe.to_body(sx, sy, -(nx * sx + ny * sy) / nz)
    r = np.hypot(bx, by)
    near, far = RING_EDGE_PX
    share = _smoothstep((r - (rings.inner - far)) / (far - near)) * _smoothstep((rings.outer + far - r) / (far - near))
    near, far = RING_CLEAR_PX
    length = np.maximum(RING_FADE_PER_SHIFT * 2 * np.abs(np.sin(turn / 2)) * r, far - near)
    rays = [((math.cos(globe.latitude), 0.0, math.sin(globe.latitude)), False)]
    if rings.sun_longitude is not None or rings.sun_latitude is not None:
        rays.append((rings.sun_body(globe), True))
    for (vx, vy, vz), sunward in rays:
        size = math.sqrt(vx * vx + vy * vy + (vz * globe.radius / globe.polar) ** 2)  # the globe made a sphere
        along = (bx * vx + by * vy) / size
        clear = np.sqrt(np.maximum(r * r - along * along, 0.0)) - globe.radius
        if sunward:
            clear = np.where(along >= 0, np.inf, clear)  # only beyond the globe there is its shadow
        share = share * _smoothstep((clear - near) / length)
    return share


def ring_turned(globe: Globe, sx, sy, turn):
    """Sky offsets on the ring plane after a turn of its material."""
    nx, ny, nz = globe.normal
    x, y, z = globe.to_body(sx, sy, -(nx * sx + ny * sy) / nz)
    gx, gy, _ = globe.to_observer(*_rotated(x, y, turn), z)
    return gx, gy


def carried(scene: Scene, x, y, src: Pose, ref: Pose):
    """(x, y, valid, gain): the detector place at ``ref`` of light at (x, y) at ``src``, and its change of brightness."""
    sx, sy = x - src.cx, src.cy - y
    turn = scene.turn(src, ref)
    swing = ref.angle - src.angle if scene.field else 0.0
    fx, fy = _rotated(sx, sy, swing)
    rx, ry = fx + ref.cx, ref.cy - fy
    valid, gain = np.isfinite(rx) & np.isfinite(ry), np.ones(np.shape(rx))
    ox, oy = _rotated(sx, sy, -src.angle) if scene.field else (sx, sy)
    if scene.edge_on:  # the plane cannot be met: its whole projected band is left out
        nx, ny, nz = scene.globe.normal
        valid &= ~((np.abs(nx * ox + ny * oy) <= scene.rings.outer * abs(nz) + 0.5) & (np.hypot(ox, oy) <= scene.rings.outer + 0.5))
    if not np.any(turn):
        return rx, ry, valid, gain
    px, py, pz, hit, mu, steep = near_side(scene.globe, ox, oy)
    gx, gy, later = _spun(scene.globe, px, py, pz, steep, turn)
    seen = hit & (later >= -1e-12)
    light = _limb_gain(np.maximum(later, 0.0), mu, scene.limb_power) if scene.limb_power else gain
    back = (lambda u, v: _rotated(u, v, ref.angle)) if scene.field else (lambda u, v: (u, v))
    gx, gy = back(gx, gy)
    gx, gy = gx + ref.cx, ref.cy - gy
    spins = np.broadcast_to(np.asarray(turn) != 0, np.shape(rx))
    if scene.rings is None:
        use = seen & spins
        return np.where(use, gx, rx), np.where(use, gy, ry), valid & (~hit | seen | ~spins), np.where(use, light, 1.0)
    # With rings nothing is cut at a silhouette: the extra motion fades out at both limbs.
    blend = np.ones(np.shape(rx))
    for cosine in (mu, later):
        blend = blend * _smoothstep(np.clip(np.where(seen, cosine, 0.0) / LIMB_TAPER_MU, 0.0, 1.0) ** 2)
    blend = np.where(spins, blend, 0.0)
    dx, dy = rx + np.where(blend > 0, blend * (gx - rx), 0.0), ry + np.where(blend > 0, blend * (gy - ry), 0.0)
    if not scene.edge_on:
        share = ring_share(scene, ox, oy, turn)
        tx, ty = back(*ring_turned(scene.globe, ox, oy, turn))
        dx, dy = dx + share * (tx + ref.cx - rx), dy + share * (ref.cy - ty - ry)
    return dx, dy, valid, 1.0 + np.where(blend > 0, blend * (light - 1.0), 0.0)


def rendered(image: np.ndarray, scene: Scene, src: Pose, ref: Pose, *, light: bool = True) -> np.ndarray:
    """The plane known at ``ref`` as it looks at ``src``; ``light`` undoes the change of brightness, else it is a support."""
    x, y, valid, gain = carried(scene, *grid(*image.shape), src, ref)
    seen = K.sample_bilinear(image, y - 0.5, x - 0.5)
    return np.where(valid, seen / gain if light else seen, 0.0)


def scattered(values: np.ndarray, weights: np.ndarray, y: np.ndarray, x: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight x value and of weight, each sample dealt to its four neighbours; round-off is snapped."""
    good = np.isfinite(y) & np.isfinite(x) & (weights > 0)
    y, x, v, w = y[good], x[good], values[good], weights[good]
    y = np.where(np.abs(y - np.rint(y)) < C.SNAP, np.rint(y), y)
    x = np.where(np.abs(x - np.rint(x)) < C.SNAP, np.rint(x), x)
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - y0, x - x0
    total, cover = np.zeros(height * width), np.zeros(height * width)
    for sy, sx, part in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
        yy, xx = y0 + sy, x0 + sx
        inside = (yy >= 0) & (yy < height) & (xx >= 0) & (xx < width) & (part > 0)
        at, share = (yy * width + xx)[inside], (part * w)[inside]
        total += np.bincount(at, share * v[inside], height * width)
        cover += np.bincount(at, share, height * width)
    return total, cover


def _clamped(planes: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples of each plane (n, h, w) at its own places, edges repeated."""
    n, h, w = planes.shape
    known = np.isfinite(y) & np.isfinite(x)
    y, x = np.clip(np.where(known, y, 0), 0, h - 1), np.clip(np.where(known, x, 0), 0, w - 1)
    y0, x0 = np.minimum(np.floor(y).astype(int), max(h - 2, 0)), np.minimum(np.floor(x).astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx, k = y - y0, x - x0, np.arange(n)[:, None, None]
    seen = (1 - fy) * ((1 - fx) * planes[k, y0, x0] + fx * planes[k, y0, x1]) + fy * ((1 - fx) * planes[k, y1, x0] + fx * planes[k, y1, x1])
    return np.where(known, seen, np.nan)


def least_jacobian(ux: np.ndarray, uy: np.ndarray) -> np.ndarray:
    """(n,) least Jacobian of p -> p + u(p) for fields (n, h, w); below LEAST_JACOBIAN a field folds or nearly so."""
    (xy, xx), (yy, yx) = (np.gradient(u, axis=(1, 2)) for u in (ux, uy))
    area = (1 + xx) * (1 + yy) - xy * yx
    return np.where(np.isfinite(area).all((1, 2)), area.min((1, 2)), -np.inf)


def inverse_field(ux: np.ndarray, uy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qx, qy, residual) with q + u(q) = p for fields (n, h, w) in pixels, by fixed-point steps.

    The residual is each field's largest error; where it exceeds INVERSE_RESIDUAL_PX the places are those of the pixels.
    """
    y, x = np.indices(ux.shape[1:], dtype=float)
    qx, qy = np.broadcast_to(x, ux.shape), np.broadcast_to(y, ux.shape)
    for _ in range(INVERSE_STEPS):
        qx, qy = x - _clamped(ux, qy, qx), y - _clamped(uy, qy, qx)
    error = np.maximum(np.abs(qx + _clamped(ux, qy, qx) - x), np.abs(qy + _clamped(uy, qy, qx) - y))
    residual = np.where(np.isfinite(error).all((1, 2)), error.max((1, 2)), np.inf)
    bad = (residual > INVERSE_RESIDUAL_PX)[:, None, None]
    return np.where(bad, x, qx), np.where(bad, y, qy), residual


def mid_exposure_error(image: np.ndarray, scene: Scene, start: Pose, ref: Pose, exposure: float, field_rate: float, nodes: int = EXPOSURE_NODES) -> float:
    """Relative L2 distance of a frame frozen at mid-exposure from the mean of ``nodes`` moments of the exposure."""
    def at(t: float) -> np.ndarray:
        return rendered(image, scene, replace(start, t=start.t + t, angle=start.angle + field_rate * t), ref)

    frozen = at(exposure / 2)
    mean = sum(at((k + 0.5) * exposure / nodes) for k in range(nodes)) / nodes
    lit = np.abs(mean) > 1e-12
    norm = math.sqrt(float((mean[lit] ** 2).sum()))
    return math.sqrt(float(((frozen - mean)[lit] ** 2).sum())) / norm if norm > 0 else 0.0
