"""Sky, globe and ring geometry as column expressions.

A view is a handful of driver-side constants; positions and times are columns.
The globe is symmetric about its pole, so rays are intersected in a frame that
does not spin and the spin only enters the longitude.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import clip, finite, smoothstep


@dataclass(frozen=True)
class Globe:
    radius: float
    flattening: float = 0.0
    pole: float = 0.0
    latitude: float = 0.0
    longitude0: float = 0.0
    rate: float = 0.0
    epoch: float = 0.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.radius) and self.radius > 0):
            raise ValueError("the equatorial radius must be positive and finite")
        if not 0 <= self.flattening < 1:
            raise ValueError("flattening must be in [0, 1)")
        if not abs(self.latitude) <= math.pi / 2:
            raise ValueError("the sub-observer latitude must be in [-pi/2, pi/2]")
        if not all(map(math.isfinite, (self.pole, self.longitude0, self.rate, self.epoch))):
            raise ValueError("globe angles must be finite")

    @property
    def polar(self) -> float:
        return self.radius * (1 - self.flattening)

    def longitude(self, t: Column) -> Column:
        return F.lit(self.longitude0) + F.lit(self.rate) * (t - F.lit(self.epoch))

    def to_body(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Observer axes to pole-aligned axes, before spin."""
        a, b = self.pole + math.pi / 2, self.latitude
        across = math.cos(a) * x - math.sin(a) * y
        side = math.sin(a) * x + math.cos(a) * y
        return (math.sin(b) * across + math.cos(b) * z, side, -math.cos(b) * across + math.sin(b) * z)

    def to_observer(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        a, b = self.pole + math.pi / 2, self.latitude
        across = math.sin(b) * x - math.cos(b) * z
        return (math.cos(a) * across + math.sin(a) * y, -math.sin(a) * across + math.cos(a) * y, math.cos(b) * x + math.sin(b) * z)

    @property
    def normal(self) -> tuple[float, float, float]:
        """Observer-frame direction of the pole."""
        a, b = self.pole + math.pi / 2, self.latitude
        return (-math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b))


@dataclass(frozen=True)
class Rings:
    inner: float
    outer: float
    transmission: float = 0.35
    sun_longitude: float | None = None
    sun_latitude: float | None = None

    def __post_init__(self) -> None:
        if not 0 < self.inner < self.outer or not math.isfinite(self.outer):
            raise ValueError("the outer ring radius must exceed a positive inner radius")
        if not 0 <= self.transmission <= 1:
            raise ValueError("ring transmission must be in [0, 1]")
        if self.sun_latitude is not None and abs(self.sun_latitude) > math.pi / 2:
            raise ValueError("the solar latitude must be in [-pi/2, pi/2]")

    def sun_body(self, globe: Globe) -> tuple[float, float, float]:
        lat = globe.latitude if self.sun_latitude is None else self.sun_latitude
        lon = self.sun_longitude or 0.0
        return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)

    def line_of_sight(self, globe: Globe) -> float:
        """Transmission along the line of sight, falling towards edge-on."""
        if self.transmission == 0:
            return 0.0
        depth = -math.log(min(max(self.transmission, 1e-12), 1.0))
        return math.exp(-depth / max(abs(globe.normal[2]), C.EDGE_ON_MU))


def detector_to_sky(x: Column, y: Column, cx: Column | float, cy: Column | float) -> tuple[Column, Column]:
    """Sky axes: x right, y up, origin at the centre."""
    return x - cx, F.lit(0.0) + cy - y


def sky_to_detector(sx: Column, sy: Column, cx: Column | float, cy: Column | float) -> tuple[Column, Column]:
    return sx + cx, F.lit(0.0) + cy - sy


def rotate(sx: Column, sy: Column, angle: Column) -> tuple[Column, Column]:
    """Counter-clockwise rotation."""
    return F.cos(angle) * sx - F.sin(angle) * sy, F.sin(angle) * sx + F.cos(angle) * sy


def with_globe_hit(df: DataFrame, globe: Globe, sx: str, sy: str, t: str) -> DataFrame:
    """Add lon, lat, on_globe, mu (emission cosine) and depth of the near side of the globe."""
    a2, c2 = 1 / globe.radius**2, 1 / globe.polar**2
    b = globe.latitude
    dx, dz = math.cos(b), math.sin(b)
    qx, qy, qz = globe.to_body(F.col(sx), F.col(sy), F.lit(0.0))
    df = df.withColumns({"_qx": qx, "_qy": qy, "_qz": qz})
    qa = dx * dx * a2 + dz * dz * c2
    qb = 2 * (F.col("_qx") * (dx * a2) + F.col("_qz") * (dz * c2))
    qc = (F.col("_qx") * F.col("_qx") + F.col("_qy") * F.col("_qy")) * a2 + F.col("_qz") * F.col("_qz") * c2 - 1
    df = df.withColumns({"_b": qb, "_disc": qb * qb - 4 * qa * qc})
    depth = F.when(F.col("_disc") >= 0, (-F.col("_b") + F.sqrt(F.greatest("_disc", F.lit(0.0)))) / (2 * qa))
    df = df.withColumn("_depth", depth)
    df = df.withColumns({"_x": F.col("_qx") + F.col("_depth") * dx, "_z": F.col("_qz") + F.col("_depth") * dz})
    toward = F.col("_x") * (dx * a2) + F.col("_z") * (dz * c2)
    steep = F.sqrt(F.pow(F.hypot("_x", "_qy") * a2, F.lit(2.0)) + F.pow(F.col("_z") * c2, F.lit(2.0)))
    hit = F.coalesce(toward >= -1e-12, F.lit(False))
    turn = globe.longitude(F.col(t))
    lx = F.cos(turn) * F.col("_x") - F.sin(turn) * F.col("_qy")
    ly = F.sin(turn) * F.col("_x") + F.cos(turn) * F.col("_qy")
    return df.withColumns({
        "on_globe": hit,
        "lon": F.when(hit, F.atan2(ly, lx)),
        "lat": F.when(hit, F.atan2(F.col("_z") / globe.polar, F.hypot("_x", "_qy") / globe.radius)),
        "mu": F.when(hit, F.greatest(toward / steep, F.lit(0.0))).otherwise(F.lit(0.0)),
        "depth": F.when(hit, F.col("_depth")),
    }).drop("_qx", "_qy", "_qz", "_b", "_disc", "_depth", "_x", "_z")


def body_to_sky(globe: Globe, lon: Column, lat: Column, t: Column) -> tuple[Column, Column, Column]:
    """(sx, sy, mu) of a body point; mu below zero means the far side."""
    a2, c2 = 1 / globe.radius**2, 1 / globe.polar**2
    turn = lon - globe.longitude(t)
    x, y, z = (globe.radius * F.cos(lat) * F.cos(turn), globe.radius * F.cos(lat) * F.sin(turn), globe.polar * F.sin(lat))
    sx, sy, _ = globe.to_observer(x, y, z)
    toward = x * (math.cos(globe.latitude) * a2) + z * (math.sin(globe.latitude) * c2)
    steep = F.sqrt(F.pow(F.lit(globe.radius) * F.cos(lat) * a2, F.lit(2.0)) + F.pow(z * c2, F.lit(2.0)))
    return sx, sy, toward / steep


def with_ring_hit(df: DataFrame, globe: Globe, rings: Rings, sx: str, sy: str) -> DataFrame:
    """Add ring_radius, ring_azimuth, ring_depth and on_ring for the equatorial annulus."""
    nx, ny, nz = globe.normal
    if abs(nz) < C.EDGE_ON_MU:
        none = F.lit(None).cast("double")
        return df.withColumns({"ring_radius": none, "ring_azimuth": none, "ring_depth": none, "on_ring": F.lit(False)})
    df = df.withColumn("_t", -(nx * F.col(sx) + ny * F.col(sy)) / nz)
    x, y, _ = globe.to_body(F.col(sx), F.col(sy), F.col("_t"))
    df = df.withColumns({"_rx": x, "_ry": y}).withColumn("_r", F.hypot("_rx", "_ry"))
    on = F.coalesce(F.col("_r").between(rings.inner, rings.outer), F.lit(False))
    return df.withColumns({
        "on_ring": on, "ring_radius": F.when(on, F.col("_r")), "ring_azimuth": F.when(on, F.atan2("_ry", "_rx")),
        "ring_depth": F.when(on, F.col("_t"))}).drop("_t", "_rx", "_ry", "_r")


def with_shadows(df: DataFrame, globe: Globe, rings: Rings, sx: str, sy: str) -> DataFrame:
    """Add globe_shadow (on a ring sample) and ring_shadow (on a globe sample); needs both hits."""
    sun = rings.sun_body(globe)
    a2, c2 = 1 / globe.radius**2, 1 / globe.polar**2
    # Globe shadow: does the ray from the ring sample towards the Sun meet the globe?
    px, py, pz = globe.to_body(F.col(sx), F.col(sy), F.col("ring_depth"))
    df = df.withColumns({"_px": px, "_py": py, "_pz": pz})
    qa = (sun[0] ** 2 + sun[1] ** 2) * a2 + sun[2] ** 2 * c2
    qb = 2 * ((F.col("_px") * sun[0] + F.col("_py") * sun[1]) * a2 + F.col("_pz") * (sun[2] * c2))
    qc = (F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py")) * a2 + F.col("_pz") * F.col("_pz") * c2 - 1
    disc = qb * qb - 4 * qa * qc
    farthest = (-qb + F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * qa)
    shaded = F.coalesce(F.col("on_ring") & (disc >= 0) & (farthest > C.MIN_RAY_U), F.lit(False))
    # Ring shadow: where does the ray from the globe sample cross the ring plane?
    gx, gy, gz = globe.to_body(F.col(sx), F.col(sy), F.col("depth"))
    if abs(sun[2]) < C.EDGE_ON_MU:
        crossed = F.lit(False)
    else:
        u = -gz / sun[2]
        radius = F.hypot(gx + u * sun[0], gy + u * sun[1])
        crossed = F.coalesce(F.col("on_globe") & (u > C.MIN_RAY_U) & radius.between(rings.inner, rings.outer), F.lit(False))
    return df.withColumns({"globe_shadow": shaded, "ring_shadow": crossed}).drop("_px", "_py", "_pz")


def layer() -> Column:
    """Front to back: near ring, globe, far ring, background."""
    return (F.when(F.col("on_ring") & (F.col("ring_depth") >= 0), "near_ring").when(F.col("on_globe"), "globe")
            .when(F.col("on_ring"), "far_ring").otherwise("background"))


def edge_on_band(globe: Globe, rings: Rings, sx: Column, sy: Column) -> Column:
    """Whole projected ring band, where the plane is too edge-on to intersect; false otherwise."""
    nx, ny, nz = globe.normal
    if abs(nz) >= C.EDGE_ON_MU:
        return F.lit(False)
    return (F.abs(nx * sx + ny * sy) <= rings.outer * abs(nz) + 0.5) & (F.hypot(sx, sy) <= rings.outer + 0.5)


def region(moon: Column, degenerate: Column) -> Column:
    """Motion region: 1/3 lit or shadowed globe, 2/4 lit or shadowed ring, 0 background, -1 unsupported."""
    label = F.when(F.col("on_globe") & ~moon, F.lit("globe")).otherwise(F.col("layer"))
    code = (F.when(label == "globe", F.when(F.col("ring_shadow"), 3).otherwise(1))
            .when(label.isin("near_ring", "far_ring"), F.when(F.col("globe_shadow"), 4).otherwise(2)).otherwise(0))
    return F.when(moon | degenerate, F.lit(-1)).otherwise(code).cast("long")


def moon_hit(x: Column, y: Column, moon_x: float, moon_y: float, radius: float, vx: float, vy: float, t: Column, t_ref: float,
             cx: Column, cy: Column, field: Column, field_ref: float = 0.0) -> Column:
    """Pixels covered by a moon that drifts in detector axes and turns with the field."""
    dt = t - t_ref
    sx, sy = detector_to_sky(moon_x + vx * dt, moon_y + vy * dt, cx, cy)
    rx, ry = rotate(*rotate(sx, sy, F.lit(-field_ref)), field)
    mx, my = sky_to_detector(rx, ry, cx, cy)
    return F.hypot(x - mx, y - my) <= radius


def limb_gain(mu_to: Column, mu_from: Column, power: float) -> Column:
    """Brightness ratio of mu^power limb darkening, clamped near the limb."""
    low = F.lit(C.LIMB_MU_FLOOR)
    return F.pow(F.greatest(mu_to, low) / F.greatest(mu_from, low), F.lit(float(power)))


def field_map(x: Column, y: Column, src: dict[str, Column], ref: dict[str, Column]) -> tuple[Column, Column]:
    """Source detector position in the reference detector under field rotation alone."""
    sx, sy = detector_to_sky(x, y, src["cx"], src["cy"])
    rx, ry = rotate(sx, sy, ref["angle"] - src["angle"])
    return sky_to_detector(rx, ry, ref["cx"], ref["cy"])


def with_globe_map(df: DataFrame, globe: Globe, x: str, y: str, src: dict[str, Column], ref: dict[str, Column],
                   ld_power: float = 0.0) -> DataFrame:
    """Add ref_x, ref_y, valid and gain: globe samples follow the spin, everything else the field.

    ``src`` and ``ref`` give cx, cy, angle and t.
    """
    sx, sy = detector_to_sky(F.col(x), F.col(y), src["cx"], src["cy"])
    sx, sy = rotate(sx, sy, -src["angle"])
    df = with_globe_hit(df.withColumns({"_sx": sx, "_sy": sy, "_t": src["t"]}), globe, "_sx", "_sy", "_t")
    gx, gy, mu_ref = body_to_sky(globe, F.col("lon"), F.col("lat"), ref["t"])
    df = df.withColumns({"_gx": gx, "_gy": gy, "_mu_ref": mu_ref})
    seen = F.coalesce(F.col("_mu_ref") >= -1e-12, F.lit(False))
    use = F.col("on_globe") & seen
    ox, oy = F.when(use, F.col("_gx")).otherwise(F.col("_sx")), F.when(use, F.col("_gy")).otherwise(F.col("_sy"))
    rx, ry = rotate(ox, oy, ref["angle"])
    dx, dy = sky_to_detector(rx, ry, ref["cx"], ref["cy"])
    gain = F.when(use, limb_gain(F.greatest("_mu_ref", F.lit(0.0)), F.col("mu"), ld_power)).otherwise(F.lit(1.0))
    return df.withColumns({
        "ref_x": dx, "ref_y": dy, "valid": finite(dx) & finite(dy) & (~F.col("on_globe") | seen),
        "gain": gain if ld_power else F.lit(1.0)}).drop("_sx", "_sy", "_t", "_gx", "_gy", "_mu_ref")


def ring_turn_chord(globe: Globe, t_src: Column, t_ref: Column) -> Column:
    """In-plane distance a ring point moves between two times, per unit radius."""
    return 2 * F.abs(F.sin((globe.longitude(t_src) - globe.longitude(t_ref)) / 2))


def limb_taper(mu: Column, width: float) -> Column:
    u = clip(mu / width, 0.0, 1.0)
    return smoothstep(u * u)


def exposure_motion(radius: float, field_rate: Column, surface_rate: Column, exposure_s: Column) -> Column:
    """Limb motion during one exposure in pixels."""
    return (F.abs(field_rate) + F.abs(surface_rate)) * radius * exposure_s


def planetocentric(latitude: Column, flattening: float) -> Column:
    """Planetocentric latitude of a planetodetic one."""
    return F.atan2(F.sin(latitude) * (1 - flattening) ** 2, F.cos(latitude))
