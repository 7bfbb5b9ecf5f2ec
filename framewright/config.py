"""Settings of a reconstruction: immutable, checked when made, hashable for provenance."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from framewright.constants import BAYER_PATTERNS

MODES = ("frame_count", "quality_range")
GEOMETRIES = ("none", "field", "surface", "combined", "saturn")


@dataclass(frozen=True)
class Settings:
    stack_percent: int = 100
    selection_mode: str = "quality_range"
    minimum_quality: float | None = None
    quality_weighting: bool = True
    reject_saturated: bool = True
    max_shift_px: float = 32.0
    pattern: str | None = None
    local_alignment: bool = False
    point_size: int = 64
    fourier_power: float = 0.0
    brightness_percent: float | None = None
    geometry: str = "none"
    reference_passes: int = 1
    # Facts of the scene, for a geometry other than none; centre and times as in operators.motion.
    radius_px: float | None = None
    flattening: float = 0.0
    pole_rad: float = 0.0
    latitude_rad: float = 0.0
    surface_rate_rad_s: float = 0.0
    ring_inner_px: float | None = None
    ring_outer_px: float | None = None
    center_x: float | None = None
    center_y: float | None = None
    field_angle_rad: float = 0.0
    field_rate_rad_s: float = 0.0
    reference_epoch_s: float = 0.0
    exposure_s: float = 0.0
    cadence_s: float | None = None
    limb_power: float = 0.0
    # NPY tables: {"bias": path, "dark": path, "flat": path, "gain": electrons for a code}.
    calibration: dict | None = None

    def __post_init__(self) -> None:
        if type(self.stack_percent) is not int or not 1 <= self.stack_percent <= 100:
            raise ValueError("stack_percent must be an integer from 1 to 100")
        if self.selection_mode not in MODES:
            raise ValueError(f"selection_mode must be one of {MODES}")
        if self.geometry not in GEOMETRIES:
            raise ValueError(f"geometry must be one of {GEOMETRIES}")
        if self.pattern is not None and self.pattern not in ("mono", "RGB", *BAYER_PATTERNS):
            raise ValueError("unknown site pattern")
        if type(self.point_size) is not int or not 16 <= self.point_size <= 256:
            raise ValueError("point_size must be an integer from 16 to 256 pixels")
        if not self.max_shift_px > 0:
            raise ValueError("max_shift_px must be positive")
        if self.geometry in ("surface", "combined", "saturn") and self.radius_px is None:
            raise ValueError(f"geometry {self.geometry} needs radius_px")
        if self.geometry == "saturn" and (self.ring_inner_px is None or self.ring_outer_px is None):
            raise ValueError("geometry saturn needs ring_inner_px and ring_outer_px")
        if self.cadence_s is not None and not self.cadence_s > 0:
            raise ValueError("cadence_s must be positive")
        if self.calibration is not None and set(self.calibration) - {"bias", "dark", "flat", "gain"}:
            raise ValueError("calibration takes bias, dark, flat and gain")
        if not 0 <= self.fourier_power <= 16:
            raise ValueError("fourier_power must be from 0 to 16")
        if self.brightness_percent is not None and not 0 < self.brightness_percent <= 100:
            raise ValueError("brightness_percent must be above 0 and at most 100")

    @classmethod
    def from_dict(cls, record: dict) -> Settings:
        unknown = set(record) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**record)

    def to_dict(self) -> dict:
        return asdict(self)
