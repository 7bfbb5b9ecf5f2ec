"""Fixed values of the domain.

Everything in this module is a published or contractual number that results
depend on; nothing here is computed.
"""

# --- fixed values: screening -------------------------------------------------
SIGMA_LIMIT = 2.0
ROUNDOFF_ULPS = 32
DOUBLE_EPS = 2.220446049250313e-16
MIN_WEIGHT = 1e-12
STATUSES = ("ok", "invalid", "saturated", "no_target", "clipped_target", "unmeasured")
METRICS = ("quality", "width_px", "height_px")
REASONS = ("low_quality", "width_outlier", "height_outlier")
SATURATED_FRACTION = 0.05

# --- fixed values: selection and rank bins ------------------------------------
RANK_P_GRID = (5, 10, 25, 50, 100)
DECISION_P = 10
RANK_BORDER_PX = 2
MAX_RANK_BINS = 16
MIN_BIN_FRAMES = 20
HALF_BLOCK = 32
REFERENCE_FRAMES = 3000
NOISE_SAMPLES = 8
TEMPLATE_CANDIDATES = 64

# --- fixed values: colour ------------------------------------------------------
LUMINANCE = (0.25, 0.5, 0.25)
# A pattern names the colours of its 2x2 site lattice, row by row.
BAYER_PATTERNS = ("RGGB", "GRBG", "GBRG", "BGGR")

# --- fixed values: frequency rings ---------------------------------------------
RING_STEP = 0.01
RING_LIMIT = 0.5
RING_SMOOTH = 1.5
RANK_TREND_DEGREE = 2
TAPER_LEVEL = 0.1
TAPER_PX = 8

# --- fixed values: registration -------------------------------------------------
CORRELATION_SIGMA = 1.5
BACKGROUND_SIGMA = 8.0
POINT_SEARCH = 6
POINT_MIN_NCC = 0.5
POINT_PRIOR = 0.01
POINT_MIN_BRIGHTNESS = 0.1
POINT_QUALITY_SIGMA = 1.5

# --- fixed values: geometry -------------------------------------------------------
EDGE_ON_MU = 0.04
MIN_RAY_U = 1e-4
LIMB_MU_FLOOR = 0.2
LIMB_FIT_MU_MIN = 0.5
LIMB_BAND_DEG = 2.0
LIMB_MIN_PIXELS = 500
LIMB_MIN_BAND_PIXELS = 20
LIMB_MAX_POWER = 3.0
MIN_SILHOUETTES = 12
SNAP = 1e-10

# Signed sidereal rotation periods in days (public planetary physical parameters).
SIDEREAL_DAYS = {
    "mercury": 58.6462,
    "venus": -243.018,
    "mars": 1.02595676,
    "jupiter": 0.41354,
    "saturn": 0.44401,
    "uranus": -0.71833,
    "neptune": 0.67125,
}
PLANET_ALIASES = {"jup": "jupiter", "sat": "saturn"}

# --- fixed values: time -------------------------------------------------------------
TICKS_PER_SECOND = 10_000_000
TICKS_AT_UNIX_EPOCH = 621_355_968_000_000_000
TICKS_PER_DAY = 864_000_000_000
JD_AT_TICK_ZERO = 1721425.5
TICKS_AT_1900 = 599_266_080_000_000_000
TICKS_AT_2101 = 662_695_776_000_000_000

# --- fixed values: evaluation thresholds ---------------------------------------------
STRONG_MEDIAN = 0.10
NEGATIVE_MEDIAN = 0.05
STRONG_POSITIVE_FRACTION = 2.0 / 3.0
NEGATIVE_GE10_FRACTION = 0.25
CONTRAST_PATHOLOGY = 0.05
CLOSURE_TARGET = 0.40
PRIOR_LIMITED_RATIO = 0.5
CANDIDATE_SLACK = 1.02
DENOMINATOR_FLOOR = 1e-15
READ_NOISE_E = 2.0
STRUCTURE_TOLERANCE = 0.25
HIGH_BAND = (0.5, 1.0)
MID_BAND = (0.2, 0.5)
HIGH_BAND_MTF_MIN = 0.05
MANDATORY_REGIMES = (8.0, 4.0)
EVALUATION_SEEDS = (2001, 2012)
DEVELOPMENT_SEEDS = (1001, 1003)

# --- fixed values: capture container (178-byte header, 100-ns trailer) -----------------
SER_MAGIC = b"LUCAM-RECORDER"
SER_HEADER_BYTES = 178
SER_COLOURS = {
    0: "mono",
    8: "RGGB",
    9: "GRBG",
    10: "GBRG",
    11: "BGGR",
    16: "CYYM",
    17: "YCMY",
    18: "YMCY",
    19: "MYYC",
    100: "RGB",
    101: "BGR",
}
