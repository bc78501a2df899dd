"""Colour science as Column expressions: metrics, exposure, transfer functions, matrices, tone mapping.

Every function takes and returns Columns of double, triggers no job and stays inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

#: Least positive normal float, below which bases of powers and arguments of logarithms are held.
FLT_MIN = 1.17549435e-38

# Fixed values of the transfer functions (ITU-T H.273, SMPTE ST 2084, ARIB STD-B67).
BT709_BETA = 0.018053968510807
BT709_ALPHA = 1.0 + 5.5 * BT709_BETA
PQ_C1, PQ_C2, PQ_C3, PQ_M1, PQ_M2 = 107 / 128, 2413 / 128, 2392 / 128, 1305 / 8192, 2523 / 32
HLG_A, HLG_B, HLG_C, HLG_PEAK, HLG_GAMMA = 0.17883277, 0.28466892, 0.55991073, 1000.0, 1.2
HLG_LUMA = (0.2627, 0.6780, 0.0593)
REFERENCE_WHITE = 203.0


def lit(v: float) -> Column:
    return F.lit(float(v))


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, lit(low)), lit(high))


def power(v: Column, exponent: float) -> Column:
    """A power whose base is held at FLT_MIN from below, so that negative bases give about 0; 0 gives 0."""
    return F.when(v == 0, lit(0)).otherwise(F.pow(F.greatest(v, lit(FLT_MIN)), lit(exponent)))


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


# Metrics of an image against a reference.


def metric(name: str, image: Column, reference: Column) -> Column:
    """e, ae, se, rae or rse. rae divides by the signed reference + 0.01; a divisor of exactly 0 gives null."""
    d = image - reference
    by_name: dict[str, Callable[[], Column]] = {
        "e": lambda: d,
        "ae": lambda: F.abs(d),
        "se": lambda: d * d,
        "rae": lambda: F.try_divide(F.abs(d), reference + lit(0.01)),
        "rse": lambda: d * d / (reference * reference + lit(0.01)),
    }
    return by_name[name.lower()]()


# Exposure, gamma and tone mapping.


def expose(v: Column, exposure: float, offset: float) -> Column:
    return v * lit(2.0**exposure) + lit(offset)


def signed_power(v: Column, exponent: float) -> Column:
    return F.when(v < 0, -power(-v, exponent)).otherwise(power(v, exponent))


def mean_rgb(rgb: RGB) -> Column:
    return (rgb[0] + rgb[1] + rgb[2]) / lit(3)


def false_color_index(rgb: RGB) -> Column:
    """Place in a 256-entry colour table: log2 of the mean from 2**-5 to 2**5."""
    t = F.ln(F.greatest(mean_rgb(rgb) + lit(1 / 32), lit(FLT_MIN))) / lit(math.log(2.0)) / lit(10) + lit(0.5)
    return clip(F.floor(t * lit(256)).cast("double"), 0, 255).cast("int")


def tonemap(name: str, rgb: RGB, gamma: float = 2.2, table: list[tuple[float, float, float]] | None = None) -> RGB:
    """none and gamma are the same; falsecolor needs a colour table of 256 entries; posneg shows the sign of the mean."""
    match name.lower():
        case "none" | "gamma":
            return tuple(signed_power(c, 1 / gamma) for c in rgb)
        case "falsecolor":
            if not table:
                raise ValueError("falsecolor needs a colour table")
            at = false_color_index(rgb) + 1
            return tuple(F.element_at(F.array(*[lit(entry[k]) for entry in table]), at) for k in range(3))
        case "posneg":
            low, high = tuple(F.least(c, lit(0)) for c in rgb), tuple(F.greatest(c, lit(0)) for c in rgb)
            return lit(-2) * mean_rgb(low), lit(2) * mean_rgb(high), lit(0)
    raise ValueError(f"unknown tone mapping {name}")


def over_background(v: Column, alpha: Column, background: float) -> Column:
    """A premultiplied value over a background."""
    return v + (lit(1) - alpha) * lit(background)


def unpremultiply(v: Column, alpha: Column) -> Column:
    return F.when(alpha != 0, v / alpha).otherwise(lit(0))


def to_byte(v: Column) -> Column:
    return F.floor(clip(v * lit(255) + lit(0.5), 0, 255)).cast("int")


def ldr_byte(v: Column, exposure: float = 0.0, offset: float = 0.0, gamma: float = 2.2) -> Column:
    """Exposure, gamma tone mapping, back to linear by the exponent 2.2, sRGB, and 8 bits."""
    shown = signed_power(signed_power(expose(v, exposure, offset), 1 / gamma), 2.2)
    return to_byte(linear_to_srgb(shown))


def mask_channel(v: Column, mask: int, bit: int, alpha: bool = False) -> Column:
    """Channels out of the mask are 0, alpha is 1; bits 1, 2, 4, 8 are R, G, B, A."""
    return v if mask & bit else lit(1 if alpha else 0)


def roll_off(v: Column, shoulder: float, peak: float) -> Column:
    """Up to the shoulder unchanged, beyond an exponential approach of the peak in stops."""
    span = math.log2(peak / shoulder)
    stops = F.ln(F.greatest(v, lit(FLT_MIN)) / lit(shoulder)) / lit(math.log(2.0))
    return F.when(v <= shoulder, v).otherwise(lit(shoulder) * F.pow(lit(2), lit(span) * (lit(1) - F.exp(-stops / lit(span)))))


# Transfer functions, by component.


def bt709_to_linear(v: Column) -> Column:
    return F.when(v <= 4.5 * BT709_BETA, v / lit(4.5)).otherwise(power((v + lit(BT709_ALPHA - 1)) / lit(BT709_ALPHA), 1 / 0.45))


def linear_to_bt709(v: Column) -> Column:
    return F.when(v <= BT709_BETA, v * lit(4.5)).otherwise(lit(BT709_ALPHA) * power(v, 0.45) - lit(BT709_ALPHA - 1))


def _odd(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A missing value stays missing."""
    return lambda v: F.when(v < 0, -f(-v)).when(v.isNotNull(), f(v))


def srgb_to_linear(v: Column) -> Column:
    return _odd(lambda a: F.when(a <= 0.04045, a / lit(12.92)).otherwise(power((a + lit(0.055)) / lit(1.055), 2.4)))(v)


def linear_to_srgb(v: Column) -> Column:
    return _odd(lambda a: F.when(a <= 0.0031308, a * lit(12.92)).otherwise(lit(1.055) * power(a, 1 / 2.4) - lit(0.055)))(v)


def bt1361_to_linear(v: Column) -> Column:
    low = lit(-0.25) * power((v * lit(-4) + lit(BT709_ALPHA - 1)) / lit(BT709_ALPHA), 1 / 0.45)
    return F.when(v < -4.5 * BT709_BETA / 4, low).otherwise(bt709_to_linear(v))


def linear_to_bt1361(v: Column) -> Column:
    low = lit(-0.25) * (lit(BT709_ALPHA) * power(v * lit(-4), 0.45) - lit(BT709_ALPHA - 1))
    return F.when(v < -BT709_BETA / 4, low).otherwise(linear_to_bt709(v))


def gamma_to_linear(v: Column, gamma: float) -> Column:
    return power(F.greatest(v, lit(0)), gamma)


def linear_to_gamma(v: Column, gamma: float) -> Column:
    return power(F.greatest(v, lit(0)), 1 / gamma)


def log_to_linear(v: Column, decades: float) -> Column:
    return F.when(v > 0, F.exp((v - lit(1)) * lit(decades * math.log(10.0)))).otherwise(lit(0))


def linear_to_log(v: Column, decades: float) -> Column:
    return F.when(v >= 10**-decades, lit(1) + F.log10(F.greatest(v, lit(FLT_MIN))) / lit(decades)).otherwise(lit(0))


def smpte240_to_linear(v: Column) -> Column:
    return F.when(v <= 0.0913, v / lit(4)).otherwise(power((v + lit(0.1115)) / lit(1.1115), 1 / 0.45))


def linear_to_smpte240(v: Column) -> Column:
    return F.when(v <= 0.022825, v * lit(4)).otherwise(lit(1.1115) * power(v, 0.45) - lit(0.1115))


def pq_to_linear(v: Column) -> Column:
    """1.0 is 203 nits; codes are held between 0 and 1."""
    p = power(clip(v, 0, 1), 1 / PQ_M2)
    return lit(10000 / REFERENCE_WHITE) * power(F.greatest(p - lit(PQ_C1), lit(0)) / F.greatest(lit(PQ_C2) - lit(PQ_C3) * p, lit(1e-5)), 1 / PQ_M1)


def linear_to_pq(v: Column) -> Column:
    p = power(F.greatest(v * lit(REFERENCE_WHITE / 10000), lit(0)), PQ_M1)
    return power((lit(PQ_C1) + lit(PQ_C2) * p) / (lit(1) + lit(PQ_C3) * p), PQ_M2)


def smpte428_to_linear(v: Column) -> Column:
    return power(v, 2.6) * lit(52.37 / 48)


def linear_to_smpte428(v: Column) -> Column:
    return power(v * lit(48 / 52.37), 1 / 2.6)


def _hlg_scene(v: Column) -> Column:
    return F.when(v <= 0.5, v * v / lit(3)).otherwise((F.exp((v - lit(HLG_C)) / lit(HLG_A)) + lit(HLG_B)) / lit(12))


def _hlg_signal(v: Column) -> Column:
    return F.when(v <= 1 / 12, F.sqrt(F.greatest(v * lit(3), lit(0)))).otherwise(lit(HLG_A) * F.ln(F.greatest(lit(12) * v - lit(HLG_B), lit(FLT_MIN))) + lit(HLG_C))


def hlg_to_linear_rgb(rgb: RGB) -> RGB:
    scene = tuple(_hlg_scene(c) for c in rgb)
    luma = sum((lit(w) * c for w, c in zip(HLG_LUMA, scene, strict=True)), lit(0))
    return tuple(power(luma, HLG_GAMMA - 1) * lit(HLG_PEAK / REFERENCE_WHITE) * c for c in scene)


def linear_to_hlg_rgb(rgb: RGB) -> RGB:
    shown = tuple(c * lit(REFERENCE_WHITE / HLG_PEAK) for c in rgb)
    luma = sum((lit(w) * c for w, c in zip(HLG_LUMA, shown, strict=True)), lit(0))
    scale = power(luma, (1 - HLG_GAMMA) / HLG_GAMMA)
    return tuple(_hlg_signal(scale * c) for c in shown)


def hlg_to_linear(v: Column) -> Column:
    e = _hlg_scene(v)
    return power(e, HLG_GAMMA - 1) * e * lit(HLG_PEAK / REFERENCE_WHITE)


def linear_to_hlg(v: Column) -> Column:
    t = v * lit(REFERENCE_WHITE / HLG_PEAK)
    return _hlg_signal(power(t, (1 - HLG_GAMMA) / HLG_GAMMA) * t)


def _same(v: Column) -> Column:
    return v


#: Name to (to linear, from linear), by component. ycbcr and hlg also have whole-pixel forms.
TRANSFERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "linear": (_same, _same),
    "bt709": (bt709_to_linear, linear_to_bt709),
    "bt601": (bt709_to_linear, linear_to_bt709),
    "bt2020_10bit": (bt709_to_linear, linear_to_bt709),
    "bt2020_12bit": (bt709_to_linear, linear_to_bt709),
    "iec61966_2_4": (_odd(bt709_to_linear), _odd(linear_to_bt709)),
    "bt1361": (bt1361_to_linear, linear_to_bt1361),
    "gamma22": (lambda v: gamma_to_linear(v, 2.2), lambda v: linear_to_gamma(v, 2.2)),
    "gamma28": (lambda v: gamma_to_linear(v, 2.8), lambda v: linear_to_gamma(v, 2.8)),
    "log100": (lambda v: log_to_linear(v, 2.0), lambda v: linear_to_log(v, 2.0)),
    "log100_sqrt10": (lambda v: log_to_linear(v, 2.5), lambda v: linear_to_log(v, 2.5)),
    "smpte240": (smpte240_to_linear, linear_to_smpte240),
    "srgb": (srgb_to_linear, linear_to_srgb),
    "pq": (pq_to_linear, linear_to_pq),
    "smpte428": (smpte428_to_linear, linear_to_smpte428),
    "hlg": (hlg_to_linear, linear_to_hlg),
}


def to_linear(transfer: str, v: Column, gamma: float | None = None) -> Column:
    """Unknown transfers, tables and unspecified ones pass through."""
    if transfer == "gamma":
        return gamma_to_linear(v, gamma or 1.0)
    return TRANSFERS.get(transfer, (_same, _same))[0](v)


def from_linear(transfer: str, v: Column, gamma: float | None = None) -> Column:
    if transfer == "gamma":
        return linear_to_gamma(v, gamma or 1.0)
    return TRANSFERS.get(transfer, (_same, _same))[1](v)


def rgb_to_linear(transfer: str, rgb: RGB) -> RGB:
    """Transfers that couple the channels of a pixel, others by component."""
    if transfer == "hlg":
        return hlg_to_linear_rgb(rgb)
    if transfer in ("ycbcr", "ycbcr_srgb"):
        plain = ycbcr_to_rgb(rgb)
        return plain if transfer == "ycbcr" else tuple(srgb_to_linear(c) for c in plain)
    return tuple(to_linear(transfer, c) for c in rgb)


def reference_white(transfer: str) -> float:
    """Nits of diffuse white by convention."""
    if transfer in ("pq", "hlg"):
        return 203.0
    return 100.0 if transfer in ("bt709", "bt601", "bt1361", "iec61966_2_4", "bt2020_10bit", "bt2020_12bit") else 80.0


# YCbCr, RCT, CMYK, Lab.

YCBCR = (1.402, -0.344136, -0.714136, 1.772)
RGB_TO_YCBCR = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))


def ycbcr_to_rgb(v: RGB, offset: float = 0.5) -> RGB:
    y, cb, cr = v[0], v[1] - lit(offset), v[2] - lit(offset)
    return y + lit(YCBCR[0]) * cr, y + lit(YCBCR[1]) * cb + lit(YCBCR[2]) * cr, y + lit(YCBCR[3]) * cb


def rgb_to_ycbcr(v: RGB, offset: float = 0.5) -> RGB:
    y, cb, cr = apply_matrix(RGB_TO_YCBCR, v)
    return y, cb + lit(offset), cr + lit(offset)


def rct_to_rgb(v: RGB) -> RGB:
    """The reversible component transform of integer samples."""
    g = v[0] - F.floor((v[1] + v[2]) / lit(4))
    return v[2] + g, g.cast("double"), v[1] + g


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> RGB:
    return tuple((lit(1) - v) * (lit(1) - k) for v in (c, m, y))


def lab_to_xyz(lab: RGB) -> RGB:
    """Relative to D50."""
    fy = (lab[0] + lit(16)) / lit(116)
    parts = (fy + lab[1] / lit(500), fy, fy - lab[2] / lit(200))
    cube = lambda f: F.when(f > 6 / 29, f * f * f).otherwise(lit(3 * (6 / 29) ** 2) * (f - lit(4 / 29)))
    return tuple(cube(f) * lit(w) for f, w in zip(parts, (0.9642, 1.0, 0.8249), strict=True))


def full_range(v: Column, bits: int, chroma: bool = False) -> Column:
    """A limited-range sample (0 to 1) of 8 to 16 bits at full range."""
    if not 8 <= bits <= 16:
        return v
    scale, top = 2 ** (bits - 8), 2**bits - 1
    return (v * lit(top) - lit(16 * scale)) / lit((240 if chroma else 235) * scale - 16 * scale)


def dicom_window(v: Column, center: float, width: float) -> Column:
    """Not clamped; no window below a width of 1, null at exactly 1."""
    if width < 1:
        return v
    return F.try_divide(v - lit(center - 0.5), lit(width - 1)) + lit(0.5)


# Matrices. They are composed on the driver and enter plans as nine literals.

Matrix = tuple[tuple[float, float, float], ...]

ILLUMINANTS = {
    "A": (0.44757, 0.40745), "B": (0.34842, 0.35161), "C": (0.31006, 0.31616), "D50": (0.34567, 0.35850), "D55": (0.33242, 0.34743),
    "D65": (0.31270, 0.32900), "D75": (0.29902, 0.31485), "E": (1 / 3, 1 / 3), "DCI": (0.314, 0.351), "F2": (0.37208, 0.37529),
}
#: Chromaticities of red, green, blue and white.
PRIMARIES = {
    "rec709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), ILLUMINANTS["D65"]),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), ILLUMINANTS["D65"]),
    "display_p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), ILLUMINANTS["D65"]),
    "dci_p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), ILLUMINANTS["DCI"]),
    "adobe_rgb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), ILLUMINANTS["D65"]),
    "prophoto": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), ILLUMINANTS["D50"]),
    "bt470m": ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), ILLUMINANTS["C"]),
    "bt470bg": ((0.64, 0.33), (0.29, 0.60), (0.15, 0.06), ILLUMINANTS["D65"]),
    "smpte170m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), ILLUMINANTS["D65"]),
    "film": ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), ILLUMINANTS["C"]),
    "ebu3213": ((0.630, 0.340), (0.295, 0.605), (0.155, 0.077), ILLUMINANTS["D65"]),
    "xyz": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), ILLUMINANTS["E"]),
}
#: H.273 colour primaries by code point; 6 and 7 are the same.
H273_PRIMARIES = {1: "rec709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte170m", 8: "film", 9: "bt2020", 10: "xyz", 11: "dci_p3", 12: "display_p3", 22: "ebu3213"}
#: EXIF light sources by code that are standard illuminants.
EXIF_LIGHTS = {17: "A", 18: "B", 19: "C", 20: "D55", 21: "D65", 22: "D75", 23: "D50"}
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


def _white_xyz(xy: tuple[float, float]) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def rgb_to_xyz_matrix(chroma) -> np.ndarray:
    """Columns are the primaries, scaled to sum to the white point; the identity for degenerate ones."""
    (xr, yr), (xg, yg), (xb, yb), white = chroma
    columns = np.array([[xr, xg, xb], [yr, yg, yb], [1 - xr - yr, 1 - xg - yg, 1 - xb - yb]])
    if abs(np.linalg.det(columns)) < 1e-12 or white[1] == 0:
        return np.eye(3)
    return columns * np.linalg.solve(columns, _white_xyz(white))


def adapt_white_matrix(source: tuple[float, float], target: tuple[float, float]) -> np.ndarray:
    cone = np.array(BRADFORD)
    return np.linalg.inv(cone) @ np.diag((cone @ _white_xyz(target)) / (cone @ _white_xyz(source))) @ cone


def conversion_matrix(source: str, target: str, intent: str = "relative") -> Matrix:
    """RGB of one set of primaries to another; whites are adapted unless the intent is absolute."""
    if source == target:
        return tuple(map(tuple, np.eye(3)))
    a, b = PRIMARIES[source], PRIMARIES[target]
    adapt = np.eye(3) if intent == "absolute" else adapt_white_matrix(a[3], b[3])
    return tuple(tuple(float(x) for x in row) for row in np.linalg.inv(rgb_to_xyz_matrix(b)) @ adapt @ rgb_to_xyz_matrix(a))


def is_identity(matrix: Matrix) -> bool:
    return float(np.linalg.norm(np.array(matrix) - np.eye(3))) < 1e-6


def apply_matrix(matrix: Matrix, rgb: RGB) -> RGB:
    """Nothing is computed for the identity."""
    if is_identity(matrix):
        return rgb
    return tuple(lit(row[0]) * rgb[0] + lit(row[1]) * rgb[1] + lit(row[2]) * rgb[2] for row in matrix)


#: Thresholds of an 8 x 8 ordered dither: each bit pair of the place puts the quarter it lies in.
DITHER = [[sum(((x >> b & 1) * 2 ^ (y >> b & 1) * 3) << 2 * (2 - b) for b in range(3)) for x in range(8)] for y in range(8)]


def ordered_dither(v: Column, threshold: Column, bits: int) -> Column:
    """A level of the given depth; threshold is the place's entry of DITHER."""
    top = float(2**bits - 1)
    return clip(F.floor(v * lit(top) + (threshold + lit(0.5)) / lit(64)).cast("double"), 0, top).cast("int")
