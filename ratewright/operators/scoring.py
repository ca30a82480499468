"""Measurement vectors: validation with the first violation named, axis scores, composites, confidence and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.numeric import band_penalty, clamp, percent, piecewise, round_half_up

# Fixed values of the scoring model.
AXES = ["sharpness", "lighting", "resolution", "framing", "background", "attire", "expression", "solo"]
COMPUTED = AXES[:4]
JUDGED = AXES[4:]
WEIGHTS = {
    "startup": [0.16, 0.08, 0.08, 0.18, 0.16, 0.04, 0.20, 0.10],
    "corporate": [0.16, 0.07, 0.09, 0.18, 0.16, 0.16, 0.10, 0.08],
    "creative": [0.20, 0.10, 0.10, 0.19, 0.13, 0.02, 0.16, 0.10],
}
DEFAULT_CONTEXT = "corporate"
KNOTS = {
    "sharpness": [(0, 1), (40, 2), (120, 3), (300, 4), (700, 5)],
    "lighting": [(0, 1), (0.35, 2), (0.6, 3), (0.8, 4), (0.95, 5)],
    "resolution": [(200, 1), (400, 3), (800, 5)],
    "framing": [(0.4801, 1), (0.6697, 2), (0.934, 3), (0.967, 4), (1, 5)],
}
RATIO_BAND, OFFSET_TOLERANCE, RATIO_SCALE, OFFSET_SCALE = (0.1298, 0.2396), 0.15, 5.0, 2.0
EXPOSURE_BAND, EXPOSURE_SCALE, CLIP_FULL = (95.0, 165.0), 0.012, 0.08
JPEG_FLOOR, VERSION, LEAST_EDGE = 50.0, "v8", 200
SEVERE, NOTABLE, MOST_FIXES = 0.9, 0.35, 3
SAFE = float(2**53 - 1)

#: (field, lowest, highest, whole number, may be null), in the order in which violations are reported.
RULES = [
    ("sharpnessLaplacian", 0.0, SAFE, False, False),
    ("sharpnessEyeRegion", 0.0, SAFE, False, True),
    ("jpegQualityEstimate", 0.0, 100.0, False, False),
    ("exposureMean", 0.0, 255.0, False, False),
    ("clippedHighlights", 0.0, 1.0, False, False),
    ("clippedShadows", 0.0, 1.0, False, False),
    ("dynamicRange", 0.0, 255.0, False, False),
    ("faceExposureMean", 0.0, 255.0, False, False),
    ("faceClippedHighlights", 0.0, 1.0, False, False),
    ("faceClippedShadows", 0.0, 1.0, False, False),
    ("exposureDelta", -255.0, 255.0, False, False),
    ("width", 1.0, SAFE, True, False),
    ("height", 1.0, SAFE, True, False),
    ("faceAreaRatio", 0.0, 1.0, False, True),
    ("faceCenterOffsetX", -1.0, 1.0, False, True),
    ("faceCenterOffsetY", -1.0, 1.0, False, True),
    ("faceCount", 0.0, SAFE, True, False),
    ("yaw", -180.0, 180.0, False, False),
    ("roll", -180.0, 180.0, False, False),
    ("pitch", -180.0, 180.0, False, True),
    ("eyeOpenness", 0.0, 1.0, False, True),
    ("smileIntensity", 0.0, 1.0, False, True),
    ("primaryFaceConfidence", 0.0, 1.0, False, True),
    ("secondLargestFaceRatio", 0.0, 1.0, False, True),
]
BOOLEANS = ["eyeRegionMeasured", "faceRegionMeasured", "isGrayscale", "aspectExtreme"]
STRINGS = ["sourceFormat", "extractorVersion"]
VECTOR_DDL = ", ".join([f"{r[0]} double" for r in RULES] + [f"{b} boolean" for b in BOOLEANS] + [f"{s} string" for s in STRINGS])


def _fault(field: str, text: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(text).alias("reason"))


def first_violation() -> Column:
    """The first rule a vector breaks as ``struct<field, reason>``, null for a usable vector. NaN is tested before range."""
    checks = []
    for name, low, high, whole, nullable in RULES:
        c = F.col(name)
        if not nullable:
            checks.append(F.when(c.isNull(), _fault(name, "expected a number")))
        checks.append(F.when(F.isnan(c), _fault(name, "is NaN")))
        checks.append(F.when(F.abs(c) == float("inf"), _fault(name, "is not finite")))
        if whole:
            checks.append(F.when(c != F.floor(c), _fault(name, "must be an integer")))
        checks.append(F.when((c < low) | (c > high), _fault(name, f"must be within [{low:.16g}, {high:.16g}]")))
    checks += [F.when(F.col(b).isNull(), _fault(b, "expected a boolean")) for b in BOOLEANS]
    checks += [F.when(F.coalesce(F.col(s), F.lit("")) == "", _fault(s, "expected a non-empty string")) for s in STRINGS]
    checks.append(F.when((F.col("faceCount") == 0) & F.col("primaryFaceConfidence").isNotNull(), _fault("primaryFaceConfidence", "is set although faceCount is 0")))
    checks.append(F.when(F.col("eyeRegionMeasured") != F.col("sharpnessEyeRegion").isNotNull(), _fault("eyeRegionMeasured", "disagrees with sharpnessEyeRegion")))
    return F.coalesce(*checks)


def face_offset() -> Column:
    """Distance of the face from the centre; null if it wasn't measured."""
    return F.sqrt(F.col("faceCenterOffsetX") * F.col("faceCenterOffsetX") + F.col("faceCenterOffsetY") * F.col("faceCenterOffsetY"))


def framing_raw() -> Column:
    """1 is ideal, towards 0 worse; null, not 0, without a measured face."""
    ratio = band_penalty(F.col("faceAreaRatio"), *RATIO_BAND, RATIO_SCALE)
    return F.when(F.col("faceCount") != 0, F.lit(1.0) / (F.lit(1.0) + ratio + band_penalty(face_offset(), 0.0, OFFSET_TOLERANCE, OFFSET_SCALE)))


def lighting_raw() -> Column:
    clipped = (F.col("faceClippedHighlights") + F.col("faceClippedShadows")) / CLIP_FULL
    return F.lit(1.0) / (F.lit(1.0) + band_penalty(F.col("faceExposureMean"), *EXPOSURE_BAND, EXPOSURE_SCALE) + clipped)


def shorter_edge() -> Column:
    return F.least("width", "height")


def sharpness_basis() -> Column:
    return F.when(F.col("eyeRegionMeasured") & F.col("sharpnessEyeRegion").isNotNull(), "eyeRegion").otherwise("frame")


def with_scalars(vectors: DataFrame) -> DataFrame:
    """Adds each measured axis's driving scalar as ``__<axis>``.

    Steps that a later one reads more than once are columns of their own: written inline, the expressions would multiply
    and outgrow code generation. The optimizer keeps such projections apart.
    """
    basis = F.when(sharpness_basis() == "eyeRegion", F.col("sharpnessEyeRegion")).otherwise(F.col("sharpnessLaplacian"))
    return vectors.withColumns({"__sharpness": basis, "__lighting": lighting_raw(), "__resolution": shorter_edge(), "__framing": framing_raw()})


def with_raw_axes(vectors: DataFrame) -> DataFrame:
    """Adds the four measured axes, unrounded, under their names."""
    v = with_scalars(vectors).withColumns({f"__m_{a}": piecewise(F.col(f"__{a}"), KNOTS[a]) for a in COMPUTED})
    sharp = F.col("__m_sharpness") - F.when(F.col("jpegQualityEstimate") < JPEG_FLOOR, 1.0).otherwise(0.0)
    out = v.withColumns({"__m_sharpness": sharp}).withColumns({a: clamp(F.col(f"__m_{a}"), 1.0, 5.0) for a in COMPUTED})
    return out.drop(*[f"__{a}" for a in COMPUTED], *[f"__m_{a}" for a in COMPUTED])


def axis_levels(vectors: DataFrame) -> DataFrame:
    """Adds the eight axes as whole levels from 1 to 5, null where absent. Judged axes missing from the input are null."""
    judged = {a: F.col(a).cast("double") if a in vectors.columns else F.lit(None).cast("double") for a in JUDGED}
    v = with_raw_axes(vectors).withColumns(judged)
    return v.withColumns({a: round_half_up(F.col(a)) for a in AXES}).withColumns({a: clamp(F.col(a), 1.0, 5.0) for a in AXES})


def composite(context: str) -> Column:
    """Weighted mean of the axes that exist, on 1 to 10 with one decimal; sums run in axis order. Null without any axis."""
    top = bottom = F.lit(0.0)
    for a, w in zip(AXES, WEIGHTS[context]):
        top = top + F.coalesce(F.col(a) * w, F.lit(0.0))
        bottom = bottom + F.when(F.col(a).isNotNull(), F.lit(w)).otherwise(0.0)
    return round_half_up(F.lit(1.0) + (F.try_divide(top, bottom) - 1.0) * 2.25, 1)


def confidence() -> Column:
    """Trust in the measurements, from 0 to 1, two decimals. What wasn't measured costs nothing."""
    c = F.lit(1.0) - F.when(F.col("faceCount") == 0, 0.45).when(F.col("faceCount") > 1, 0.25).otherwise(0.0)
    pose = F.greatest(F.abs("yaw"), F.abs("pitch"))
    c = c - F.when(pose > 35, 0.2).when(pose > 20, 0.1).otherwise(0.0)
    c = c - F.when(F.col("jpegQualityEstimate") < JPEG_FLOOR, 0.15).otherwise(0.0)
    c = c - F.when(face_offset() > 0.35, 0.1).otherwise(0.0)
    disagree = F.col("solo").isNotNull() & ((F.col("faceCount") <= 1) != (F.col("solo") >= 4))
    c = c - F.when(disagree, 0.2).otherwise(0.0)
    return round_half_up(clamp(c, 0.0, 1.0), 2)


def advice(axis: str) -> Column:
    """What to do about a weak axis, quoting the measurement."""
    fixed = {
        "background": "Move to a plain wall, or step further from what is behind you so it falls out of focus.",
        "attire": "Dress one level more formally than this for the audience you picked.",
        "expression": "Look straight into the lens and let your expression settle before the shutter fires.",
        "solo": "Crop to one subject - a second person in frame makes it unclear who the photo is of.",
    }
    if axis in fixed:
        return F.lit(fixed[axis])
    if axis == "framing":
        band = "13%-24%"
        ratio, off = F.col("faceAreaRatio"), face_offset()
        return (
            F.when((ratio.isNull() | off.isNull()) & (F.col("faceCount") == 0), "Reframe so your face is clearly visible - no face was detected in this photo.")
            .when(ratio.isNull() | off.isNull(), "Move closer or crop tighter - the faces in this photo are too small to measure framing from.")
            .when(ratio < RATIO_BAND[0], F.concat(F.lit("Recrop to head-and-shoulders - your face fills "), percent(ratio), F.lit(f" of the frame, aim for {band}.")))
            .when(ratio > RATIO_BAND[1], F.concat(F.lit("Step back or crop wider - your face fills "), percent(ratio), F.lit(f" of the frame, aim for {band}.")))
            .otherwise(F.concat(F.lit("Recentre the crop - your face sits "), percent(off), F.lit(" of the frame off centre, keep it under 15%.")))
        )
    if axis == "sharpness":
        return (
            F.when(F.col("jpegQualityEstimate") < JPEG_FLOOR, "Re-export at higher quality - compression artifacts are visible, which also makes the focus hard to judge.")
            .when(F.col("eyeRegionMeasured"), "Refocus on the eyes and hold the camera steadier - the eye region is softer than the rest of the frame.")
            .otherwise("Refocus and steady the camera - tap to focus before the shutter fires, and use a faster shutter speed.")
        )
    if axis == "lighting":
        hi, lo = F.col("clippedHighlights"), F.col("clippedShadows")
        return (
            F.when((hi + lo > CLIP_FULL) & (hi >= lo), F.concat(F.lit("Reduce the exposure - "), percent(hi), F.lit(" of the frame is blown to pure white and cannot be recovered.")))
            .when(hi + lo > CLIP_FULL, F.concat(F.lit("Add light on your face - "), percent(lo), F.lit(" of the frame is crushed to pure black.")))
            .when(F.col("exposureMean") < EXPOSURE_BAND[0], "Face a window or add a light in front of you - the photo is underexposed.")
            .when(F.col("exposureMean") > EXPOSURE_BAND[1], "Move out of direct sun or reduce the exposure - the photo is overexposed.")
            .otherwise("Shoot facing a window - the light is flat, so the photo has little tonal range.")
        )
    size = F.concat(F.col("width").cast("bigint").cast("string"), F.lit("x"), F.col("height").cast("bigint").cast("string"))
    return F.concat(F.lit("Reshoot at full resolution - this image is "), size, F.lit(" ("), F.format_string("%.1f", F.col("width") * F.col("height") / 1e6), F.lit("MP), which leaves nothing to crop from."))


def top_fixes(context: str = DEFAULT_CONTEXT, most: int = MOST_FIXES, messages: bool = True) -> Column:
    """The ``most`` axes with the most to gain: ``array<struct<axis, severity, headroom, message>>``, ties in axis order."""
    each = []
    for n, (a, w) in enumerate(zip(AXES, WEIGHTS[context])):
        head = (F.lit(5.0) - F.col(a)) * w * 2.25
        severity = F.when(head >= SEVERE, "high").when(head >= NOTABLE, "medium").otherwise("low")
        fields = [(-head).alias("rank"), F.lit(n).alias("n"), F.lit(a).alias("axis"), severity.alias("severity"), head.alias("headroom")]
        each.append(F.struct(*fields, *([advice(a).alias("message")] if messages else [])))
    found = F.filter(F.array(*each), lambda s: s["headroom"] > 0)
    keep = ["axis", "severity", "headroom"] + (["message"] if messages else [])
    return F.transform(F.slice(F.array_sort(found), 1, most), lambda s: F.struct(*[s[k].alias(k) for k in keep]))


def first_advice(context: str = DEFAULT_CONTEXT) -> Column:
    """The message of the axis with most to gain, worded for that axis only; null if nothing can be gained."""
    axis = F.try_element_at(top_fixes(context, most=1, messages=False), F.lit(1))["axis"]
    out = None
    for a in AXES:
        out = F.when(axis == a, advice(a)) if out is None else out.when(axis == a, advice(a))
    return out


def axis_breakdown(rows: DataFrame, key: str, context: str = DEFAULT_CONTEXT) -> DataFrame:
    """One row a present axis: level, weight, contribution and headroom on the composite's scale (four decimals)."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("axis"), F.col(a).alias("level"), F.lit(w).alias("weight")) for n, (a, w) in enumerate(zip(AXES, WEIGHTS[context]))])
    out = rows.select(key, F.explode(each).alias("x")).select(key, "x.*").where("level is not null")
    return out.select(key, "n", "axis", "level", "weight", round_half_up(F.col("level") * F.col("weight"), 4).alias("contribution"), round_half_up((F.lit(5.0) - F.col("level")) * F.col("weight") * 2.25, 4).alias("headroom"))
