"""Queries on measurement vectors: validation, axis scores, composites, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import norm_key, read
from ratewright.functions.numeric import piecewise_sql
from ratewright.operators import scoring as S

MEASURED = "sharpnessLaplacian double, sharpnessEyeRegion double, eyeRegionMeasured boolean, jpegQualityEstimate double, exposureMean double, clippedHighlights double, clippedShadows double, dynamicRange double, width double, height double, faceAreaRatio double, faceCenterOffsetX double, faceCount double, yaw double, isGrayscale boolean, sourceFormat string"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Cached measurements as full vectors, one row a content and version: of several, the first written.

    The cache keeps a part of the fields; face exposure is taken from the frame, what else is missing is unmeasured.
    """
    cached = read(spark, d, "feature_cache").groupBy("sha256", "extractor_version")
    raw = cached.agg(F.min(F.struct("extracted_at", "computed")).alias("first")).select("sha256", "extractor_version", "first.computed")
    # inline, not a plain projection: filters on single fields would be pushed below that, each parsing the text again.
    v = raw.select("sha256", F.col("extractor_version").alias("extractorVersion"), F.inline(F.array(F.from_json("computed", MEASURED))))
    edge, other = F.least("width", "height"), F.greatest("width", "height")
    return v.withColumns(
        {
            "faceExposureMean": F.col("exposureMean"),
            "faceClippedHighlights": F.col("clippedHighlights"),
            "faceClippedShadows": F.col("clippedShadows"),
            "faceRegionMeasured": F.col("faceCount") > 0,
            "exposureDelta": F.lit(0.0),
            "faceCenterOffsetY": F.when(F.col("faceCenterOffsetX").isNotNull(), F.lit(0.0)),
            "roll": F.lit(0.0),
            "pitch": F.lit(None).cast("double"),
            "eyeOpenness": F.lit(None).cast("double"),
            "smileIntensity": F.lit(None).cast("double"),
            "primaryFaceConfidence": F.when(F.col("faceCount") > 0, F.lit(0.9)),
            "secondLargestFaceRatio": F.lit(None).cast("double"),
            "aspectExtreme": other > edge * 3,
        }
    )


def _sql(x: str, kind: str = "double") -> str:
    return f"cast(json_extract_string(computed, '$.{x}') as {kind})"


VECTORS_SQL = f"""
raw as (select sha256, extractor_version, arg_min(computed, (extracted_at, computed)) as computed from feature_cache group by 1, 2),
v as (select sha256, extractor_version as ev, {', '.join(_sql(x) + ' as ' + x for x in ('sharpnessLaplacian', 'sharpnessEyeRegion', 'jpegQualityEstimate', 'exposureMean', 'clippedHighlights', 'clippedShadows', 'dynamicRange', 'width', 'height', 'faceAreaRatio', 'faceCenterOffsetX', 'faceCount', 'yaw'))},
  {_sql('eyeRegionMeasured', 'boolean')} as eyeRegionMeasured, {_sql('isGrayscale', 'boolean')} as isGrayscale, json_extract_string(computed, '$.sourceFormat') as sourceFormat from raw)"""

_BAND = "case when {x} < {lo} then ({lo} - {x}) * {s} when {x} > {hi} then ({x} - {hi}) * {s} when {x} is not null then 0.0 end"
_D = lambda x: f"cast({x!r} as double)"
_RATIO = _BAND.format(x="faceAreaRatio", lo=_D(S.RATIO_BAND[0]), hi=_D(S.RATIO_BAND[1]), s=_D(S.RATIO_SCALE))
_OFF = "sqrt(faceCenterOffsetX * faceCenterOffsetX)"
_OFFSET = _BAND.format(x=_OFF, lo=_D(0.0), hi=_D(S.OFFSET_TOLERANCE), s=_D(S.OFFSET_SCALE))
_EXPOSURE = _BAND.format(x="exposureMean", lo=_D(S.EXPOSURE_BAND[0]), hi=_D(S.EXPOSURE_BAND[1]), s=_D(S.EXPOSURE_SCALE))
_FRAMING = f"case when faceCount <> 0 then 1.0::double / (1.0::double + ({_RATIO}) + ({_OFFSET})) end"
_LIGHTING = f"1.0::double / (1.0::double + ({_EXPOSURE}) + (clippedHighlights + clippedShadows) / {_D(S.CLIP_FULL)})"

AXES_SQL = f"""{VECTORS_SQL},
scalars as (select *, case when eyeRegionMeasured and sharpnessEyeRegion is not null then 'eyeRegion' else 'frame' end as basis,
  case when eyeRegionMeasured and sharpnessEyeRegion is not null then sharpnessEyeRegion else sharpnessLaplacian end as sharp_raw,
  {_FRAMING} as framing_raw, {_LIGHTING} as lighting_raw, least(width, height) as edge from v),
axes as (select *, least(5.0::double, greatest(1.0::double, ({piecewise_sql('sharp_raw', S.KNOTS['sharpness'])}) - case when jpegQualityEstimate < 50 then 1.0 else 0.0 end)) as sharpness,
  least(5.0::double, greatest(1.0::double, {piecewise_sql('lighting_raw', S.KNOTS['lighting'])})) as lighting,
  {piecewise_sql('edge', S.KNOTS['resolution'])} as resolution,
  case when framing_raw is not null then {piecewise_sql('framing_raw', S.KNOTS['framing'])} end as framing from scalars)"""


def validate_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("fault", S.first_violation())
    return v.select("sha256", F.col("extractorVersion").alias("version"), F.col("fault").isNull().alias("usable"), F.col("fault.field").alias("field"), F.col("fault.reason").alias("reason"))


#: What is done to vectors whose sha256 begins with a digit, so that each kind of fault occurs.
DAMAGE = {"0": ("exposureMean", "300.0"), "1": ("width", "null"), "2": ("height", "10.5"), "3": ("clippedShadows", "-1.0"), "4": ("sourceFormat", "''"), "5": ("sharpnessEyeRegion", "null"), "6": ("isGrayscale", "null"), "7": ("yaw", "181.0")}


def rejects_by_reason(spark: SparkSession, d: str) -> DataFrame:
    """Faults of vectors of which some are damaged on purpose, by field and reason."""
    v = vectors(spark, d)
    v = v.withColumns({c: F.when(F.col("sha256").startswith(k), F.expr(x)).otherwise(F.col(c)) for k, (c, x) in DAMAGE.items()})
    faults = v.select(S.first_violation().alias("f")).where("f is not null")
    return faults.groupBy("f.field", "f.reason").agg(F.count("*").alias("n"))


def dimension_checks(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.groupBy("extractorVersion").agg(F.count_if(S.shorter_edge() < S.LEAST_EDGE).alias("below_floor"), F.count_if("aspectExtreme").alias("extreme_aspect"), F.count("*").alias("n"))


def computed_axes(spark: SparkSession, d: str) -> DataFrame:
    return S.with_raw_axes(vectors(spark, d)).select("sha256", F.col("extractorVersion").alias("version"), *[F.round(a, 6).alias(a) for a in S.COMPUTED])


def scalars(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("sha256", F.col("extractorVersion").alias("version"), S.sharpness_basis().alias("basis"), F.round(S.framing_raw(), 6).alias("framing_raw"), F.round(S.lighting_raw(), 6).alias("lighting_raw"), S.shorter_edge().alias("edge"), F.round(S.face_offset(), 6).alias("face_offset"))


def sharpness_basis_mix(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).groupBy(F.col("extractorVersion").alias("version"), S.sharpness_basis().alias("basis")).agg(F.count("*").alias("n"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Mean human level of the judged axes per content; images are matched to content by sha256."""
    labels = read(spark, d, "human_label").select(norm_key("image_id").alias("image_id"), norm_key("axis").alias("axis"), norm_key("rater").alias("rater"), "score", "labelled_at").where(F.col("score").between(1, 5)).distinct()
    images = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256")).where("sha256 is not null").distinct()
    by_axis = labels.where(F.col("axis").isin(S.JUDGED)).groupBy("image_id").pivot("axis", S.JUDGED).agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    joined = images.join(by_axis, "image_id")
    return joined.groupBy("sha256").agg(*[F.try_divide(F.sum(f"{a}_s"), F.sum(f"{a}_n")).alias(a) for a in S.JUDGED])


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Current, usable vectors with all axes as levels."""
    v = vectors(spark, d).where((F.col("extractorVersion") == S.VERSION) & S.first_violation().isNull())
    return S.axis_levels(v.join(judged(spark, d), "sha256", "left"))


JUDGED_SQL = """
lab as (select distinct lower(trim(regexp_replace(image_id, '\\s+', ' ', 'g'))) as image_id, lower(trim(regexp_replace(axis, '\\s+', ' ', 'g'))) as axis, lower(trim(regexp_replace(rater, '\\s+', ' ', 'g'))) as rater, score, labelled_at
  from human_label where score between 1 and 5),
img as (select distinct lower(trim(image_id)) as image_id, lower(trim(sha256)) as sha256 from dataset_image where sha256 is not null),
jud as (select i.sha256, avg(score) filter (axis = 'background') as background, avg(score) filter (axis = 'attire') as attire, avg(score) filter (axis = 'expression') as expression, avg(score) filter (axis = 'solo') as solo
  from img i join lab using (image_id) where axis in ('background', 'attire', 'expression', 'solo') group by 1)"""

_LEVEL = "least(5.0::double, greatest(1.0::double, floor({} + 0.5)))"
SCORED_SQL = f"""{AXES_SQL}, {JUDGED_SQL},
lev as (select a.* exclude (sharpness, lighting, resolution, framing), {', '.join(_LEVEL.format(x) + ' as ' + x for x in S.COMPUTED)}, {', '.join(f'case when {x} is not null then {_LEVEL.format(x)} end as {x}' for x in S.JUDGED)}
  from axes a left join jud using (sha256) where ev = 'v8'),
lv as (select * replace (case when framing_raw is not null then framing end as framing) from lev)"""


def _composite_sql(context: str) -> str:
    top = " + ".join(f"case when {a} is not null then {a} * {_D(w)} else 0.0 end" for a, w in zip(S.AXES, S.WEIGHTS[context]))
    bottom = " + ".join(f"case when {a} is not null then {_D(w)} else 0.0 end" for a, w in zip(S.AXES, S.WEIGHTS[context]))
    return f"floor((1.0::double + ((0.0::double + {top}) / (0.0::double + {bottom}) - 1.0) * 2.25::double) * 10.0::double + 0.5) / 10.0::double"


def composite_by_context(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("sha256", *S.AXES, *[S.composite(c).alias(c) for c in S.WEIGHTS])


def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("sha256", S.confidence().alias("confidence"))


def top_fixes(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("sha256", F.posexplode(S.top_fixes(messages=False)).alias("place", "f"))
    return rows.select("sha256", (F.col("place") + 1).alias("place"), "f.axis", "f.severity", F.round("f.headroom", 6).alias("headroom"))


def advice(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("sha256", F.explode(S.top_fixes()).alias("f"))
    return rows.select("sha256", "f.axis", "f.severity", "f.message")


def axis_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return S.axis_breakdown(scored(spark, d), "sha256").select("sha256", "axis", F.col("level").cast("int").alias("level"), "contribution", "headroom")


def weakest_axes(spark: SparkSession, d: str) -> DataFrame:
    """Axes of each content from the weakest up, ties in axis order."""
    each = F.array(*[F.struct(F.col(a).alias("level"), F.lit(n).alias("n"), F.lit(a).alias("axis")) for n, a in enumerate(S.AXES)])
    rows = scored(spark, d).select("sha256", F.transform(F.array_sort(F.filter(each, lambda s: s["level"].isNotNull())), lambda s: s["axis"]).alias("a"))
    return rows.select("sha256", F.array_join("a", ",").alias("axes"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scored vectors with composite, confidence and the first piece of advice, best first."""
    rows = scored(spark, d)
    return rows.select("sha256", S.composite(S.DEFAULT_CONTEXT).alias("score"), S.confidence().alias("confidence"), S.first_advice().alias("advice")).orderBy(F.desc("score"), "sha256")


def clip_summary(spark: SparkSession, d: str) -> DataFrame:
    """Embedding column kept beside the vectors: width check and text codec."""
    rows = read(spark, d, "feature_cache").select("extractor_version", F.size("clip_embedding").alias("width"), F.col("clip_embedding").isNull().alias("missing"))
    return rows.groupBy("extractor_version").agg(F.count_if("missing").alias("missing"), F.count_if(F.expr("not missing and width = 512")).alias("fits"), F.count_if(F.expr("not missing and width <> 512")).alias("wrong_width"))


QUERIES = {f.__name__: f for f in (validate_vectors, rejects_by_reason, dimension_checks, computed_axes, scalars, sharpness_basis_mix, composite_by_context, confidence_scores, top_fixes, advice, axis_breakdown, weakest_axes, flagship, clip_summary)}

_HEAD = [(f"(5.0::double - {a}) * {_D(w)} * 2.25::double", a, n) for n, (a, w) in enumerate(zip(S.AXES, S.WEIGHTS["corporate"]))]
_EACH = " union all ".join(f"select sha256, {n} as n, '{a}' as axis, {a} as level, {_D(w)} as w from lv where {a} is not null" for n, (a, w) in enumerate(zip(S.AXES, S.WEIGHTS["corporate"])))

_FAULTS = []
for _n, _lo, _hi, _whole, _null in S.RULES:
    if _n in ("sharpnessLaplacian", "sharpnessEyeRegion", "jpegQualityEstimate", "exposureMean", "clippedHighlights", "clippedShadows", "dynamicRange", "width", "height", "faceAreaRatio", "faceCenterOffsetX", "faceCount", "yaw"):
        if not _null:
            _FAULTS.append((f"{_n} is null", _n, "expected a number"))
        if _whole:
            _FAULTS.append((f"{_n} <> floor({_n})", _n, "must be an integer"))
        _FAULTS.append((f"{_n} < {_lo} or {_n} > {_hi}", _n, f"must be within [{_lo:.16g}, {_hi:.16g}]"))
_FAULTS.append(("isGrayscale is null", "isGrayscale", "expected a boolean"))
_FAULTS.append(("coalesce(sourceFormat, '') = ''", "sourceFormat", "expected a non-empty string"))
_FAULTS.append(("eyeRegionMeasured <> (sharpnessEyeRegion is not null)", "eyeRegionMeasured", "disagrees with sharpnessEyeRegion"))
_FIELD = "case " + " ".join(f"when {c} then '{f}'" for c, f, _ in _FAULTS) + " end"
_REASON = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in _FAULTS) + " end"

_TENTH = lambda v: f"round(cast(({v})::varchar as decimal(38, 25)), 1)::decimal(18, 1)::varchar"  # noqa: E731  (halves up, as written)
_PCT = lambda v: f"case when ({v}) * 100 > 0 and ({v}) * 100 < 1 then {_TENTH(f'({v}) * 100')} || '%' else floor(({v}) * 100 + 0.5)::bigint || '%' end"
_RATIO_IS, _OFF_IS = "faceAreaRatio", f"({_OFF})"
_ADVICE = f"""case axis when 'background' then 'Move to a plain wall, or step further from what is behind you so it falls out of focus.'
  when 'attire' then 'Dress one level more formally than this for the audience you picked.'
  when 'expression' then 'Look straight into the lens and let your expression settle before the shutter fires.'
  when 'solo' then 'Crop to one subject - a second person in frame makes it unclear who the photo is of.'
  when 'framing' then case when ({_RATIO_IS} is null or {_OFF_IS} is null) and faceCount = 0 then 'Reframe so your face is clearly visible - no face was detected in this photo.'
    when {_RATIO_IS} is null or {_OFF_IS} is null then 'Move closer or crop tighter - the faces in this photo are too small to measure framing from.'
    when {_RATIO_IS} < {_D(S.RATIO_BAND[0])} then 'Recrop to head-and-shoulders - your face fills ' || {_PCT(_RATIO_IS)} || ' of the frame, aim for 13%-24%.'
    when {_RATIO_IS} > {_D(S.RATIO_BAND[1])} then 'Step back or crop wider - your face fills ' || {_PCT(_RATIO_IS)} || ' of the frame, aim for 13%-24%.'
    else 'Recentre the crop - your face sits ' || {_PCT(_OFF_IS)} || ' of the frame off centre, keep it under 15%.' end
  when 'sharpness' then case when jpegQualityEstimate < 50 then 'Re-export at higher quality - compression artifacts are visible, which also makes the focus hard to judge.'
    when eyeRegionMeasured then 'Refocus on the eyes and hold the camera steadier - the eye region is softer than the rest of the frame.' else 'Refocus and steady the camera - tap to focus before the shutter fires, and use a faster shutter speed.' end
  when 'lighting' then case when clippedHighlights + clippedShadows > {_D(S.CLIP_FULL)} and clippedHighlights >= clippedShadows then 'Reduce the exposure - ' || {_PCT('clippedHighlights')} || ' of the frame is blown to pure white and cannot be recovered.'
    when clippedHighlights + clippedShadows > {_D(S.CLIP_FULL)} then 'Add light on your face - ' || {_PCT('clippedShadows')} || ' of the frame is crushed to pure black.'
    when exposureMean < {_D(S.EXPOSURE_BAND[0])} then 'Face a window or add a light in front of you - the photo is underexposed.'
    when exposureMean > {_D(S.EXPOSURE_BAND[1])} then 'Move out of direct sun or reduce the exposure - the photo is overexposed.' else 'Shoot facing a window - the light is flat, so the photo has little tonal range.' end
  else 'Reshoot at full resolution - this image is ' || width::bigint || 'x' || height::bigint || ' (' || {_TENTH('width * height / 1e6')} || 'MP), which leaves nothing to crop from.' end"""
_FIXES = f"""e as ({_EACH}), h as (select *, (5.0::double - level) * w * 2.25::double as headroom from e), r as (select *, row_number() over (partition by sha256 order by headroom desc, n) as place from h where headroom > 0)"""
_CONFIDENCE = f"""floor(least(1.0::double, greatest(0.0::double, 1.0::double - case when faceCount = 0 then 0.45::double when faceCount > 1 then 0.25::double else 0.0 end
      - case when abs(yaw) > 35 then 0.2::double when abs(yaw) > 20 then 0.1::double else 0.0 end - case when jpegQualityEstimate < 50 then 0.15::double else 0.0 end - case when {_OFF} > 0.35 then 0.1::double else 0.0 end
      - case when solo is not null and (faceCount <= 1) <> (solo >= 4) then 0.2::double else 0.0 end)) * 100.0::double + 0.5) / 100.0::double"""

SQL = {
    "advice": f"with {SCORED_SQL}, {_FIXES} select r.sha256, axis, case when headroom >= 0.9 then 'high' when headroom >= 0.35 then 'medium' else 'low' end as severity, {_ADVICE} as message from r join lv using (sha256) where place <= 3",
    "flagship": f"with {SCORED_SQL}, {_FIXES}, b as (select * from r where place = 1) select lv.sha256, {_composite_sql('corporate')} as score, {_CONFIDENCE} as confidence, case when axis is not null then {_ADVICE} end as advice from lv left join b using (sha256)",
    "validate_vectors": f"with {VECTORS_SQL} select sha256, ev as version, ({_FIELD}) is null as usable, {_FIELD} as field, {_REASON} as reason from v",
    "rejects_by_reason": f"with {VECTORS_SQL}, w as (select * replace ({', '.join(f"case when starts_with(sha256, '{k}') then {x} else {c} end as {c}" for k, (c, x) in DAMAGE.items())}) from v) select field, reason, count(*) as n from (select {_FIELD} as field, {_REASON} as reason from w) where field is not null group by 1, 2",
    "dimension_checks": f"with {VECTORS_SQL} select ev as extractorVersion, count(*) filter (least(width, height) < 200) as below_floor, count(*) filter (greatest(width, height) > least(width, height) * 3) as extreme_aspect, count(*) as n from v group by 1",
    "computed_axes": f"with {AXES_SQL} select sha256, ev as version, round(sharpness, 6) as sharpness, round(lighting, 6) as lighting, round(resolution, 6) as resolution, round(framing, 6) as framing from axes",
    "scalars": f"with {AXES_SQL} select sha256, ev as version, basis, round(framing_raw, 6) as framing_raw, round(lighting_raw, 6) as lighting_raw, edge, round({_OFF}, 6) as face_offset from axes",
    "sharpness_basis_mix": f"with {AXES_SQL} select ev as version, basis, count(*) as n from axes group by 1, 2",
    "composite_by_context": f"with {SCORED_SQL} select sha256, {', '.join(S.AXES)}, {', '.join(_composite_sql(c) + ' as ' + c for c in S.WEIGHTS)} from lv",
    "confidence_scores": f"""with {SCORED_SQL} select sha256, floor(least(1.0::double, greatest(0.0::double, 1.0::double - case when faceCount = 0 then 0.45::double when faceCount > 1 then 0.25::double else 0.0 end
      - case when abs(yaw) > 35 then 0.2::double when abs(yaw) > 20 then 0.1::double else 0.0 end - case when jpegQualityEstimate < 50 then 0.15::double else 0.0 end - case when {_OFF} > 0.35 then 0.1::double else 0.0 end
      - case when solo is not null and (faceCount <= 1) <> (solo >= 4) then 0.2::double else 0.0 end)) * 100.0::double + 0.5) / 100.0::double as confidence from lv""",
    "top_fixes": f"""with {SCORED_SQL}, e as ({_EACH}), h as (select *, (5.0::double - level) * w * 2.25::double as headroom from e), r as (select *, row_number() over (partition by sha256 order by headroom desc, n) as place from h where headroom > 0)
      select sha256, place::int as place, axis, case when headroom >= 0.9 then 'high' when headroom >= 0.35 then 'medium' else 'low' end as severity, round(headroom, 6) as headroom from r where place <= 3""",
    "axis_breakdown": f"with {SCORED_SQL}, e as ({_EACH}) select sha256, axis, level::int as level, floor(level * w * 10000.0::double + 0.5) / 10000.0::double as contribution, floor((5.0::double - level) * w * 2.25::double * 10000.0::double + 0.5) / 10000.0::double as headroom from e",
    "weakest_axes": f"with {SCORED_SQL}, e as ({_EACH}) select sha256, string_agg(axis, ',' order by level, n) as axes from e group by 1",
    "clip_summary": "select extractor_version, count(*) filter (clip_embedding is null) as missing, count(*) filter (len(clip_embedding) = 512) as fits, count(*) filter (clip_embedding is not null and len(clip_embedding) <> 512) as wrong_width from feature_cache group by 1",
}
