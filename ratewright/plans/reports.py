"""Queries on whole populations: duplicate groups, candidates for labelling, metrics of maps, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import attach, materialize, norm_key, read
from ratewright.functions.numeric import apply_knots
from ratewright.operators import agreement as A
from ratewright.operators import fitting as I
from ratewright.operators import grouping as G
from ratewright.operators import scoring as S
from ratewright.plans import agreement as P
from ratewright.plans import datasets as D
from ratewright.plans import fits as C
from ratewright.plans import measures as M

COHORT = "seed_a"
#: Unit in which an axis's driving scalar is told (fixed values).
UNITS = {"sharpness": "Laplacian variance (eye region)", "lighting": "lightingRaw (1 = ideal)", "resolution": "shorter edge (px)", "framing": "framingRaw (1 = ideal)"}


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """``(image_id, split_group, duplicate_of, roles, mixed)``: images of one content, of fingerprints within 6 bits, of one
    source group or creator group are in one group, also through others; it is named by its least image.

    ``duplicate_of`` is the least image of the same content. A group with several roles is ``mixed``: it can't be split.
    Every key is collapsed to its least image, fingerprints are matched by block keys; no pairs within a group are listed.
    """
    keys = {"image_id": "image_id", "sha256": "sha", "source_group": "source", "creator_group": "creator", "dataset_role": "role"}
    rows = read(spark, d, "dataset_image").select(*[norm_key(c).alias(n) for c, n in keys.items()], G.hash_code(F.col("perceptual_hash")).alias("code"))
    rows = materialize(rows, "images").where("image_id is not null").distinct()
    held = rows.select("image_id", F.posexplode(F.array("sha", "source", "creator", F.col("code").cast("string"))).alias("p", "k")).where("k is not null").distinct()
    hubs = materialize(held.groupBy("p", "k").agg(F.min("image_id").alias("hub"), F.count("*").alias("n")), "hubs")
    links = attach(held, hubs, ["p", "k"], "n", held.count()).where("image_id <> hub").select(F.col("image_id").alias("a"), F.col("hub").alias("b"))
    of = hubs.where("p = 3").select(F.col("k").cast("bigint").alias("code"), "hub").hint("merge")
    near = G.near_pairs(rows).join(of.select(F.col("code").alias("code_a"), F.col("hub").alias("a")), "code_a").join(of.select(F.col("code").alias("code_b"), F.col("hub").alias("b")), "code_b").select("a", "b")
    labels = G.least_labels(links.unionByName(near))
    every = rows.join(labels.withColumnRenamed("vertex", "image_id"), "image_id", "left").withColumn("split_group", F.coalesce("label", "image_id"))
    roles = every.groupBy("split_group").agg(F.size(F.collect_set("role")).alias("roles"))  # few roles
    first = hubs.where("p = 0").select(F.col("k").alias("sha"), F.col("hub").alias("first")).hint("merge")
    one = every.join(first, "sha", "left").groupBy("image_id", "split_group").agg(F.min(F.when(F.col("first") != F.col("image_id"), F.col("first"))).alias("duplicate_of"))
    return one.join(roles, "split_group").select("image_id", "split_group", "duplicate_of", "roles", (F.col("roles") > 1).alias("mixed"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """The last written row of each image."""
    raw = read(spark, d, "dataset_image")
    rows = raw.select(norm_key("image_id").alias("image_id"), "ingested_at", *[norm_key(c).alias(c) for c in ("sha256", "source", "cohort", "dataset_role", "split_group", "duplicate_of", "feature_status", "vlm_status", "eligibility_reason", "extractor_version")], F.col("eligible_for_product_scoring").alias("eligible"))
    return G.last_writes(rows.where("image_id is not null"), ["image_id"], "ingested_at")


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    """Current vectors with the driving scalar of each measured axis, one row a content."""
    v = M.vectors(spark, d).where(F.col("extractorVersion") == S.VERSION)
    return S.with_scalars(v).withColumn("sha256", norm_key("sha256"))


def candidate_selection(spark: SparkSession, d: str, limit: int = 100) -> DataFrame:
    """The development images to label next: ``(image_id, axes_to_label, coverage_priority, reasons)``, one a split group.

    Each measured axis is cut into eight bins of equal width; an axis that an image lacks a label for brings it the more
    the fewer labelled images lie in its bin. Of a group the image of highest priority stays, ties to the smaller name.
    """
    v = _scalars(spark, d).select("sha256", "faceCount", F.log1p("__sharpness").alias("sharpness"), F.col("__lighting").alias("lighting"), F.log1p("__resolution").alias("resolution"), F.col("__framing").alias("framing"))
    items = _latest(spark, d).where("dataset_role = 'development' and feature_status = 'ready'").join(v, "sha256")
    items = materialize(items.select("image_id", F.coalesce("split_group", "image_id").alias("g"), "eligible", "faceCount", *S.COMPUTED), "items")
    bounds = F.broadcast(items.agg(*[f(a).alias(f"{k}_{a}") for a in S.COMPUTED for k, f in (("lo", F.min), ("hi", F.max))]))  # one row
    done = P.labels(spark, d).where(F.col("axis").isin(S.COMPUTED)).groupBy("image_id").agg(F.collect_set("axis").alias("done"))
    binned = items.join(bounds).join(done, "image_id", "left").withColumns({f"bin_{a}": _bin(a) for a in S.COMPUTED} | {f"has_{a}": F.coalesce(F.array_contains("done", a), F.lit(False)) for a in S.COMPUTED})
    binned = materialize(binned.drop("done"), "binned")
    counts = binned.agg(*[F.count_if(F.col(f"has_{a}") & (F.col(f"bin_{a}") == b)).alias(f"n_{a}_{b}") for a in S.COMPUTED for b in range(8)])
    rows = binned.join(F.broadcast(counts))  # one row
    n_of = lambda a: F.element_at(F.array(*[F.col(f"n_{a}_{b}") for b in range(8)]), F.col(f"bin_{a}") + 1)
    priority = F.lit(0.0)
    for a in S.COMPUTED:
        priority = priority + F.when(F.col(f"has_{a}"), 0.0).otherwise(F.lit(1.0) / (n_of(a) + 1))
    reasons = [F.when(~F.col(f"has_{a}") & (F.col(f"bin_{a}") == b), f"{w} {a}") for a in S.COMPUTED for b, w in ((0, "low"), (7, "high"))]
    reasons += [F.when(F.col("faceCount") == 0, "no face"), F.when(F.col("faceCount") > 1, "multiple faces"), F.when(~F.col("eligible"), "below product dimension floor")]
    lacks = F.concat_ws(",", *[F.when(~F.col(f"has_{a}"), a) for a in S.COMPUTED])
    scored = rows.select("image_id", "g", lacks.alias("axes_to_label"), priority.alias("coverage_priority"), F.concat_ws("; ", *reasons).alias("reasons")).where("axes_to_label <> ''")
    best = scored.groupBy("g").agg(F.min(F.struct((-F.col("coverage_priority")).alias("less"), "image_id", "axes_to_label", "reasons")).alias("b")).select("b.*")
    top = best.orderBy("less", "image_id").limit(limit)
    return top.select("image_id", "axes_to_label", F.round(-F.col("less"), 9).alias("coverage_priority"), "reasons")


def _bin(a: str) -> Column:
    low, high = F.col(f"lo_{a}"), F.col(f"hi_{a}")
    return F.when(F.col(a).isNull() | (high == low), 0).otherwise(F.least(F.lit(7), F.floor((F.col(a) - low) / (high - low) * 8).cast("int")))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """``observations`` with what the present map gives: ``(axis, image_id, cluster, x, level, current)``."""
    v = S.with_raw_axes(M.vectors(spark, d).where(F.col("extractorVersion") == S.VERSION))
    own = v.select("sha256", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("current")) for a in S.COMPUTED])).alias("e")).select(norm_key("sha256").alias("sha256"), "e.*").where("current is not null")
    images = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256")).where("sha256 is not null").distinct()
    return C.observations(spark, d).join(images.join(own, "sha256").select("axis", "image_id", "current"), ["axis", "image_id"])


def _rounded(m: DataFrame, *more: str) -> DataFrame:
    return m.select("axis", *more, "n", *[F.round(c, 6).alias(c) for c in ("spearman", "kendall", "mae", "exact", "within_one", "bias")])


def axis_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How the present map of each axis predicts the human level."""
    return _rounded(A.score_metrics(_predicted(spark, d), ["axis"], "level", "current"))


def predicted_levels(spark: SparkSession, d: str) -> DataFrame:
    """Human and predicted level of each axis, all 25 cells: ``(axis, human, predicted, n)``."""
    whole = F.floor(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("current"))) + 0.5).cast("int")
    p = _predicted(spark, d).withColumn("p", whole)
    c = A.confusion(A.cells(p, ["axis"], "level", "p"), ["axis"], p.select("axis").distinct())
    return c.select("axis", F.col("x").alias("human"), F.col("y").alias("predicted"), "n")


def compare_axes(spark: SparkSession, d: str, folds: int = 5) -> DataFrame:
    """The present map against one fitted anew, on identical held-out folds: a row an axis and ``side``.

    Clusters go to folds whole, the largest first, each to the fold that holds least. The candidate is fitted on the other
    folds with knots for levels of five examples or more; where it has none it defers to the present map.
    """
    rows = materialize(_predicted(spark, d), "predicted")
    dealt = []
    for axis in S.COMPUTED:
        dealt += [(axis, c, f) for c, f in I.greedy_bins(I.cluster_sizes(rows.where(F.col("axis") == axis), "cluster"), folds).items()]
    rows = materialize(rows.join(spark.createDataFrame(dealt, "axis string, cluster string, fold int"), ["axis", "cluster"]), "folded")
    train = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> held")
    knots = I.supported_knots(train, ["axis", "held"], "x", "level").withColumnRenamed("held", "fold")
    p = rows.join(knots, ["axis", "fold"], "left")
    candidate = F.when(F.coalesce(F.size("knots"), F.lit(0)) > 0, apply_knots(F.col("x"), F.col("knots"))).otherwise(F.col("current"))
    sides = F.explode(F.array(F.struct(F.lit("current").alias("side"), F.col("current").alias("p")), F.struct(F.lit("candidate").alias("side"), candidate.alias("p")))).alias("s")
    each = materialize(p.select("axis", "level", sides).select("axis", "level", "s.side", F.round("s.p", 9).alias("p")), "sides")
    return _rounded(A.score_metrics(each, ["axis", "side"], "level", "p"), "side")


def calibration_stops(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against the fitted map of each axis, a row a warning; ``stop`` forbids its use. A few rows an axis are
    brought to the driver to be put in words.
    """
    o = materialize(C.observations(spark, d), "observations")
    modes = o.groupBy("axis", "x").agg(F.count("*").alias("k")).groupBy("axis").agg(F.max(F.struct("k", (-F.col("x")).alias("x"))).alias("m"))
    counts = o.groupBy("axis").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") == v).alias(f"l{v}") for v in A.LEVELS])
    held = C.cross_validated(spark, d).select("axis", "rho")
    rows = counts.join(modes, "axis").join(I.fitted_knots(o, ["axis"], "x", "level"), "axis").join(held, "axis", "left").collect()  # four rows
    out = []
    for r in rows:
        texts = I.calibration_warnings(r.n, r.m.k / r.n, -r.m.x, {v: r[f"l{v}"] for v in A.LEVELS}, [(k.x, k.y) for k in r.knots], list(r.unreachable), r.rho, UNITS[r.axis])
        out += [(r.axis, i, t, t.startswith("STOP")) for i, t in enumerate(texts)]
    return spark.createDataFrame(out, "axis string, place int, warning string, stop boolean")


def _section(name: str, rows: DataFrame, key: Column | str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(F.coalesce(k.cast("string"), F.lit("none")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")


def population_report(spark: SparkSession, d: str, cohort: str = COHORT) -> DataFrame:
    """Who a calibration on ``cohort`` would be fitted on: ``(section, key, n)``.

    Sections: eligibility and its reasons, versions, labels and their levels by axis, and for each axis the labels of
    eligible images with a measurement (fitted) and without one (missing). A missing measurement is never filled in.
    """
    images = materialize(_latest(spark, d).where(F.col("cohort") == cohort), "cohort")
    raw = read(spark, d, "human_label")
    l = raw.select(*[norm_key(c).alias(c) for c in ("image_id", "axis", "rater", "cohort")], "score", "labelled_at").where(F.col("score").between(1, 5) & (F.col("cohort") == cohort)).distinct()  # noqa: E741
    l = materialize(l, "labels")  # noqa: E741
    x = _scalars(spark, d).select("sha256", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"__{a}").alias("x")) for a in S.COMPUTED])).alias("e")).select("sha256", "e.*")
    able = l.where(F.col("axis").isin(S.COMPUTED)).join(images.where("eligible").select("image_id", "sha256"), "image_id").join(x, ["sha256", "axis"], "left")
    out = _section("images", images, F.when(F.col("eligible"), "eligible").otherwise("excluded"))
    for part in (
        _section("exclusion", images.where("eligible is not true"), F.coalesce("eligibility_reason", F.lit("unknown"))),
        _section("version", images, "extractor_version"),
        _section("labels", l, "axis"),
        _section("level", l.where(F.col("axis").isin(S.COMPUTED)), F.concat_ws("/", "axis", "score")),
        _section("fitted", able.where("x is not null"), "axis"),
        _section("missing", able.where("x is null"), "axis"),
    ):
        out = out.unionByName(part)
    return out


def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """An inventory of all images by their last row: ``(section, key, n)``. Near pairs are those of ``near_duplicate_images``.

    Sections of one image are counted in one reading, so plan and tasks don't grow with their number.
    """
    named = ["source", "cohort", "dataset_role", "feature_status", "vlm_status"]
    i = materialize(_latest(spark, d).select(*named, "eligible", "eligibility_reason", "duplicate_of", "split_group"), "latest")
    eligible = F.when(F.col("eligible").isNull(), "unknown").when(F.col("eligible"), "eligible").otherwise(F.coalesce("eligibility_reason", F.lit("ineligible")))
    said = {"images": F.lit("all")} | {c: F.coalesce(c, F.lit("none")) for c in named} | {"eligibility": eligible}
    each = [F.struct(F.lit(name).alias("section"), key.alias("key")) for name, key in said.items()]
    each.append(F.when(F.col("duplicate_of").isNotNull(), F.struct(F.lit("duplicates").alias("section"), F.lit("all").alias("key"))))
    out = i.select(F.explode(F.array(*each)).alias("e")).where("e is not null").groupBy("e.section", "e.key").agg(F.count("*").alias("n"))
    groups = i.where("split_group is not null").groupBy("split_group").agg(F.count("*").alias("k")).where("k > 1")
    return out.unionByName(_section("groups_of_several", groups, F.lit("all"))).unionByName(_section("near_pairs", D.near_duplicate_images(spark, d), "bits"))


def gate_exclusions(spark: SparkSession, d: str, cohort: str = COHORT) -> DataFrame:
    """Why an image of ``cohort`` takes no part in comparing the judge with people, the first reason that holds:
    ``(outcome, n, large)``, ``large`` being the compared labels that lie two levels or more from the measured one.
    """
    v = _scalars(spark, d).select("sha256", "faceCount")
    rows = _latest(spark, d).where(F.col("cohort") == cohort).join(v, "sha256", "left")
    outcome = (
        F.when(~F.coalesce("eligible", F.lit(False)), "below_dimension_floor").when(F.col("faceCount").isNull(), "features_missing").when(F.col("faceCount") == 0, "no_face")
        .when(F.col("vlm_status") == "declined", "vlm_declined").when(F.coalesce("vlm_status", F.lit("")) != "assessed", "assessment_missing").otherwise("compared")
    )
    far = P.levels(spark, d).where("abs(human - model) >= 2").groupBy("image_id").agg(F.count("*").alias("far"))
    return rows.select("image_id", outcome.alias("outcome")).join(far, "image_id", "left").groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "compared", F.col("far"))), F.lit(0)).alias("large"))


def corpus_framing(spark: SparkSession, d: str) -> DataFrame:
    """Framing labels of collected photos with their vector and a cluster by photographer: ``(state, labels, photos, clusters)``.

    A label whose photo has no vector is counted as missing, none is dropped unseen. A photo without a photographer is a
    cluster of its own.
    """
    images = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256")).where("image_id is not null and sha256 is not null").distinct()
    l = P.ratings(spark, d).where("axis = 'framing'").join(images, "image_id")  # noqa: E741
    credit = read(spark, d, "manifest").select(norm_key("sha256").alias("sha256"), F.nullif(F.trim("photographer"), F.lit("")).alias("who")).where("sha256 is not null").groupBy("sha256").agg(F.min("who").alias("who"))
    known = _scalars(spark, d).select("sha256", F.lit(True).alias("known")).distinct()
    rows = l.join(known, "sha256", "left").join(credit, "sha256", "left")
    cluster = F.coalesce(F.concat(F.lit("creator:"), "who"), F.concat(F.lit("image:"), "sha256"))
    return rows.groupBy(F.when(F.col("known"), "merged").otherwise("missing").alias("state")).agg(F.count("*").alias("labels"), F.countDistinct("sha256").alias("photos"), F.countDistinct(cluster).alias("clusters"))


def artifact_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each image's cached vector can be used, by what its row says: ``(feature_status, state, n)``.

    The states in order: not ready, another version wanted, no vector of that content, only vectors of other versions,
    or found.
    """
    cache = read(spark, d, "feature_cache").select(norm_key("sha256").alias("sha256"), F.trim("extractor_version").alias("v")).where("sha256 is not null").groupBy("sha256").agg(F.bool_or(F.col("v") == S.VERSION).alias("current"))
    rows = _latest(spark, d).join(cache, "sha256", "left")
    state = (
        F.when(F.coalesce("feature_status", F.lit("")) != "ready", "not ready").when(F.coalesce("extractor_version", F.lit("")) != S.VERSION, "other version wanted")
        .when(F.col("current").isNull(), "no vector").when(~F.col("current"), "other versions only").otherwise("found")
    )
    return rows.groupBy("feature_status", state.alias("state")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (duplicate_groups, candidate_selection, axis_metrics, predicted_levels, compare_axes, calibration_stops, population_report, dataset_report, gate_exclusions, corpus_framing, artifact_states)}

_K = P._K
_LAST = [_K(c) for c in ("sha256", "source", "cohort", "dataset_role", "split_group", "duplicate_of", "feature_status", "vlm_status", "eligibility_reason", "extractor_version")] + ["eligible_for_product_scoring"]
_LATEST = f"""lt as (select {_K('image_id')} as image_id, {_K('sha256')} as sha256, {_K('source')} as source, {_K('cohort')} as cohort, {_K('dataset_role')} as dataset_role, {_K('split_group')} as split_group, {_K('duplicate_of')} as duplicate_of, {_K('feature_status')} as feature_status,
  {_K('vlm_status')} as vlm_status, {_K('eligibility_reason')} as eligibility_reason, {_K('extractor_version')} as extractor_version, eligible_for_product_scoring as eligible from dataset_image where {_K('image_id')} is not null qualify row_number() over (partition by {_K('image_id')} order by ingested_at desc nulls last, {', '.join(f'{c} desc nulls last' for c in _LAST)}) = 1)"""
_SX = "sx as (select sha256, basis, sharp_raw as sharpness, lighting_raw as lighting, edge as resolution, framing_raw as framing, faceCount from axes where ev = 'v8')"
_AX = " union all ".join(f"select sha256, '{a}' as axis, {a} as current from axes where ev = 'v8' and {a} is not null" for a in S.COMPUTED)
_PRED = f"{C._OBS}, cur as ({_AX}), pr as (select ob.axis, ob.image_id, level, current from ob join im on im.image_id = ob.image_id join cur on cur.sha256 = im.sha256 and cur.axis = ob.axis), pl as (select *, floor(least(5.0, greatest(1.0, current)) + 0.5)::int as p from pr)"
_DIMS = {"sharpness": "ln(1 + sharpness)", "lighting": "lighting", "resolution": "ln(1 + resolution)", "framing": "framing"}
_BINS = ", ".join(f"case when {a} is null or max({a}) over () = min({a}) over () then 0 else least(7, floor(({a} - min({a}) over ()) / (max({a}) over () - min({a}) over ()) * 8)::int) end as bin_{a}" for a in _DIMS)
_HAS = ", ".join(f"exists (select 1 from l where l.image_id = it.image_id and l.axis = '{a}') as has_{a}" for a in _DIMS)
_PRIO = " + ".join(f"case when has_{a} then 0.0::double else 1.0::double / (1 + count(*) filter (has_{a}) over (partition by bin_{a})) end" for a in _DIMS)
_WHY = ", ".join(f"case when not has_{a} and bin_{a} = {b} then '{w} {a}' end" for a in _DIMS for b, w in ((0, "low"), (7, "high")))


def _count(section: str, key: str, source: str) -> str:
    return f"select '{section}' as section, coalesce({key}::varchar, 'none') as key, count(*) as n from {source} group by 2"


SQL = {
    "duplicate_groups": f"""with recursive im as (select distinct {_K('image_id')} as i, {_K('sha256')} as s, {_K('source_group')} as g, {_K('creator_group')} as c, {_K('dataset_role')} as r,
      case when regexp_full_match(lower(trim(perceptual_hash)), '[0-9a-f]{{16}}') then cast(('0x' || lower(trim(perceptual_hash))) as ubigint) end as h from dataset_image where {_K('image_id')} is not null),
      k as (select i, 's' || s as k from im where s is not null union select i, 'g' || g from im where g is not null union select i, 'c' || c from im where c is not null union select i, 'h' || h from im where h is not null),
      hub as (select k, min(i) as hub from k group by 1), hc as (select h, min(i) as hub from im where h is not null group by 1),
      n as (select a.hub as a, b.hub as b from hc a join hc b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 6), e as (select i as a, hub as b from k join hub using (k) where i <> hub union select hub, i from k join hub using (k) where i <> hub union select a, b from n),
      w as (select a as v, a as u from e union select w.v, e.b from w join e on e.a = w.u), lab as (select v, min(u) as m from w group by 1), every as (select im.*, coalesce(m, i) as grp from im left join lab on v = i),
      ro as (select grp, count(distinct r) as roles from every group by 1), f as (select s, min(i) as first from im where s is not null group by 1)
      select i as image_id, grp as split_group, min(case when first <> i then first end) as duplicate_of, any_value(roles) as roles, any_value(roles) > 1 as mixed from every left join f using (s) join ro using (grp) group by 1, 2""",
    "candidate_selection": f"""with {P._LABELS}, {M.AXES_SQL}, {_LATEST}, {_SX}, it as (select image_id, coalesce(split_group, image_id) as g, eligible, faceCount, {', '.join(f'{e} as {a}' for a, e in _DIMS.items())} from lt join sx using (sha256) where dataset_role = 'development' and feature_status = 'ready'),
      b as (select *, {_BINS}, {_HAS} from it), p as (select *, {_PRIO} as prio from b),
      c as (select image_id, g, concat_ws(',', {', '.join(f"case when not has_{a} then '{a}' end" for a in _DIMS)}) as axes_to_label, prio, concat_ws('; ', {_WHY}, case when faceCount = 0 then 'no face' end, case when faceCount > 1 then 'multiple faces' end, case when not eligible then 'below product dimension floor' end) as reasons from p)
      select image_id, axes_to_label, round(prio, 9) as coverage_priority, reasons from (select * from c where axes_to_label <> '' qualify row_number() over (partition by g order by prio desc, image_id) = 1) order by prio desc, image_id limit 100""",
    "axis_metrics": f"""with {_PRED}, rks as (select axis, rank() over (partition by axis order by level) + (count(*) over (partition by axis, level) - 1) / 2.0::double as rx, rank() over (partition by axis order by current) + (count(*) over (partition by axis, current) - 1) / 2.0::double as ry from pr),
      prs as (select a.axis, sign(a.level - b.level) * sign(a.current - b.current) as s, a.level = b.level as tx, a.current = b.current as ty from pr a join pr b on a.axis = b.axis and a.image_id < b.image_id),
      tie as (select axis, count(*) filter (s > 0) as c, count(*) filter (s < 0) as d, count(*) filter (tx and not ty) as x, count(*) filter (ty and not tx) as y from prs group by 1), sp as (select axis, corr(rx, ry) as rho from rks group by 1)
      select axis, count(*) as n, round(any_value(rho), 6) as spearman, round(any_value((c - d) / sqrt((c + d + x)::double * (c + d + y))), 6) as kendall, round(avg(abs(p - level)), 6) as mae, round(avg((p = level)::int), 6) as exact, round(avg((abs(p - level) <= 1)::int), 6) as within_one, round(avg(p - level), 6) as bias from pl join tie using (axis) join sp using (axis) group by 1""",
    "predicted_levels": f"with {_PRED}, hx as (select unnest([1, 2, 3, 4, 5]) as human), mx as (select unnest([1, 2, 3, 4, 5]) as predicted), ax as (select distinct axis from pl) select ax.axis, human, predicted, count(pl.axis) as n from ax cross join hx cross join mx left join pl on pl.axis = ax.axis and level = human and p = predicted group by 1, 2, 3",
    "population_report": f"""with {M.AXES_SQL}, {_LATEST}, {_SX}, im as (select * from lt where cohort = '{COHORT}'), l as (select distinct {_K('image_id')} as image_id, {_K('axis')} as axis, {_K('rater')} as rater, score, labelled_at from human_label where score between 1 and 5 and {_K('cohort')} = '{COHORT}'),
      xs as ({' union all '.join(f"select sha256, '{a}' as axis, {a} as x from sx" for a in S.COMPUTED)}), ca as (select * from l where axis in ('sharpness', 'lighting', 'resolution', 'framing')), ab as (select ca.axis, x from ca join im using (image_id) left join xs on xs.sha256 = im.sha256 and xs.axis = ca.axis where eligible)
      {_count('images', "case when eligible then 'eligible' else 'excluded' end", 'im')} union all {_count('exclusion', "coalesce(eligibility_reason, 'unknown')", '(select * from im where eligible is not true)')} union all {_count('version', 'extractor_version', 'im')} union all {_count('labels', 'axis', 'l')}
      union all {_count('level', "axis || '/' || score", 'ca')} union all {_count('fitted', 'axis', '(select * from ab where x is not null)')} union all {_count('missing', 'axis', '(select * from ab where x is null)')}""",
    "dataset_report": f"""with {_LATEST}, np as ({D.SQL['near_duplicate_images']}) {_count('images', "'all'", 'lt')} union all {' union all '.join(_count(c, c, 'lt') for c in ('source', 'cohort', 'dataset_role', 'feature_status', 'vlm_status'))}
      union all {_count('eligibility', "case when eligible is null then 'unknown' when eligible then 'eligible' else coalesce(eligibility_reason, 'ineligible') end", 'lt')} union all {_count('duplicates', "'all'", '(select * from lt where duplicate_of is not null)')}
      union all {_count('groups_of_several', "'all'", '(select split_group from lt where split_group is not null group by 1 having count(*) > 1)')} union all {_count('near_pairs', 'bits', 'np')}""",
    "gate_exclusions": f"""with {P._LEVELS}, {_LATEST}, fa as (select sha256, faceCount from v where ev = 'v8'), far as (select image_id, count(*) as far from p where abs(x - y) >= 2 group by 1),
      o as (select image_id, case when eligible is not true then 'below_dimension_floor' when faceCount is null then 'features_missing' when faceCount = 0 then 'no_face' when vlm_status = 'declined' then 'vlm_declined' when coalesce(vlm_status, '') <> 'assessed' then 'assessment_missing' else 'compared' end as outcome from lt left join fa using (sha256) where cohort = '{COHORT}')
      select outcome, count(*) as n, coalesce(sum(case when outcome = 'compared' then far end), 0)::bigint as large from o left join far using (image_id) group by 1""",
    "corpus_framing": f"""with {P._LABELS}, im as (select distinct {_K('image_id')} as image_id, {_K('sha256')} as sha256 from dataset_image where {_K('image_id')} is not null and {_K('sha256')} is not null),
      cr as (select {_K('sha256')} as sha256, min(nullif(trim(photographer, ' '), '')) as who from manifest group by 1), kn as (select distinct {_K('sha256')} as sha256, true as known from feature_cache where extractor_version = 'v8')
      select case when known then 'merged' else 'missing' end as state, count(*) as labels, count(distinct im.sha256) as photos, count(distinct coalesce('creator:' || who, 'image:' || im.sha256)) as clusters from r join im using (image_id) left join kn using (sha256) left join cr using (sha256) where axis = 'framing' group by 1""",
    "artifact_states": f"""with {_LATEST}, c as (select {_K('sha256')} as sha256, bool_or(trim(extractor_version) = 'v8') as current from feature_cache where {_K('sha256')} is not null group by 1)
      select feature_status, case when coalesce(feature_status, '') <> 'ready' then 'not ready' when coalesce(extractor_version, '') <> 'v8' then 'other version wanted' when current is null then 'no vector' when not current then 'other versions only' else 'found' end as state, count(*) as n from lt left join c using (sha256) group by 1, 2""",
}
