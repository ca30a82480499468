"""Queries on agreement: raters among each other, humans against the measured axes, labelling passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import norm_key, read
from ratewright.functions.numeric import round_half_up
from ratewright.operators import agreement as A
from ratewright.operators import scoring as S
from ratewright.plans import measures as M


def labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "human_label").select(norm_key("image_id").alias("image_id"), norm_key("axis").alias("axis"), norm_key("rater").alias("rater"), "score", "labelled_at").distinct()


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """The last valid rating of each rater on each image and axis."""
    return A.last_ratings(labels(spark, d).where(F.col("score").between(1, 5)), ["axis", "image_id"], "rater", "score", "labelled_at")


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Human and measured level of each image and measured axis: ``(axis, image_id, human, model)``, null where missing."""
    human = ratings(spark, d).groupBy("axis", "image_id").agg(round_half_up(F.avg("score")).cast("int").alias("human")).where(F.col("axis").isin(S.COMPUTED))
    v = M.vectors(spark, d).where(F.col("extractorVersion") == S.VERSION)
    own = S.axis_levels(v).select("sha256", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("model")) for a in S.COMPUTED])).alias("x")).select("sha256", "x.*").where("model is not null")
    images = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256")).where("sha256 is not null").distinct()
    model = images.join(own, "sha256").groupBy("axis", "image_id").agg(F.max("model").alias("model"))
    return human.join(model, ["axis", "image_id"], "full_outer")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return A.cells(levels(spark, d), ["axis"], "human", "model")


_R = lambda c, n: F.round(c, 6).alias(n)


def alpha_ordinal(spark: SparkSession, d: str) -> DataFrame:
    a = A.ordinal_alpha(ratings(spark, d), ["axis"], "image_id", "score")
    return a.select("axis", _R("alpha", "alpha"), "units", "ratings", A.alpha_verdict(F.col("alpha")).alias("verdict"))


def spearman_axis(spark: SparkSession, d: str) -> DataFrame:
    return A.spearman(_cells(spark, d), ["axis"]).select("axis", _R("rho", "rho"), "n")


def kendall_axis(spark: SparkSession, d: str) -> DataFrame:
    c = A.concordance(_cells(spark, d), ["axis"])
    return c.select("axis", _R(A.kendall_tau(c), "tau"))


def pairwise_axis(spark: SparkSession, d: str) -> DataFrame:
    c = A.concordance(_cells(spark, d), ["axis"])
    return c.select("axis", _R(A.pairwise_accuracy("x"), "accuracy"), _R(A.rank_agreement(), "rank_agreement"))


def agreement_axis(spark: SparkSession, d: str) -> DataFrame:
    return A.simple_agreement(_cells(spark, d), ["axis"]).select("axis", *[_R(c, c) for c in ("exact", "within_one", "mae", "bias", "off_by_two")], "n")


def confusion_axis(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(a,) for a in S.COMPUTED], "axis string")
    return A.confusion(_cells(spark, d), ["axis"], groups).select("axis", F.col("x").alias("human"), F.col("y").alias("model"), "n")


def unmatched_axis(spark: SparkSession, d: str) -> DataFrame:
    """Images that only one side has, per axis."""
    return levels(spark, d).groupBy("axis").agg(F.count_if(F.col("model").isNull()).alias("only_human"), F.count_if(F.col("human").isNull()).alias("only_model"))


def axis_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(labels(spark, d), ["axis"], "score").withColumn("share", F.round("share", 6))


def composite_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Photos per rounded composite (zero-filled), with the mean and spread over all."""
    s = M.scored(spark, d).select(S.composite(S.DEFAULT_CONTEXT).alias("score"))  # never null: each usable vector has three axes
    bins = s.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", round_half_up(F.col("score")))
    total = F.sum("n")
    mean = F.sum(F.col("score") * F.col("n")) / total
    square = F.sum(F.col("score") * F.col("score") * F.col("n"))
    sd = F.sqrt((square - mean * mean * total) / F.greatest(total - 1, F.lit(1)))
    whole = bins.agg(mean.alias("mean"), sd.alias("sd"), total.alias("total"), *[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).alias(f"b{b}") for b in range(1, 11)])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("n")) for b in range(1, 11)])).alias("x")
    rows = whole.select("mean", "sd", "total", each).select("mean", "sd", "total", "x.*")
    return rows.select("bin", "n", F.round(F.try_divide(F.col("n").cast("double"), F.col("total")), 6).alias("share"), _R("mean", "mean"), _R("sd", "sd"))


def variance_contribution(spark: SparkSession, d: str) -> DataFrame:
    v = A.variance_shares(M.scored(spark, d), S.COMPUTED, S.WEIGHTS["corporate"][:4])
    return v.select("axis", _R("share", "share"), _R("sd", "sd"), "dead_weight", "n")


def rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise accuracy of every two raters on the images both scored, per axis: the raters' own ceiling."""
    r = ratings(spark, d)
    a, b = r.select("axis", "image_id", F.col("rater").alias("r1"), F.col("score").alias("s1")), r.select("axis", "image_id", F.col("rater").alias("r2"), F.col("score").alias("s2"))
    both = a.join(b, ["axis", "image_id"]).where("r1 < r2")
    c = A.concordance(A.cells(both, ["axis", "r1", "r2"], "s1", "s2"), ["axis", "r1", "r2"])
    return c.select("axis", "r1", "r2", A.pairwise_accuracy("x").alias("accuracy")).where("accuracy is not null")


def self_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rater_pairs(spark, d).groupBy("axis").agg(_R(F.avg("accuracy"), "accuracy"), F.count("*").alias("pairs"))


def _model_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = levels(spark, d).where("model is not null").select("axis", "image_id", "model")
    both = ratings(spark, d).join(m, ["axis", "image_id"])
    c = A.concordance(A.cells(both, ["axis", "rater"], "score", "model"), ["axis", "rater"])
    return c.select("axis", "rater", A.pairwise_accuracy("x").alias("accuracy")).where("accuracy is not null")


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _model_pairs(spark, d).groupBy("axis").agg(_R(F.avg("accuracy"), "accuracy"), F.count("*").alias("raters"))


def ceiling_report(spark: SparkSession, d: str) -> DataFrame:
    """The model's pairwise accuracy against that of raters among each other, per axis; ``unmatched`` has only one of them."""
    h = rater_pairs(spark, d).groupBy("axis").agg(F.avg("accuracy").alias("human"))
    m = _model_pairs(spark, d).groupBy("axis").agg(F.avg("accuracy").alias("model"))
    both = h.join(m, "axis", "full_outer")
    return both.select("axis", _R("human", "human"), _R("model", "model"), _R(F.col("human") - F.col("model"), "headroom"), _R(F.when(F.col("human") == 0, 0.0 * F.col("model")).otherwise(F.col("model") / F.col("human")), "fraction"), A.ceiling_verdict(F.col("human"), F.col("model")).alias("verdict"), (F.col("human").isNull() | F.col("model").isNull()).alias("unmatched"))


def _passes(spark: SparkSession, d: str) -> DataFrame:
    """First and last label of each image and axis that was labelled at two times or more."""
    l = labels(spark, d).where(F.col("score").between(1, 5))  # noqa: E741
    g = l.groupBy("axis", "image_id").agg(F.min(F.struct("labelled_at", "score", "rater")).alias("a"), F.max(F.struct("labelled_at", "score", "rater")).alias("b"))
    return g.where("a.labelled_at < b.labelled_at").select("axis", "image_id", F.col("a.score").alias("old"), F.col("b.score").alias("new"))


def overlap_verdict(spark: SparkSession, d: str) -> DataFrame:
    p = _passes(spark, d)
    long = p.select("axis", "image_id", F.explode(F.array("old", "new")).alias("score"))
    alpha = A.ordinal_alpha(long, ["axis"], "image_id", "score").select("axis", "alpha", F.col("units").alias("overlap"))
    rank = A.concordance(A.cells(p, ["axis"], "old", "new"), ["axis"]).select("axis", A.rank_agreement().alias("rank_agreement"))
    offset = p.groupBy("axis").agg(F.avg(F.col("new") - F.col("old")).alias("offset"), F.expr("percentile(old, 0.5)").alias("median_old"), F.expr("percentile(new, 0.5)").alias("median_new"))
    out = alpha.join(rank, "axis").join(offset, "axis")
    return out.select("axis", "overlap", _R("alpha", "alpha"), _R("rank_agreement", "rank_agreement"), _R("offset", "offset"), "median_old", "median_new", A.overlap_verdict(F.col("overlap"), F.col("alpha"), F.col("rank_agreement"), F.col("offset")).alias("verdict"))


def anchor_check(spark: SparkSession, d: str) -> DataFrame:
    """Anchors are images on whose axis four raters or more agree; how many measured levels lie within one of them."""
    anchors = ratings(spark, d).groupBy("axis", "image_id").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).where("n >= 4 and lo = hi")
    got = anchors.join(levels(spark, d).where("model is not null").select("axis", "image_id", "model"), ["axis", "image_id"])
    return got.groupBy("axis").agg(F.count("*").alias("anchors"), F.count_if(F.abs(F.col("model") - F.col("lo")) <= 1).alias("ok"))


def ratings_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """The ratings of each unit in rater order, as text."""
    r = ratings(spark, d).groupBy("axis", "image_id").agg(F.array_sort(F.collect_list(F.struct("rater", "score"))).alias("x"))
    return r.select("axis", "image_id", F.array_join(F.transform("x", lambda s: F.concat_ws("=", s["rater"], s["score"])), ";").alias("ratings"))


def large_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).where("abs(human - model) >= 2").select("image_id", "axis", "human", "model").orderBy("image_id", "axis")


QUERIES = {
    f.__name__: f
    for f in (alpha_ordinal, spearman_axis, kendall_axis, pairwise_axis, agreement_axis, confusion_axis, unmatched_axis, axis_distribution, composite_histogram, variance_contribution, self_agreement, model_agreement, ceiling_report, overlap_verdict, anchor_check, ratings_by_unit, large_disagreements)
}

_K = lambda c: f"nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"
_LABELS = f"""
l as (select distinct {_K('image_id')} as image_id, {_K('axis')} as axis, {_K('rater')} as rater, score, labelled_at from human_label),
r as (select axis, image_id, coalesce(rater, 'unnamed') as rater, arg_max(score, (labelled_at, score)) as score from l where score between 1 and 5 group by 1, 2, 3)"""
_AXES_OF = " union all ".join(f"select sha256, '{a}' as axis, least(5.0::double, greatest(1.0::double, floor({a} + 0.5)))::int as model from axes where ev = 'v8' and {a} is not null" for a in S.COMPUTED)
_LEVELS = f"""{_LABELS}, {M.AXES_SQL},
hum as (select axis, image_id, floor(avg(score) + 0.5)::int as human from r where axis in ('sharpness', 'lighting', 'resolution', 'framing') group by 1, 2),
own as ({_AXES_OF}),
im as (select distinct {_K('image_id')} as image_id, {_K('sha256')} as sha256 from dataset_image where {_K('sha256')} is not null),
mod as (select axis, image_id, max(model) as model from im join own using (sha256) group by 1, 2),
lev as (select axis, image_id, human, model from hum full join mod using (axis, image_id)),
p as (select axis, image_id, human as x, model as y from lev where human is not null and model is not null)"""


def _alpha_sql(src: str) -> str:
    """Alpha straight from its definition: ordered pairs of ratings within units."""
    return f"""u as (select axis, image_id, count(*) as m from {src} group by 1, 2 having count(*) >= 2),
g as (select axis, image_id, score, row_number() over (partition by axis, image_id) as k from {src}),
o as (select a.axis, a.score as i, b.score as j, sum(1.0::double / (u.m - 1)) as o from g a join g b on a.axis = b.axis and a.image_id = b.image_id and a.k <> b.k join u on u.axis = a.axis and u.image_id = a.image_id group by 1, 2, 3),
nn as (select axis, i, sum(o) as n from o group by 1, 2),
dd as (select a.axis, a.i as i, b.i as j, a.n as ni, b.n as nj, power((select sum(n) from nn c where c.axis = a.axis and c.i between a.i and b.i) - (a.n + b.n) / 2, 2) as d from nn a join nn b on a.axis = b.axis and a.i < b.i),
al as (select dd.axis, 1 - ((select sum(n) from nn where nn.axis = dd.axis) - 1) * sum(coalesce(o.o, 0) * d) / nullif(sum(ni * nj * d), 0) as alpha from dd left join o on o.axis = dd.axis and o.i = dd.i and o.j = dd.j group by dd.axis)"""


_PAIR = """q as (select a.axis, sign(a.x - b.x) * sign(a.y - b.y) as s, a.x = b.x as tx, a.y = b.y as ty from p a join p b on a.axis = b.axis and a.image_id < b.image_id),
t as (select axis, count(*) filter (s > 0) as c, count(*) filter (s < 0) as d, count(*) filter (tx and not ty) as tx, count(*) filter (ty and not tx) as ty from q group by 1)"""
_SELF = """rp as (select a.axis, a.rater as r1, b.rater as r2, a.image_id, a.score as x, b.score as y from r a join r b on a.axis = b.axis and a.image_id = b.image_id and a.rater < b.rater),
sq as (select a.axis, a.r1, a.r2, avg(case when a.y = b.y then 0.5 when sign(a.x - b.x) = sign(a.y - b.y) then 1.0 else 0.0 end) as acc from rp a join rp b on a.axis = b.axis and a.r1 = b.r1 and a.r2 = b.r2 and a.image_id < b.image_id where a.x <> b.x group by 1, 2, 3)"""
_MODEL = """mp as (select r.axis, r.rater, r.image_id, r.score as x, m.model as y from r join mod m using (axis, image_id)),
mq as (select a.axis, a.rater, avg(case when a.y = b.y then 0.5 when sign(a.x - b.x) = sign(a.y - b.y) then 1.0 else 0.0 end) as acc from mp a join mp b on a.axis = b.axis and a.rater = b.rater and a.image_id < b.image_id where a.x <> b.x group by 1, 2)"""
_PASSES = """ps as (select axis, image_id, arg_min(score, (labelled_at, score, rater)) as old, arg_max(score, (labelled_at, score, rater)) as new from l where score between 1 and 5 group by 1, 2 having min(labelled_at) < max(labelled_at)),
lo as (select axis, image_id, old as score from ps union all select axis, image_id, new from ps),
p as (select axis, image_id, old as x, new as y from ps)"""

SQL = {
    "alpha_ordinal": f"with {_LABELS}, {_alpha_sql('r')} select al.axis, round(alpha, 6) as alpha, (select count(*) from u where u.axis = al.axis) as units, (select sum(m)::bigint from u where u.axis = al.axis) as ratings, case when alpha >= 0.8 then 'ship' when alpha >= 0.65 then 'rewrite-anchors' when alpha is not null then 'do-not-train' end as verdict from al",
    "spearman_axis": f"with {_LEVELS}, k as (select axis, rank() over (partition by axis order by x) + (count(*) over (partition by axis, x) - 1) / 2.0::double as rx, rank() over (partition by axis order by y) + (count(*) over (partition by axis, y) - 1) / 2.0::double as ry from p) select axis, round(corr(rx, ry), 6) as rho, count(*) as n from k group by 1",
    "kendall_axis": f"with {_LEVELS}, {_PAIR} select axis, round((c - d) / sqrt((c + d + tx)::double * (c + d + ty)), 6) as tau from t",
    "pairwise_axis": f"with {_LEVELS}, {_PAIR} select axis, round((c + ty / 2.0::double) / (c + d + ty), 6) as accuracy, round(c / (c + d)::double, 6) as rank_agreement from t",
    "agreement_axis": f"with {_LEVELS} select axis, round(avg((x = y)::int), 6) as exact, round(avg((abs(x - y) <= 1)::int), 6) as within_one, round(avg(abs(x - y)), 6) as mae, round(avg(x - y), 6) as bias, round(avg((abs(x - y) >= 2)::int), 6) as off_by_two, count(*) as n from p group by 1",
    "confusion_axis": f"with {_LEVELS}, ax as (select unnest(['sharpness', 'lighting', 'resolution', 'framing']) as axis), hx as (select unnest([1, 2, 3, 4, 5]) as human), mx as (select unnest([1, 2, 3, 4, 5]) as model) select ax.axis, human, model, count(p.axis) as n from ax cross join hx cross join mx left join p on p.axis = ax.axis and p.x = human and p.y = model group by 1, 2, 3",
    "unmatched_axis": f"with {_LEVELS} select axis, count(*) filter (model is null) as only_human, count(*) filter (human is null) as only_model from lev group by 1",
    "axis_distribution": f"with {_LABELS}, lv as (select unnest([1, 2, 3, 4, 5]) as level), n as (select axis, count(*) filter (score between 1 and 5) as n, count(*) filter (score not between 1 and 5) as off_scale from l group by 1), c as (select n.axis, level, off_scale, n.n, (select count(*) from l where l.axis is not distinct from n.axis and l.score = level) as count from n cross join lv) select axis, level, count, round(coalesce(count / nullif(n, 0)::double, 0), 6) as share, case when coalesce(count / nullif(n, 0)::double, 0) > 0.6 then 'dominant' when coalesce(count / nullif(n, 0)::double, 0) < 0.05 then 'rare' else '' end as flag, off_scale, n < 20 as provisional from c",
    "composite_histogram": f"with {M.SCORED_SQL}, s as (select {M._composite_sql('corporate')} as score from lv), b as (select unnest(range(1, 11))::int as bin) select bin, (select count(*) from s where floor(score + 0.5)::int = bin) as n, round((select count(*) from s where floor(score + 0.5)::int = bin) / (select count(*) from s)::double, 6) as share, (select round(avg(score), 6) from s) as mean, (select round(stddev_samp(score), 6) from s) as sd from b",
    "variance_contribution": f"with {M.SCORED_SQL}, f as (select *, sharpness * 0.16::double + lighting * 0.07::double + resolution * 0.09::double + framing * 0.18::double as s from lv where framing is not null), a as ({' union all '.join(f'select {chr(39)}{a}{chr(39)} as axis, {a} as v, {a} * {w}::double as wv, s from f' for a, w in zip(S.COMPUTED, S.WEIGHTS['corporate']))}) select axis, round(covar_samp(wv, s) / var_samp(s), 6) as share, round(stddev_samp(v), 6) as sd, abs(covar_samp(wv, s) / var_samp(s)) < 0.02 as dead_weight, count(*) as n from a group by 1",
    "self_agreement": f"with {_LABELS}, {_SELF} select axis, round(avg(acc), 6) as accuracy, count(*) as pairs from sq group by 1",
    "model_agreement": f"with {_LEVELS}, {_MODEL} select axis, round(avg(acc), 6) as accuracy, count(*) as raters from mq group by 1",
    "ceiling_report": f"with {_LEVELS}, {_SELF}, {_MODEL}, h as (select axis, avg(acc) as human from sq group by 1), m as (select axis, avg(acc) as model from mq group by 1) select axis, round(human, 6) as human, round(model, 6) as model, round(human - model, 6) as headroom, human is null or model is null as unmatched, case when model > human + 0.02 then 'above-ceiling' when model >= human - 0.02 then 'at-ceiling' when model is not null and human is not null then 'headroom' end as verdict, round(case when human = 0 then 0 * model else model / human end, 6) as fraction from h full join m using (axis)",
    "overlap_verdict": f"with {_LABELS}, {_PASSES}, {_alpha_sql('lo')}, {_PAIR}, f as (select axis, count(*) as overlap, avg(y - x) as \"offset\", median(x) as median_old, median(y) as median_new from p group by 1) select f.axis, overlap, round(alpha, 6) as alpha, round(c / (c + d)::double, 6) as rank_agreement, round(\"offset\", 6) as \"offset\", median_old, median_new, case when overlap < 20 then 'block' when alpha is null then 'block' when alpha < 0.65 and c / (c + d)::double >= 0.8 and abs(\"offset\") >= 0.5 then 'rescale' when alpha < 0.65 then 'block' else 'merge' end as verdict from f join al using (axis) join t using (axis)",
    "anchor_check": f"with {_LEVELS}, a as (select axis, image_id, min(score) as s from r group by 1, 2 having count(*) >= 4 and min(score) = max(score)) select axis, count(*) as anchors, count(*) filter (abs(model - s) <= 1) as ok from a join mod using (axis, image_id) group by 1",
    "ratings_by_unit": f"with {_LABELS} select axis, image_id, string_agg(rater || '=' || score, ';' order by rater) as ratings from r group by 1, 2",
    "large_disagreements": f"with {_LEVELS} select image_id, axis, x as human, y as model from p where abs(x - y) >= 2",
}
