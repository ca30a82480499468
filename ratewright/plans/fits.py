"""Queries on calibration: monotone fits of measured scalars to human levels, folds, splits and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import materialize, norm_key, read
from ratewright.functions.numeric import apply_knots
from ratewright.operators import agreement as A
from ratewright.operators import fitting as I
from ratewright.operators import scoring as S
from ratewright.plans import agreement as P
from ratewright.plans import datasets as D
from ratewright.plans import measures as M


def observations(spark: SparkSession, d: str) -> DataFrame:
    """``(axis, image_id, cluster, x, level)``: driving scalar and human level of each image, with its creator cluster."""
    v = M.vectors(spark, d).where(F.col("extractorVersion") == S.VERSION)
    basis = F.when(S.sharpness_basis() == "eyeRegion", F.col("sharpnessEyeRegion")).otherwise(F.col("sharpnessLaplacian"))
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.round(c, 9).alias("x")) for a, c in (("sharpness", basis), ("lighting", S.lighting_raw()), ("resolution", S.shorter_edge()), ("framing", S.framing_raw()))])
    x = v.select("sha256", F.explode(each).alias("e")).select("sha256", "e.*").where("x is not null")
    images = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256")).where("sha256 is not null").distinct()
    human = P.levels(spark, d).where("human is not null").select("axis", "image_id", F.col("human").alias("level"))
    return images.join(x, "sha256").join(human, ["axis", "image_id"]).join(D.clusters_from_creators(spark, d), "image_id").select("axis", "image_id", "cluster", "x", "level")


def isotonic_blocks(spark: SparkSession, d: str) -> DataFrame:
    return I.isotonic(observations(spark, d), ["axis"], "x", "level").select("axis", F.round("x", 6).alias("x"), F.round("fitted", 6).alias("fitted"), F.col("weight").cast("long").alias("weight"))


def isotonic_fitted(spark: SparkSession, d: str) -> DataFrame:
    """The fit at each distinct x of the resolution axis, as the block that holds it says."""
    return _fitted(observations(spark, d).where("axis = 'resolution'")).select("x", "fitted")


def isotonic_fitted_axes(spark: SparkSession, d: str) -> DataFrame:
    """The fit at each distinct x of every axis. The max-min form is too slow for its SQL; the tests state it on few rows."""
    return _fitted(observations(spark, d))


def _fitted(o: DataFrame) -> DataFrame:
    b = I.isotonic(o, ["axis"], "x", "level").groupBy("axis").agg(F.array_sort(F.collect_list(F.struct("x", "fitted"))).alias("b"))
    at = F.try_element_at(F.filter("b", lambda k: k["x"] >= F.col("x")), F.lit(1))["fitted"]
    return o.select("axis", "x").distinct().join(F.broadcast(b), "axis").select("axis", "x", F.round(at, 6).alias("fitted"))


def isotonic_knots(spark: SparkSession, d: str) -> DataFrame:
    k = I.fitted_knots(observations(spark, d), ["axis"], "x", "level")
    return k.select("axis", F.to_json("knots").alias("knots"), F.array_join("unreachable", ",").alias("unreachable"))


def calibration_folds(spark: SparkSession, d: str) -> DataFrame:
    return I.folds_by_rank(observations(spark, d), "cluster")


def cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rank correlation of each axis: one grouped fit of all axes and folds, applied to the fold left out."""
    o = materialize(observations(spark, d), "observations")
    o = o.join(F.broadcast(I.folds_by_rank(o, "cluster")) if o.count() < 1_000_000 else I.folds_by_rank(o, "cluster"), "cluster")
    train = o.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> held")
    k = I.fitted_knots(train, ["axis", "held"], "x", "level")
    p = o.join(k, (o["axis"] == k["axis"]) & (o["fold"] == k["held"])).select(o["axis"], "level", F.round(apply_knots(F.col("x"), F.col("knots")), 9).alias("p"))
    return A.rank_statistics(p, ["axis"], "level", "p").select("axis", F.round("rho", 6).alias("rho"), "n")


def boundary_threshold(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    out = None
    for k in (1, 2, 3, 4):
        b = I.boundary(o, ["axis"], "x", "level", k).withColumn("k", F.lit(k))
        out = b if out is None else out.unionByName(b)
    return out.select("axis", "k", F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


def threshold_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the framing scalar by the fixed thresholds .48, .67, .93 and .97."""
    o = observations(spark, d).where("axis = 'framing'")
    return o.select(I.apply_thresholds(F.col("x"), [0.48, 0.67, 0.93, 0.97]).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def class_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median scalar of each level with five examples or more."""
    g = observations(spark, d).groupBy("axis", "level").agg(F.count("*").alias("n"), F.expr("percentile(x, 0.5)").alias("median"))
    return g.where("n >= 5").select("axis", "level", "n", F.round("median", 6).alias("median"))


def split_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Train and test share of images per greedy cluster split at 0.8."""
    rows = D.clusters_from_creators(spark, d)
    sides, _ = I.split_two(I.cluster_sizes(rows, "cluster"), 0.8)
    table = spark.createDataFrame(sorted(sides.items()), "cluster string, side string")
    return rows.join(table, "cluster").select("image_id", "cluster", "side")


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Clusters in five folds of about equal size."""
    rows = D.clusters_from_creators(spark, d)
    table = I.greedy_bins(I.cluster_sizes(rows, "cluster"), 5)
    return spark.createDataFrame(sorted(table.items()), "cluster string, fold int")


def nested_folds(spark: SparkSession, d: str) -> DataFrame:
    """Outer folds of clusters, and of each outer training part its inner folds: ``(outer, inner, cluster)``."""
    sizes = I.cluster_sizes(D.clusters_from_creators(spark, d), "cluster")
    outer = I.greedy_bins(sizes, 3)
    out = []
    for k in range(3):
        inner = I.greedy_bins([s for s in sizes if outer[s[1]] != k], 2)
        out += [(k, f, c) for c, f in inner.items()]
    return spark.createDataFrame(out, "outer int, inner int, cluster string")


def calibration_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels and thin levels (under five) of each axis, with the share of the most frequent scalar."""
    o = observations(spark, d)
    per = o.groupBy("axis").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") == v).alias(f"l{v}") for v in A.LEVELS])
    thin = F.array_join(F.filter(F.array(*[F.when(F.col(f"l{v}") < 5, F.lit(str(v))) for v in A.LEVELS]), lambda x: x.isNotNull()), ",")
    m = o.groupBy("axis", "x").agg(F.count("*").alias("k")).groupBy("axis").agg(F.max("k").alias("k"))
    return per.join(m, "axis").select("axis", "n", thin.alias("thin"), F.round(F.col("k") / F.col("n"), 6).alias("mode_share"))


QUERIES = {f.__name__: f for f in (isotonic_blocks, isotonic_fitted, isotonic_fitted_axes, isotonic_knots, calibration_folds, cross_validated, boundary_threshold, threshold_levels, class_medians, split_by_cluster, group_folds, nested_folds, calibration_counts)}

_OBS = f"""{P._LEVELS}, cl as ({D.SQL['clusters_from_creators'].replace('with r as', 'with rr as').replace('from r', 'from rr')}),
sx as ({' union all '.join(f"select sha256, '{a}' as axis, round({c}, 9) as x from axes where ev = 'v8' and {c} is not null" for a, c in (('sharpness', 'sharp_raw'), ('lighting', 'lighting_raw'), ('resolution', 'edge'), ('framing', 'framing_raw')))}),
ob as (select h.axis, h.image_id, cluster, x, human as level from im join sx using (sha256) join hum h on h.axis = sx.axis and h.image_id = im.image_id join cl on cl.image_id = h.image_id)"""

_CL = f"cl as ({D.SQL['clusters_from_creators'].replace('with r as', 'with rr as').replace('from r', 'from rr')})"


def _greedy(sizes: str, bins: int, name: str, part: str) -> str:
    """Clusters of ``sizes (part, cluster, n)`` from the largest, each to the bin that holds least: one recursive step a cluster."""
    return f"""{name}_o as (select *, row_number() over (partition by {part} order by n desc, cluster) as k from {sizes}),
{name} as (select {part}, 0::bigint as k, null::varchar as cluster, null::int as fold, [{', '.join(['0::bigint'] * bins)}] as loads from (select distinct {part} from {sizes})
  union all select o.{part}, o.k, o.cluster, list_position(g.loads, list_min(g.loads))::int - 1, [case when i = list_position(g.loads, list_min(g.loads)) then g.loads[i] + o.n else g.loads[i] end for i in range(1, {bins + 1})]
  from {name} g join {name}_o o on o.{part} = g.{part} and o.k = g.k + 1)"""


SQL = {
    "group_folds": f"with recursive {_CL}, z as (select 0 as part, cluster, count(*) as n from cl group by cluster), {_greedy('z', 5, 'g', 'part')} select cluster, fold from g where k > 0",
    "nested_folds": f"""with recursive {_CL}, z as (select 0 as part, cluster, count(*) as n from cl group by cluster), {_greedy('z', 3, 'g', 'part')}, y as (select q.part, z.cluster, n from z join g on g.cluster = z.cluster join (select unnest([0, 1, 2]) as part) q on g.fold <> q.part),
      {_greedy('y', 2, 'h', 'part')} select part::int as outer, fold as inner, cluster from h where k > 0""".replace("as outer", 'as "outer"').replace("as inner", 'as "inner"'),
    "split_by_cluster": f"""with recursive {_CL}, z as (select cluster, count(*) as n from cl group by cluster), o as (select *, row_number() over (order by n desc, cluster) as k, sum(n) over () as total from z),
      g as (select 0::bigint as k, null::varchar as cluster, null::varchar as side, 0::hugeint as a, 0::hugeint as b union all select o.k, o.cluster, case when (total * 0.8::double - g.a) / (total * 0.8::double) >= (total * (1 - 0.8::double) - g.b) / (total * (1 - 0.8::double)) then 'train' else 'test' end,
        case when (total * 0.8::double - g.a) / (total * 0.8::double) >= (total * (1 - 0.8::double) - g.b) / (total * (1 - 0.8::double)) then g.a + n else g.a end, case when (total * 0.8::double - g.a) / (total * 0.8::double) >= (total * (1 - 0.8::double) - g.b) / (total * (1 - 0.8::double)) then g.b else g.b + n end from g join o on o.k = g.k + 1)
      select image_id, cluster, side from cl join g using (cluster)""",
    "isotonic_fitted": f"""with {_OBS}, g as (select x, avg(level) as y, count(*) as w from ob where axis = 'resolution' group by 1), c as (select x, sum(w) over (order by x) as cw, sum(w * y) over (order by x) as cs, w, y from g),
      m as (select a.x as lo, b.x as hi, (b.cs - a.cs + a.w * a.y) / (b.cw - a.cw + a.w) as mean from c a join c b on a.x <= b.x),
      s as (select p.x, m.lo, min(m.mean) as least from g p join m on m.lo <= p.x and m.hi >= p.x group by 1, 2) select x, round(max(least), 6) as fitted from s group by 1""",
    "calibration_folds": f"with {_OBS} select cluster, ((dense_rank() over (order by cluster) - 1) % 5)::int as fold from (select distinct cluster from ob)",
    "boundary_threshold": f"""with {_OBS}, ks as (select unnest([1, 2, 3, 4]) as k), bv as (select axis, k, x, lead(x) over (partition by axis, k order by x) as nx from (select distinct axis, x from ob) cross join ks),
      t as (select bv.axis, bv.k, (bv.x + nx) / 2 as t, (count(*) filter (level <= bv.k and o.x <= bv.x) / nullif(count(*) filter (level <= bv.k), 0)::double + count(*) filter (level > bv.k and o.x > bv.x) / nullif(count(*) filter (level > bv.k), 0)::double) / 2 as s from bv join ob o on o.axis = bv.axis where nx is not null group by bv.axis, bv.k, bv.x, nx)
      select axis, k, round(t, 6) as threshold, round(round(s, 12), 6) as score from t where s is not null qualify row_number() over (partition by axis, k order by round(s, 12) desc, t) = 1""",
    "threshold_levels": f"with {_OBS} select least(5, 1 + (x > 0.48)::int + (x > 0.67)::int + (x > 0.93)::int + (x > 0.97)::int) as level, count(*) as n from ob where axis = 'framing' group by 1",
    "class_medians": f"with {_OBS} select axis, level, count(*) as n, round(median(x), 6) as median from ob group by 1, 2 having count(*) >= 5",
    "calibration_counts": f"with {_OBS}, lv as (select unnest([1, 2, 3, 4, 5]) as v), n as (select axis, count(*) as n from ob group by 1), th as (select n.axis, string_agg(v::varchar, ',' order by v) as thin from n cross join lv where (select count(*) from ob where ob.axis = n.axis and level = v) < 5 group by 1), m as (select axis, max(k) as k from (select axis, count(*) as k from ob group by axis, x) group by 1) select n.axis, n, coalesce(thin, '') as thin, round(k / n::double, 6) as mode_share from n join m using (axis) left join th using (axis)",
}
