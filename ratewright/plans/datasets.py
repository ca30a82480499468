"""Queries on the image manifest: duplicates, groups, frequencies, quantiles, quotas and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import norm_key, read
from ratewright.functions.text import mime_of
from ratewright.operators import agreement as A
from ratewright.operators import grouping as G
from ratewright.operators import summary as Y
from ratewright.plans import agreement as P
from ratewright.plans import measures as M


def images(spark: SparkSession, d: str) -> DataFrame:
    return (
        read(spark, d, "dataset_image")
        .select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha256"), "perceptual_hash", norm_key("dataset_role").alias("role"), norm_key("source").alias("source"), "creator", "width", "height")
        .where("image_id is not null").distinct()
    )


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = images(spark, d).select("image_id", "sha256").distinct()
    return G.duplicate_of(rows, "image_id", "sha256").where("duplicate_of is not null").select("image_id", "duplicate_of")


def first_of_content(spark: SparkSession, d: str) -> DataFrame:
    """First image of each content in source and id order."""
    rows = images(spark, d).where("sha256 is not null")
    return rows.groupBy("sha256").agg(F.min(F.struct("source", "image_id")).alias("f")).select("sha256", "f.*")


def corpus_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Collected photos whose content is an image already (semi join), and those that are new (anti join), per role."""
    m = read(spark, d, "manifest").select(norm_key("sha256").alias("sha256")).where("sha256 is not null").distinct()
    i = images(spark, d).where("sha256 is not null").select("sha256", "role").distinct()
    known = m.join(i, "sha256").groupBy("role").agg(F.countDistinct("sha256").alias("n"))
    return known.unionByName(m.join(i, "sha256", "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("role"), "n"))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = images(spark, d).select("image_id", G.hash_code(F.col("perceptual_hash")).alias("code")).where("code is not null").distinct()
    near = G.near_pairs(c)
    a, b = c.select(F.col("image_id").alias("i"), F.col("code").alias("code_a")), c.select(F.col("image_id").alias("j"), F.col("code").alias("code_b"))
    out = near.join(a, "code_a").join(b, "code_b").select(F.least("i", "j").alias("image_a"), F.greatest("i", "j").alias("image_b"), F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))).alias("bits"))
    return out.where("image_a <> image_b").distinct()


def phash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Single linkage over fingerprints within 6 bits: each fingerprint of a group and the group's least."""
    c = images(spark, d).select(G.hash_code(F.col("perceptual_hash")).alias("code"))
    pairs = G.near_pairs(c).select(G.hexed("code_a").alias("a"), G.hexed("code_b").alias("b"))
    return G.least_labels(pairs).select(F.col("vertex").alias("hash"), F.col("label").alias("keeper"))


def near_duplicate_images(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images with different content and fingerprints within 6 bits, equal ones included; of null content each differs."""
    return G.near_images(images(spark, d).select("image_id", "sha256", G.hash_code(F.col("perceptual_hash")).alias("code")))


def phash_members(spark: SparkSession, d: str) -> DataFrame:
    """Group of each image with a fingerprint, by single linkage within 6 bits: its fingerprint, the group's least and its first image."""
    return G.image_groups(images(spark, d).select("image_id", G.hash_code(F.col("perceptual_hash")).alias("code")))


def creator_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "dataset_image").select("creator").distinct()
    return rows.select("creator", G.creator_group(F.col("creator")).alias("creator_group"))


def clusters_from_creators(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of each image: its creator where that has several images, else the image itself."""
    rows = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), G.source_cluster(F.col("creator")).alias("g")).where("image_id is not null").distinct()
    several = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "g", "left").select("image_id", F.when(F.col("n") > 1, F.concat(F.lit("creator:"), "g")).otherwise(F.concat(F.lit("image:"), "image_id")).alias("cluster"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("image_id", "source", "role").distinct().rollup("source", "role").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("TOTAL")).alias("source"), F.coalesce("role", F.lit("ALL")).alias("role"), "n")


def resolution_spread(spark: SparkSession, d: str) -> DataFrame:
    """Megapixels by nearest rank, and how many different sizes."""
    rows = images(spark, d).where("width is not null and height is not null").select("image_id", "width", "height").distinct()
    c = Y.with_totals(Y.value_counts(rows.withColumn("mp", F.col("width") * F.col("height") / 1e6), [], "mp"), [])
    t = F.first("total")
    q = c.withColumn("p10", F.greatest(F.lit(0), F.ceil(F.col("total") * 0.1) - 1)).withColumn("p50", F.ceil(F.col("total") * 0.5) - 1).withColumn("p90", F.ceil(F.col("total") * 0.9) - 1)
    out = q.agg(t.alias("n"), *[Y.at_index(F.col(p)).alias(p) for p in ("p10", "p50", "p90")])
    sizes = rows.agg(F.countDistinct("width", "height").alias("sizes"))
    return out.select("n", *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")], F.lit(0).alias("j")).join(sizes.withColumn("j", F.lit(0)), "j").drop("j")


SCALARS = ["sharpnessLaplacian", "jpegQualityEstimate", "exposureMean", "dynamicRange", "faceAreaRatio", "yaw"]


def _long(spark: SparkSession, d: str) -> DataFrame:
    v = M.vectors(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).alias("v")) for s in SCALARS])).alias("x")
    return v.select("sha256", each).select("sha256", "x.*").where("v is not null")


def describe_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Count, extremes, quartiles at ``floor(q n)``, distinct values and mode share of each measurement."""
    c = Y.with_totals(Y.value_counts(_long(spark, d), ["field"], "v"), ["field"])
    pos = {p: F.least(F.col("total") - 1, F.floor(F.col("total") * q)) for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    c = c.withColumns(pos)
    return c.groupBy("field").agg(F.first("total").alias("n"), F.min("value").alias("low"), *[Y.at_index(F.col(p)).alias(p) for p in pos], F.max("value").alias("high"), F.count("*").alias("different"), F.round(F.max("n") / F.first("total"), 6).alias("mode_share"))


def distribution_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles at ``floor((n - 1) q)``."""
    c = Y.with_totals(Y.value_counts(_long(spark, d), ["field"], "v"), ["field"])
    pos = {f"p{int(q * 100)}": F.floor((F.col("total") - 1) * q).cast("bigint") for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return c.withColumns(pos).groupBy("field").agg(*[Y.at_index(F.col(p)).alias(p) for p in pos])


def modes(spark: SparkSession, d: str) -> DataFrame:
    """The commonest level of each axis and its share; of equals the one that was labelled first."""
    rows = P.labels(spark, d).where("score between 1 and 5").select("axis", "score", F.struct("labelled_at", "image_id", "rater").alias("seen"))
    return Y.mode(rows, ["axis"], "score", "seen").select("axis", "mode", F.round("share", 6).alias("share"))


def coverage_bins(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width bins of three log or raw scalars, how many contents lie in each."""
    v = M.vectors(spark, d).select(F.log1p("sharpnessLaplacian").alias("sharpness"), F.log1p(F.least("width", "height")).alias("resolution"), F.col("exposureMean").alias("exposure"))
    names = ["sharpness", "resolution", "exposure"]
    bounds = v.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).withColumn("j", F.lit(0))
    rows = v.withColumn("j", F.lit(0)).join(F.broadcast(bounds), "j")  # bounds is one row
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scalar"), Y.equal_width_bin(F.col(n), F.col(f"{n}_lo"), F.col(f"{n}_hi")).alias("bin")) for n in names])).alias("x")
    return rows.select(each).groupBy("x.scalar", "x.bin").agg(F.count("*").alias("n"))


def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Raters who gave one image and axis two levels."""
    l = P.labels(spark, d).where("score between 1 and 5 and rater is not null")  # noqa: E741
    return G.merge_labels(l, l.limit(0), ["image_id", "axis", "rater"], "score")[1].select("image_id", "axis", "rater", F.col("score").alias("low"), F.col("other").alias("high"))


def merge_human_labels(spark: SparkSession, d: str) -> DataFrame:
    l = P.labels(spark, d).where("score between 1 and 5 and rater is not null")  # noqa: E741
    late = l.where("labelled_at >= '2026-06-01'")
    return G.merge_labels(l.where("labelled_at < '2026-06-01'"), late, ["image_id", "axis", "rater"], "score")[0]


def cache_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "feature_cache").select("sha256", "extractor_version", "extracted_at", "computed")
    return G.first_writes(rows, ["sha256", "extractor_version"], "extracted_at").select("sha256", "extractor_version", F.md5("computed").alias("computed"))


def features_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "feature_cache").select("sha256", "extracted_at", "extractor_version", "computed")
    return G.last_writes(rows, ["sha256"], "extracted_at").select("sha256", "extractor_version", F.md5("computed").alias("computed"))


def latest_image_state(spark: SparkSession, d: str) -> DataFrame:
    """The last written status of each image."""
    rows = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), "ingested_at", "feature_status", "vlm_status", "human_label_status")
    return G.last_writes(rows, ["image_id"], "ingested_at").drop("ingested_at")


def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    """What pruning all but the current version would delete."""
    c = read(spark, d, "feature_cache")
    return c.groupBy((F.col("extractor_version") != "v8").alias("stale")).agg(F.count("*").alias("n"))


def manifest_index(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the manifest (page and source) with the number of rows that name them, repeated ones only."""
    m = read(spark, d, "manifest").select(F.explode(F.array_distinct(F.array("url", "sourceurl"))).alias("address"))
    return m.where("address is not null").groupBy("address").agg(F.count("*").alias("n")).where("n > 1")


def quota_plan(spark: SparkSession, d: str) -> DataFrame:
    """Largest-remainder split of 1000 rows over the variants, then evenly over each variant's queries."""
    m = read(spark, d, "manifest").select(norm_key("queryvariant").alias("variant"), norm_key("query").alias("query")).where("query is not null").distinct()
    share = {"good": 0.3, "mediocre": 0.3, "bad": 0.3, "edge": 0.1}
    v = spark.createDataFrame([(k, s, n) for n, (k, s) in enumerate(share.items())], "variant string, share double, place int")
    have = m.join(F.broadcast(v), "variant")
    per = have.groupBy("variant", "share", "place").agg(F.count("*").alias("queries"))
    w = Window.partitionBy(F.lit(0))  # as many rows as variants
    per = per.withColumn("exact", F.col("share") / F.sum("share").over(w) * 1000).withColumn("base", F.floor("exact"))
    per = per.withColumn("short", F.lit(1000) - F.sum("base").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "place")))
    per = per.withColumn("rows", F.col("base") + F.when(F.col("r") <= F.col("short"), 1).otherwise(0))
    q = have.select("variant", "query").withColumn("k", F.row_number().over(Window.partitionBy("variant").orderBy("query"))).join(per.select("variant", "rows", "queries"), "variant")
    return q.select("variant", "query", (F.floor(F.col("rows") / F.col("queries")) + F.when(F.col("k") <= F.col("rows") % F.col("queries"), 1).otherwise(0)).alias("wanted"))


def quota_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "manifest").select(norm_key("sha256").alias("sha256"), norm_key("queryvariant").alias("variant"), norm_key("query").alias("query")).where("variant is not null and query is not null").distinct()
    return m.rollup("variant", "query").agg(F.count("*").alias("have")).select(F.coalesce("variant", F.lit("TOTAL")).alias("variant"), F.coalesce("query", F.lit("")).alias("query"), "have")


#: First bytes of a JPEG, PNG, WebP and HEIF file and of none of them (fixed values).
HEADS = ["FFD8FFE000104A46", "89504E470D0A1A0A0000", "524946462400000057454250", "000000186674797068656963", "474946383961"]
TYPES = ["image/jpeg", " IMAGE/PNG", "image/webp; q=1", "image/heif", "text/plain", None]


def mime_checks(spark: SparkSession, d: str) -> DataFrame:
    """Declared type against the type by a file's first bytes, here those that event numbers stand for; parameters, case and
    outer space don't matter.
    """
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    e = read(spark, d, "events").select(pick(TYPES, F.col("event_id")).alias("declared"), F.unhex(pick(HEADS, F.col("event_id") * 7 + F.col("user_id"))).alias("content"))
    told = F.lower(F.trim(F.split_part("declared", F.lit(";"), F.lit(1))))
    return e.select(told.alias("told"), mime_of(F.col("content")).alias("real")).groupBy("told", "real").agg(F.count("*").alias("n"), F.count_if(F.col("told") == F.col("real")).alias("agree"))


def axis_flags(spark: SparkSession, d: str) -> DataFrame:
    """What is odd about the levels of each axis, in words; ``collapsed`` if one level holds over 60 %."""
    a = A.distribution_flags(P.labels(spark, d), ["axis"], "score")
    return a.select("axis", "n", "collapsed", "provisional", "off_scale", F.array_join("flags", "; ").alias("flags"))


QUERIES = {
    f.__name__: f
    for f in (exact_duplicates, first_of_content, corpus_collisions, near_duplicate_pairs, phash_groups, near_duplicate_images, phash_members, creator_groups, clusters_from_creators, source_counts, resolution_spread, describe_scalars, distribution_deciles, modes, coverage_bins, label_conflicts, merge_human_labels, cache_first_wins, features_last_wins, latest_image_state, cache_prune, manifest_index, quota_plan, quota_rollup, mime_checks, axis_flags)
}

_K = P._K
_IMG = f"img as (select distinct {_K('image_id')} as image_id, {_K('sha256')} as sha256, perceptual_hash, {_K('dataset_role')} as role, {_K('source')} as source, creator, width, height from dataset_image where {_K('image_id')} is not null)"
_CODE = f"{_IMG}, c as (select distinct image_id, cast(('0x' || lower(trim(perceptual_hash))) as ubigint) as h from img where regexp_full_match(lower(trim(perceptual_hash)), '[0-9a-f]{{16}}'))"
_GROUP = "case when trim(creator) <> '' and not regexp_matches(creator, '(?i)^\\s*(unknown|not stated|no(t)? known|anonymous|n\\/?a|none|-)\\b') then 'creator:' || lower(regexp_replace(trim(creator), '\\s+', ' ', 'g')) end"
_LONG = f"{M.VECTORS_SQL}, lg as ({' union all '.join(f'select {chr(39)}{s}{chr(39)} as field, {s} as v from v where {s} is not null' for s in SCALARS)}), a as (select field, list(v order by v) as s, count(*) as n from lg group by 1)"

SQL = {
    "exact_duplicates": f"with {_IMG}, f as (select sha256, min(image_id) as f from img where sha256 is not null group by 1) select distinct image_id, f as duplicate_of from img join f using (sha256) where image_id <> f",
    "first_of_content": f"with {_IMG} select sha256, source, image_id from (select distinct sha256, source, image_id from img where sha256 is not null) qualify row_number() over (partition by sha256 order by source, image_id) = 1",
    "corpus_collisions": f"with {_IMG}, m as (select distinct {_K('sha256')} as sha256 from manifest where {_K('sha256')} is not null) select role, count(distinct sha256) as n from m join img using (sha256) group by 1 union all select 'new', count(*) from m where sha256 not in (select sha256 from img where sha256 is not null)",
    "near_duplicate_pairs": f"with {_CODE} select distinct a.image_id as image_a, b.image_id as image_b, bit_count(xor(a.h, b.h))::int as bits from c a join c b on a.image_id < b.image_id and a.h <> b.h and bit_count(xor(a.h, b.h)) <= 6",
    "phash_groups": f"with recursive {_CODE}, h as (select distinct h from c), e as (select a.h as a, b.h as b from h a join h b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 6), w as (select a as v, a as u from e union select w.v, e.b from w join e on e.a = w.u) select printf('%016x', v) as hash, min(printf('%016x', u)) as keeper from w group by v",
    "near_duplicate_images": f"with {_IMG}, c as (select distinct image_id, sha256, cast(('0x' || lower(trim(perceptual_hash))) as ubigint) as h from img where regexp_full_match(lower(trim(perceptual_hash)), '[0-9a-f]{{16}}')) select distinct a.image_id as image_a, b.image_id as image_b, bit_count(xor(a.h, b.h))::int as bits from c a join c b on a.image_id < b.image_id and (a.sha256 = b.sha256) is not true and bit_count(xor(a.h, b.h)) <= 6",
    "phash_members": f"with recursive {_CODE}, h as (select distinct h from c), e as (select a.h as a, b.h as b from h a join h b on bit_count(xor(a.h, b.h)) <= 6), w as (select a as v, a as u from e union select w.v, e.b from w join e on e.a = w.u), g as (select v as h, min(u) as k from w group by v) select image_id, printf('%016x', h) as hash, printf('%016x', k) as keeper, min(image_id) over (partition by k) as first_image, count(distinct image_id) over (partition by k) as images from c join g using (h)",
    "creator_groups": f"select distinct creator, {_GROUP} as creator_group from dataset_image",
    "clusters_from_creators": f"with r as (select distinct {_K('image_id')} as image_id, case when trim(creator) <> '' and not regexp_matches(trim(creator), '(?i)^\\s*(unknown|not stated|no(t)? known|anonymous|n\\/?a|none|-)\\s*') then trim(creator) end as g from dataset_image where {_K('image_id')} is not null) select image_id, case when g is not null and count(*) over (partition by g) > 1 then 'creator:' || g else 'image:' || image_id end as cluster from r",
    "source_counts": f"with {_IMG} select coalesce(source, 'TOTAL') as source, coalesce(role, 'ALL') as role, count(*) as n from (select distinct image_id, source, role from img) group by rollup(source, role)",
    "resolution_spread": f"with {_IMG}, s as (select distinct image_id, width, height from img where width is not null and height is not null), l as (select list(width * height / 1e6 order by width * height / 1e6) as m, count(*) as n, count(distinct (width, height)) as sizes from s) select n, round(m[ceil(n * 0.1::double)::int], 6) as p10, round(m[ceil(n * 0.5::double)::int], 6) as p50, round(m[ceil(n * 0.9::double)::int], 6) as p90, sizes from l",
    "describe_scalars": f"with {_LONG} select field, n, s[1] as low, s[least(n - 1, floor(n * 0.25)::int) + 1] as p25, s[least(n - 1, floor(n * 0.5)::int) + 1] as p50, s[least(n - 1, floor(n * 0.75)::int) + 1] as p75, s[n] as high, len(list_distinct(s)) as different, (select round(max(k) / a.n::double, 6) from (select count(*) as k from lg where lg.field = a.field group by v)) as mode_share from a",
    "distribution_deciles": f"with {_LONG} select field, s[floor((n - 1) * 0.1::double)::int + 1] as p10, s[floor((n - 1) * 0.25::double)::int + 1] as p25, s[floor((n - 1) * 0.5::double)::int + 1] as p50, s[floor((n - 1) * 0.75::double)::int + 1] as p75, s[floor((n - 1) * 0.9::double)::int + 1] as p90 from a",
    "coverage_bins": f"with {M.VECTORS_SQL}, x as (select 'sharpness' as scalar, ln(1 + sharpnessLaplacian) as s from v union all select 'resolution', ln(1 + least(width, height)) from v union all select 'exposure', exposureMean from v), b as (select scalar, min(s) as lo, max(s) as hi from x group by 1) select scalar, case when s is null or hi <= lo then 0 else least(7, floor((s - lo) / (hi - lo) * 8)::int) end as bin, count(*) as n from x join b using (scalar) group by 1, 2",
    "label_conflicts": f"with {P._LABELS} select image_id, axis, rater, min(score) as low, max(score) as high from l where score between 1 and 5 and rater is not null group by 1, 2, 3 having min(score) <> max(score)",
    "merge_human_labels": f"with {P._LABELS} select image_id, axis, rater, min(score) as score from l where score between 1 and 5 and rater is not null group by 1, 2, 3 having min(score) = max(score)",
    "cache_first_wins": "select sha256, extractor_version, md5(arg_min(computed, (extracted_at, computed))) as computed from feature_cache group by 1, 2",
    "features_last_wins": "select sha256, arg_max(extractor_version, (extracted_at, extractor_version, computed)) as extractor_version, md5(arg_max(computed, (extracted_at, extractor_version, computed))) as computed from feature_cache group by 1",
    "latest_image_state": f"select {_K('image_id')} as image_id, feature_status, vlm_status, human_label_status from dataset_image qualify row_number() over (partition by {_K('image_id')} order by ingested_at desc, feature_status desc, vlm_status desc, human_label_status desc) = 1",
    "cache_prune": "select extractor_version <> 'v8' as stale, count(*) as n from feature_cache group by 1",
    "manifest_index": "with m as (select url as address from manifest union all select sourceurl from manifest where sourceurl is distinct from url) select address, count(*) as n from m where address is not null group by 1 having count(*) > 1",
    "quota_plan": f"""with m as (select distinct {_K('queryvariant')} as variant, {_K('query')} as query from manifest where {_K('query')} is not null), v as (select * from (values ('good', 0.3::double, 0), ('mediocre', 0.3, 1), ('bad', 0.3, 2), ('edge', 0.1, 3)) t(variant, share, place)),
      p as (select variant, share, place, count(*) as queries from m join v using (variant) group by 1, 2, 3), e as (select *, share / sum(share) over () * 1000 as exact from p), f as (select *, floor(exact) as base from e), g as (select *, 1000 - sum(base) over () as short, row_number() over (order by round(exact - base, 9) desc, place) as r from f),
      h as (select variant, (base + (r <= short)::int)::bigint as total, queries from g), q as (select variant, query, row_number() over (partition by variant order by query) as k from m join v using (variant)) select variant, query, total // queries + (k <= total % queries)::int as wanted from q join h using (variant)""",
    "quota_rollup": f"with m as (select distinct {_K('sha256')} as sha256, {_K('queryvariant')} as variant, {_K('query')} as query from manifest where {_K('queryvariant')} is not null and {_K('query')} is not null) select coalesce(variant, 'TOTAL') as variant, coalesce(query, '') as query, count(*) as have from m group by rollup(variant, query)",
    "mime_checks": f"""with e as (select lower(trim(split_part({[t or '' for t in TYPES]}[event_id % {len(TYPES)} + 1], ';', 1))) as t, {['image/jpeg', 'image/png', 'image/webp', 'image/heif', '']}[(event_id * 7 + user_id) % {len(HEADS)} + 1] as h from events), x as (select nullif(t, '') as told, nullif(h, '') as real from e)
      select told, real, count(*) as n, count(*) filter (told = real) as agree from x group by 1, 2""",
    "axis_flags": f"""with {P._LABELS}, lv as (select unnest([1, 2, 3, 4, 5]) as level), n as (select axis, count(*) filter (score between 1 and 5) as n, count(*) filter (score not between 1 and 5) as off from l group by 1 having count(*) filter (score between 1 and 5) > 0),
      c as (select n.axis, level, n.n, off, (select count(*) from l where l.axis is not distinct from n.axis and l.score = level) as k from n cross join lv), s as (select *, k / n::double as share from c),
      f as (select axis, any_value(n) as n, any_value(off) as off_scale, bool_or(share > 0.6) as collapsed, string_agg(case when share > 0.6 then printf('level %d holds %.1f%% of ratings - the axis is close to constant', level, share * 100) when share < 0.05 then printf('level %d holds %.1f%% (%d) - raters are not using it', level, share * 100, k) end, '; ' order by level) as t from s group by axis)
      select axis, n, collapsed, n < 20 as provisional, off_scale, concat_ws('; ', t, case when off_scale > 0 then off_scale || ' rating(s) were not one of 1/2/3/4/5' end, case when n < 20 then 'only ' || n || ' ratings; under 20 the flags above are noise, not evidence' end) as flags from f""",
    "modes": f"with {P._LABELS}, c as (select axis, score, count(*) as n, min((labelled_at, image_id, rater)) as seen, sum(count(*)) over (partition by axis) as t from l where score between 1 and 5 group by 1, 2) select axis, score as mode, round(n / t, 6) as share from c qualify row_number() over (partition by axis order by n desc, seen) = 1",
}
