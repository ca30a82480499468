"""Queries of the training-data problems, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import read
from ratewright.llm import consensus, groups, neighbours, overlap, packing, quotas, splits, stuffing, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "human_label")).select("image_id", "axis", "score")


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "human_label"))


def p1_raters(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rater_reliability(read(spark, d, "human_label"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.linked_groups(read(spark, d, "dataset_image"), read(spark, d, "match_pairs"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.all_groups(read(spark, d, "dataset_image"), read(spark, d, "match_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "feature_cache").where(F.trim("extractor_version") == "v8")
    return neighbours.similar_pairs(vectors).select(F.col("a").alias("sha256_a"), F.col("b").alias("sha256_b"))


def _quota(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read(spark, d, "manifest"), read(spark, d, "dataset_image"), read(spark, d, "quota_target")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quotas.unmet_targets(*_quota(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.quota_report(*_quota(spark, d))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.quota_sample(*_quota(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.parted_sets(read(spark, d, "dataset_image"))


def p6_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(read(spark, d, "dataset_image"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(splits.assign_splits(read(spark, d, "dataset_image")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(read(spark, d, "dataset_image"))
    return pairs.select(F.least("image_t", "image_e").alias("image_id_a"), F.greatest("image_t", "image_e").alias("image_id_b")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(read(spark, d, "dataset_image"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(read(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "container_spec"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    specs = read(spark, d, "container_spec")
    return packing.packing_report(packing.pack_documents(read(spark, d, "documents"), specs), specs)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.score_texts(read(spark, d, "documents")).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.score_texts(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_agreement, p1_raters, p3_found, p3_groups, p4_found, p5_found, p5_report, p5_sample, p6_found, p6_split, p6_report, p7_found, p7_report, p8_ids, p9_pack, p9_report, p10_found, p10_scores)
}

KEY = "nullif(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), '')"

_P3_LINKS = f"""
ids as (select distinct {KEY.format('image_id')} as i from dataset_image),
raw as (
  select {KEY.format('left_image_id')} as a, {KEY.format('right_image_id')} as b from match_pairs where {KEY.format('verdict')} = 'match'
  union select {KEY.format('image_id')}, {KEY.format('duplicate_of')} from dataset_image),
links as (select a, b from raw where a in (select i from ids) and b in (select i from ids) and a <> b),
e as (select a, b from links union select b, a from links),
walk as (select a as v, a as u from e union select w.v, e.b from walk w join e on e.a = w.u),
grp as (select v as image_id, min(u) as group_id from walk group by v)"""

_P5 = f"""
m as (select distinct {KEY.format('sha256')} as s, {KEY.format('queryvariant')} as v, {KEY.format('query')} as q from manifest
      where {KEY.format('queryvariant')} in ('good', 'mediocre', 'bad', 'edge') and {KEY.format('query')} is not null),
i as (select distinct {KEY.format('sha256')} as s, {KEY.format('cohort')} as c from dataset_image where {KEY.format('cohort')} is not null),
pool as (select m.s, v, q, c from m join i on m.s = i.s),
size as (select count(distinct s) as n from pool),
fits as (select t.target_id, t.share, t.sample_rate, t.min_rows, count(distinct pool.s) as n
  from quota_target t left join pool on ({KEY.format('t.queryvariant')} is null or {KEY.format('t.queryvariant')} = v)
    and ({KEY.format('t.query')} is null or {KEY.format('t.query')} = q) and ({KEY.format('t.cohort')} is null or {KEY.format('t.cohort')} = c)
  group by all)"""

def _passed(before: str, after: str, family: str) -> str:
    """What the targets of a family lack passes to those with spare stock, in proportion to it."""
    return f"""
{after}_f as (select *, sum(lacks) over w as unmet, sum(spare) over w as room from {before} window w as (partition by target_set, {family})),
{after}_p as (select *, least(unmet, room) as amount, least(unmet, room) * spare / nullif(room, 0) as part from {after}_f),
{after}_r as (select *, amount - sum(coalesce(floor(part), 0)) over (partition by target_set, {family}) as rest,
  row_number() over (partition by target_set, {family} order by part - floor(part) desc nulls last, target_id) as r,
  sum(lacks) over (partition by target_set, {family} order by target_id) - lacks as earlier from {after}_p),
{after}_m as (select *, coalesce(floor(part), 0)::bigint + case when r <= rest and floor(part) < spare then 1 else 0 end as more from {after}_r),
{after} as (select target_id, target_set, v, q, need, n, wanted, given + more as given, spare - more as spare, lacks - greatest(0, least(lacks, amount - earlier)) as lacks from {after}_m)"""


#: The targets of a set are disjoint in the tables, so their stocks are their own.
_P5_REPORT = f"""{_P5},
wanted as (select fits.target_id, coalesce(t.target_set, '') as target_set, coalesce({KEY.format('t.queryvariant')}, '') as v, coalesce({KEY.format('t.query')}, '') as q,
  greatest(fits.share * fits.sample_rate * size.n, fits.min_rows)::double as need, fits.n, ceil(greatest(fits.share * fits.sample_rate * size.n, fits.min_rows) - 1e-9)::bigint as wanted
  from fits join quota_target t using (target_id), size),
l0 as (select *, least(wanted, n) as given, n - least(wanted, n) as spare, wanted - least(wanted, n) as lacks from wanted),
{_passed("l0", "l1", "v, q")},
{_passed("l1", "l2", "v")},
{_passed("l2", "l3", "1")}"""

_P6 = f"""
img as (select distinct {KEY.format('image_id')} as i, {KEY.format('creator_group')} as c, {KEY.format('source_group')} as s, {KEY.format('split_group')} as g,
        {KEY.format('dataset_role')} as r from dataset_image),
k as (select i, 'c' || c as k from img where c is not null union select i, 's' || s from img where s is not null union select i, 'g' || g from img where g is not null),
hub as (select k, min(i) as h from k group by k),
e as (select i as a, h as b from k join hub using (k) where i <> h union select h, i from k join hub using (k) where i <> h),
walk as (select a as v, a as u from e union select w.v, e.b from walk w join e on e.a = w.u),
sets as (select v as i, min(u) as set_id from walk group by v)"""

_HASH = "cast(('0x' || {}) as ubigint)"
_P7 = f"""
img as (select distinct {KEY.format('image_id')} as i, {KEY.format('dataset_role')} as r, {KEY.format('sha256')} as s,
        case when regexp_full_match({KEY.format('perceptual_hash')}, '[0-9a-f]{{16}}') then {_HASH.format(KEY.format('perceptual_hash'))} end as h from dataset_image),
pairs as (select distinct t.i as t, e.i as e from img t join img e on t.r = 'development' and e.r in ('validation', 'final_test') and t.i <> e.i
  and (t.s = e.s or bit_count(xor(t.h, e.h)) <= 6))"""

#: The search of p4_found is approximate, so it has no SQL here; its recall is measured in the tests.
SQL: dict[str, str] = {
    "p3_found": f"with recursive {_P3_LINKS} select image_id, group_id from grp",
    "p3_groups": f"with recursive {_P3_LINKS} select i as image_id, coalesce(group_id, i) as group_id from ids left join grp on i = image_id where i is not null",
    "p5_found": f"with {_P5} select target_id from fits, size where fits.n < greatest(share * sample_rate * size.n, min_rows)",
    "p5_report": f"with {_P5_REPORT} select target_id, target_set, need, n as available, wanted, given as allocated, n >= need as possible, given >= need as met from l3",
    "p6_found": f"with recursive {_P6} select distinct i as image_id, set_id from sets where set_id in (select set_id from sets join img using (i) group by set_id having count(distinct r) > 1)",
    "p7_report": f"""with {_P7},
src as (select distinct {KEY.format('image_id')} as i, {KEY.format('dataset_role')} as r, {KEY.format('source')} as source from dataset_image),
exact as (select p.t, p.e, max(coalesce(a.s = b.s, false)) as same from pairs p join img a on a.i = p.t and a.r = 'development' join img b on b.i = p.e and b.r in ('validation', 'final_test') group by all),
per as (select e as i, max(same) as same, count(*) as pairs from exact group by e)
select r as role, source, count(*) as images, count(*) filter (where same) as with_exact, count(*) filter (where not same) as with_near_only, coalesce(sum(pairs), 0) as pairs
from src left join per using (i) where r in ('validation', 'final_test') group by all""",
    "p7_found": f"with {_P7} select distinct least(t, e) as image_id_a, greatest(t, e) as image_id_b from pairs",
}
