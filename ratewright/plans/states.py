"""Queries on event state, streams and pixel planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import read
from ratewright.operators import kernels as K
from ratewright.operators import state as T
from ratewright.streaming import windows as W

LIMIT, SECONDS = 3, 3600.0


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return T.limited(read(spark, d, "events"), "user_id", "ts", "event_id", LIMIT, SECONDS).select("event_id", "allowed", "retry_after")


def lease_claims(spark: SparkSession, d: str) -> DataFrame:
    return T.leases(read(spark, d, "events"), "user_id", "ts", "event_id", 120.0).where("granted").select("event_id", "user_id")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = T.sessions(read(spark, d, "events"), "user_id", "ts", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def stream_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limiter as a stream; the same decisions as the batch form."""
    s = W.stream_limited(W.read_stream(spark, f"{d}/events.parquet"), "user_id", "ts", "event_id", LIMIT, SECONDS)
    return W.run_to_end(s, "limits").select(F.col("tie").alias("event_id"), "allowed")


def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed when the stream is drained; the last ones stay open."""
    s = W.windowed_counts(W.read_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "value")
    return W.run_to_end(s, "hourly").select("started", "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    e = W.read_stream(spark, f"{d}/events.parquet")
    twice = e.unionByName(e)
    out = W.run_to_end(W.distinct_events(twice, ["event_id"], "ts"), "distinct")
    return out.groupBy("user_id").agg(F.count("*").alias("events"))


def _planes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 x 8 planes of whole grey levels."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(x.cast("double") * 400 + 128))))
    return read(spark, d, "embeddings").select("vec_id", grey.alias("plane"))


def plane_measures(spark: SparkSession, d: str) -> DataFrame:
    m = K.plane_measures(_planes(spark, d), "vec_id", "plane", 8, 8)
    return m.select("vec_id", *[F.round(c, 6).alias(c) for c in ("sharpness", "mean", "range", "highlights", "shadows")])


def block_quality(spark: SparkSession, d: str) -> DataFrame:
    """Four planes of 8 x 8 stand under each other twice: 16 x 16, two blocks either way."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(x.cast("double") * 400 + 128))))
    rows = read(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat(grey, 4)).alias("plane"))
    return K.plane_measures(rows, "vec_id", "plane", 16, 16).select("vec_id", F.round("quality", 6).alias("quality"))


def plane_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their first eight values again at the end, as planes of 9 x 8."""
    p = read(spark, d, "embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 8)).alias("plane"))
    return p.select("vec_id", F.lpad(F.lower(F.hex(K.neighbour_hash(F.col("plane")))), 16, "0").alias("hash"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 50 / 100.0).alias("x"), (F.col("l_suppkey") % 50 / 100.0).alias("y"), (F.col("l_quantity") / 100).alias("w"), (F.lit(0.1) + F.col("l_discount")).alias("h"), F.col("l_extendedprice").alias("score"))


def primary_faces(spark: SparkSession, d: str) -> DataFrame:
    return K.primary_box(_boxes(spark, d), "l_orderkey").select("l_orderkey", "ordinal", F.round("second_ratio", 6).alias("second_ratio"))


def suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    return K.suppress_overlaps(_boxes(spark, d), "l_orderkey", 0.3)


QUERIES = {f.__name__: f for f in (rate_limit_decisions, lease_claims, event_sessions, stream_limits, stream_hourly_counts, stream_distinct_users, plane_measures, block_quality, plane_hashes, primary_faces, suppressed_boxes)}


def _chain(seconds: float) -> str:
    return f"""recursive st as (select user_id, min(ts) as s from events group by 1 union all
      select st.user_id, (select min(ts) from events e where e.user_id = st.user_id and e.ts >= st.s + interval '{int(seconds)} seconds') from st where st.s is not null),
w as (select e.*, (select max(s) from st where st.user_id = e.user_id and st.s <= e.ts) as opened from events e),
r as (select *, row_number() over (partition by user_id, opened order by ts, event_id) as place from w)"""


_PIX = """px as (select vec_id, unnest(range(64)) as i, unnest(embedding) as e from embeddings),
g as (select vec_id, i, i // 8 as y, i % 8 as x, least(255.0::double, greatest(0.0::double, floor(e::double * 400 + 128))) as v from px)"""
_BOX = "b as (select l_orderkey, l_linenumber as ordinal, l_partkey % 50 / 100.0::double as x, l_suppkey % 50 / 100.0::double as y, l_quantity / 100 as w, 0.1::double + l_discount as h from lineitem)"

_IOU = "greatest(0, least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x)) * greatest(0, least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y))"

SQL = {
    "suppressed_boxes": f"""with recursive {_BOX.replace(' from lineitem', ', l_extendedprice as score from lineitem')}, o as (select *, row_number() over (partition by l_orderkey order by score desc, ordinal, x, y, w, h) as r from b),
      g as (select *, true as kept, [{{'x': x, 'y': y, 'w': w, 'h': h}}] as ks from o where r = 1 union all
        select l_orderkey, ordinal, x, y, w, h, score, r, free, case when free then list_append(ks, {{'x': x, 'y': y, 'w': w, 'h': h}}) else ks end from (select o.*, g.ks, len([1 for k in g.ks if {_IOU} / (o.w * o.h + k.w * k.h - {_IOU}) > 0.3::double]) = 0 as free from g join o on o.l_orderkey = g.l_orderkey and o.r = g.r + 1))
      select l_orderkey, ordinal, score from g where kept""",
    "rate_limit_decisions": f"with {_chain(SECONDS)} select event_id, place <= {LIMIT} as allowed, case when place > {LIMIT} then greatest(1, ceil((epoch_us(opened) + {int(SECONDS * 1e6)} - epoch_us(ts)) / 1e6)::bigint) else 0 end as retry_after from r",
    "lease_claims": f"with {_chain(120)} select event_id, user_id from r where place = 1",
    "event_sessions": "with g as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes, true) as n from events) select user_id, count(*) filter (n) as sessions, count(*) as events from g group by 1",
    "stream_limits": f"with {_chain(SECONDS)} select event_id, place <= {LIMIT} as allowed from r",
    "stream_hourly_counts": "select date_trunc('hour', ts) as started, event_type, count(*) as n, round(sum(value), 4) as total from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 10 minutes from events) group by 1, 2",
    "stream_distinct_users": "select user_id, count(*) as events from events group by 1",
    "plane_measures": f"""with {_PIX}, l as (select a.vec_id, u.v + dn.v + lf.v + rt.v - 4 * a.v as r from g a join g u on u.vec_id = a.vec_id and u.x = a.x and u.y = a.y - 1 join g dn on dn.vec_id = a.vec_id and dn.x = a.x and dn.y = a.y + 1
      join g lf on lf.vec_id = a.vec_id and lf.y = a.y and lf.x = a.x - 1 join g rt on rt.vec_id = a.vec_id and rt.y = a.y and rt.x = a.x + 1), s as (select vec_id, greatest(0, avg(r * r) - avg(r) * avg(r)) as sharpness from l group by 1),
      o as (select vec_id, list(v order by v) as f, avg(v) as mean, avg((v >= 250)::int) as highlights, avg((v <= 5)::int) as shadows from g group by 1) select vec_id, round(sharpness, 6) as sharpness, round(mean, 6) as mean, f[64] - f[1] as range, round(highlights, 6) as highlights, round(shadows, 6) as shadows from s join o using (vec_id)""",
    "block_quality": f"""with {_PIX}, s as (select a.vec_id, (a.i % 16 + 1) % 8 = 0 as edge, abs(b.v - a.v) as d from g a join g b on b.vec_id = a.vec_id and b.i = a.i + 1 and b.i // 16 = a.i // 16), m as (select vec_id, avg(d) filter (edge) as b, avg(d) filter (not edge) as i from s group by 1)
      select vec_id, round(case when i > 0 then greatest(0, least(100, 100 - greatest(0, b / i - 1) * 26)) when b > 0 then 0 else 100 end, 6) as quality from m""",
    "plane_hashes": "with w as (select vec_id, list_concat(embedding, embedding[1:8]) as e from embeddings), p as (select vec_id, [(e[i // 8 * 9 + i % 8 + 1] > e[i // 8 * 9 + i % 8 + 2])::int::varchar for i in range(64)] as b from w) select vec_id, array_to_string([lpad(lower(to_hex(list_sum([b[k * 4 + j + 1]::int * (8 >> j) for j in range(4)])::int)), 1, '0') for k in range(16)], '') as hash from p",
    "primary_faces": f"""with {_BOX}, a as (select *, w * h as area, sqrt(power(x + w / 2 - 0.5, 2) + power(y + h / 2 - 0.5, 2)) as off from b), m as (select *, max(area) over (partition by l_orderkey) as most from a),
      p as (select l_orderkey, arg_min(ordinal, (off, ordinal)) as ordinal from m where area >= most * (1 - 0.05::double) group by 1), t as (select l_orderkey, list(area order by area desc) as l from a group by 1) select l_orderkey, ordinal, round(case when len(l) > 1 then least(1.0, l[2] / l[1]) end, 6) as second_ratio from p join t using (l_orderkey)""",
}
