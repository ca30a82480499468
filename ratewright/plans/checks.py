"""Queries on faces, replies, label files and other small checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import norm_key, read
from ratewright.functions import faces
from ratewright.functions import text as T
from ratewright.operators import agreement as A
from ratewright.operators import scoring as S
from ratewright.plans import agreement as P
from ratewright.plans import measures as M
from ratewright.plans import texts

_R = lambda c: F.round(c, 6)


def face_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Pose, eye region and framing of faces whose points stand for the numbers of an order line, on frames of 400 x 300."""
    li = read(spark, d, "lineitem").where("l_partkey % 7 < 6")
    c = lambda e: F.expr(e).cast("double")
    lx, ly = c("l_partkey % 200"), c("l_suppkey % 60")
    points = li.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), lx.alias("lx"), ly.alias("ly"), (lx + c("l_quantity")).alias("rx"), (ly + c("l_discount") * 100).alias("ry"), (lx + c("l_quantity") * 0.6).alias("nx"), (ly + c("l_tax") * 200).alias("ny"), (c("l_partkey % 7") < 1).alias("blind"))
    p = [F.when(~F.col("blind"), F.col(k)) for k in ("lx", "ly", "rx", "ry")]
    region = faces.eye_region(F.col("lx"), F.col("ly"), F.col("rx") - F.col("lx"), F.lit(80.0), *p)
    frame = faces.framing(F.col("lx"), F.col("ly"), F.col("rx") - F.col("lx"), F.lit(80.0), F.lit(400.0), F.lit(300.0))
    out = points.select("l_orderkey", "ordinal", _R(faces.roll(*[F.col(k) for k in ("lx", "ly", "rx", "ry")])).alias("roll"), _R(faces.yaw(*[F.col(k) for k in ("lx", "ly", "rx", "ry", "nx", "ny")])).alias("yaw"), region.alias("r"), frame.alias("f"))
    return out.select("l_orderkey", "ordinal", "roll", "yaw", *[_R(F.col(f"r.{k}")).alias(f"eyes_{k}") for k in "xywh"], *[_R(F.col(f"f.{k}")).alias(k) for k in ("ratio", "dx", "dy")])


def decoded_faces(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read as flat detections of a 64 wide graph on frames of 640 x 320; ``subject`` where one may be the subject."""
    flat = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4)
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(faces.decoded_boxes(flat, 10.0, 5.0, 0.3)).alias("place", "b")).select("vec_id", "place", "b.*")
    subject = faces.qualifies(F.col("w"), F.col("h"), F.col("confidence"), F.lit(640.0), F.lit(320.0))
    return rows.select("vec_id", "place", *[_R(F.col(k)).alias(k) for k in ("x", "y", "w", "h", "confidence")], subject.alias("subject"))


#: Fields made non-finite by the first digit of their sha256.
BROKEN = {"0": ("exposureMean", "nan"), "1": ("width", "inf"), "2": ("yaw", "-inf")}


def non_finite(columns: list[str]) -> Column:
    """Names of the columns that are NaN or infinite, in order."""
    return F.array_compact(F.array(*[F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in columns]))


def non_finite_fields(spark: SparkSession, d: str) -> DataFrame:
    v = M.vectors(spark, d).withColumns({c: F.when(F.col("sha256").startswith(k), F.lit(float(x))).otherwise(F.col(c)) for k, (c, x) in BROKEN.items()})
    return v.select(F.array_join(non_finite([c for c, _ in BROKEN.values()]), ",").alias("fields")).groupBy("fields").agg(F.count("*").alias("n"))


def label_csv(lines: DataFrame, line: str, header: list[str]) -> DataFrame:
    """CSV label records by the names in ``header``, in any order: ``(filename, axis, score, problem)``.

    ``problem`` is the number of fields if it isn't the header's, or a score that is no finite number; an empty score is 0.
    """
    if not {"filename", "axis", "score"} <= set(header):
        raise ValueError(f"labels need filename, axis and score columns; found {', '.join(header)}")
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'), F.lit(1)), lambda f: F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    rows = lines.select(F.inline(F.array(F.struct(fields.alias("f")))))
    of = lambda n: F.get("f", F.lit(header.index(n)))
    score = F.when(F.trim(of("score")) == "", 0.0).otherwise(F.trim(of("score")).try_cast("double"))
    ok = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    problem = F.when(F.size("f") != len(header), F.concat(F.size("f").cast("string"), F.lit(f" fields; expected {len(header)}"))).when(~F.coalesce(ok, F.lit(False)), "non-numeric score")
    return rows.select(of("filename").alias("filename"), of("axis").alias("axis"), F.when(problem.isNull(), score).alias("score"), problem.alias("problem"))


def label_records(spark: SparkSession, d: str) -> DataFrame:
    """Human labels written as CSV records with columns in another order, some damaged, and read again."""
    l = read(spark, d, "human_label").select("image_id", "axis", "score").distinct()  # noqa: E741
    score = F.when(F.col("score") == 5, "five").otherwise(F.coalesce(F.col("score").cast("string"), F.lit("")))
    line = F.concat(T.csv_line([score, F.col("axis"), F.col("image_id")]), F.when(F.col("score") == 4, ",x").otherwise(""))
    out = label_csv(l.select(line.alias("line")), "line", ["score", "axis", "filename"])
    return out.groupBy("score", "problem").agg(F.count("*").alias("n"))


def reply_union(v: Column, strict: bool = False) -> Column:
    """A flat reply as one of two kinds: ``struct<kind, reason, detail, fault>``; ``fault`` tells what contradicts its status.

    An assessed reply needs scores, a declined one a reason (its detail defaults to ''). ``strict`` also asks that nothing of
    the other kind is there.
    """
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    status, scores, reason, detail = get("$.status"), get("$.scores", "map<string,variant>"), get("$.reason"), get("$.detail")
    fault = F.when(status == "assessed", F.when(scores.isNull(), "assessed without scores")).when(status == "declined", F.when(reason.isNull(), "declined without a reason")).otherwise("unknown status")
    if strict:
        mixed = ((status == "assessed") & (reason.isNotNull() | detail.isNotNull())) | ((status == "declined") & scores.isNotNull())
        fault = F.coalesce(fault, F.when(mixed, "parts of both kinds"))
    fine = fault.isNull() & (status == "declined")
    return F.struct(F.when(fault.isNull(), status).alias("kind"), F.when(fine, reason).alias("reason"), F.when(fine, F.coalesce(detail, F.lit(""))).alias("detail"), fault.alias("fault"))


def reply_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Replies among the documents by kind, reason and fault, read strictly."""
    docs = read(spark, d, "documents").select("doc_id", "text").where(F.col("text").contains("{")).distinct()
    found, way = T.reply_json(F.col("text"))
    rows = docs.select(F.inline(F.array(F.struct("doc_id", way.alias("way"), F.try_parse_json(found).alias("v"))))).where("way is not null")
    return rows.select(reply_union(F.col("v"), True).alias("u")).groupBy("u.kind", "u.reason", "u.fault").agg(F.count("*").alias("n"))


def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the present axes, each put on 0 to 1, by the weights of each context; 0 where none is present."""
    rows = M.scored(spark, d)
    out = []
    for context, weights in S.WEIGHTS.items():
        top = reduce(lambda a, b: a + b, [F.coalesce((F.col(x) - 1) / 4 * w, F.lit(0.0)) for x, w in zip(S.AXES, weights)])
        bottom = reduce(lambda a, b: a + b, [F.when(F.col(x).isNotNull(), F.lit(w)).otherwise(0.0) for x, w in zip(S.AXES, weights)])
        out.append(_R(F.coalesce(F.try_divide(top, bottom), F.lit(0.0))).alias(context))
    return rows.select("sha256", *out)


def weight_sums(spark: SparkSession, d: str) -> DataFrame:
    """Weights of each context; they add up to 1."""
    rows = [(c, a, w) for c, ws in S.WEIGHTS.items() for a, w in zip(S.AXES, ws)]
    t = spark.createDataFrame(rows, "context string, axis string, weight double")
    return t.groupBy("context").agg(F.count("*").alias("axes"), _R(F.sum("weight")).alias("total"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of what identifies a measurement, as a JSON array."""
    rows = read(spark, d, "dataset_image").select("image_id", "sha256", "extractor_version", "dataset_role").distinct()
    return rows.select("image_id", F.sha2(F.to_json(F.array("sha256", "extractor_version", "dataset_role")), 256).alias("fingerprint"))


def share_bars(spark: SparkSession, d: str) -> DataFrame:
    """Each level's share of an axis as a bar of 30 cells and a percentage of five places."""
    rows = A.distribution(P.labels(spark, d), ["axis"], "score")
    return rows.select("axis", "level", F.rpad(F.repeat(F.lit("#"), F.floor(F.col("share") * 30 + 0.5).cast("int")), 30, ".").alias("bar"), F.concat(F.lpad(F.format_string("%.1f", F.col("share") * 100), 5, " "), F.lit("%")).alias("percent"))


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Images written more than once, and whether their rows agree in content and role."""
    rows = read(spark, d, "dataset_image").select(norm_key("image_id").alias("image_id"), norm_key("sha256").alias("sha"), norm_key("dataset_role").alias("role")).where("image_id is not null")
    g = rows.groupBy("image_id").agg(F.count("*").alias("n"), F.min("sha").alias("s0"), F.max("sha").alias("s1"), F.min("role").alias("r0"), F.max("role").alias("r1"))
    return g.where("n > 1").select("image_id", "n", F.expr("s0 <=> s1 and r0 <=> r1").alias("alike"))


def first_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Event numbers as uploads: of one uploader and content the first stays and answers for the others; without an uploader
    each upload is its own.
    """
    e = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("uploader"), "event_type")
    first = e.where("uploader is not null").groupBy("uploader", "event_type").agg(F.min("event_id").alias("first"))
    return e.join(first, ["uploader", "event_type"], "left").select("event_id", F.coalesce("first", "event_id").alias("row"), F.coalesce(F.col("first") < F.col("event_id"), F.lit(False)).alias("repeated"))


def usable_reason(text: Column, least: int = 30) -> Column:
    """Whether a text is a reason for an override: not empty, not an option, and of ``least`` characters or more."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "missing").when(t.startswith("--"), "an option").when(F.length(t) < least, "too short").otherwise("accepted")


def override_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text").distinct()
    return docs.groupBy(usable_reason(F.col("text")).alias("verdict")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (face_geometry, decoded_faces, non_finite_fields, label_records, reply_kinds, weighted_means, weight_sums, fingerprints, share_bars, repeated_ids, first_inserts, override_reasons)}

_EYES = "greatest(1, sqrt(power(rx - lx, 2) + power(ry - ly, 2)))"
_D = lambda w: f"{w}::double"


def _mean_sql(weights: list[float]) -> str:
    top = " + ".join(f"coalesce(({a} - 1) / 4 * {_D(w)}, 0)" for a, w in zip(S.AXES, weights))
    bottom = " + ".join(f"case when {a} is not null then {_D(w)} else 0 end" for a, w in zip(S.AXES, weights))
    return f"round(coalesce(({top}) / nullif({bottom}, 0), 0), 6)"


SQL = {
    "face_geometry": f"""with p as (select l_orderkey, l_linenumber as ordinal, (l_partkey % 200)::double as lx, (l_suppkey % 60)::double as ly, (l_partkey % 200)::double + l_quantity as rx, (l_suppkey % 60)::double + l_discount * 100 as ry,
      (l_partkey % 200)::double + l_quantity * 0.6::double as nx, (l_suppkey % 60)::double + l_tax * 200 as ny, l_partkey % 7 < 1 as blind from lineitem where l_partkey % 7 < 6), e as (select *, {_EYES} as dist, {_EYES} * 0.45::double as m from p)
      select l_orderkey, ordinal, round(atan2(ry - ly, rx - lx) * 180 / pi(), 6) as roll, round(greatest(-90, least(90, ((nx - (lx + rx) / 2) * ((rx - lx) / dist) + (ny - (ly + ry) / 2) * ((ry - ly) / dist)) / dist * 70)), 6) as yaw,
      round(case when blind then lx else least(lx, rx) - m end, 6) as eyes_x, round(case when blind then ly + 80 * 0.22::double else (ly + ry) / 2 - m end, 6) as eyes_y, round(case when blind then rx - lx else greatest(lx, rx) + m - (least(lx, rx) - m) end, 6) as eyes_w, round(case when blind then 80 * 0.3::double else m * 2 end, 6) as eyes_h,
      round(least(1, (rx - lx) * 80 / (400.0::double * 300)), 6) as ratio, round((lx + (rx - lx) / 2 - 200) / 400, 6) as dx, round((ly + 40 - 150) / 300, 6) as dy from e""",
    "decoded_faces": """with v as (select vec_id, i as k, abs(embedding[i * 5 + 1]::double) * 4 as x, abs(embedding[i * 5 + 2]::double) * 4 as y, abs(embedding[i * 5 + 3]::double) * 4 * 10 as w, abs(embedding[i * 5 + 4]::double) * 4 * 5 as h, abs(embedding[i * 5 + 5]::double) * 4 as c from (select vec_id, embedding, unnest(range(len(embedding) // 5)) as i from embeddings)),
      b as (select *, row_number() over (partition by vec_id order by k) - 1 as place, least(1, c) as confidence from v where c >= 0.3::double and w > 0 and h > 0)
      select vec_id, place::int as place, round(x * 10, 6) as x, round(y * 5, 6) as y, round(w, 6) as w, round(h, 6) as h, round(confidence, 6) as confidence, confidence >= 0.5 and w * h / (640.0::double * 320) >= 0.0025::double as subject from b""",
    "non_finite_fields": f"with {M.VECTORS_SQL} select case {' '.join(f'''when starts_with(sha256, '{k}') then '{c}' ''' for k, (c, _) in BROKEN.items())} else '' end as fields, count(*) as n from v group by 1",
    "label_records": "with l as (select distinct image_id, axis, score from human_label) select case when score is null then 0.0::double when score in (4, 5) then null else score::double end as score, case when score = 4 then '4 fields; expected 3' when score = 5 then 'non-numeric score' end as problem, count(*) as n from l group by 1, 2",
    "weighted_means": f"with {M.SCORED_SQL} select sha256, {', '.join(_mean_sql(w) + ' as ' + c for c, w in S.WEIGHTS.items())} from lv",
    "weight_sums": " union all ".join(f"select '{c}' as context, {len(w)} as axes, round({' + '.join(map(_D, w))}, 6) as total" for c, w in S.WEIGHTS.items()),
    "fingerprints": "select image_id, sha256(to_json([sha256, extractor_version, dataset_role])::varchar) as fingerprint from (select distinct image_id, sha256, extractor_version, dataset_role from dataset_image)",
    "repeated_ids": "with r as (select nullif(lower(trim(regexp_replace(image_id, '\\s+', ' ', 'g'))), '') as image_id, nullif(lower(trim(sha256)), '') as s, nullif(lower(trim(dataset_role)), '') as r from dataset_image) select image_id, count(*) as n, min(s) is not distinct from max(s) and min(r) is not distinct from max(r) as alike from r where image_id is not null group by 1 having count(*) > 1",
    "first_inserts": "with e as (select event_id, case when user_id % 5 <> 0 then user_id end as u, event_type from events) select event_id, case when u is null then event_id else min(event_id) over (partition by u, event_type) end as row, u is not null and min(event_id) over (partition by u, event_type) < event_id as repeated from e".replace("as row,", 'as "row",'),
    "override_reasons": "with t as (select trim(coalesce(text, ''), ' ') as t from (select distinct doc_id, text from documents)) select case when t = '' then 'missing' when starts_with(t, '--') then 'an option' when length(t) < 30 then 'too short' else 'accepted' end as verdict, count(*) as n from t group by 1",
}

_SHARE = "coalesce(count / nullif(n, 0)::double, 0)"
SQL["share_bars"] = P.SQL["axis_distribution"].partition(" select axis, level, count")[0] + f" select axis, level, rpad(repeat('#', floor({_SHARE} * 30 + 0.5)::int), 30, '.') as bar, lpad(printf('%.1f', {_SHARE} * 100), 5, ' ') || '%' as percent from c"
SQL["reply_kinds"] = f"""with {texts._REPLY}, x as (select json_extract_string(js, '$.status') as status, json_type(js, '$.scores') = 'OBJECT' as scores, json_extract_string(js, '$.reason') as reason, json_extract_string(js, '$.detail') as detail from j),
  fl as (select *, case when status = 'assessed' then case when scores is not true then 'assessed without scores' when reason is not null or detail is not null then 'parts of both kinds' end when status = 'declined' then case when reason is null then 'declined without a reason' when scores then 'parts of both kinds' end else 'unknown status' end as fault from x)
  select case when fault is null then status end as kind, case when fault is null and status = 'declined' then reason end as reason, fault, count(*) as n from fl group by 1, 2, 3"""
