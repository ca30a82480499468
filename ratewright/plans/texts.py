"""Queries on texts: replies, label lines, word filters, addresses, CSV and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import read
from ratewright.functions import text as T
from ratewright.functions.numeric import hmac_sha256, percent


def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold a JSON reply, and how it was found."""
    docs = read(spark, d, "documents").select("doc_id", "text").distinct()
    found, way = T.reply_json(F.col("text"))
    rows = docs.where(F.col("text").contains("{")).select("doc_id", way.alias("way"), F.try_variant_get(F.try_parse_json(found), "$.status", "string").alias("status"))
    return rows.where("way is not null")


def reply_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores in assessed replies, one row a reply and axis; scores off the scale are left out."""
    docs = read(spark, d, "documents").select("doc_id", "text").where(F.col("text").contains("{")).distinct()
    found, way = T.reply_json(F.col("text"))
    v = docs.where(way.isNotNull()).select("doc_id", F.explode(F.try_variant_get(F.try_parse_json(found), "$.scores", "map<string,int>")).alias("axis", "score"))
    return v.where("score between 1 and 5")


def trait_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "text").distinct()
    return docs.groupBy("source").agg(F.count_if(F.col("text").rlike(T.TRAITS)).alias("rejected"), F.count("*").alias("n"))


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Human labels written as JSON lines, some of them damaged, and read again: records and problems by reason."""
    lines = _lines(spark, d)
    good, bad = T.label_lines(lines, "line")
    n = good.select(F.lit("record").alias("reason")).unionByName(bad.select("reason"))
    return n.groupBy("reason").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    body = F.concat(F.lit('{"id":"'), "event_id", F.lit('","axes":{"'), "event_type", F.lit('":'), F.col("value").cast("string"), F.lit("}}"))
    k = F.col("event_id") % 9
    line = (
        F.when(k == 1, F.concat(body, F.lit(",")))
        .when(k == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(k == 3, F.replace(body, F.lit('"id"'), F.lit('"key"')))
        .when(k == 4, F.replace(body, F.lit('"axes"'), F.lit('"levels"')))
        .when(k == 5, F.regexp_replace(body, r"\{[^{}]*\}\}$", "{}}"))
        .when(k == 6, F.regexp_replace(body, r":[-0-9.E]+\}\}$", ':"high"}}'))
        .when(k == 7, F.substring(body, 1, 9))
        .when(k == 8, F.lit("  "))
        .otherwise(body)
    )
    return e.select("event_id", line.alias("line"))


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows as CSV lines."""
    m = read(spark, d, "manifest").select("sha256", "url", "photographer", "query", "width").distinct()
    return m.select(T.csv_line([F.col(c) for c in m.columns]).alias("line"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines parsed back by the CSV reader's own rules."""
    lines = csv_lines(spark, d)
    p = lines.select(F.from_csv("line", F.lit("sha256 string, url string, photographer string, query string, width long"), {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return p.select("r.*").groupBy("query").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


def extensions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "manifest").select(T.extension(F.col("sourceurl")).alias("extension")).groupBy("extension").agg(F.count("*").alias("n"))


def keyed_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Subjects as keyed hashes: the events of each."""
    e = read(spark, d, "events")
    return e.groupBy(hmac_sha256("local-key", F.concat(F.lit("ip:"), F.col("user_id").cast("string"))).alias("subject")).agg(F.count("*").alias("n"))


def percents(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "dataset_image").select("width", "height").where("width is not null and height > 0").distinct()
    return m.select("width", "height", percent(F.col("width") / (F.col("width") + F.col("height") * 40)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored once by content: how many documents share each repeated one."""
    docs = read(spark, d, "documents").select("doc_id", "text").where("text is not null").distinct()
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")


def vector_texts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    t = T.vector_text(F.transform("embedding", lambda x: F.round(x * 1000).cast("int")))
    return e.select("vec_id", F.md5(t).alias("digest"), F.size("embedding").alias("width"))


QUERIES = {f.__name__: f for f in (reply_parse, reply_scores, trait_filter, label_lines, csv_lines, csv_round_trip, extensions, keyed_hashes, percents, content_hashes, vector_texts)}

_REPLY = """t as (select distinct doc_id, text from documents where contains(text, '{')),
f as (select *, regexp_replace(trim(text, E' '), '^```(?:json)?\\s*|\\s*```$', '', 'g') as fenced, case when strpos(text, '{') > 0 and length(text) - strpos(reverse(text), '}') + 1 > strpos(text, '{') and contains(text, '}') then text[strpos(text, '{'):length(text) - strpos(reverse(text), '}') + 1] end as sliced from t),
w as (select *, case when starts_with(ltrim(text, ' '), '{') and json_valid(text) then 'plain' when contains(text, '```') and starts_with(ltrim(fenced, ' '), '{') and json_valid(fenced) then 'fenced' when json_valid(sliced) then 'sliced' end as way from f),
j as (select doc_id, way, case way when 'plain' then text when 'fenced' then fenced when 'sliced' then sliced end as js from w where way is not null)"""

_PADS = ["".join(f"\\x{b ^ k:02X}" for b in b"local-key".ljust(64, b"\0")) for k in (0x36, 0x5C)]

SQL = {
    "keyed_hashes": f"select sha256('{_PADS[1]}'::blob || unhex(sha256('{_PADS[0]}'::blob || encode('ip:' || user_id)))) as subject, count(*) as n from events group by 1",
    "vector_texts": "select vec_id, md5('[' || array_to_string([round(x * 1000::float)::int for x in embedding], ',') || ']') as digest, len(embedding) as width from embeddings",
    "reply_parse": f"with {_REPLY} select doc_id, way, json_extract_string(js, '$.status') as status from j",
    "reply_scores": f"with {_REPLY}, s as (select doc_id, unnest(map_entries(from_json(json_extract(js, '$.scores'), '\"MAP(VARCHAR, INTEGER)\"'))) as e from j) select doc_id, e.key as axis, e.value as score from s where e.value between 1 and 5",
    "trait_filter": f"select source, count(*) filter (regexp_matches(text, '(?i)\\b(?:{'|'.join(T.TRAIT_WORDS)})\\b')) as rejected, count(*) as n from (select distinct doc_id, source, text from documents) group by 1",
    "label_lines": "select case event_id % 9 when 1 then 'not JSON (trailing comma)' when 2 then 'not an object' when 3 then 'missing id' when 4 then 'missing axes' when 5 then 'empty axes' when 6 then 'axis value is not a finite number' when 7 then 'not JSON' else 'record' end as reason, count(*) as n from events where event_id % 9 <> 8 group by 1",
    "csv_lines": "with m as (select distinct sha256, url, photographer, query, width from manifest), c as (select [regexp_replace(coalesce(x, ''), '[\\r\\n]+', ' ', 'g') for x in [sha256, url, photographer, query, width::varchar]] as f from m) select array_to_string([case when regexp_matches(x, '[\",]') then '\"' || replace(x, '\"', '\"\"') || '\"' else x end for x in f], ',') as line from c",
    "csv_round_trip": "select query, count(*) as n, sum(width)::bigint as width from (select distinct sha256, url, photographer, trim(query, ' ') as q0, query, width from manifest) group by 1",
    "extensions": "select case when e = '' then 'jpg' else e end as extension, count(*) as n from (select lower(regexp_extract(sourceurl, '(?i)\\.(jpe?g|png|webp)(?:\\?|$)', 1)) as e from manifest) group by 1",
    "percents": "with m as (select distinct width, height from dataset_image where width is not null and height > 0), x as (select width / (width + height * 40)::double * 100 as v from m) select case when v > 0 and v < 1 then printf('%.1f%%', v) else floor(v + 0.5)::bigint || '%' end as p, count(*) as n from x group by 1",
    "content_hashes": "select sha256(text) as sha256, count(*) as n from (select distinct doc_id, text from documents where text is not null) group by 1 having count(*) > 1",
}
