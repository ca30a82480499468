"""Queries on manifest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.common import read
from ratewright.sources.manifest_lines import COLUMNS, HEADER, RULES, parse_manifest_lines


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_manifest_lines(read(spark, d, "manifest_raw"))[1].select("raw_id", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return parse_manifest_lines(read(spark, d, "manifest_raw"))[0]


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    rejected = parse_manifest_lines(read(spark, d, "manifest_raw"))[1]
    return rejected.select("reason", F.explode_outer("details").alias("detail")).groupBy("reason", "detail").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_valid, p2_reasons)}

_FIELD = """("[^"]*(?:""[^"]*)*"|[^",]*)"""
_SPLIT = f"""
l as (select raw_id, raw_line from manifest_raw where raw_line is not null and not regexp_full_match(raw_line, '\\s*') and raw_line <> '{HEADER}'),
p as (select *, regexp_full_match(raw_line, '(?:{_FIELD}(?:,|$))*') and regexp_full_match(raw_line, '{_FIELD}(,{_FIELD})*') as whole,
      regexp_extract_all(',' || raw_line, ',{_FIELD}', 1) as f from l),
u as (select *, [case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end for x in f] as v from p),
r as (select *, case when not whole then 'quoting' when len(f) <> 11 then 'column_count'
  when not regexp_full_match(v[1], '[0-9a-f]{{64}}') or not regexp_full_match(v[9], '[0-9]*[1-9][0-9]*') or not regexp_full_match(v[10], '[0-9]*[1-9][0-9]*')
    or v[8] not in ('good', 'mediocre', 'bad', 'edge') or regexp_full_match(v[5], '\\s*') then 'invalid_value' end as reason from u)"""

_VALID = ", ".join(f"try_cast(v[{i + 1}] as bigint) as {n}" if n in ("width", "height") else f"v[{i + 1}] as {n.lower()}" for i, n in enumerate(COLUMNS)) + ", v[9] as width_text, v[10] as height_text"
_WHY = [("not regexp_full_match(v[1], '[0-9a-f]{64}')", "sha256"), ("not regexp_full_match(v[9], '[0-9]*[1-9][0-9]*')", "width"), ("not regexp_full_match(v[10], '[0-9]*[1-9][0-9]*')", "height"),
        ("v[8] not in ('good', 'mediocre', 'bad', 'edge')", "queryVariant"), ("regexp_full_match(v[5], '\\s*')", "photographer")]
_DETAILS = " union all ".join(f"select reason, '{RULES[n][1]}' as detail from r where reason = 'invalid_value' and {test}" for test, n in _WHY)

SQL = {
    "p2_found": f"with {_SPLIT} select raw_id, reason from r where reason is not null",
    "p2_reasons": f"with {_SPLIT}, d as (select reason, null as detail from r where reason in ('quoting', 'column_count') union all {_DETAILS}) select reason, detail, count(*) as n from d group by all",
    "p2_valid": f"with {_SPLIT} select raw_id, {_VALID} from r where reason is null",
}
