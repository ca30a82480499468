"""The problems' queries against their SQL on the smallest test data."""

import os

import pytest

from ratewright.llm import queries
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = sqlcheck.canonical(queries.QUERIES[name](spark, sqlcheck.DATA).toPandas())
    assert got == sqlcheck.canonical(sqlcheck.connect().sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, sqlcheck.DATA).count() > 0


P4 = """
v as (select distinct lower(trim(sha256)) as s, clip_embedding::float[512] as e from feature_cache where trim(extractor_version) = 'v8' and len(clip_embedding) = 512
      and list_bool_and([isfinite(x) for x in clip_embedding]) and list_bool_or([x <> 0 for x in clip_embedding])),
sim as (select a.s as a, b.s as b, array_cosine_similarity(a.e::double[512], b.e::double[512]) as c from v a join v b on a.s <> b.s),
top as (select * from sim qualify row_number() over (partition by a order by c desc, b) <= 5)"""


def test_recall_of_p4(spark):
    want = sqlcheck.connect().sql(f"with {P4} select distinct least(a, b), greatest(a, b) from top where c >= 0.8").fetchall()
    got = {tuple(r) for r in queries.p4_found(spark, sqlcheck.DATA).collect()}
    assert len(got & set(want)) >= 0.95 * len(want) and len(got - set(want)) <= 0.02 * len(want)


def test_ids_are_the_librarys(spark):
    from ratewright.llm import tokens

    core = tokens.encoder(*tokens.vocabulary("byte_bpe_50k")).core
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sqlcheck.DATA}/documents.parquet").collect()}
    for r in queries.p8_ids(spark, sqlcheck.DATA).collect():
        assert r.ids == core.encode_ordinary(texts[r.doc_id] or "")
