"""Quota samples and container packing: invariants and hand cases."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from ratewright.llm import packing, quotas

M = "sha256 string, queryvariant string, query string, share string"
I = "image_id string, sha256 string, cohort string"  # noqa: E741
T = "target_id long, target_set string, queryvariant string, query string, cohort string, share double, sample_rate double, min_rows int"


@pytest.fixture(scope="module")
def tables(spark):
    man = [(f"S{n} ", ["good", " Good", "bad", "edge", "odd", None][n % 6], ["q1", "Q1 ", None, "q  2"][n % 4], "x") for n in range(600)]
    man += man[:50]
    img = [(f"i{n}", f"s{n}", [None, "a", "A", "b"][n % 4]) for n in range(0, 600)]
    tar = [
        (1, "v", "good", None, None, 0.5, 0.5, 0),
        (2, "v", "bad", None, "a", 0.2, 0.5, 0),
        (3, "v", "edge", None, None, 0.3, 1.0, 5000),
        (4, "w", None, "q1", None, 1.0, 0.1, 1),
        (5, "w", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(man, M), spark.createDataFrame(img, I), spark.createDataFrame(tar + tar[:1], T)


def brute(tables):
    man, img, tar = (t.collect() for t in tables)
    norm = lambda s: " ".join(s.lower().split()) if s and s.strip() else None
    cohort = {norm(r.sha256): norm(r.cohort) for r in img}
    pool = {(norm(r.sha256), norm(r.queryvariant), norm(r.query), cohort.get(norm(r.sha256))) for r in man}
    pool = {p for p in pool if p[1] in quotas.VARIANTS and p[2] and p[3]}
    fits = {t.target_id: {p[0] for p in pool if all(w is None or w == g for w, g in zip((t.queryvariant, t.query, t.cohort), p[1:]))} for t in tar}
    return len({p[0] for p in pool}), fits, {t.target_id: t for t in tar}


def test_report_and_unmet(tables):
    size, fits, targets = brute(tables)
    rows = {r.target_id: r for r in quotas.quota_report(*tables).collect()}
    assert {i: r.available for i, r in rows.items()} == {i: len(s) for i, s in fits.items()}
    unmet = {i for i, t in targets.items() if len(fits[i]) < max((t.share or 0) * (t.sample_rate or 1) * size, t.min_rows or 0)}
    assert {r.target_id for r in quotas.unmet_targets(*tables).collect()} == unmet


def test_sample_draws_what_was_allocated(tables):
    _, fits, _ = brute(tables)
    sample = quotas.quota_sample(*tables).collect()
    assert len({(r.target_set, r.sha256) for r in sample}) == len(sample)
    assert all(r.sha256 in fits[r.target_id] for r in sample)
    assert sorted(sample) == sorted(quotas.quota_sample(*[t.repartition(5) for t in tables]).collect())
    drawn = Counter(r.target_id for r in sample)
    assert {r.target_id: r.allocated for r in quotas.quota_report(*tables).collect()} == {i: drawn[i] for i in fits}


def test_one_stock(spark):
    """A photo that fits two targets serves one of them, in the report as in the sample."""
    man = spark.createDataFrame([(f"s{n}", "good", "q1" if n < 20 else "q2", "") for n in range(100)], M)
    img = spark.createDataFrame([(f"i{n}", f"s{n}", "a") for n in range(100)], I)
    tar = spark.createDataFrame([(1, "x", "good", None, None, 0.9, 1.0, 0), (2, "x", "good", "q1", None, 0.15, 1.0, 0)], T)
    rows = {r.target_id: r for r in quotas.quota_report(man, img, tar).collect()}
    assert [(rows[i].allocated, rows[i].possible, rows[i].met) for i in (1, 2)] == [(85, True, False), (15, True, True)]
    drawn = quotas.quota_sample(man, img, tar).collect()
    assert Counter(r.target_id for r in drawn) == {1: 85, 2: 15} and len({r.sha256 for r in drawn}) == 100
    wide = spark.createDataFrame([(1, "x", "good", None, None, 0.85, 1.0, 0), (2, "x", "good", "q1", None, 0.15, 1.0, 0)], T)
    assert all(r.met for r in quotas.quota_report(man, img, wide).collect())


def _t(i, v, share, query=None, cohort=None):
    return {"target_id": i, "queryvariant": v, "query": query, "cohort": cohort, "share": share, "sample_rate": 1.0, "min_rows": 0}


def _sums(plan):
    out = Counter()
    for (i, _), n in plan.given.items():
        out[i] += n
    return dict(out)


def test_unmet_goes_to_siblings_then_cousins():
    plan = quotas.allocate([_t(1, "good", 0.4), _t(2, "good", 0.1), _t(3, "bad", 0.5)], 100, {(1,): 10, (2,): 20, (3,): 90})
    assert plan.wanted == {1: 40, 2: 10, 3: 50} and _sums(plan) == {1: 10, 2: 20, 3: 70}
    near = quotas.allocate([_t(1, "good", 0.4, "q", "a"), _t(2, "good", 0.1, "q", "b"), _t(3, "good", 0.5, "r")], 100, {(1,): 10, (2,): 90, (3,): 90})
    assert _sums(near) == {1: 10, 2: 40, 3: 50}
    assert quotas.allocate([], 0, {}).given == {}


def test_rerouting_reaches_the_most_that_can_be_given():
    """Against the largest flow, found by cuts over all sets of targets."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(1, 5))
        stock = {leaf: int(rng.integers(0, 30)) for leaf in {tuple(sorted(rng.choice(np.arange(1, k + 1), rng.integers(1, k + 1), replace=False).tolist())) for _ in range(4)}}
        targets = [_t(i, "good", float(rng.integers(0, 60)) / 100) for i in range(1, k + 1)]
        plan = quotas.allocate(targets, 100, stock)
        used = Counter()
        for (i, leaf), n in plan.given.items():
            assert i in leaf and n > 0
            used[leaf] += n
        assert all(used[x] <= n for x, n in stock.items())
        most = min(sum(w for i, w in plan.wanted.items() if i not in c) + sum(n for x, n in stock.items() if set(x) & c) for c in (set(c) for r in range(k + 1) for c in combinations(range(1, k + 1), r)))
        got = _sums(plan)
        assert sum(min(got.get(i, 0), w) for i, w in plan.wanted.items()) == most


def test_empty_tables(spark, tables):
    man, img, tar = tables
    assert {r.target_id for r in quotas.unmet_targets(man.limit(0), img, tar).collect()} == {3, 4}
    assert quotas.quota_sample(man, img, tar.limit(0)).count() == 0
    assert quotas.quota_report(man, img, tar.limit(0)).count() == 0


def check_packing(items, capacity, rows):
    sizes = {i: n for i, n in items if i is not None and n and n > 0}
    by_item, by_box = defaultdict(list), defaultdict(list)
    for r in rows:
        by_item[r.item].append(r)
        by_box[r.container].append(r)
    assert set(by_item) == set(sizes)
    for i, parts in by_item.items():
        parts.sort(key=lambda r: r.part)
        assert sum(p.size for p in parts) == sizes[i]
        assert [p.item_start for p in parts] == [k * capacity for k in range(len(parts))]
        assert all(p.size == capacity for p in parts[:-1])
    for box in by_box.values():
        box.sort(key=lambda r: r.start)
        at = 0
        for r in box:
            assert r.start == at
            at += r.size
        assert at <= capacity
    return sum(sizes.values()) / (capacity * len(by_box))


@pytest.mark.parametrize("capacity", [16, 512, 2048])
def test_packing_is_whole_and_tight(spark, capacity):
    rng = np.random.default_rng(capacity)
    items = [(int(n), int(s)) for n, s in enumerate(rng.lognormal(5, 1, 3000))] + [(9000, 0), (9001, None), (None, 5), (9002, capacity), (9003, 10 * capacity)]
    df = spark.createDataFrame([(*i, "x") for i in items + items[:10]], "item long, size long, container string")
    fill = check_packing(items, capacity, packing.pack_items(df, capacity).collect())
    assert fill > 0.97


def test_packing_ties_and_nothing(spark):
    df = spark.createDataFrame([(n, 7) for n in range(1000)], "item long, size long")
    assert check_packing([(n, 7) for n in range(1000)], 21, packing.pack_items(df, 21).collect()) == pytest.approx(1.0, abs=0.01)
    assert packing.pack_items(df.limit(0), 21).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(df, 0)


def test_too_many_specs_are_refused(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    specs = spark.range(packing.MOST_SPECS + 1).selectExpr("id as spec_id", "16 as capacity_tokens", "'byte_bpe_50k' as tokenizer")
    with pytest.raises(ValueError, match="container specs"):
        packing.pack_documents(docs, specs)


def test_nnls_against_exact():
    a = np.array([[2.0, 0, 1], [0, 3, 1], [0, 0, 1]])
    x = np.array([5.0, 0, 2])
    assert np.allclose(packing.nnls(a, a @ x, 30), x, atol=1e-9)
    assert packing.nnls(a, np.array([-1.0, -1, -1]), 30).max() == 0
