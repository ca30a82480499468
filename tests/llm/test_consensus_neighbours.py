"""Consensus on generated raters with known levels; neighbours against brute force."""

import math

import numpy as np
import pytest

from ratewright.llm import consensus, neighbours

LABEL = "source string, image_id string, axis string, score int, cohort string, rater string, labelled_at timestamp, received_at timestamp, n long"


def generated(seed=0, items=400):
    import datetime as dt

    rng = np.random.default_rng(seed)
    levels = rng.integers(1, 6, items)
    ways = {"fair": lambda k: k, "high": lambda k: min(5, k + 1), "reverse": lambda k: 6 - k, "flat": lambda k: 3, "low": lambda k: max(1, k - 1)}
    names = list(ways)
    raters = {f"r{n}": names[n % 5 if n < 10 else 0] for n in range(14)} | {"desk": "high"}
    rows = []
    t0 = dt.datetime(2026, 1, 1)
    for i, k in enumerate(levels):
        for r in [*rng.choice(list(raters)[:-1], 6, replace=False), "desk"]:
            s = ways[raters[r]](int(k))
            if rng.random() < 0.1:
                s = int(np.clip(s + rng.choice([-1, 1]), 1, 5))
            rows.append(("human", f"i{i:03}", "solo", s, None, r, t0 + dt.timedelta(minutes=len(rows)), t0, 0))
    return levels, rows


def test_consensus_recovers_levels(spark):
    levels, rows = generated()
    spelled = [(a, f" {b.upper()}", "Solo" if n % 2 else c, s, d, r.upper() if n % 3 else r, t, v, x) for n, (a, b, c, s, d, r, t, v, x) in enumerate(rows)]
    junk = [("h", "i000", "solo", None, None, "r0", None, None, 0), ("h", "i000", "solo", 9, None, "r0", None, None, 0), ("h", None, "solo", 3, None, "r0", None, None, 0), ("h", "i000", None, 3, None, " ", None, None, 0), ("h", "few", "solo", 3, None, "r0", None, None, 0)]
    df = spark.createDataFrame(spelled + junk + spelled[:40], LABEL)
    out = {r.image_id: r for r in consensus.consensus(df).collect()}
    assert "few" not in out and len(out) == len(levels)
    assert np.mean([out[f"i{i:03}"].score == k for i, k in enumerate(levels)]) > 0.97
    assert all(r.raters == 7 and r.labels == 7 and 0 <= r.agreement <= 1 and 0.2 <= r.confidence <= 1 for r in out.values())
    raters = {r.rater: r for r in consensus.rater_reliability(df).collect()}
    assert raters["r3"].reliability < 0.3 < 0.6 < raters["r0"].reliability
    assert raters["r2"].slope < -0.5 and raters["desk"].shift > 0.5


def long_tail(seed=1, items=400, tail=1500):
    """Six raters with many labels, and a tail of raters with four each, of whom most score at random."""
    import datetime as dt

    rng = np.random.default_rng(seed)
    levels, t0, rows = rng.integers(1, 6, items), dt.datetime(2026, 1, 1), []
    for i, k in enumerate(levels):
        for r in rng.choice(6, 3, replace=False):
            s = int(k) if rng.random() < 0.75 else int(np.clip(k + rng.choice([-1, 1]), 1, 5))
            rows.append(("human", f"i{i:03}", "solo", s, None, f"main{r}", t0, t0, 0))
    for r in range(tail):
        for i in rng.choice(items, 4, replace=False):
            s = int(rng.integers(1, 6)) if r % 4 else int(levels[i])
            rows.append(("human", f"i{i:03}", "solo", s, None, f"tail{r:03}", t0, t0, 0))
    return levels, rows


def test_the_bound_keeps_the_long_tail_down(spark):
    levels, rows = long_tail()
    df = spark.createDataFrame(rows, LABEL)
    score = lambda out: np.mean([{r.image_id: r.score for r in out}[f"i{i:03}"] == k for i, k in enumerate(levels)])
    bounded, plain = (score(consensus.consensus(df, bounded=b).collect()) for b in (True, False))
    assert bounded > 0.92 and bounded > plain + 0.05
    weights = {r.rater: r.weight for r in consensus.rater_reliability(df).collect()}
    mean = lambda kind: np.mean([w for r, w in weights.items() if r.startswith(kind)])
    assert mean("tail") < 0.5 * mean("main")


@pytest.mark.parametrize("how", [{"hot": 6}, {"most_raters": 3}])
def test_large_items_and_many_raters_give_the_same(spark, how):
    _, rows = generated(items=120)
    df = spark.createDataFrame(rows, LABEL).where("image_id <> 'i003' or rater <> 'desk'")
    want, got = (sorted((r.image_id, r.score, round(r.confidence, 6), r.stable, r.raters, r.labels, r.agreement) for r in consensus.consensus(df, **h).collect()) for h in ({}, how))
    assert got == want
    want, got = (sorted((r.rater, r.n, round(r.weight, 6), round(r.shift, 6)) for r in consensus.rater_reliability(df, **h).collect()) for h in ({}, how))
    assert got == want


def test_rounds_that_end_early_are_reported(spark):
    levels, rows = generated(items=60)
    with pytest.warns(UserWarning, match="changed their level"):
        out = consensus.consensus(spark.createDataFrame(rows, LABEL), rounds=1).collect()
    assert not all(r.stable for r in out) and all(r.stable for r in consensus.consensus(spark.createDataFrame(rows, LABEL)).collect())


def test_consensus_of_nothing(spark):
    df = spark.createDataFrame([], LABEL)
    assert consensus.consensus(df).count() == 0
    assert consensus.rater_reliability(df).count() == 0


def test_chi_squared_quantile():
    got = consensus.chi_squared_quantile(0.025, np.array([5.0, 20.0, 100.0]))
    assert np.allclose(got, [0.831, 9.591, 74.222], rtol=0.05)


VEC = "sha256 string, clip_embedding array<float>, a string, id long"


def brute(named, k, similarity):
    keys = sorted(named)
    x = np.array([named[s] for s in keys], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-round(s[i, j], 12), keys[j]))
        for j in order[:k]:
            if s[i, j] >= similarity:
                out.add((min(key, keys[j]), max(key, keys[j])))
    return out


def clustered(rng, centres, each, width, noise):
    c = rng.standard_normal((centres, width))
    return [row + rng.standard_normal(width) * noise for row in c for _ in range(each)]


@pytest.mark.parametrize("centres,each", [(1500, 6), (3, 3000), (1, 6000)])
def test_recall_of_dense_clusters(spark, centres, each):
    """A cluster of distinct vectors may hold a third of all rows, or all of them."""
    x = np.array(clustered(np.random.default_rng(1), centres, each, 64, 0.3), np.float32)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for lo in range(0, len(y), 1000):
        s = y[lo : lo + 1000] @ y.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        near = np.argpartition(-s, 5, axis=1)[:, :5]
        want |= {(min(lo + i, j), max(lo + i, j)) for i, row in enumerate(near.tolist()) for j in row if s[i, j] >= 0.8}
    df = spark.createDataFrame([(f"{i:06}", v) for i, v in enumerate(x.tolist())], "sha256 string, clip_embedding array<float>")
    got = {(int(r.a), int(r.b)) for r in neighbours.similar_pairs(df, width=64).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


@pytest.mark.parametrize("rows,least", [(60, 1.0), (3000, 0.95)])
def test_recall_against_brute_force(spark, rows, least):
    rng = np.random.default_rng(rows)
    x = clustered(rng, rows // 6, 6, 32, 0.3)
    named = {f"s{i:05}": v for i, v in enumerate(x)}
    bad = [("nul", None, "", 1), ("short", [1.0] * 31, "", 1), ("zero", [0.0] * 32, "", 1), ("nan", [math.nan] * 32, "", 1), ("inf", [math.inf] + [1.0] * 31, "", 1), (None, [1.0] * 32, "", 1), ("hole", [None] + [1.0] * 31, "", 1)]
    good = [(f" {s.upper()}", [float(y) for y in v], "", 1) for s, v in named.items()]
    df = spark.createDataFrame(good + good[:20] + bad, VEC)
    got = {(r.a, r.b) for r in neighbours.similar_pairs(df, width=32).collect()}
    want = brute(named, 5, 0.8)
    assert len(got & want) >= least * len(want)
    assert len(got - want) <= (1 - least) * len(want)


def test_copies_and_full_leaf(spark):
    rng = np.random.default_rng(2)
    one = [float(y) for y in rng.standard_normal(16)]
    rows = [(f"c{i:04}", one, "", 0) for i in range(500)] + [(f"x{i}", [float(y) for y in rng.standard_normal(16)], "", 0) for i in range(30)]
    got = {(r.a, r.b) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), width=16, similarity=0.95).collect()}
    assert {p for p in got if p[0] == "c0000"} == {("c0000", f"c{i:04}") for i in range(1, 500)}
    assert {p for p in got if p[1] == "c0400"} == {(f"c{i:04}", "c0400") for i in range(5)}
    assert neighbours.similar_pairs(spark.createDataFrame([], VEC)).count() == 0


def test_leaves_are_whole():
    code = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint32)
    parts = neighbours._leaves(code)
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and all(len(set(code[p].tolist())) == 1 for p in parts) and len(parts) == 9


def test_a_large_place_becomes_cells_in_which_all_meet(spark):
    """Any two members of a place share a cell, however large it is; no cell is larger than the bound by much."""
    placed = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(20)], "place long, id long")
    rows = neighbours._cells(placed, 64).collect()
    cells = {}
    for r in rows:
        cells.setdefault(r.place, set()).add(r.id)
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert len(met) == 300 * 299 // 2 and max(map(len, cells.values())) < 128


def test_vector_bytes_round_trip():
    import pyarrow as pa

    x = np.random.default_rng(1).standard_normal((7, 24)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 24).cast(pa.list_(pa.float32()))], names=["id", "v"])
    (out,) = neighbours.pack_vectors(iter([batch]))
    assert np.array_equal(neighbours._unpack(out.column(1).to_pylist(), 24), x)


def found_share(spark, x, least=0.8):
    """Share of the pairs that brute force finds, and how many pairs were found beyond them."""
    named = {f"s{i:05}": v for i, v in enumerate(x)}
    df = spark.createDataFrame([(s, [float(y) for y in v], "", 1) for s, v in named.items()], VEC)
    got = {(r.a, r.b) for r in neighbours.similar_pairs(df, width=len(x[0])).collect()}
    y = np.array(x, np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, :5]
    keys = sorted(named)
    want = {(min(keys[i], keys[j]), max(keys[i], keys[j])) for i, row in enumerate(near) for j in row if s[i, j] >= least}
    return len(got & want) / len(want), len(got - want) / len(want)


def test_hubs_and_spokes(spark):
    rng = np.random.default_rng(4)
    x = []
    for hub in rng.standard_normal((60, 64)):
        hub /= np.linalg.norm(hub)
        x.append(hub)
        for side in rng.standard_normal((30, 64)):
            side -= (side @ hub) * hub
            x.append(0.84 * hub + np.sqrt(1 - 0.84**2) * side / np.linalg.norm(side))
    share, more = found_share(spark, x)
    assert share >= 0.95 and more <= 0.05


def test_cluster_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    x = [*(centre + rng.standard_normal((3000, 32)) * 0.4), *rng.standard_normal((6000, 32))]
    share, more = found_share(spark, x)
    assert share >= 0.95 and more <= 0.05


def test_large_leaves_and_places_are_compared_in_full(spark, monkeypatch):
    for name, most in (("LEAF_MOST", 50), ("PLACE_MOST", 50), ("CELL", 100)):
        monkeypatch.setattr(neighbours, name, most, raising=False)
    rng = np.random.default_rng(6)
    x = [*(rng.standard_normal(32) + rng.standard_normal((600, 32)) * 0.4), *rng.standard_normal((1200, 32))]
    share, more = found_share(spark, x)
    assert share >= 0.95 and more <= 0.05


def meeting(rows, x, a, b):
    """Share of the pairs of ``x`` that meet in a leaf of the forest for so many rows."""
    trees, extra = neighbours.widened(rows) if hasattr(neighbours, "widened") else (neighbours.TREES, neighbours.EXTRA)
    f = neighbours.fit_forest(x, rows, 0.8, trees)

    def leaves(y):
        p = (f.centred(y) @ f.directions.T).reshape(len(y), trees, f.depth)
        home, margin = f.descend(p.reshape(-1, f.depth), np.tile(np.arange(trees), len(y)), np.zeros(len(y) * trees, np.int64))
        t, flips = neighbours._queue(margin.reshape(len(y), trees, f.depth), extra)
        far, _ = f.descend(p[np.repeat(np.arange(len(y)), extra), t.ravel()], t.ravel(), flips.ravel())
        return home.reshape(len(y), -1), t, far.reshape(len(y), -1)

    (ha, ta, fa), (hb, tb, fb) = leaves(x[a]), leaves(x[b])
    return ((ha == hb).any(1) | (np.take_along_axis(hb, ta, 1) == fa).any(1) | (np.take_along_axis(ha, tb, 1) == fb).any(1)).mean()


def test_similar_vectors_meet_among_many_rows_as_among_few():
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((1000, 128))
    x = np.concatenate([centre, centre + rng.standard_normal((1000, 128)) * 0.55]).astype(np.float32)
    few, many = (meeting(n, x, np.arange(1000), np.arange(1000, 2000)) for n in (80_000, 6_000_000))
    assert few > 0.9 and many > few - 0.05


def test_any_two_of_a_large_place_share_a_cell(spark):
    rows = spark.createDataFrame([(7, i) for i in range(300)] + [(8, i) for i in range(5)], "place long, id long")
    cells = {}
    for r in neighbours._cells(rows, 50).collect():
        cells.setdefault(r.place, set()).add(r.id)
    assert cells.pop(8) == set(range(5))
    assert {(a, b) for c in cells.values() for a in c for b in c} == {(a, b) for a in range(300) for b in range(300)}
    assert max(map(len, cells.values())) < 100
