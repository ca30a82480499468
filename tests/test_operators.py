"""Core operators against published or hand-computed values."""

import math
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ratewright import common
from ratewright.functions import bits, faces
from ratewright.functions import numeric as N
from ratewright.functions import text as T
from ratewright.operators import agreement as A
from ratewright.operators import fitting as I
from ratewright.operators import grouping as G
from ratewright.operators import kernels as K
from ratewright.operators import scoring as S
from ratewright.operators import state as St
from ratewright.operators import summary as Y
from ratewright.plans import checks, datasets, fits, reports
from ratewright.sources import manifest_lines as L
from tests import sqlcheck

UNITS = ["-1-", "---", "-22", "-11", "-33", "334", "444", "13-", "2-2", "1-1", "1-1", "3-3", "3-3", "---", "3-4"]


def alpha(spark, units):
    rows = [("a", u, int(c)) for u, cells in enumerate(units) for c in cells if c != "-"]
    return A.ordinal_alpha(spark.createDataFrame(rows, "g string, u int, score int"), ["g"], "u", "score").first()


def test_alpha_published_value(spark):
    assert alpha(spark, UNITS).alpha == pytest.approx(0.806721, abs=1e-6)


@pytest.mark.parametrize("units,want", [(["11", "22", "13"], 1 / 9), (["11", "22", "33"], 1.0)])
def test_alpha_hand_values(spark, units, want):
    assert alpha(spark, units).alpha == pytest.approx(want)


def test_alpha_undefined(spark):
    assert alpha(spark, ["22", "22"]).reason == "every rating is identical, so alpha is undefined"
    assert alpha(spark, ["2", "3"]).reason == "no unit has two or more ratings"
    assert alpha(spark, ["13", "31", "24", "42"]).alpha < 0


def pair(spark, a, b):
    return A.cells(spark.createDataFrame([("g", x, y) for x, y in zip(a, b)], "g string, a int, b int"), ["g"], "a", "b")


@pytest.mark.parametrize("a,b,rho", [([1, 2, 3, 4, 5], [2, 4, 6, 8, 10], 1), ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1], -1), ([1, 2, 2, 3], [1, 2, 3, 4], math.sqrt(0.9))])
def test_spearman(spark, a, b, rho):
    assert A.spearman(pair(spark, a, b), ["g"]).first().rho == pytest.approx(rho)


def test_spearman_constant(spark):
    assert A.spearman(pair(spark, [1, 2, 3], [4, 4, 4]), ["g"]).first().reason.startswith("one series")


@pytest.mark.parametrize("a,b,tau", [([1, 2, 3, 4, 5], [1, 2, 3, 5, 4], 0.8), ([1, 1, 2, 3], [1, 2, 2, 3], 0.8)])
def test_kendall(spark, a, b, tau):
    c = A.concordance(pair(spark, a, b), ["g"])
    assert c.select(A.kendall_tau(c)).first()[0] == pytest.approx(tau)


@pytest.mark.parametrize("a,b,want", [([1, 2, 3], [4, 7, 9], 1), ([1, 2, 3], [9, 7, 4], 0), ([1, 1, 3], [1, 2, 3], 1.0), ([1, 2, 3], [1, 1, 3], 2.5 / 3)])
def test_pairwise(spark, a, b, want):
    c = A.concordance(pair(spark, a, b), ["g"])
    assert c.select(A.pairwise_accuracy("x")).first()[0] == pytest.approx(want)


def test_variance_shares(spark):
    v = {r.axis: r for r in A.variance_shares(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double"), ["a", "b"], [0.5, 0.5]).collect()}
    assert v["a"].share == pytest.approx(0.5) and v["a"].sd == pytest.approx(1)
    flat = {r.axis: r for r in A.variance_shares(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"], [0.5, 0.5]).collect()}
    assert flat["b"].share == 0 and flat["b"].dead_weight


@pytest.mark.parametrize(
    "points,want",
    [
        ([(1, 1), (2, 3), (3, 1), (4, 4)], [(1, 1, 1), (3, 2, 2), (4, 4, 1)]),
        ([(1, 1), (2, 5), (3, 4), (4, 3)], [(1, 1, 1), (4, 4, 3)]),
        ([(1, 2), (1, 4), (2, 3)], [(1, 3, 2), (2, 3, 1)]),
    ],
)
def test_isotonic(spark, points, want):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in points] + [("g", None, 1.0)], "g string, x double, y double")
    got = sorted((r.x, r.fitted, r.weight) for r in I.isotonic(df, ["g"], "x", "y").collect())
    assert got == [tuple(map(float, w)) for w in want]


def test_isotonic_slices_agree(spark):
    rng = random.Random(2)
    points = [(rng.randrange(400) / 7, rng.randrange(1, 6)) for _ in range(1500)]
    means = {}
    for x, y in points:
        means.setdefault(x, []).append(y)
    whole = I.pool_adjacent([(x, sum(y) / len(y), len(y)) for x, y in sorted(means.items())])
    df = spark.createDataFrame([("g", x, float(y)) for x, y in points], "g string, x double, y double")
    got = sorted((r.x, round(r.fitted, 9)) for r in I.isotonic(df, ["g"], "x", "y").collect())
    assert got == [(x, round(m, 9)) for x, m, _ in whole]


def test_knots():
    block = lambda *p: [(float(x), float(y), 1.0) for x, y in p]
    assert I.knots_from_blocks(block((10, 1), (20, 2), (30, 3)), [1, 2, 3, 4, 5]) == ([(10, 1), (20, 2), (30, 3)], [4, 5])
    assert I.knots_from_blocks(block((10, 1), (20, 4)), [1, 2, 3, 4])[0] == [(10, 1), (20, 4)]
    assert I.knots_from_blocks(block((100, 3), (200, 5)), [1, 2, 3, 4, 5])[0][0] == (100, 3)
    assert I.knots_from_blocks([], [1]) == ([], [1])


def test_splits():
    sizes = [(2, "ana"), (2, "ben"), (1, "cal")]
    got, _ = I.split_two(sizes, 0.67)
    assert set(got) == {"ana", "ben", "cal"} and set(got.values()) == {"train", "test"}
    assert I.split_two([(3, "a")], 0.5)[1].endswith("found 1")
    assert I.split_two(sizes, 1.0)[1] == "ratio must be strictly between 0 and 1"
    got, _ = I.split_two([(2, f"p{n:02}") for n in range(50)], 0.8)
    assert 0.75 < sum(s == "train" for s in got.values()) / 50 < 0.85
    bins = I.greedy_bins([(5, "a"), (3, "b"), (3, "c"), (1, "d")], 2)
    assert bins == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_order_and_thresholds(spark):
    assert I.enforce_order([1.0, 0.5, 2.0]) == [1.0, 1.0 + 1e-6, 2.0]
    df = spark.createDataFrame([("g", v, k) for v, k in ((0.1, 1), (0.2, 1), (0.3, 2), (0.4, 2))] + [("h", 0.1, 1)], "g string, v double, k int")
    (r,) = I.boundary(df, ["g"], "v", "k", 1).collect()
    assert r.g == "g" and r.threshold == pytest.approx(0.25) and r.score == 1
    assert df.select(I.apply_thresholds(F.col("v"), [0.15, 0.35])).collect()[3][0] == 3


def test_rounding_and_maps(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.round_half_up(F.lit(-2.5))) == -2 and one(N.round_half_up(F.lit(2.5))) == 3
    assert one(N.piecewise(F.lit(60.0), S.KNOTS["sharpness"])) == 2.25
    assert one(N.clamp(F.lit(None).cast("double"), 1.0, 5.0)) is None
    assert math.isnan(one(N.clamp(F.lit(float("nan")), 1.0, 5.0)))
    assert one(N.band_penalty(F.lit(90.0), 95.0, 165.0, 0.012)) == pytest.approx(0.06)
    assert one(N.hamming_hex(F.lit("ff00" * 8), F.lit("FF01" * 8), 32)) == 8
    assert one(N.hamming_hex(F.lit("zz"), F.lit("00"), 2)) is None
    with pytest.raises(ValueError):
        N.piecewise(F.lit(1.0), [(1, 1), (1, 2)])


def test_keyed_hash(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("1.2.3.4",)], "ip string").select(N.hmac_sha256("k" * 80, F.col("ip"))).first()[0]
    assert got == hmac.new(b"k" * 80, b"1.2.3.4", hashlib.sha256).hexdigest()


GOOD = dict(sharpnessLaplacian=800.0, sharpnessEyeRegion=800.0, jpegQualityEstimate=95.0, exposureMean=128.0, clippedHighlights=0.001, clippedShadows=0.001, dynamicRange=215.0, faceExposureMean=118.0, faceClippedHighlights=0.002, faceClippedShadows=0.003, exposureDelta=0.0, width=1600.0, height=1600.0, faceAreaRatio=0.18, faceCenterOffsetX=0.01, faceCenterOffsetY=-0.02, faceCount=1.0, yaw=0.0, roll=0.0, pitch=0.0, eyeOpenness=0.9, smileIntensity=0.5, primaryFaceConfidence=0.9, secondLargestFaceRatio=None, eyeRegionMeasured=True, faceRegionMeasured=True, isGrayscale=False, aspectExtreme=False, sourceFormat="jpeg", extractorVersion="v8")


def vectors(spark, *changes):
    rows = [Row(**(GOOD | c)) for c in changes]
    return spark.createDataFrame(rows, S.VECTOR_DDL + ", background int, attire int, expression int, solo int" if "solo" in changes[0] else S.VECTOR_DDL)


def test_good_and_bad(spark):
    judged = lambda k: dict(background=k, attire=k, expression=k, solo=k)
    bad = dict(sharpnessLaplacian=5.0, sharpnessEyeRegion=5.0, jpegQualityEstimate=20.0, exposureMean=25.0, faceExposureMean=25.0, dynamicRange=30.0, faceClippedShadows=0.35, width=300.0, height=300.0, faceAreaRatio=0.02, faceCenterOffsetX=0.4, faceCenterOffsetY=0.35)
    rows = S.axis_levels(vectors(spark, judged(5), bad | judged(1))).select(S.composite("corporate").alias("s"), S.top_fixes().alias("f")).collect()
    assert rows[0].s >= 8 and rows[1].s <= 3 and len(rows[1].f) == 3
    assert all("None" not in f.message for f in rows[1].f)


@pytest.mark.parametrize("change,field,reason", [(dict(width=1.5), "width", "must be an integer"), (dict(yaw=float("nan")), "yaw", "is NaN"), (dict(yaw=float("inf")), "yaw", "is not finite"), (dict(yaw=None), "yaw", "expected a number"), (dict(pitch=None), None, None), (dict(exposureMean=256.0), "exposureMean", "must be within [0, 255]"), (dict(faceCount=0.0), "primaryFaceConfidence", "is set although faceCount is 0"), (dict(sharpnessEyeRegion=None), "eyeRegionMeasured", "disagrees with sharpnessEyeRegion"), (dict(sourceFormat=""), "sourceFormat", "expected a non-empty string"), (dict(isGrayscale=None), "isGrayscale", "expected a boolean")])
def test_validation(spark, change, field, reason):
    v = vectors(spark, change).select(S.first_violation().alias("v")).first().v
    assert (v and v.field) == field and (v and v.reason) == reason


@pytest.mark.parametrize("change,want", [({}, 1), (dict(faceCount=0.0), 0.55), (dict(faceCount=3.0), 0.75), (dict(yaw=25.0), 0.9), (dict(yaw=-50.0), 0.8), (dict(jpegQualityEstimate=20.0), 0.85)])
def test_confidence(spark, change, want):
    assert S.axis_levels(vectors(spark, change)).select(S.confidence()).first()[0] == want


def test_absent_framing_costs_nothing(spark):
    rows = S.axis_levels(vectors(spark, dict(faceCount=0.0, primaryFaceConfidence=None), {}))
    a, b = rows.select("framing", S.composite("startup").alias("s")).collect()
    assert a.framing is None and a.s is not None and b.framing is not None


LINES = ["{}", '{"id":"a","axes":{"x":1}}', '{"id":"a","axes":{"x":1}},', '[{"id":"a"}]', '{"axes":{"x":1}}', '{"id":"a"}', '{"id":"a","axes":{"x":"y"}}', '{"id":"a","axes":{}}', "nope", "  ", '{"id":"","axes":{"x":1}}', '{"id":"a","axes":{"x":1}} {}']


def test_label_lines(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, line string")
    good, bad = T.label_lines(df, "line")
    assert [r.n for r in good.collect()] == [1]
    assert {r.n: r.reason for r in bad.collect()} == {0: "missing id", 2: "not JSON (trailing comma)", 3: "not an object", 4: "missing id", 5: "missing axes", 6: "axis value is not a finite number", 7: "empty axes", 8: "not JSON", 10: "missing id", 11: "not JSON"}


def test_replies(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '```json\n{"a":1}\n```'), (3, 'Here: {"a":1} ok'), (4, "no"), (5, None), (6, "{broken")], "n int, t string")
    found, way = T.reply_json(F.col("t"))
    assert {r.n: r.w for r in df.select("n", way.alias("w")).collect()} == {1: "plain", 2: "fenced", 3: "sliced", 4: None, 5: None, 6: None}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "3.3.3.3", "a/../Data/x", bytes.fromhex("89504E470D0A1A0A00"), "http://x/y.PNG?z=1", "unknown person", "No Body")], "f string, r string, p string, b binary, u string, c1 string, c2 string")
    r = df.select(T.client_address(F.col("f"), F.col("r")), T.client_address(F.lit(" "), F.col("r")), T.safe_path(F.col("p"), "Data"), T.mime_of(F.col("b")), T.extension(F.col("u")), G.creator_group(F.col("c1")), G.creator_group(F.col("c2"))).first()
    assert list(r) == ["1.1.1.1", "3.3.3.3", False, "image/png", "png", None, "creator:no body"]


def brute_line(line):
    """Straight state machine over the line's characters."""
    fields, cur, state = [], "", "start"
    for ch in line:
        if state == "start":
            if ch == '"':
                state = "quoted"
            elif ch == ",":
                fields.append("")
            else:
                cur, state = ch, "plain"
        elif state == "plain":
            if ch == '"':
                return None
            if ch == ",":
                fields.append(cur)
                cur, state = "", "start"
            else:
                cur += ch
        elif state == "quoted":
            if ch == '"':
                state = "maybe"
            else:
                cur += ch
        elif ch == '"':
            cur += '"'
            state = "quoted"
        elif ch == ",":
            fields.append(cur)
            cur, state = "", "start"
        else:
            return None
    return None if state == "quoted" else [*fields, cur]


def test_manifest_lines_against_state_machine(spark):
    rng = random.Random(8)
    sha = "a" * 64
    ok = f'{sha},u,s,l,"Doe, ""J""",p,q,good,10,20,f'
    lines = [ok, ok.replace("good", "Good"), ok.replace(",10,", ",0,"), ok.replace(",10,", ",010,"), ok.replace(",10,", ",1.0,"), ok.replace(sha, sha.upper()), ok.replace('"Doe, ""J"""', '" "'), ok + ",", ok.replace('"Doe', 'x"Doe'), "", "  ", None, L.HEADER, "," + ok[65:], "x" * 100_000, '"' * 100_001, ok.replace(",10,", ",99999999999999999999,")]
    lines += ["".join(rng.choice('",,ab"') for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    df = spark.createDataFrame([(n, x, "b") for n, x in enumerate(lines)], "raw_id long, raw_line string, sha256 string")
    valid, rejected = L.parse_manifest_lines(df)
    want = {}
    for n, x in enumerate(lines):
        if x is None or not x.strip() or x == L.HEADER:
            continue
        f = brute_line(x)
        if f is None:
            want[n] = "quoting"
        elif len(f) != 11:
            want[n] = "column_count"
        elif not (len(f[0]) == 64 and set(f[0]) <= set("0123456789abcdef")) or not all(s.isascii() and s.isdigit() and int(s) >= 1 for s in f[8:10]) or f[7] not in L.VARIANTS or not f[4].strip():
            want[n] = "invalid_value"
    assert {r.raw_id: r.reason for r in rejected.collect()} == want
    got = {r.raw_id: r for r in valid.collect()}
    assert set(got) == {0, 3, 16} and got[0].photographer == 'Doe, "J"' and got[3].width == 10 and got[16].width is None and got[16].width_text == "9" * 20 and got[3].width_text == "010"
    v, r = L.parse_manifest_lines(df.limit(0))
    assert v.count() == 0 and r.count() == 0


def test_duplicates_and_labels(spark):
    df = spark.createDataFrame([("b", "s"), ("a", "s"), ("c", None), ("d", None)], "k string, s string")
    assert {r.k: r.duplicate_of for r in G.duplicate_of(df, "k", "s").collect()} == {"a": None, "b": "a", "c": None, "d": None}
    old, new = spark.createDataFrame([("i", 3), ("j", 2)], "k string, v int"), spark.createDataFrame([("i", 3), ("j", 4), ("l", 1)], "k string, v int")
    merged, conflicts = G.merge_labels(old, new, ["k"], "v")
    assert sorted((r.k, r.v) for r in merged.collect()) == [("i", 3), ("l", 1)] and [r.k for r in conflicts.collect()] == ["j"]


def test_components_and_append(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z0")]
    got = {r.vertex: r.label for r in G.least_labels(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"z0": "z0", "z1": "z0"}
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("e", "e")], "key string, label string")
    links = spark.createDataFrame([("d", "b"), ("d", "c")], "a string, b string")
    assert {r.key: r.label for r in G.append_grouped(groups, links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}


def test_more_codes_take_longer_keys():
    assert [bits.best_agree(n, n, 6) for n in (10**3, 10**5, 10**7, 10**9)] == sorted(bits.best_agree(n, n, 6) for n in (10**3, 10**5, 10**7, 10**9))
    assert bits.best_agree(10, 10, 6) == 1 and bits.best_agree(10**9, 10**9, 6) >= 4 and bits.best_agree(10**10, 10**10, 6) >= 5
    assert len(bits.block_masks(6, 3)) == 84 and all(m.bit_length() <= 64 for m in bits.block_masks(6, 3))


@pytest.mark.parametrize("agree", [None, 1, 3, 6])
def test_near_pairs_equal_brute_force(spark, agree):
    rng = random.Random(3)
    codes = [rng.getrandbits(63) for _ in range(30)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in codes for _ in range(3)]
    signed = [c - (1 << 64) if c >> 63 else c for c in set(codes)]
    got = {(r.code_a, r.code_b) for r in G.near_pairs(spark.createDataFrame([(c,) for c in signed], "code long"), agree=agree).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}


def test_keys_of_codes_are_never_broadcast(spark):
    df = G.near_pairs(spark.createDataFrame([(c,) for c in range(40)], "code long"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and df.count() == 40 * 39 // 2


def test_images_meet_by_merged_keys(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("b", "y", 4)], "image_id string, sha256 string, code long")
    out = G.near_images(rows)
    assert "SortMergeJoin [k#" in out._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in out.collect()] == [("a", "b", 1)]


@pytest.fixture
def all_plans(monkeypatch):
    """Plans of the steps that are written; call it with the result to get its own as well."""
    plans, write = [], G.materialize
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(G, "materialize", lambda df, *name: (plans.append(plan_of(df)), write(df, *name))[1])
    return lambda df: [*plans, plan_of(df)]


def test_images_of_pairs_are_never_broadcast(spark, all_plans, tmp_path):
    spark.createDataFrame([("a", "x", 5), ("b", "y", 4)], "image_id string, sha256 string, code long").write.parquet(f"{tmp_path}/rows")
    out = G.near_images(spark.read.parquet(f"{tmp_path}/rows"))  # a file's size is known, and small
    plans = all_plans(out)
    assert "Broadcast" not in "".join(plans) and plans[-1].count("SortMergeJoin") == 3 and [tuple(r) for r in out.collect()] == [("a", "b", 1)]


def test_members_are_never_broadcast(spark, all_plans, tmp_path):
    spark.createDataFrame([("a", 5), ("b", 4), ("c", -1)], "image_id string, code long").write.parquet(f"{tmp_path}/rows")
    out = G.image_groups(spark.read.parquet(f"{tmp_path}/rows"))
    plans = all_plans(out)
    assert "Broadcast" not in "".join(plans) and "SortMergeJoin" in plans[-1]
    assert {(r.image_id, r.keeper[-1], r.first_image, r.images) for r in out.collect()} == {("a", "4", "a", 2), ("b", "4", "a", 2), ("c", "f", "c", 1)}


@pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test data here")
def test_pairs_of_the_report_are_never_broadcast(spark):
    plan = reports.dataset_report(spark, sqlcheck.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


@pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test data here")
def test_sections_of_the_report_are_counted_in_one_reading(spark):
    out = reports.dataset_report(spark, sqlcheck.DATA)
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # two of the last rows, five for pairs
    assert plan.count("Relation [") == 7 and {"images", "source", "duplicates", "eligibility"} <= {r.section for r in out.collect()}


@pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test data here")
def test_fingerprints_and_labels_are_never_broadcast(spark, all_plans):
    plans = all_plans(datasets.phash_groups(spark, sqlcheck.DATA))
    assert "Broadcast" not in "".join(plans) and sum("SortMergeJoin" in p for p in plans) >= 2  # edges, and each round


def test_keys_of_one_table_are_written_once(spark, all_plans):
    out = G.near_pairs(spark.createDataFrame([(c,) for c in range(40)], "code long"))
    assert len(all_plans(out)) == 2 and out.count() == 40 * 39 // 2  # its codes, and the result
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_many_keys_meet_in_passes(spark, all_plans, monkeypatch):
    monkeypatch.setattr(G, "PASS_ROWS", 0)
    rng = random.Random(5)
    codes = {rng.getrandbits(62) for _ in range(20)}
    codes |= {c ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(9))) for c in codes for _ in range(3)}
    table = spark.createDataFrame([(c,) for c in codes], "code long")
    near = {(a, b) for a in codes for b in codes if (a ^ b).bit_count() <= 6}
    out, both = G.near_pairs(table, agree=2), G.near_codes(table, table, agree=2)  # 28 keys a code
    assert sum("SortMergeJoin" in p for p in all_plans(out)[:-1]) == 4 and "SortMergeJoin" not in all_plans(out)[-1]
    joined = out.join(G.near_codes(table, table, agree=2).withColumnRenamed("code_b", "other"), "code_a")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Broadcast" not in joined
    assert sorted(map(tuple, out.collect())) == sorted(x for x in near if x[0] < x[1]) and sorted(map(tuple, both.collect())) == sorted(near)


def test_labels_are_never_broadcast(spark):
    labels = G.least_labels(spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d")], "a string, b string"))
    joined = labels.join(labels.withColumnRenamed("label", "other"), "vertex")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in joined.collect()} == {(v, x, x) for v, x in zip("abcde", "aaadd")}


def test_isotonic_fitted_axes_equal_max_min(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(axis, f"i{n}", "c", float(rng.randrange(12)), rng.randrange(1, 6)) for axis in ("sharpness", "lighting", "resolution", "framing") for n in range(40)]
    monkeypatch.setattr(fits, "observations", lambda s, d: s.createDataFrame(rows, "axis string, image_id string, cluster string, x double, level int"))
    want = {}
    for axis in {r[0] for r in rows}:
        own = [(r[3], r[4]) for r in rows if r[0] == axis]
        xs = sorted({x for x, _ in own})
        mean = lambda lo, hi: sum(y for x, y in own if lo <= x <= hi) / sum(lo <= x <= hi for x, _ in own)  # noqa: B023, E731
        want |= {(axis, x): max(min(mean(lo, hi) for hi in xs if hi >= x) for lo in xs if lo <= x) for x in xs}
    got = {(r.axis, r.x): r.fitted for r in fits.QUERIES["isotonic_fitted_axes"](spark, "").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_images_of_one_fingerprint(spark):
    rows = [("a", "x", 5), ("b", "y", 5), ("c", "y", 5), ("d", None, 5), ("e", "z", 4), ("f", "w", -1), ("g", "w", -1), ("h", "v", 1 << 40 | 0xFFFFFFF0000), ("i", "u", None), ("a", "x", 5)]
    df = spark.createDataFrame(rows, "image_id string, sha256 string, code long")
    pairs = {tuple(r) for r in G.near_images(df).collect()}
    assert pairs == {("a", "b", 0), ("a", "c", 0), ("a", "d", 0), ("b", "d", 0), ("c", "d", 0)} | {(x, "e", 1) for x in "abcd"}
    groups = {r.image_id: (r.hash[-1], r.keeper[-1], r.first_image, r.images) for r in G.image_groups(df).collect()}
    assert groups == {x: ("5", "4", "a", 5) for x in "abcd"} | {"e": ("4", "4", "a", 5), "f": ("f", "f", "f", 2), "g": ("f", "f", "f", 2), "h": ("0", "0", "h", 1)}


def test_quantile_rules(spark):
    rng = random.Random(1)
    x = sorted(rng.choice([rng.gauss(0, 5), 0.0, 1.0, -3.5]) for _ in range(501))
    c = Y.with_totals(Y.value_counts(spark.createDataFrame([("g", v) for v in x] + [("g", None)], "g string, v double"), ["g"], "v"), ["g"])
    for q in (0.1, 0.25, 0.5, 0.9):
        rows = c.groupBy("g").agg(Y.quantile_floor(q, F.lit(501)).alias("a"), Y.quantile_lower(q, F.lit(501)).alias("b"), Y.quantile_nearest(q, F.lit(501)).alias("c")).first()
        assert (rows.a, rows.b, rows.c) == (x[min(500, int(q * 501))], x[int(500 * q)], x[max(0, math.ceil(q * 501) - 1)])


def test_anchored_windows(spark):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1)
    rng = random.Random(5)
    rows = [(n, rng.choice(["a", "b", None]), t0 + dt.timedelta(seconds=rng.randrange(0, 5000))) for n in range(300)]
    want = {}
    for key in ("a", "b"):
        opened, used = None, 0
        for n, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if opened is None or (t - opened).total_seconds() >= 600:
                opened, used = t, 0
            used += 1
            want[n] = used <= 4
    got = St.limited(spark.createDataFrame(rows, "n long, k string, t timestamp"), "k", "t", "n", 4, 600.0).collect()
    assert {r.n: r.allowed for r in got} == want and all(r.retry_after >= 1 for r in got if not r.allowed)


def test_boxes(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.2, 0.2, 0.9), (1, 2, 0.4, 0.4, 0.2, 0.195, 0.8), (1, 3, 0.41, 0.4, 0.2, 0.195, 0.7), (2, 1, 0.0, 0.0, 0.1, 0.1, 0.5)], "i int, ordinal int, x double, y double, w double, h double, score double")
    got = {r.i: r for r in K.primary_box(df, "i").collect()}
    assert got[1].ordinal in (2, 3) and got[1].second_ratio == pytest.approx(0.975) and got[2].second_ratio is None
    assert sorted((r.i, r.ordinal) for r in K.suppress_overlaps(df, "i", 0.3).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_boxes_of_many_images_are_judged_together(spark, monkeypatch):
    monkeypatch.setattr(K, "BOXES", 50, raising=False)
    rng = random.Random(11)
    value = lambda: rng.choice([0.0, None, *[rng.randrange(1, 9) / 10] * 18])
    rows = [(i, o, *[value() for _ in range(5)]) for i in [None, *range(60)] for o in range(rng.choice([1, 2, 3, 7, 70]))]
    rng.shuffle(rows)

    def over(a, b):
        iw, ih = (max(0, min(a[n] + a[n + 2], b[n] + b[n + 2]) - max(a[n], b[n])) for n in (2, 3))
        union = a[4] * a[5] + b[4] * b[5] - iw * ih
        return union > 0 and iw * ih / union > 0.3

    want = set()
    for i in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[6] is None, -(r[6] or 0), r[1])):
            if None in r[2:6] or not any(over(r, k) for k in kept if None not in k[2:6]):
                kept.append(r)
        want |= {(i, r[1], r[6]) for r in kept}
    out = K.suppress_overlaps(spark.createDataFrame(rows, "i int, ordinal int, x double, y double, w double, h double, score double"), "i", 0.3)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_attach_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "heavy_bound", lambda total: 10)
    rows = spark.createDataFrame([("hot", n) for n in range(100)] + [(f"k{n}", n) for n in range(20)], "k string, n int")
    stats = rows.groupBy("k").agg(F.count("*").alias("c"))
    out = common.attach(rows, stats, "k", "c", 120).collect()
    assert len(out) == 120 and all(r.c == (100 if r.k == "hot" else 1) for r in out)


def test_shared_dir_is_the_sessions(spark):
    df = common.materialize(spark.range(5))
    assert df.count() == 5 and common.shared_dir(spark) in df._ratewright_path
    common.release(df)


def test_traits_and_extensions(spark):
    rows = [("He frames it well.", "a/b.PNG?x=1"), ("The theme is fine.", "a/b.gif"), ("middle-aged, perhaps", "a/b.jpeg"), ("The skin is pretty.", "a.jpg/b"), ("political affiliation", "a/b.webp#x")]
    got = spark.createDataFrame(rows, "t string, u string").select(F.col("t").rlike(T.TRAITS).alias("t"), T.extension(F.col("u")).alias("u")).collect()
    assert [(r.t, r.u) for r in got] == [(True, "png"), (False, "jpg"), (True, "jpeg"), (False, "jpg"), (True, "jpg")]


def test_placeholders(spark):
    rows = [("NA",), ("n/a (unstated)",), ("Nobody Inc",), ("no known author",), ("not known",), ("Unknownish",), (" - ",), ("Ann  Bell",), (None,)]
    got = spark.createDataFrame(rows, "c string").select(G.creator_group(F.col("c")).alias("g"), G.source_cluster(F.col("c")).alias("s")).collect()
    assert [r.g for r in got] == [None, None, "creator:nobody inc", None, None, "creator:unknownish", "creator:-", "creator:ann bell", None]
    assert [r.s for r in got] == [None, None, "Nobody Inc", None, None, None, None, "Ann  Bell", None]


def test_difference_hash_and_small_planes(spark):
    plane = [float((7 * i) % 11) for i in range(72)]
    want = 0
    for y in range(8):
        for x in range(8):
            want = want << 1 | (plane[y * 9 + x] > plane[y * 9 + x + 1])
    rows = [(plane,), (plane[:64],), (None,)]
    got = [r.h for r in spark.createDataFrame(rows, "p array<double>").select(K.neighbour_hash(F.col("p")).alias("h")).collect()]
    assert got[0] & (2**64 - 1) == want and got[1:] == [None, None]
    steps = K.np.tile(K.np.repeat([0.0, 50.0, 0.0, 50.0], 8), (1, 32, 1))
    assert K.block_quality(steps)[0] == 0 and K.block_quality(steps[:, :15])[0] == 100 and K.block_quality(steps[:, :, :15])[0] == 100
    grid = K.np.arange(100.0).reshape(1, 10, 10)
    assert K.crop(grid, 2.2, 4.0, 2.1, 1.0).tolist() == [[[42.0, 43.0, 44.0]]] and K.crop(grid, -5, 0, 4, 4) is None and K.crop(grid, -1, 9.5, 2, 9).tolist() == [[[90.0]]]
    assert K.face_light(grid, None)[1] is False and K.face_light(grid, (0, 0, 1, 1))[0]["mean"].tolist() == [0.0]
    assert K.eye_sharpness(grid, None) is None and K.eye_sharpness(grid, (0, 0, 2, 9)) is None and K.eye_sharpness(grid, (0, 0, 5, 5)).tolist() == [0.0]


def test_flags_of_a_distribution(spark):
    df = spark.createDataFrame([("a", s) for s in [3] * 15 + [1, 2, 4, 5] + [9, None]] + [("b", 9)], "axis string, score int")
    r = A.distribution_flags(df, ["axis"], "score").collect()
    assert len(r) == 1 and r[0].collapsed and r[0].provisional and r[0].n == 19 and r[0].off_scale == 1
    assert r[0].flags == ["level 3 holds 78.9% of ratings - the axis is close to constant", "1 rating(s) were not one of 1/2/3/4/5", "only 19 ratings; under 20 the flags above are noise, not evidence"]


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 4, 1), ("a", 2, 9), ("a", 4, 7), ("a", 1, 0)], "g string, v int, at int")
    assert [tuple(r) for r in Y.mode(df, ["g"], "v", "at").collect()] == [("a", 4, 0.4)]


def test_rank_statistics_equal_pairs(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(1, 6), rng.choice([rng.uniform(-3, 3), float(rng.randrange(4))])) for g in "ab" for _ in range(60)] + [("a", None, 1.0), ("a", 3, None), ("c", 2, 1.0), ("c", 2, 5.0)]
    df = spark.createDataFrame(rows, "g string, level int, v double")
    got = {r.g: r for r in A.rank_statistics(df, ["g"], "level", "v").collect()}
    for g in "ab":
        own = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        signs = [((a > c) - (a < c), (b > d) - (b < d)) for i, (a, b) in enumerate(own) for c, d in own[:i]]
        assert got[g].concordant == sum(s * t > 0 for s, t in signs) and got[g].discordant == sum(s * t < 0 for s, t in signs)
        assert got[g].tied_x == sum(s == 0 != t for s, t in signs) and got[g].tied_y == sum(t == 0 != s for s, t in signs)
        ranks = [[sum(b < a for b in z) + (z.count(a) + 1) / 2 for a in z] for z in (list(c) for c in zip(*own))]
        mean = (len(own) + 1) / 2
        dot = lambda p, q: sum((x - mean) * (y - mean) for x, y in zip(p, q))
        assert got[g].rho == pytest.approx(dot(*ranks) / math.sqrt(dot(ranks[0], ranks[0]) * dot(ranks[1], ranks[1]))) and got[g].n == len(own)
    assert got["c"].rho is None and A.rank_statistics(df.limit(0), ["g"], "level", "v").count() == 0


def test_score_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 2.5), ("a", 4, 4.4), ("a", 5, 2.0), ("a", 9, 3.0)], "g string, level int, p double")
    r = A.score_metrics(df, ["g"], "level", "p").first()
    assert (r.n, r.exact, r.within_one, r.mae, r.bias) == (4, 0.5, 0.75, 1.0, -0.5) and r.kendall == pytest.approx(1 / 3)


def test_supported_knots(spark):
    rows = [("a", float(i), 1 + i // 5) for i in range(20)] + [("a", 30.0, 5)] + [("b", float(i), 2) for i in range(9)]
    got = {r.g: [(k.x, k.y) for k in r.knots] for r in I.supported_knots(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], "x", "y").collect()}
    assert got == {"a": [(0.0, 1.0), (5.0, 2.0), (10.0, 3.0), (15.0, 4.0)], "b": []}


def test_calibration_warnings():
    quiet = I.calibration_warnings(200, 0.05, 1.0, dict.fromkeys(range(1, 6), 20), [(0.1, 1.0), (0.9, 5.0)], [], 0.6, "px")
    assert quiet == []
    loud = I.calibration_warnings(12, 0.25, 3.0, {1: 0, 2: 4, 3: 5, 4: 5, 5: 5}, [(2.0, 3.0)], [4, 5], 0.1, "px")
    assert loud[0].startswith("25.0% of images sit on the single value 3.0000.") and "NO example scored 1, so this map can never output 1" in loud
    assert "only 4 example(s) scored 2, below the 5 needed to anchor a knot" in loud and "the fit never reaches 4; no knot was invented for it" in loud
    assert [t.split(" is ")[0].split(" the fit")[0] for t in loud if t.startswith("STOP")] == ["STOP: top knot", "STOP:", "STOP: cross-validated Spearman"]
    assert loud[-1].startswith("bottom knot is 2.000 px scoring 3.00")


def test_faces_by_hand(spark):
    c = lambda *v: [F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v]
    r = spark.range(1).select(
        faces.roll(*c(0, 0, 10, 10)).alias("roll"), faces.yaw(*c(0, 0, 10, 0, 7.5, 9)).alias("yaw"), faces.yaw(*c(0, 0, 10, 0, 99, 0)).alias("far"),
        faces.eye_region(*c(1, 2, 30, 40), *c(10, 20, 30, 20)).alias("eyes"), faces.eye_region(*c(1, 2, 30, 40), *c(10, None, 30, 20)).alias("band"),
        faces.framing(*c(10, 20, 20, 30, 100, 100)).alias("f"), faces.framing(*c(None, None, None, None, 100, 100)).alias("none"), faces.central_third(*c(90, 60)).alias("third"),
        faces.qualifies(*c(5, 5, 0.5, 100, 100)).alias("yes"), faces.qualifies(*c(4.9, 5, 0.9, 100, 100)).alias("small"),
        faces.decoded_boxes(F.lit([-1.0, 2.0, 3.0, 4.0, 1.5, 0.0, 0.0, 0.0, 9.0, 0.9, 0.0, 0.0, 9.0, 9.0, 0.1, 7.0]), 2.0, 1.0, 0.3).alias("b"), faces.decoded_boxes(F.lit([]).cast("array<double>"), 1.0, 1.0, 0.0).alias("empty"),
    ).first()
    assert r.roll == pytest.approx(45) and r.yaw == pytest.approx(17.5) and r.far == 90
    assert tuple(r.eyes) == pytest.approx((1, 11, 38, 18)) and tuple(r.band) == pytest.approx((1, 10.8, 30, 12))
    assert tuple(r.f) == pytest.approx((0.06, -0.3, -0.15)) and tuple(r.none) == (0, 0, 0) and tuple(r.third) == (30, 20, 30, 20)
    assert r.yes and not r.small and [tuple(b) for b in r.b] == [(0.0, 2.0, 6.0, 4.0, 1.0)] and r.empty == []


def test_label_csv(spark):
    lines = spark.createDataFrame([('a,"b,""c""",3',), ("a,b,",), ("a,b,x",), ("a,b",), ("a,b,NaN",)], "l string")
    got = [tuple(r) for r in checks.label_csv(lines, "l", ["filename", "axis", "score"]).collect()]
    assert got == [("a", 'b,"c"', 3.0, None), ("a", "b", 0.0, None), ("a", "b", None, "non-numeric score"), ("a", "b", None, "2 fields; expected 3"), ("a", "b", None, "non-numeric score")]
    with pytest.raises(ValueError, match="found a, b"):
        checks.label_csv(lines, "l", ["a", "b"])


def test_reply_union(spark):
    texts = ['{"status":"assessed","scores":{"solo":3}}', '{"status":"assessed"}', '{"status":"declined","reason":"no_face"}', '{"status":"declined"}', '{"status":"assessed","scores":{},"reason":"x"}', '{"status":"maybe"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    loose, strict = ([tuple(r.u) for r in df.select(checks.reply_union(F.col("v"), s).alias("u")).collect()] for s in (False, True))
    assert loose[0] == ("assessed", None, None, None) and loose[1][3] == "assessed without scores" and loose[2] == ("declined", "no_face", "", None)
    assert loose[3][3] == "declined without a reason" and loose[4][3] is None and strict[4][3] == "parts of both kinds" and loose[5][3] == "unknown status"


def test_duplicate_groups_and_candidates(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    cols = "image_id string, sha256 string, perceptual_hash string, source string, cohort string, source_group string, creator_group string, dataset_role string, split_group string, duplicate_of string, feature_status string, vlm_status string, eligibility_reason string, extractor_version string, eligible_for_product_scoring boolean, ingested_at timestamp, creator string, width long, height long"
    row = lambda i, sha, h, sg=None, cg=None, role="development": (i, sha, h, "s", "c", sg, cg, role, None, None, "ready", "x", None, "v8", True, t, None, 1, 1)
    rows = [row("a", "1", "0" * 16), row("b", "2", "0" * 15 + "f", "G"), row("c", "3", None, " g "), row("d", "3", "f" * 16, role="validation"), row("e", "5", "00ff" * 4), row("e", "5", "00FF" * 4), row(None, "1", None)]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/dataset_image.parquet")
    got = {r.image_id: tuple(r)[1:] for r in reports.duplicate_groups(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a", None, 2, True), "b": ("a", None, 2, True), "c": ("a", None, 2, True), "d": ("a", "c", 2, True), "e": ("e", None, 1, False)}
