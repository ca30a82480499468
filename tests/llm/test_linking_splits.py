"""Groups, splits and overlaps against brute force on small tables."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratewright.llm import groups, linking, overlap, splits

IMAGE = "image_id string, duplicate_of string, dataset_role string, sha256 string, perceptual_hash string, source string, creator_group string, source_group string, split_group string, extra int"
MATCH = "pair_id long, left_image_id string, right_image_id string, verdict string, similarity double, v string"


def components(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def image(i, **kw):
    row = dict(image_id=i, duplicate_of=None, dataset_role="development", sha256=None, perceptual_hash=None, source="s", creator_group=None, source_group=None, split_group=None, extra=1) | kw
    return tuple(row.values())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, edges):
    named = [(f"v{a:02}", f"v{b:02}") for a, b in edges]
    got = {r.vertex: r.root for r in linking.hash_to_min(spark.createDataFrame(named, "a string, b string")).collect()}
    assert got == components([e for e in named if e[0] != e[1]])


def test_long_chain_and_hot_vertex(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"h{i}") for i in range(300)]
    rows = linking.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.vertex: r.root for r in rows} == components(edges)
    assert len(rows) == 121 + 301


def test_components_of_nothing(spark):
    none = spark.createDataFrame([("a", "a"), (None, "b"), ("c", None)], "a string, b string")
    assert linking.hash_to_min(none).count() == 0
    assert linking.hash_to_min(none.limit(0)).count() == 0


def test_groups_ignore_gone_and_null_ends(spark):
    images = spark.createDataFrame([image("A "), image("b"), image("b"), image("c", duplicate_of="b"), image("d", duplicate_of="gone"), image(None)], IMAGE)
    matches = spark.createDataFrame(
        [(1, "a", "B", "match", None, ""), (2, "b", "a", "match", 0.9, ""), (3, "d", "d", "match", 1.0, ""), (4, "d", None, "match", 1.0, ""), (5, "d", "a", "no_match", 1.0, ""), (6, "d", "a", None, 1.0, "")], MATCH
    )
    got = {r.image_id: r.group_id for r in groups.linked_groups(images, matches).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}
    assert {r.image_id: r.group_id for r in groups.all_groups(images, matches).collect()} == got | {"d": "d"}
    assert groups.linked_groups(images.limit(0), matches).count() == 0


def related(rows):
    edges = []
    for i, c, s, g in rows:
        edges += [(f"0{i}", f"1{n}{k}") for n, k in enumerate((c, s, g)) if k]
    root = components(edges)
    return {i: root.get(f"0{i}", f"0{i}")[1:] for i, *_ in rows}


def test_related_and_parted_sets(spark):
    rng = random.Random(3)
    rows = [(f"i{n:03}", rng.choice([None, "hot", f"c{rng.randrange(30)}"]), rng.choice([None, " ", f"s{rng.randrange(60)}"]), rng.choice([None, f"g{n}"])) for n in range(200)]
    clean = [(i, c, s if s and s.strip() else None, g) for i, c, s, g in rows]
    roles = [rng.choice(["development", "Development ", "validation", None]) for _ in rows]
    images = spark.createDataFrame([image(i, creator_group=c and c.upper(), source_group=s, split_group=g, dataset_role=r) for (i, c, s, g), r in zip(rows, roles)], IMAGE)
    want = related(clean)
    assert {r.image_id: r.set_id for r in splits.related_sets(images).collect()} == want
    held = defaultdict(set)
    for (i, *_), r in zip(rows, roles):
        if r:
            held[want[i]].add(r.strip().lower())
    parted = {(r.image_id, r.set_id) for r in splits.parted_sets(images).collect()}
    assert parted == {(i, s) for i, s in want.items() if len(held[s]) > 1}


def test_split_keeps_sets_whole_and_meets_proportions(spark):
    rows = [image(f"i{n:04}", creator_group=f"c{n % 150}" if n % 3 else None) for n in range(1500)]
    images = spark.createDataFrame(rows, IMAGE)
    out = splits.assign_splits(images).collect()
    assert len(out) == 1500 == len({r.image_id for r in out})
    by_set = defaultdict(set)
    for r in out:
        by_set[r.set_id].add(r.dataset_role)
    assert all(len(v) == 1 for v in by_set.values())
    for role, share in splits.PROPORTIONS.items():
        assert abs(sum(r.dataset_role == role for r in out) / 1500 - share) < 0.02
    assert sorted(out) == sorted(splits.assign_splits(images.repartition(7)).collect())
    assert splits.assign_splits(images.limit(0)).count() == 0


def test_one_set_with_a_third_of_all(spark):
    images = spark.createDataFrame([image(f"i{n:04}", creator_group="one" if n % 3 == 0 else f"c{n}") for n in range(900)], IMAGE)
    out = splits.assign_splits(images).collect()
    assert len({r.dataset_role for r in out if r.set_id == "i0000"}) == 1
    assert abs(sum(r.dataset_role == "validation" for r in out) / 900 - 0.15) < 0.02


def test_differencing_balances():
    rng = random.Random(1)
    items = [(rng.randrange(1, 500), n) for n in range(400)]
    weight = {n: w for w, n in items}
    bins = splits.differencing(items, 10)
    assert sorted(x for b in bins for x in b) == list(range(400))
    loads = [sum(weight[x] for x in b) for b in bins]
    assert max(loads) - min(loads) <= 500 // 10
    with pytest.raises(ValueError):
        splits.assign_splits(None, {"a": 0.0})


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for n in range(300):
        code = rng.choice(base)
        for _ in range(rng.randrange(0, 9)):
            code ^= 1 << rng.randrange(64)
        h = f"{code:016x}"
        rows.append((f"i{n:03}", rng.choice(["development", "validation", "final_test"]), rng.choice([None, f"sha{rng.randrange(80)}"]), rng.choice([h, h.upper(), None, "xyz", f" {h}"])))
    images = spark.createDataFrame([image(i, dataset_role=r, sha256=s, perceptual_hash=h) for i, r, s, h in rows], IMAGE).unionByName(spark.createDataFrame([image("i000", dataset_role=rows[0][1], sha256=rows[0][2], perceptual_hash=rows[0][3])], IMAGE))

    def code_of(h):
        return int(h, 16) if h and h != "xyz" else None

    want = set()
    for a, ra, sa, ha in rows:
        for b, rb, sb, hb in rows:
            if ra == "development" and rb != "development":
                ca, cb = code_of(ha), code_of(hb)
                if sa and sa == sb or ca is not None and cb is not None and (ca ^ cb).bit_count() <= 6:
                    want.add((a, b))
    for agree in (None, 1, 2, 4):
        assert {(r.image_t, r.image_e) for r in overlap.cross_split_pairs(images, 6, agree).collect()} == want
    report = overlap.overlap_report(images).collect()
    assert sum(r.pairs for r in report) == len(want)
    both = images.unionByName(spark.createDataFrame([image("i001", dataset_role=r, sha256="shaX") for r in ("development", "final_test")] + [image("i002", dataset_role="development", sha256="shaX")], IMAGE))
    pairs = {(r.image_t, r.image_e) for r in overlap.cross_split_pairs(both).collect()} - want
    assert ("i002", "i001") in pairs and ("i001", "i001") not in pairs
    assert sum(r.pairs for r in overlap.overlap_report(both.where("sha256 = 'shaX'")).collect()) == 1
    assert overlap.overlap_report(images.limit(0)).count() == 0
    assert overlap.cross_split_pairs(images.limit(0)).count() == 0
