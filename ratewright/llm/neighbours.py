"""The most similar vectors of every vector: a forest of random-projection trees, searched through one queue, then exact.

A tree splits by one random direction a level, at the median of each node (fitted on a bounded sample). A vector is
indexed in its leaf of every tree. It searches those leaves and, through one priority queue shared by all trees, the
further leaves whose splits it lies nearest to. What travels to a leaf is a sketch of sign bits, not the vector. Every
leaf candidate that the sketch puts in reach is compared exactly, in a place where full vectors meet. Each vector takes
the least hash of its candidates, and vectors that agree on one meet (as sets with a high overlap do by min-wise hashing;
``PLACES`` hashes are taken). Candidates that agree on none meet in a place of their own, and a leaf with very many
candidates, or too large for sketches, is a place itself. In a place all similarities are computed exactly.

Vectors with the same content travel once; their rows are expanded again at the end.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import attach, materialize, norm_key, release

TREES = 16
EXTRA = 24
BITS = 256
PLACES = 3
LEAF = 96
LEAF_MOST = 2048
PLACE_MOST = 2048
#: Candidates a member from which a leaf becomes a place, instead of its pairs being listed.
DENSE = 64
#: Most vectors of one comparing task's place; a larger place becomes cells, in some of which any two of its members meet.
CELL = 16_384
#: Levels up to which ``TREES`` and ``EXTRA`` hold. With each further level two similar vectors part more often, so beyond
#: them extra leaves double every two levels and trees every six.
LEVELS = 10
#: Most vectors the forest's splits are fitted on.
SAMPLE = 8192
#: Levels with a split of their own in every node that holds ``NODE_LEAST`` of the sample; below, a level's nodes share one.
NODE_LEVELS, NODE_LEAST = 12, 32
FLUSH = 20_000


@dataclass
class Forest:
    """Directions and splits; ``reach`` is the most differing sketch bits of a candidate."""

    mean: np.ndarray
    directions: np.ndarray
    splits: list[np.ndarray]
    signs: np.ndarray
    trees: int
    depth: int
    prefix: int
    reach: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        y = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-30) - self.mean
        return y / np.linalg.norm(y, axis=1, keepdims=True).clip(1e-30)

    def descend(self, p: np.ndarray, tree: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf codes and signed margins of projections ``p`` (rows, depth) in ``tree``, turning off at the flipped levels."""
        code = np.zeros(len(p), dtype=np.int64)
        margin = np.empty_like(p)
        for level in range(self.depth):
            split = self.splits[level]
            margin[:, level] = p[:, level] - split[tree, code if split.shape[1] > 1 else 0]
            code = code * 2 + ((margin[:, level] > 0) ^ (flips >> level & 1).astype(bool))
        return code, margin


def _orthogonal(rng: np.random.Generator, count: int, width: int) -> np.ndarray:
    out = []
    while len(out) < count:
        out.extend(np.linalg.qr(rng.standard_normal((width, width)))[0].T)
    return np.array(out[:count], dtype=np.float32)


def _depth(rows: int, leaf: int = LEAF) -> int:
    return min(30, max(1, math.ceil(math.log2(max(2, rows / leaf)))))


def widened(rows: int, trees: int = TREES, extra: int = EXTRA) -> tuple[int, int]:
    """Trees and extra leaves for so many vectors, so that recall doesn't fall with their number."""
    more = max(0, _depth(rows) - LEVELS)
    return math.ceil(trees * 2 ** (more / 6)), math.ceil(extra * 2 ** (more / 2))


def fit_forest(sample: np.ndarray, rows: int, similarity: float, trees: int = TREES, bits: int = BITS, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Forest for ``rows`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    depth = _depth(rows, leaf)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True).clip(1e-30)
    mean = unit.mean(0).astype(np.float32) if len(sample) >= 64 else np.zeros(width, np.float32)
    m2 = float((mean**2).sum())
    c = min(1.0, max(-1.0, (similarity - m2) / max(1 - m2, 1e-9)))
    share = math.acos(c) / math.pi
    reach = min(bits, math.ceil(bits * share + math.sqrt(bits * share * (1 - share))))
    forest = Forest(mean, _orthogonal(rng, trees * depth, width), [], _orthogonal(rng, bits, width), trees, depth, min(depth, max(0, math.ceil(math.log2(max(1, rows / 20_000))))), reach)
    p = (forest.centred(sample) @ forest.directions.T).reshape(len(sample), trees, depth)
    code = np.zeros((len(sample), trees), dtype=np.int64)
    for level in range(depth):
        whole = np.median(p[:, :, level], axis=0)
        if level < NODE_LEVELS:
            split = np.repeat(whole[:, None], 1 << level, axis=1)
            for t in range(trees):
                own = p[np.lexsort((p[:, t, level], code[:, t])), t, level]
                size = np.bincount(code[:, t], minlength=1 << level)
                start = np.cumsum(size) - size
                node = np.flatnonzero(size >= NODE_LEAST)
                split[t, node] = (own[start[node] + (size[node] - 1) // 2] + own[start[node] + size[node] // 2]) / 2
        else:
            split = whole[:, None]
        forest.splits.append(split.astype(np.float32))
        at = split[np.arange(trees)[None, :], code if split.shape[1] > 1 else np.zeros_like(code)]
        code = code * 2 + (p[:, :, level] > at)
    return forest


def _queue(margin: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``extra`` nearest further leaves of each row over all trees: ``(tree, flips)``, each (rows, extra).

    Of each tree the five splits a row lies nearest to may be crossed; a leaf's priority is its distance over the crossed
    splits, and the leaves of all trees stand in one queue.
    """
    n, trees, depth = margin.shape
    near = min(5, depth)
    a = np.abs(margin)
    order = np.argsort(a, axis=2)[:, :, :near]
    value = np.take_along_axis(a, order, 2) ** 2
    score, flips = [], []
    for s in range(1, 1 << near):
        used = [i for i in range(near) if s >> i & 1]
        score.append(value[:, :, used].sum(2))
        flips.append((np.int64(1) << order[:, :, used]).sum(2))
    score, flips = np.stack(score, 2).reshape(n, -1), np.stack(flips, 2).reshape(n, -1)
    extra = min(extra, score.shape[1])
    best = np.argpartition(score, extra - 1, axis=1)[:, :extra]
    return best // ((1 << near) - 1), np.take_along_axis(flips, best, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1).astype(np.float32, copy=False) if len(flat) else np.empty((0, 0), np.float32)


def index_blobs(forest: Forest, extra: int):
    """Map side of the search: rows ``(g, data)``, a blob of sketches for each part of a tree that rows fall into."""

    def pack(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, first = np.unique(ids, return_index=True)
        z = forest.centred(x[first])
        n = len(ids)
        bits = np.packbits(z @ forest.signs.T > 0, axis=1)
        p = (z @ forest.directions.T).reshape(n, forest.trees, forest.depth)
        tree = np.tile(np.arange(forest.trees), n)
        code, margin = forest.descend(p.reshape(-1, forest.depth), tree, np.zeros(len(tree), np.int64))
        row = np.repeat(np.arange(n), forest.trees)
        home = np.ones(len(tree), bool)
        if extra:
            t, flips = _queue(margin.reshape(n, forest.trees, forest.depth), extra)
            r2 = np.repeat(np.arange(n), t.shape[1])
            t, flips = t.ravel(), flips.ravel()
            code2, _ = forest.descend(p[r2, t], t, flips)
            row, tree, code, home = np.concatenate([row, r2]), np.concatenate([tree, t]), np.concatenate([code, code2]), np.concatenate([home, np.zeros(len(t), bool)])
        group = (tree << forest.prefix) | (code >> (forest.depth - forest.prefix))
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        keys, blobs = [], []
        for part in np.split(order, cuts):
            keys.append(int(group[part[0]]))
            blobs.append(np.int64(len(part)).tobytes() + (code[part] * 2 + home[part]).astype(np.uint32).tobytes() + ids[row[part]].tobytes() + bits[row[part]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["g", "data"])

    # A row's places in all leaves are held at once.
    flush = max(1, FLUSH * (TREES + EXTRA) // max(TREES + EXTRA, forest.trees + extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append((np.asarray(b.column(0)), _matrix(b.column(1))))
                count += b.num_rows
            if count >= flush:
                yield from pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held, count = [], 0
        if count:
            yield from pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return run


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


def _leaves(code: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each leaf."""
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def leaf_search(bits: int, reach: int, places: int, most: int):
    """Reduce side of the search: of one part of a tree, rows ``(id, l0, l1, ..., others, dense)``.

    ``l0, l1, ...`` are the least hashes of each vector's candidates, ``others`` its candidates of a greater id, ``dense``
    the leaves that are places: those with over ``most`` vectors or ``DENSE`` candidates a member.
    """

    def lists(at: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order]))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        codes, ids, sketches = [], [], []
        for blob in table.column("data").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            codes.append(np.frombuffer(blob, np.uint32, n, 8))
            ids.append(np.frombuffer(blob, np.int64, n, 8 + 4 * n))
            sketches.append(np.frombuffer(blob, np.uint8, n * bits // 8, 8 + 12 * n).reshape(n, -1))
        code, ids, sketch = np.concatenate(codes), np.concatenate(ids), np.concatenate(sketches)
        home = code & 1 > 0
        known, at = np.unique(ids, return_inverse=True)
        hashes = [_mixed(known, r) for r in range(places)]
        none = np.iinfo(np.int64).max
        best = [np.full(len(known), none) for _ in range(places)]
        pairs, members, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        group = int(key[0].as_py())
        for part in _leaves(code >> 1):
            # Copies of a vector from other map tasks stand for one; a home row serves as data and as query.
            own = part[home[part]]
            if not len(own):
                continue
            _, u = np.unique(at[own], return_index=True)
            own = own[u]
            asking = np.concatenate([own, part[~home[part]]])
            dense = len(asking) > most
            if not dense:
                side = np.unpackbits(sketch[asking], axis=1).astype(np.float32) * 2 - 1
                agree = side @ side[: len(own)].T
                q, d = np.nonzero(agree >= bits - 2 * reach)
                q, d = at[asking[q]], at[own[d]]
                keep = q != d
                q, d = q[keep], d[keep]
                dense = len(q) > DENSE * len(asking)
            if dense:
                inside = np.unique(at[asking])
                members.append(inside)
                leaves.append(np.full(len(inside), _mixed(np.array([(group << 32) | int(code[part[0]] >> 1)]), places)[0]))
                continue
            pairs.append(np.unique(np.minimum(q, d) * len(known) + np.maximum(q, d)))
            q, d = np.concatenate([q, d]), np.concatenate([d, q])
            for h, b in zip(hashes, best):
                np.minimum.at(b, q, h[d])
        pair, member, leaf = np.unique(np.concatenate(pairs)), np.concatenate(members), np.concatenate(leaves)
        got = best[0] < none
        least = {f"l{r}": pa.array(np.minimum(best[r], hashes[r]), mask=~got) for r in range(places)}
        out = pa.table({"id": known} | least | {"others": lists(pair // len(known), known[pair % len(known)], len(known)), "dense": lists(member, leaf, len(known))})
        got[member] = True
        return out.filter(pa.array(got))

    return run


def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, data)``: each content of a task once, its bytes by plane and entropy coded, without loss."""
    seen: set[int] = set()
    for b in batches:
        ids, x = np.asarray(b.column(0)), _matrix(b.column(1))
        keep = [i for i, k in enumerate(ids.tolist()) if not (k in seen or seen.add(k))]
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)) if len(x) else x
        blobs = []
        for i in keep:
            z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
            blobs.append(z.compress(planes[i].tobytes()) + z.flush())
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(blobs, pa.binary())], names=["id", "data"])


def _unpack(blobs: list[bytes], width: int) -> np.ndarray:
    planes = np.frombuffer(b"".join(zlib.decompress(b, -15) for b in blobs), np.uint8).reshape(len(blobs), 4, width)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(len(blobs), -1).view(np.float32).reshape(len(blobs), width)


def place_search(width: int, k: int, similarity: float, most: int):
    """Exact similarities of the vectors that meet in a place: rows ``(id, other, similarity)``, of each vector its best ``k``.

    Input is sorted by place. All vectors of a place are compared, with at most ``most`` squared similarities held at once.
    """

    def compare(ids: np.ndarray, blobs: list[bytes], out: list) -> None:
        ids, first = np.unique(ids, return_index=True)
        if len(ids) < 2:
            return
        y = _unpack([blobs[i] for i in first], width)
        norm = np.sqrt(np.einsum("ij,ij->i", y, y, dtype=np.float64))
        z = (y / norm[:, None]).astype(np.float32)
        take = min(k + 3, len(ids) - 1)
        step = max(1, most * most // len(ids))
        for lo in range(0, len(ids), step):
            s = z[lo : lo + step] @ z.T
            own = np.arange(len(s))
            s[own, own + lo] = -2
            near = np.argpartition(-s, take - 1, axis=1)[:, :take]
            q = np.repeat(own, take)
            d = near.ravel()
            keep = s[q, d] >= similarity - 1e-3
            q, d = q[keep] + lo, d[keep]
            exact = np.einsum("ij,ij->i", y[q] / norm[q, None], y[d] / norm[d, None])
            keep = exact >= similarity
            out.append((ids[q[keep]], ids[d[keep]], exact[keep]))

    def emit(out: list) -> pa.RecordBatch:
        a, b, s = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["id", "other", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, blobs, out = np.empty(0, np.int64), np.empty(0, np.int64), [], []
        for b in batches:
            place, ids = np.concatenate([place, np.asarray(b.column(0))]), np.concatenate([ids, np.asarray(b.column(1))])
            blobs += b.column(2).to_pylist()
            start = 0
            for cut in np.flatnonzero(np.diff(place)) + 1:
                compare(ids[start:cut], blobs[start:cut], out)
                start = cut
            place, ids, blobs = place[start:], ids[start:], blobs[start:]
            if out:
                yield emit(out)
                out = []
        compare(ids, blobs, out)
        if out:
            yield emit(out)

    return run


def _places(found: DataFrame, places: int) -> tuple[DataFrame, DataFrame]:
    """``(place, id)`` such that any two candidates of ``found`` share a place, and what to release once that is read."""
    least = [f"l{r}" for r in range(places)]
    whole = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    each = found.groupBy("id").agg(*[F.min(c).alias(c) for c in least], whole("others").alias("others"), whole("dense").alias("dense"))
    meet = materialize(each.select("id", F.array_distinct(F.concat(F.array_compact(F.array(*least)), "dense")).alias("hosts"), "others"), "meet")
    links = meet.select("id", F.col("hosts").alias("mine"), F.explode("others").alias("other"))
    apart = links.join(meet.select(F.col("id").alias("other"), "hosts"), "other").where(~F.arrays_overlap("mine", "hosts")).select("id", "other")
    stars = apart.groupBy("id").agg(F.collect_list("other").alias("others")).select(F.xxhash64("id", F.lit("star")).alias("place"), F.explode(F.concat("others", F.array("id"))).alias("id"))
    return meet.select(F.explode("hosts").alias("place"), "id").unionByName(stars), meet


def _cells(placed: DataFrame, most: int) -> DataFrame:
    """Splits a place of over ``most`` vectors into smaller ones, so that any two of its members still share one.

    Its members fall into blocks by their hash, and each two blocks are a cell.
    """
    large = placed.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > most).select("place", F.ceil(F.col("n") * 2 / most).alias("blocks"))
    rows = placed.join(F.broadcast(large), "place", "left")  # at most the rows over ``most``
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    cells = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != own), lambda j: F.xxhash64("place", F.least(own, j), F.greatest(own, j)))
    return rows.select(F.explode(F.when(F.col("blocks").isNull(), F.array("place")).otherwise(cells)).alias("place"), "id")


def usable(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``(key, vector, id)`` of rows whose vector has exactly ``width`` finite numbers, not all zero; ``id`` hashes its content."""
    rows = vectors.select(norm_key(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.where(F.col("key").isNotNull() & _fine("vector", width)).withColumn("id", F.xxhash64("vector"))


def _fine(name: str, width: int) -> Column:
    v, inf = F.col(name), F.lit(float("inf")).cast("float")
    return v.isNotNull() & (F.size(v) == width) & (F.size(F.array_compact(v)) == width) & (F.array_max(v) < inf) & (F.array_min(v) > -inf) & ((F.array_max(v) > 0) | (F.array_min(v) < 0))


def similar_contents(rows: DataFrame, width: int, k: int, similarity: float, trees: int = TREES, extra: int = EXTRA, places: int = PLACES) -> DataFrame:
    """``(id, others)`` of distinct contents: up to ``k`` others, as structs ``(far, other)``, far being minus the similarity."""
    spark = rows.sparkSession
    count = rows.select("id").distinct().count()
    # A content hash picks the sample from distinct contents: bounded, and the same on every run.
    order = F.xxhash64("id", F.lit(1))
    some = rows.where(F.pmod(order, F.lit(max(1, count // SAMPLE))) == 0).groupBy("id").agg(F.any_value("vector").alias("vector"))
    picked = some.orderBy(order, "id").limit(SAMPLE).toArrow()
    sample = _matrix(picked.column("vector")) if picked.num_rows else np.ones((1, width), np.float32)
    base = (trees + extra) / trees
    trees, extra = widened(count, trees, extra)
    most = math.ceil(LEAF_MOST * (trees + extra) / trees / base)  # a leaf has more askers then
    forest = fit_forest(sample, count, similarity, trees)
    labels = ", ".join(f"l{r} long" for r in range(places))
    blobs = rows.select("id", "vector").mapInArrow(index_blobs(forest, extra), "g long, data binary")
    found = blobs.groupBy("g").applyInArrow(leaf_search(BITS, forest.reach, places, most), f"id long, {labels}, others array<long>, dense array<long>")
    hosts, meet = _places(found, places)
    whole = materialize(hosts, "hosts")
    hosts = materialize(_cells(whole, CELL), "cells")
    release(whole)
    release(meet)
    data = rows.select("id", "vector").mapInArrow(pack_vectors, "id long, data binary")
    placed = hosts.join(data, "id").select("place", "id", "data")
    width_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    compared = placed.repartition(width_parts, "place").sortWithinPartitions("place", "id").mapInArrow(place_search(width, k, similarity, PLACE_MOST), "id long, other long, similarity double")
    best = compared.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("far"), "other"))), 1, k).alias("others"))
    out = materialize(best, "near")
    release(hosts)
    return out


def similar_pairs(vectors: DataFrame, key: str = "sha256", vector: str = "clip_embedding", width: int = 512, k: int = 5, similarity: float = 0.8, **search: int) -> DataFrame:
    """``(a, b, similarity)``, a before b: pairs of keys of which at least one is among the ``k`` most similar to the other.

    Similarity is the cosine, at least ``similarity``. Rows with a null key or an unusable vector (null, other width, null
    or non-finite numbers, all zero) take no part. Repeated rows count once; of rows of one key with different vectors each
    takes part. Equal similarities are ranked by key. Any number of keys may share one vector: contents are compared, not
    rows, and each row then takes the ``k`` smallest keys among its copies before others. No rows give no pairs; extra
    columns are ignored.
    """
    rows = usable(vectors, key, vector, width)
    near = similar_contents(rows, width, k, similarity, **search)
    members = materialize(rows.select("id", "key").distinct(), "members")
    total = members.count()
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).where(F.col("r") <= k + 1)
    first = first.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    sizes = members.groupBy("id").agg(F.count("*").alias("n"))
    lists = near.select("id", F.explode("others").alias("o")).select("id", F.col("o.other").alias("other"), F.col("o.far").alias("far"))
    wide = lists.join(first.withColumnRenamed("id", "other"), "other").select("id", F.explode("keys").alias("key"), "far")
    others = wide.groupBy("id").agg(F.collect_list(F.struct("far", "key")).alias("others"))
    copies = first.where(F.size("keys") > 1).select("id", F.transform("keys", lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("key"))).alias("copies"))
    table = others.join(copies, "id", "full_outer").join(sizes, "id")
    empty = F.array().cast("array<struct<far:double,key:string>>")
    table = table.select("id", "n", F.slice(F.array_sort(F.concat(F.coalesce("others", empty), F.coalesce("copies", empty))), 1, 2 * k + 1).alias("c"))
    mine = attach(members, table, "id", "n", total)
    top = mine.select("key", F.explode(F.slice(F.filter("c", lambda x: x["key"] != F.col("key")), 1, k)).alias("o"))
    return top.select(F.least("key", "o.key").alias("a"), F.greatest("key", "o.key").alias("b"), (-F.col("o.far")).alias("similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
