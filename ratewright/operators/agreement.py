"""Agreement of raters and models, computed from contingency cells instead of pairs of rows.

Levels are few, so whatever the number of ratings, a pair of series is described by at most 25 counts; rank correlation,
concordance, confusion and the rest follow from those. No plan here enumerates pairs of items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import materialize
from ratewright.operators.summary import order_bucket

LEVELS = [1, 2, 3, 4, 5]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def last_ratings(labels: DataFrame, unit: list[str], rater: str, score: str, at: str) -> DataFrame:
    """One rating a unit and rater: the latest, of equal times the highest; null raters are one rater, 'unnamed'."""
    r = F.coalesce(F.col(rater), F.lit("unnamed")).alias(rater)
    return labels.groupBy(*unit, r).agg(F.max(F.struct(at, score))[score].alias(score))


def ordinal_alpha(ratings: DataFrame, by: list[str], unit: str, score: str) -> DataFrame:
    """Krippendorff's alpha for ordinal levels, per ``by``: ``(…, alpha, reason, units, ratings)``.

    One pass: level counts per unit, then the 25 sums of the coincidence matrix. Units with one rating aren't pairable.
    """
    counts = ratings.groupBy(*by, unit).agg(*[F.count_if(F.col(score) == v).alias(f"c{v}") for v in LEVELS])
    m = total([F.col(f"c{v}") for v in LEVELS])
    counts = counts.withColumn("m", m)
    pair = F.col("m") >= 2
    sums = [F.sum(F.when(pair, F.col(f"c{i}") * (F.col(f"c{j}") - (1 if i == j else 0)) / (F.col("m") - 1).cast("double"))).alias(f"o{i}{j}") for i in LEVELS for j in LEVELS]
    o = counts.groupBy(*by).agg(F.count_if(pair).alias("units"), F.coalesce(F.sum(F.when(pair, F.col("m"))), F.lit(0)).alias("ratings"), *sums)
    n = {i: total([F.col(f"o{i}{j}") for j in LEVELS]) for i in LEVELS}
    every = total(list(n.values()))

    def delta(i: int, j: int) -> Column:
        d = total([n[g] for g in LEVELS if i <= g <= j]) - (n[i] + n[j]) / 2
        return d * d

    observed = total([F.col(f"o{i}{j}") * delta(i, j) for i in LEVELS for j in LEVELS if i < j])
    expected = total([n[i] * n[j] * delta(i, j) for i in LEVELS for j in LEVELS if i < j])
    reason = F.when(F.col("units") == 0, "no unit has two or more ratings").when(expected == 0, "every rating is identical, so alpha is undefined")
    return o.select(*by, F.when(reason.isNull(), F.lit(1.0) - (every - 1) * F.try_divide(observed, expected)).alias("alpha"), reason.alias("reason"), "units", "ratings")


def alpha_verdict(alpha: Column) -> Column:
    return F.when(alpha >= 0.8, "ship").when(alpha >= 0.65, "rewrite-anchors").when(alpha.isNotNull(), "do-not-train")


def cells(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Counts ``(…, x, y, n)`` of paired levels."""
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))


def _mid_ranks(c: DataFrame, by: list[str]) -> DataFrame:
    for v in ("x", "y"):
        sums = c.groupBy(*by, v).agg(F.sum("n").alias("t"))
        ranks = sums.select(*by, v, (F.sum("t").over(Window.partitionBy(*by).orderBy(v)) - F.col("t") + (F.col("t") + 1) / 2).alias(f"r{v}"))
        c = c.join(ranks, [*by, v])
    return c


def spearman(c: DataFrame, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks, per ``by``; a constant series has a reason instead of a value."""
    c = materialize(c, "cells")  # read three times
    r = _mid_ranks(c, by)
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxx, syy, sxy = (F.sum(F.col("n") * F.col(a) * F.col(b)) for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry")))
    g = r.groupBy(*by).agg(n.alias("n"), (sxy - sx * sy / n).alias("c"), (sxx - sx * sx / n).alias("vx"), (syy - sy * sy / n).alias("vy"))
    reason = F.when(F.col("n") < 2, "need at least two paired observations").when((F.col("vx") <= 1e-9) | (F.col("vy") <= 1e-9), "one series has no variance, so correlation is undefined")
    return g.select(*by, F.when(reason.isNull(), F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))).alias("rho"), reason.alias("reason"), F.col("n").cast("long").alias("n"))


def concordance(c: DataFrame, by: list[str]) -> DataFrame:
    """Concordant, discordant and tied pair counts of items per ``by``, from at most 625 pairs of cells each."""
    c = materialize(c, "cells")  # read twice
    a, b = c.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1")), c.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    both = a.join(b, by)
    s = F.signum((F.col("x1") - F.col("x2")).cast("double")) * F.signum((F.col("y1") - F.col("y2")).cast("double"))
    tx, ty = F.col("x1") == F.col("x2"), F.col("y1") == F.col("y2")
    w = F.col("n1") * F.col("n2") / 2
    zero = F.lit(0.0)
    return both.groupBy(*by).agg(
        F.sum(F.when(s > 0, w).otherwise(zero)).alias("concordant"),
        F.sum(F.when(s < 0, w).otherwise(zero)).alias("discordant"),
        F.sum(F.when(tx & ~ty, w).otherwise(zero)).alias("tied_x"),
        F.sum(F.when(ty & ~tx, w).otherwise(zero)).alias("tied_y"),
    )


def kendall_tau(counts: DataFrame) -> Column:
    """Tau-b from ``concordance``; null if one series ranks nothing."""
    c, d, x, y = (F.col(k) for k in ("concordant", "discordant", "tied_x", "tied_y"))
    return F.try_divide(c - d, F.sqrt((c + d + x) * (c + d + y)))


def pairwise_accuracy(truth: str = "x") -> Column:
    """Of the pairs that the truth orders, the share ordered alike; a tie of the other side counts half."""
    other = F.col("tied_y" if truth == "x" else "tied_x")
    return F.try_divide(F.col("concordant") + other / 2, F.col("concordant") + F.col("discordant") + other)


def rank_agreement() -> Column:
    """Share of concordant among the pairs that neither side ties."""
    return F.try_divide(F.col("concordant"), F.col("concordant") + F.col("discordant"))


def simple_agreement(c: DataFrame, by: list[str]) -> DataFrame:
    """Exact and within-one shares, mean absolute error and bias ``x - y``, per ``by``."""
    d = (F.col("x") - F.col("y")).cast("double")
    n = F.sum("n")
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0.0)) / n
    return c.groupBy(*by).agg(share(d == 0).alias("exact"), share(F.abs(d) <= 1).alias("within_one"), (F.sum(F.abs(d) * F.col("n")) / n).alias("mae"), (F.sum(d * F.col("n")) / n).alias("bias"), share(F.abs(d) >= 2).alias("off_by_two"), n.cast("long").alias("n"))


def confusion(c: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """All 25 cells of every group, empty ones with 0."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in LEVELS for j in LEVELS])).alias("g")
    return groups.select(*by, grid).select(*by, "g.*").join(c, [*by, "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)).cast("long"))


def distribution(ratings: DataFrame, by: list[str], score: str) -> DataFrame:
    """Count and share of each level (zero-filled), flags, and ratings off the scale, per ``by``."""
    per = ratings.groupBy(*by).agg(*[F.count_if(F.col(score) == v).alias(f"c{v}") for v in LEVELS], F.count_if(F.col(score).isNotNull() & ~F.col(score).isin(LEVELS)).alias("off_scale"))
    n = total([F.col(f"c{v}") for v in LEVELS])
    rows = per.select(*by, n.alias("n"), "off_scale", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"c{v}").alias("c")) for v in LEVELS])).alias("x")).select(*by, "n", "off_scale", "x.level", F.col("x.c").alias("count"))
    share = F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("n")), F.lit(0.0))
    flag = F.when(share > DOMINANT, "dominant").when(share < RARE, "rare").otherwise("")
    return rows.select(*by, "level", "count", share.alias("share"), flag.alias("flag"), "off_scale", (F.col("n") < LEAST_RATINGS).alias("provisional"))


#: Level shares over which an axis is nearly constant, or under which a level isn't used, and the fewest ratings that tell (fixed values).
DOMINANT, RARE, LEAST_RATINGS = 0.6, 0.05, 20


def distribution_flags(ratings: DataFrame, by: list[str], score: str) -> DataFrame:
    """``(…, n, off_scale, collapsed, provisional, flags)`` of each group with a rating on the scale; ``flags`` are texts."""
    rows = distribution(ratings, by, score)
    percent = F.format_string("%.1f", F.col("share") * 100)
    text = (
        F.when(F.col("share") > DOMINANT, F.concat(F.lit("level "), "level", F.lit(" holds "), percent, F.lit("% of ratings - the axis is close to constant")))
        .when(F.col("share") < RARE, F.concat(F.lit("level "), "level", F.lit(" holds "), percent, F.lit("% ("), "count", F.lit(") - raters are not using it")))
    )
    per = rows.groupBy(*by).agg(F.sum("count").alias("n"), F.first("off_scale").alias("off_scale"), F.bool_or(F.col("share") > DOMINANT).alias("collapsed"), F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("level", text.alias("t"))))).alias("x"))
    whole = [
        F.when(F.col("off_scale") > 0, F.concat("off_scale", F.lit(f" rating(s) were not one of {'/'.join(map(str, LEVELS))}"))),
        F.when(F.col("n") < LEAST_RATINGS, F.concat(F.lit("only "), "n", F.lit(f" ratings; under {LEAST_RATINGS} the flags above are noise, not evidence"))),
    ]
    return per.where("n > 0").select(*by, "n", "off_scale", "collapsed", (F.col("n") < LEAST_RATINGS).alias("provisional"), F.concat(F.col("x.t"), F.array_compact(F.array(*whole))).alias("flags"))


def variance_shares(rows: DataFrame, axes: list[str], weights: list[float]) -> DataFrame:
    """Share of the weighted sum's variance that each axis brings, over complete rows; the shares add up to 1."""
    full = rows.where(total([F.col(a).isNull().cast("int") for a in axes]) == 0)
    s = total([F.col(a) * w for a, w in zip(axes, weights)])
    full = full.withColumn("__s", s)
    one = full.agg(F.count("*").alias("n"), F.var_samp("__s").alias("v"), *[F.covar_samp(F.col(a) * w, F.col("__s")).alias(f"c{i}") for i, (a, w) in enumerate(zip(axes, weights))], *[F.stddev_samp(a).alias(f"d{i}") for i, a in enumerate(axes)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"c{i}").alias("c"), F.col(f"d{i}").alias("sd")) for i, a in enumerate(axes)]))
    share = F.when(F.col("v") > 0, F.col("x.c") / F.col("v"))
    return one.select("n", "v", each.alias("x")).select("x.axis", share.alias("share"), F.col("x.sd").alias("sd"), (F.abs(share) < 0.02).alias("dead_weight"), "n")


def ceiling_verdict(human: Column, model: Column, margin: float = 0.02) -> Column:
    return F.when(model > human + margin, "above-ceiling").when(model >= human - margin, "at-ceiling").when(model.isNotNull() & human.isNotNull(), "headroom")


def overlap_verdict(overlap: Column, alpha: Column, rank: Column, offset: Column) -> Column:
    """Whether two labelling passes may be merged: too little overlap or agreement blocks; a steady shift may be rescaled."""
    return F.when(overlap < 20, "block").when(alpha.isNull(), "block").when((alpha < 0.65) & (rank >= 0.8) & (F.abs(offset) >= 0.5), "rescale").when(alpha < 0.65, "block").otherwise("merge")


def rank_statistics(rows: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """``(…, n, rho, concordant, discordant, tied_x, tied_y)`` of levels 1 to 5 against any numbers, x being the level.

    Counts of levels are summed over order buckets and within each bucket, so neither pairs nor a whole group meet in one
    task, however many different values there are. Rows without a level or value are left out; ``rho`` is null for a
    constant series.
    """
    full = rows.where(F.col(value).isNotNull() & F.col(level).isin(LEVELS))
    names = [f"c{v}" for v in LEVELS]
    c = full.groupBy(*by, F.col(value).alias("v")).agg(*[F.count_if(F.col(level) == v).cast("double").alias(f"c{v}") for v in LEVELS]).withColumn("bucket", order_bucket(F.col("v")))
    per = c.groupBy(*by, "bucket").agg(*[F.sum(k).alias(k) for k in names])
    over = Window.partitionBy(*by).orderBy("bucket")
    start = per.select(*by, "bucket", *[(F.sum(k).over(over) - F.col(k)).alias(f"s{k}") for k in names])
    within = Window.partitionBy(*by, "bucket").orderBy("v")
    p = c.join(start, [*by, "bucket"]).select(*by, *names, *[(F.col(f"s{k}") + F.sum(k).over(within) - F.col(k)).alias(f"b{k}") for k in names])
    pairs = [(a, b) for a in names for b in names if a < b]
    rank = total([F.col(f"b{k}") for k in names]) + (total([F.col(k) for k in names]) + 1) / 2
    t = total([F.col(k) for k in names])
    g = p.withColumns({"r": rank, "t": t}).groupBy(*by).agg(
        *[F.sum(k).alias(f"n{k}") for k in names],
        *[F.sum(F.col(k) * F.col("r")).alias(f"r{k}") for k in names],
        F.sum(F.col("t") * F.col("r") * F.col("r")).alias("vv"),
        F.sum(total([F.col(b) * F.col(f"b{a}") for a, b in pairs])).alias("concordant"),
        F.sum(total([F.col(a) * F.col(f"b{b}") for a, b in pairs])).alias("discordant"),
        F.sum(total([F.col(a) * F.col(b) for a, b in pairs])).alias("tied_y"),
        F.sum(total([F.col(k) * (F.col(k) - 1) / 2 for k in names])).alias("same"),
    )
    n = total([F.col(f"n{k}") for k in names])
    ranks = [total([F.lit(0.0), *[F.col(f"n{j}") for j in names[:i]]]) + (F.col(f"n{k}") + 1) / 2 for i, k in enumerate(names)]
    mean = (n + 1) / 2
    sxy = total([r * F.col(f"r{k}") for r, k in zip(ranks, names)]) - n * mean * mean
    sxx = total([F.col(f"n{k}") * r * r for r, k in zip(ranks, names)]) - n * mean * mean
    syy = F.col("vv") - n * mean * mean
    tied = total([F.col(f"n{k}") * (F.col(f"n{k}") - 1) / 2 for k in names]) - F.col("same")
    rho = F.when((n >= 2) & (sxx > 1e-9) & (syy > 1e-9), F.try_divide(sxy, F.sqrt(sxx * syy)))
    return g.select(*by, n.cast("long").alias("n"), rho.alias("rho"), "concordant", "discordant", tied.alias("tied_x"), "tied_y")


def score_metrics(rows: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """``(…, n, spearman, kendall, mae, exact, within_one, bias)`` of predictions against levels.

    Rank correlations take the predictions as they are; the others round them to a level from 1 to 5, halves up.
    """
    whole = F.floor(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col(value))) + 0.5).cast("int")
    r = rank_statistics(rows, by, level, value)
    r = r.select(*by, "n", F.col("rho").alias("spearman"), kendall_tau(r).alias("kendall"))
    a = simple_agreement(cells(rows.where(F.col(level).isin(LEVELS)).withColumn("__p", whole), by, "__p", level), by)
    return r.join(a.drop("n", "off_by_two"), by)
