"""Same or nearly the same records in training and evaluation splits, by hash and by bit fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.common import attach, materialize, norm_key, release
from ratewright.operators.grouping import near_codes

TRAIN = ["development"]
EVAL = ["validation", "final_test"]
RADIUS = 6


def fingerprint_code(col: Column) -> Column:
    """The 64 bits of 16 hex digits of either case; null for anything else."""
    return F.when(col.rlike(r"^[0-9a-f]{16}\z"), F.conv(col, 16, -10).cast("bigint"))


def prepared(images: DataFrame) -> DataFrame:
    """One row an image, role, hash, code and source, written once; repeated rows count once."""
    names = {"image_id": "image_id", "dataset_role": "role", "sha256": "sha", "perceptual_hash": "hash", "source": "source"}
    held = materialize(images.select(*[norm_key(c).alias(n) for c, n in names.items()]), "images")
    return held.where("image_id is not null and role is not null").select("image_id", "role", "sha", fingerprint_code(F.col("hash")).alias("code"), "source").distinct()


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("role").isin(TRAIN)), rows.where(F.col("role").isin(EVAL))


def cross_split_pairs(images: DataFrame, radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """``(image_t, image_e, exact, distance)``: each training image with each evaluation image it is the same or nearly the same as.

    Segmented code blocks: codes within ``radius`` bits agree in several blocks at least, which make the join keys; how many
    is chosen by the number of codes (``agree`` fixes it). ``exact`` tells whether the sha256 agree; ``distance`` is the
    number of differing bits, null if a fingerprint is missing or the distance exceeds ``radius``. Keys compare without case
    or white space; malformed fingerprints are missing; repeated rows count once; an image in both roles isn't paired with
    itself. Matching is done on distinct fingerprints; a group of copies is expanded only in the result, which lists every
    pair, and there a code or hash shared by very many images is met by broadcast. Empty tables give an empty result.
    """
    t, e = _sides(prepared(images))
    tc, ec = t.where("code is not null").select("image_id", "code").distinct(), e.where("code is not null").select("image_id", "code").distinct()
    near = near_codes(tc, ec, radius, agree)
    by_code = (
        near.join(tc.select(F.col("image_id").alias("image_t"), F.col("code").alias("code_a")), "code_a")
        .join(ec.select(F.col("image_id").alias("image_e"), F.col("code").alias("code_b")), "code_b")
        .select("image_t", "image_e", F.lit(False).alias("exact"), F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))).alias("distance"))
    )
    by_sha = (
        t.where("sha is not null").select("sha", F.col("image_id").alias("image_t"))
        .join(e.where("sha is not null").select("sha", F.col("image_id").alias("image_e")), "sha")
        .select("image_t", "image_e", F.lit(True).alias("exact"), F.lit(None).cast("int").alias("distance"))
    )
    both = by_code.unionByName(by_sha).where("image_t <> image_e")
    return both.groupBy("image_t", "image_e").agg(F.max("exact").alias("exact"), F.min("distance").alias("distance"))


def overlap_report(images: DataFrame, radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """Counts per evaluation role and source: images, those with an exact or a near copy in training, and pairs.

    Images of one sha256 and fingerprint are a class; classes are matched and pairs counted by their sizes, never listed.
    An image whose rows disagree in hash or fingerprint belongs to each of its classes, and its pairs count in each.
    """
    rows = materialize(prepared(images).withColumn("class", F.concat_ws("/", F.coalesce("sha", F.lit("-")), F.coalesce(F.col("code").cast("string"), F.lit("-")))), "classed")
    t, e = _sides(rows)
    sized = materialize(t.select("image_id", "class", "sha", "code").distinct().groupBy(F.col("class").alias("class_t"), F.col("sha").alias("sha_t"), F.col("code").alias("code_a")).agg(F.count("*").alias("n")), "train-classes")
    wanted = materialize(e.groupBy(F.col("class").alias("class_e"), F.col("sha").alias("sha_e"), F.col("code").alias("code_b")).agg(F.count("*").alias("m")), "eval-classes")
    near = near_codes(sized.select(F.col("code_a").alias("code")), wanted.select(F.col("code_b").alias("code")), radius, agree)
    by_code = near.join(sized, "code_a").join(wanted, "code_b").select("class_e", "class_t", "n", F.coalesce(F.col("sha_t") == F.col("sha_e"), F.lit(False)).alias("exact"))
    by_sha = sized.join(wanted, F.col("sha_t") == F.col("sha_e")).select("class_e", "class_t", "n", F.lit(True).alias("exact"))
    links = materialize(by_code.unionByName(by_sha).distinct(), "class-links")
    # An image in both roles is no pair with itself.
    own = t.select("image_id", F.col("class").alias("class_t")).distinct().join(e.select("image_id", F.col("class").alias("class")).distinct(), "image_id")
    selves = own.join(links.select(F.col("class_e").alias("class"), "class_t", "exact"), ["class", "class_t"]).groupBy("image_id", "class").agg(F.count("*").alias("self"))
    per = links.groupBy(F.col("class_e").alias("class")).agg(F.max("exact").alias("exact"), F.sum("n").alias("pairs")).join(wanted.select(F.col("class_e").alias("class"), "m"), "class")
    total = e.count()
    every = e.select("image_id", "role", "source", "class").distinct()
    met = attach(every, per, "class", "m", total).join(selves, ["image_id", "class"], "left")
    met = met.withColumn("pairs", F.col("pairs") - F.coalesce("self", F.lit(0))).where("pairs > 0")
    found = met.groupBy("image_id", "role", "source").agg(F.max("exact").alias("exact"), F.sum("pairs").alias("pairs"))
    out = (
        every.select("image_id", "role", F.coalesce("source", F.lit("\0")).alias("source")).distinct()
        .join(found.withColumn("source", F.coalesce("source", F.lit("\0"))), ["image_id", "role", "source"], "left")
        .groupBy("role", F.nullif("source", F.lit("\0")).alias("source"))
        .agg(
            F.count("*").alias("images"),
            F.count_if(F.col("exact")).alias("with_exact"),
            F.count_if(~F.col("exact")).alias("with_near_only"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        )
    )
    out = materialize(out, "overlap")
    for x in (rows, sized, wanted, links):
        release(x)
    return out
