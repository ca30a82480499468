"""Group identifiers for images linked by match results and earlier duplicate marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.common import norm_key
from ratewright.llm.linking import hash_to_min


def image_links(images: DataFrame, matches: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between images that exist: match rows with verdict 'match' and ``duplicate_of`` marks.

    Ends that are null, blank, gone or the image itself link nothing.
    """
    known = images.select(norm_key("image_id").alias("k")).where("k is not null")
    marked = images.select(norm_key("image_id").alias("a"), norm_key("duplicate_of").alias("b"))
    matched = matches.where(norm_key("verdict") == "match").select(norm_key("left_image_id").alias("a"), norm_key("right_image_id").alias("b"))
    links = matched.unionByName(marked).where("a is not null and b is not null and a <> b").distinct()
    return links.join(known, links.a == known.k, "left_semi").join(known, links.b == known.k, "left_semi")


def linked_groups(images: DataFrame, matches: DataFrame) -> DataFrame:
    """``(image_id, group_id)`` of every image linked to another, directly or through others.

    ``group_id`` is the group's smallest image_id, byte by byte. Images linked to nothing aren't listed: see
    ``all_groups``. Repeated image or match rows count once, null verdicts and similarities aren't matches, extra columns
    are ignored, empty tables give an empty result.
    """
    return hash_to_min(image_links(images, matches)).select(F.col("vertex").alias("image_id"), F.col("root").alias("group_id"))


def all_groups(images: DataFrame, matches: DataFrame) -> DataFrame:
    """``(image_id, group_id)`` of every image; one linked to nothing is its own group."""
    ids = images.select(norm_key("image_id").alias("image_id")).where("image_id is not null").distinct()
    found = linked_groups(images, matches)
    return ids.join(found, "image_id", "left").withColumn("group_id", F.coalesce("group_id", "image_id"))
