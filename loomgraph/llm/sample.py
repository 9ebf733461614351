"""Bounded samples by the hash of an id, which don't depend on how rows are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first cut takes this part more than is wanted.
SPARE = 1.25
#: Fewer ids than this are ordered without a first cut.
FEW = 100_000


def smallest_hashes(ids: DataFrame, sample: int) -> DataFrame:
    """(id): the ``sample`` distinct ids, not null, with the smallest hash (fewer where there are fewer).

    Hashes under a threshold are taken first, which leaves a quarter more than is
    wanted whatever the input, and only these are ordered; should the threshold
    leave too few, all are.
    """
    hashed = ids.select("id").where("id IS NOT NULL").distinct().withColumn("h", F.xxhash64("id"))
    n = hashed.count()
    near = hashed
    if n > max(FEW, 2 * sample):
        cut = int(-(2**63) + SPARE * sample / n * 2**64)
        within = hashed.where(F.col("h") < cut)
        if within.count() >= sample:
            near = within
    return near.orderBy("h", "id").limit(sample).select("id")


def one_text_each(docs: DataFrame) -> DataFrame:
    """One row for each id (``id, text``): where an id has several texts, the one with the smallest hash."""
    return docs.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("t"))).alias("text"))
