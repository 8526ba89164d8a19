"""Feature blocks of recipients: named long tables that meet on the recipient, never by position."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.plans.features import attribute_features, payment_features
from remitlens.session import materialize

#: The blocks that describe a recipient: shares by nature, form and product type, amounts by
#: company, license states and specialties.
BLOCKS = ("nature", "form", "type", "company", "license", "specialty")


def recipient_blocks(phys: DataFrame, pay: DataFrame) -> dict[str, DataFrame]:
    """(id, feature, value) of every block; one pass over the payments makes four of them."""
    long = payment_features(pay).unionByName(attribute_features(phys))
    written = materialize(long, "blocks")
    return {b: written.filter(F.col("block") == b).drop("block") for b in BLOCKS}


def stack(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """(id, block, feature, value): all blocks in one long table."""
    if not blocks:
        raise ValueError("no blocks given")
    named = [
        long.select("id", F.lit(name).alias("block"), "feature", "value")
        for name, long in blocks.items()
    ]
    return reduce(DataFrame.unionByName, named)


def join_blocks(spine: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of ``spine`` with an array of (feature, value) per block, in feature order.

    An id without a block has an empty array there, and ids that ``spine`` lacks are left out.
    However many blocks there are, they move once and meet ``spine`` in one join. A group holds one
    entry per feature of its id. A block named like a column of ``spine`` is an error.
    """
    clash = sorted(set(blocks) & set(spine.columns))
    if clash:
        raise ValueError(f"blocks named like columns: {', '.join(clash)}")
    entry = F.struct("feature", F.col("value").cast("double").alias("value"))

    def own(block: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("block") == block, entry))).alias(block)

    wide = stack(blocks).groupBy("id").agg(*[own(b) for b in blocks])
    none = F.array().cast("array<struct<feature:string,value:double>>")
    joined = spine.join(wide, "id", "left")
    return joined.withColumns({b: F.coalesce(b, none) for b in blocks})


def block_dictionary(
    blocks: Mapping[str, DataFrame], sides: DataFrame, in_test: Column
) -> DataFrame:
    """block, feature, n_train, n_test: how many ids of either side carry each feature.

    ``sides`` holds one row per id; ids it lacks are left out.
    """
    placed = stack(blocks).join(sides.select("id", in_test.alias("_test")), "id")
    return placed.groupBy("block", "feature").agg(
        F.count(F.when(~F.col("_test"), 1)).alias("n_train"),
        F.count(F.when(F.col("_test"), 1)).alias("n_test"),
    )
