"""Audit of five quality filters: what each removes, alone and in every order.

A row's outcome under the filters is one of 32. Counts by part and outcome, reshaped to a
2 x 2 x 2 x 2 x 2 tensor per part, answer all questions: for a step of an order, every axis is
contracted with a vector that takes what passes (filters before), what fails (the filter of
the step) or all (filters after). Only the counts reach the contraction, 32 rows a part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import materialize

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_COUNTS = ("n", "good", "toxic")
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text; A to D."""
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * upper > 10 * F.length(text),
        "D": F.translate(text, "#$%&*|", "") != text,
    }


def outcomes(docs: DataFrame) -> DataFrame:
    """doc_id, part, outcome: which filters each row fails, A the highest of five bits.

    A: under 100 words. B: distinct words under 80 percent. C: over 10 percent of the characters
    are A-Z. D: one of ``#$%&*|``. E: the text is that of a smaller doc_id. Null texts count as
    empty, null languages as the part of the empty name. A null doc_id is not smaller than
    any, and none is smaller than it. Texts are compared by SHA-256.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    fails = text_failures(F.col("text"), F.col("words"))
    bits = sum((f.cast("int") * (16 >> i) for i, f in enumerate(fails.values())), F.lit(0))
    flags = materialize(
        seen.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("same")),
        "flags",
    )
    named = flags.where("doc_id is not null")
    # the key of the join is unique but for repeated ids, however many copies a text has
    firsts = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    copies = named.join(firsts, ["same", "doc_id"], "left").withColumn(
        "outcome", F.col("bits") + F.col("first").isNull().cast("int")
    )
    rest = flags.where("doc_id is null").withColumn("outcome", F.col("bits"))
    columns = ["doc_id", "part", "outcome"]
    return copies.select(*columns).unionByName(rest.select(*columns))


def outcome_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, outcome, n, good, toxic: rows, and those whose id has a label of 1.

    Of repeated labels of an id one of 1 is enough; unlabelled rows are neither good nor toxic.
    """
    found = materialize(found, "outcomes")
    zero = F.lit(0).cast("long")
    counts = found.groupBy("part", "outcome").agg(
        F.count("*").alias("n"), zero.alias("good"), zero.alias("toxic")
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("is_good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic"),
    )
    marked = marks.where("is_good = 1 or is_toxic = 1")
    per_id = found.groupBy("doc_id", "part", "outcome").agg(F.count("*").alias("rows"))
    lost = (
        per_id.join(marked, "doc_id")
        .groupBy("part", "outcome")
        .agg(
            zero.alias("n"),
            F.sum(F.col("rows") * F.coalesce("is_good", zero)).alias("good"),
            F.sum(F.col("rows") * F.coalesce("is_toxic", zero)).alias("toxic"),
        )
    )
    both = counts.unionByName(lost)
    return both.groupBy("part", "outcome").agg(*(F.sum(c).cast("long").alias(c) for c in _COUNTS))


def contracted(tensor: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Counts (k) at every step (s): tensor (k,2,2,2,2,2) by choices (s,5,2) along the axes."""
    axes = [choice[:, i] for i in range(len(FILTERS))]
    return np.einsum("kabcde,sa,sb,sc,sd,se->ks", tensor, *axes)


def _choices(now: tuple[int, int], later: tuple[int, int] | None = None, earlier=_PASS) -> np.ndarray:
    """For each step of each order a vector per axis: filters before, the step's own, those after."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        for step, current in enumerate(order):
            axis = [earlier if order.index(f) < step else later or earlier for f in range(len(FILTERS))]
            axis[current] = now
            rows.append(axis)
    return np.array(rows, np.int64)


def report(counts: pd.DataFrame) -> pd.DataFrame:
    """The audit of one part from its rows of ``outcome_counts``."""
    tensor = np.zeros((len(_COUNTS), 2 ** len(FILTERS)), np.int64)
    tensor[:, counts["outcome"].to_numpy()] = counts[list(_COUNTS)].to_numpy().T
    tensor = tensor.reshape(len(_COUNTS), *[2] * len(FILTERS))
    orders = ["".join(o) for o in permutations(FILTERS)]
    kept = contracted(tensor, _choices(_PASS, _ALL))
    removed = contracted(tensor, _choices(_FAIL, _ALL))
    failing = contracted(tensor, _choices(_FAIL, _ALL, _ALL))
    alone = contracted(tensor, _choices(_FAIL, _PASS))
    current = np.array([FILTERS.index(f) for o in orders for f in o])
    shapley = np.array([removed[0][current == f].sum() for f in range(len(FILTERS))])
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0],
            "filter_order": np.repeat(orders, len(FILTERS)),
            "step": np.tile(np.arange(1, len(FILTERS) + 1), len(orders)),
            "kept": kept[0],
            "removed": removed[0],
            "redundant": failing[0] - removed[0],
            "unique_fails": alone[0],
            "good_lost": removed[1],
            "toxic_lost": removed[2],
            "shapley": shapley[current],
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see ``REPORT`` for the columns.

    An empty table has no parts and so no rows. Other columns of ``docs`` and ``labels`` take no
    part.
    """
    return outcome_counts(outcomes(docs), labels).groupBy("part").applyInPandas(report, REPORT)
