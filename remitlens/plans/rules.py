"""A fixed rule score: how much of a recipient's payments takes the stock form.

Evaluation and sinks need a score that is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.values import any_known, yes_no
from remitlens.schemas import FORM, ID, LABEL


def is_stock() -> Column:
    return F.col(FORM).startswith("Stock").cast("int")


def stock_prediction(pay: DataFrame) -> DataFrame:
    """1 for recipients with any stock-form payment."""
    return pay.groupBy(F.col(ID).alias("id")).agg(F.max(is_stock()).alias("prediction"))


def stock_scores(pay: DataFrame) -> DataFrame:
    """Share of stock-form payments and the true label per recipient."""
    return pay.groupBy(ID).agg(
        (F.sum(is_stock()).cast("double") / F.count("*")).alias("score"),
        any_known(yes_no(F.col(LABEL))).alias("truth"),
    )


def row_predictions(pay: DataFrame) -> DataFrame:
    """Payments with the rule as prediction and the label as truth."""
    return pay.withColumns({"prediction": is_stock(), "truth": yes_no(F.col(LABEL))})
