"""Binned payment shares beside recipient and company attributes: the rows of the single tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions.bins import (
    PERCENT_BREAKS_FINE,
    PERCENT_BREAKS_FORM,
    TOTAL_BREAKS_FINE,
    cut,
)
from remitlens.functions.values import count_parts, count_present, percent, yes_no
from remitlens.operators.joins import join_skewed
from remitlens.operators.reshape import compact_array
from remitlens.plans.clean import named_companies, split_specialties
from remitlens.schemas import AMOUNT, COMPANY, FORM, ID, LABEL, LICENSES, NATURE, SPECIALTIES

ORDERED = ("n_licenses", "n_specialties")
FEATURES = (
    *ORDERED, "licensed_in", "specialty", "total_bin", "company_bin", "nature", "nature_bin",
    "form", "form_bin", "company_state", "company_country",
)


def share_rows(phys: DataFrame, pay: DataFrame, comp: DataFrame) -> DataFrame:
    """A row per recipient, company, nature, form and label, for each license and specialty.

    Payments are summed to those categories first; totals are windows over them. Recipients
    without a license or specialty have no row. Bins are null outside their edges.
    """
    grain = [ID, COMPANY, NATURE, FORM]
    cells = pay.groupBy(*grain, LABEL).agg(F.sum(AMOUNT).alias("_s"))

    def over(*keys: str):
        return F.expr(f"sum(_s) over (partition by {', '.join([ID, *keys])})")

    sums = cells.select(
        *grain, LABEL, over().alias("_t"), over(COMPANY, NATURE).alias("_n"),
        over(FORM).alias("_f"), over(COMPANY).alias("_c"),
    )

    def share_bin(part: str, breaks):
        # rounding keeps a full share from passing 100
        return cut(F.round(percent(F.col(part), F.col("_t")), 6), breaks)

    shares = sums.select(
        ID,
        COMPANY,
        yes_no(F.col(LABEL)).alias("label"),
        cut(F.col("_t"), TOTAL_BREAKS_FINE).alias("total_bin"),
        share_bin("_c", PERCENT_BREAKS_FINE).alias("company_bin"),
        F.col(NATURE).alias("nature"),
        share_bin("_n", PERCENT_BREAKS_FINE).alias("nature_bin"),
        F.col(FORM).alias("form"),
        share_bin("_f", PERCENT_BREAKS_FORM).alias("form_bin"),
    )
    named = split_specialties(phys.withColumn("_p", F.col("Primary_Specialty")))
    people = named.select(
        F.col("id").alias(ID),
        "split_set",
        count_present(LICENSES).alias("n_licenses"),
        count_parts(F.col("_p")).alias("n_specialties"),
        compact_array(LICENSES).alias("_licenses"),
        compact_array(SPECIALTIES).alias("_specialties"),
    ).filter((F.size("_licenses") > 0) & (F.size("_specialties") > 0))
    spread = [COMPANY, "nature", "form"]
    joined = join_skewed(shares, people, ID, spread, "inner")
    companies = named_companies(comp).select(
        COMPANY,
        F.col("Company_State").alias("company_state"),
        F.col("Company_Country").alias("company_country"),
    )
    joined = join_skewed(joined, companies, COMPANY, [ID, "nature", "form"])
    return (
        joined.withColumnRenamed(ID, "id")
        .withColumn("licensed_in", F.explode("_licenses"))
        .withColumn("specialty", F.explode("_specialties"))
        .select("id", "split_set", "label", COMPANY, *FEATURES)
    )
