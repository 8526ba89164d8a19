"""Projections, renames and filters."""

from pyspark.sql import functions as F

from remitlens.catalog.registry import query
from remitlens.operators.columns import (
    ending_with,
    matching,
    relocate,
    starting_with,
    without,
)
from remitlens.operators.missing import SENTINEL, fill_sentinel
from remitlens.plans.clean import named_companies
from remitlens.plans.rules import stock_scores
from remitlens.schemas import (
    AMOUNT,
    COMPANY,
    ID,
    LABEL,
    LICENSES,
    N_PAYMENTS,
    NATURE,
    PHYSICIANS,
    RECORD,
)

LICENSE_LIST = ", ".join(LICENSES)
USED = {"id", "split_set", "Primary_Specialty", *LICENSES}


@query(f"SELECT Physician_ID, {NATURE}, CAST({AMOUNT} AS DOUBLE) AS amount FROM pay")
def project_keep(t):
    return t.pay.select(ID, NATURE, F.col(AMOUNT).cast("double").alias("amount"))


@query(f"SELECT id, split_set, Primary_Specialty, {LICENSE_LIST} FROM phys")
def project_drop(t):
    return without(t.phys, [c for c in PHYSICIANS.names if c not in USED])


@query(f"SELECT id, {LICENSE_LIST} FROM phys")
def project_by_prefix(t):
    return t.phys.select("id", *starting_with(t.phys, "license_state_"))


@query("SELECT Record_ID, City_of_Travel, State_of_Travel, Country_of_Travel FROM pay")
def project_by_suffix(t):
    return t.pay.select(RECORD, *ending_with(t.pay, "_travel"))


@query(
    "SELECT id, "
    + ", ".join(f"CASE WHEN l{i} IS NOT NULL THEN 1 ELSE 0 END AS has_{i}" for i in range(1, 6))
    + " FROM (SELECT id, "
    + ", ".join(f"{c} AS l{i}" for i, c in enumerate(LICENSES, 1))
    + " FROM phys)"
)
def project_by_regex(t):
    flags = {f"has_{i}": F.col(c).isNotNull().cast("int") for i, c in enumerate(LICENSES, 1)}
    lacks = {f"has_{i}_{SENTINEL}": F.col(c).isNull().cast("int") for i, c in enumerate(LICENSES, 1)}
    wide = t.phys.select("id", *[c.alias(n) for n, c in {**flags, **lacks}.items()])
    return without(wide, matching(wide, f"{SENTINEL}$"))


@query(
    " UNION ALL ".join(
        f"SELECT id, concat('LState_', {c}) AS feature FROM phys WHERE {c} IS NOT NULL"
        for c in LICENSES
    )
)
def features_without_sentinel(t):
    filled = fill_sentinel(t.phys.select("id", *LICENSES))
    long = filled.select("id", F.explode(F.array(*LICENSES)).alias("level")).select(
        "id", F.concat(F.lit("LState_"), "level").alias("feature")
    )
    return long.filter(~F.col("feature").rlike(f"{SENTINEL}$"))


@query(
    """SELECT Company_ID, Name AS Company_Name, State AS Company_State,
    Country AS Company_Country FROM comp"""
)
def rename_columns(t):
    return named_companies(t.comp)


@query("SELECT id AS Physician_ID, split_set, State FROM phys")
def key_rename_by_copy(t):
    return t.phys.withColumnRenamed("id", ID).select(ID, "split_set", "State")


@query(f"SELECT Ownership_Indicator, Record_ID, Physician_ID, Company_ID, {N_PAYMENTS} FROM pay")
def relocate_columns(t):
    return relocate(t.pay.select(RECORD, ID, COMPANY, N_PAYMENTS, LABEL), LABEL)


@query(f"SELECT Ownership_Indicator, {NATURE}, Charity FROM pay")
def project_positional_drop(t):
    table = t.pay.select(LABEL, RECORD, ID, COMPANY, NATURE, "Charity")
    return without(table, [RECORD, ID, COMPANY])


@query(
    f"""SELECT Record_ID, amount_cents, CASE WHEN amount_cents >= 10000 THEN 1 ELSE 0 END
    AS large, CASE WHEN amount_cents >= 10000 THEN 'large' ELSE 'small' END AS size_label
    FROM (SELECT Record_ID, CAST({AMOUNT} * 100 AS BIGINT) AS amount_cents FROM pay)"""
)
def derive_columns(t):
    return (
        t.pay.select(RECORD, (F.col(AMOUNT) * 100).cast("bigint").alias("amount_cents"))
        .withColumn("large", (F.col("amount_cents") >= 10000).cast("int"))
        .withColumn("size_label", F.when(F.col("large") == 1, "large").otherwise("small"))
    )


@query("SELECT id, split_set FROM phys WHERE split_set = 'train'")
def filter_equals(t):
    return t.phys.filter(F.col("split_set") == "train").select("id", "split_set")


@query("SELECT id, License_State_1 AS license FROM phys WHERE License_State_1 IS NOT NULL")
def filter_not_equals(t):
    filled = fill_sentinel(t.phys.select("id", F.col("License_State_1").alias("license")))
    return filled.filter(F.col("license") != SENTINEL)


@query(f"SELECT Record_ID, {N_PAYMENTS} FROM pay WHERE {N_PAYMENTS} BETWEEN 5 AND 11")
def filter_range_between(t):
    return t.pay.filter(F.col(N_PAYMENTS).between(5, 11)).select(RECORD, N_PAYMENTS)


@query(
    """SELECT Physician_ID, CASE WHEN score > 0.1 THEN 1 ELSE 0 END AS prediction FROM
    (SELECT Physician_ID, CAST(count(CASE WHEN Form_of_Payment_or_Transfer_of_Value
    LIKE 'Stock%' THEN 1 END) AS DOUBLE) / count(*) AS score FROM pay GROUP BY 1)"""
)
def filter_threshold(t):
    return stock_scores(t.pay).select(ID, (F.col("score") > 0.1).cast("int").alias("prediction"))
