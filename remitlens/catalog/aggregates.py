"""Aggregations and window values."""

from pyspark.sql import functions as F

from remitlens.catalog.registry import query
from remitlens.functions.values import any_known, count_present, percent, strict_sum, yes_no
from remitlens.models.evaluate import roll_up
from remitlens.operators.aggregates import (
    amount_sketches,
    any_by,
    attach_totals,
    exact_median,
    level_counts,
    merged_sketches,
    share_of_total,
    sketched_median,
    totals_by,
)
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import with_hash_index
from remitlens.operators.reshape import unpivot_groups
from remitlens.plans.clean import split_specialties
from remitlens.plans.rules import row_predictions
from remitlens.schemas import (
    AMOUNT,
    COMPANY,
    FORM,
    ID,
    LABEL,
    LICENSES,
    N_PAYMENTS,
    NATURE,
    PRODUCT_GROUPS,
    RECORD,
)
from remitlens.session import materialize


def _dbl(name: str, places: int | None = None):
    c = F.col(name).cast("double")
    return (F.round(c, places) if places else c).alias(name)


SUM = f"CAST(sum({AMOUNT}) AS DOUBLE)"


@query(f"SELECT Physician_ID, {SUM} AS total_amount FROM pay GROUP BY 1")
def agg_sum_by_key(t):
    return t.pay.groupBy(ID).agg(F.sum(AMOUNT).cast("double").alias("total_amount"))


N_LICENSES = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in LICENSES)


@query(
    f"""SELECT Company_ID, round(avg(CAST({N_LICENSES} AS DOUBLE)), 6) AS mean_licenses
    FROM pay JOIN phys ON pay.Physician_ID = phys.id GROUP BY 1"""
)
def agg_mean_by_key(t):
    """Mean number of licenses over the payments of each company."""
    people = t.phys.select(F.col("id").alias(ID), count_present(LICENSES).alias("n_licenses"))
    pairs = t.pay.groupBy(ID, COMPANY).agg(F.count("*").alias("n"))
    joined = join_skewed(pairs, people, ID, COMPANY, "inner")
    mean = F.sum(F.col("n") * F.col("n_licenses")) / F.sum("n")
    return joined.groupBy(COMPANY).agg(F.round(mean, 6).alias("mean_licenses"))


@query("SELECT Physician_ID, count(*) AS n FROM pay GROUP BY 1")
def agg_count_via_ones(t):
    return t.pay.groupBy(ID).agg(F.count("*").alias("n"))


@query(
    f"""SELECT Physician_ID, round(median(CAST({AMOUNT} AS DOUBLE)), 6) AS median_amount
    FROM pay GROUP BY 1"""
)
def agg_median(t):
    return exact_median(t.pay, ID, AMOUNT).select(ID, _dbl("median_amount", 6))


@query(
    f"""SELECT Physician_ID, round(quantile_disc(CAST({AMOUNT} AS DOUBLE), 0.5), 6) AS median_amount
    FROM pay GROUP BY 1"""
)
def agg_median_sketch(t):
    """Lower medians from quantile sketches of two batches, stored and merged.

    Equal to the SQL while a recipient has no more than ``SKETCH_K`` payments in all.
    """
    batches = [t.pay.filter(f"coalesce(pmod({RECORD}, 2), 0) = {i}") for i in (0, 1)]
    stored = [materialize(amount_sketches(b, ID, AMOUNT), "sketches") for b in batches]
    merged = merged_sketches(stored[0].unionByName(stored[1]), ID)
    return sketched_median(merged, ID).select(ID, _dbl("median_amount", 6))


@query(
    f"""SELECT Physician_ID, round({SUM} / nullif(CAST(sum({N_PAYMENTS}) AS DOUBLE), 0), 6)
    AS mean_amount FROM pay GROUP BY 1"""
)
def agg_ratio_mean(t):
    return totals_by(t.pay, ID, AMOUNT, N_PAYMENTS).select(ID, _dbl("mean_amount", 6))


@query(
    """SELECT Physician_ID, CAST(CASE WHEN max(f) = 1 THEN 1 WHEN count(f) = count(*) THEN 0
    END AS INTEGER) AS travelled FROM (SELECT Physician_ID, CASE WHEN Charity = 'No' THEN
    CASE WHEN City_of_Travel IS NULL THEN 0 ELSE 1 END END AS f FROM pay) GROUP BY 1"""
)
def agg_any_rollup(t):
    """Whether a non-charity payment covered travel; unknown charity leaves it undecided."""
    travel = F.col("City_of_Travel").isNotNull().cast("int")
    flags = t.pay.select(ID, F.when(F.col("Charity") == "No", travel).alias("f"))
    return any_by(flags, ID, travelled="f")


@query(
    """SELECT Physician_ID, CAST(sign(sum(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0
    END)) AS INTEGER) AS label FROM pay GROUP BY 1"""
)
def agg_sign_rollup(t):
    label = F.signum(F.sum(yes_no(F.col(LABEL)))).cast("int")
    return t.pay.groupBy(ID).agg(label.alias("label"))


ATTRIBUTES = {
    "form": FORM,
    "nature": NATURE,
    "third_party": "Third_Party_Recipient",
    "related_product": "Related_Product_Indicator",
    "product_type": "Product_Type_1",
    "company": COMPANY,
    "specialty": "Specialty1",
    "state": "State",
    "company_state": "Company_State",
}


@query(
    " UNION ALL ".join(
        f"SELECT Physician_ID, '{k}' AS attribute, CAST({c} AS VARCHAR) AS level, count(*) AS n "
        "FROM j GROUP BY 1, 3"
        for k, c in ATTRIBUTES.items()
    ),
    """j AS (SELECT pay.*, nullif(split_part(Primary_Specialty, '|', 1), '') AS Specialty1,
    phys.State, comp.State AS Company_State FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID)""",
)
def agg_onehot_counts(t):
    people = split_specialties(t.phys).select(F.col("id").alias(ID), "Specialty1", "State")
    companies = t.comp.select(COMPANY, F.col("State").alias("Company_State"))
    joined = join_skewed(t.pay, people, ID, RECORD)
    joined = join_skewed(joined, companies, COMPANY, RECORD, keys_from=t.pay)
    return level_counts(joined, ID, ATTRIBUTES)


def _share_sql(*by: str) -> str:
    names = ", ".join(by)
    return f"""SELECT p.Physician_ID, {', '.join('p.' + b for b in by)},
    round(CAST(p.s AS DOUBLE) / nullif(CAST(w.s AS DOUBLE), 0) * 100, 6) AS pct FROM
    (SELECT Physician_ID, {names}, sum({AMOUNT}) AS s FROM pay GROUP BY Physician_ID, {names}) p
    JOIN (SELECT Physician_ID, sum({AMOUNT}) AS s FROM pay GROUP BY 1) w
    ON p.Physician_ID = w.Physician_ID"""


def _shares(t, *by: str):
    return share_of_total(t.pay, ID, by, AMOUNT).select(ID, *by, _dbl("pct", 6))


@query(_share_sql(NATURE))
def agg_percent_by_nature(t):
    return _shares(t, NATURE)


@query(_share_sql(COMPANY, NATURE))
def agg_percent_by_nature_company(t):
    return _shares(t, COMPANY, NATURE)


@query(_share_sql(FORM))
def agg_percent_by_form(t):
    return _shares(t, FORM)


@query(_share_sql(COMPANY))
def agg_percent_by_company(t):
    return _shares(t, COMPANY)


@query(f"SELECT Physician_ID, Company_ID, {SUM} AS amount FROM pay GROUP BY 1, 2")
def agg_amount_by_company(t):
    return t.pay.groupBy(ID, COMPANY).agg(F.sum(AMOUNT).cast("double").alias("amount"))


@query(_share_sql("Product_Type_1"))
def agg_percent_by_product_type(t):
    return _shares(t, "Product_Type_1")


@query(f"SELECT DISTINCT Physician_ID, Company_ID, {NATURE} FROM pay")
def distinct_rows(t):
    return t.pay.select(ID, COMPANY, NATURE).distinct()


@query(
    """SELECT truth, prediction, count(*) AS n FROM (SELECT Physician_ID,
    max(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 ELSE 0 END)
    AS prediction, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS truth
    FROM pay GROUP BY 1) GROUP BY 1, 2"""
)
def agg_contingency(t):
    rolled = roll_up(row_predictions(t.pay), ID)
    return rolled.groupBy("truth", "prediction").agg(F.count("*").alias("n"))


FANNED = f"""fanned AS (
    SELECT Physician_ID, {AMOUNT} FROM pay WHERE coalesce(Product_Code_1, Product_Name_1,
    Product_Category_1, Product_Type_1) IS NOT NULL UNION ALL
    SELECT Physician_ID, {AMOUNT} FROM pay WHERE coalesce(Product_Code_2, Product_Name_2,
    Product_Category_2, Product_Type_2) IS NOT NULL UNION ALL
    SELECT Physician_ID, {AMOUNT} FROM pay WHERE coalesce(Product_Code_3, Product_Name_3,
    Product_Category_3, Product_Type_3) IS NOT NULL)"""


@query(
    f"""SELECT a.Physician_ID, a.total_amount, coalesce(b.s, 0) AS fanned_amount FROM
    (SELECT Physician_ID, {SUM} AS total_amount FROM pay GROUP BY 1) a LEFT JOIN
    (SELECT Physician_ID, {SUM} AS s FROM fanned GROUP BY 1) b
    ON a.Physician_ID = b.Physician_ID""",
    FANNED,
)
def agg_sum_after_fanout(t):
    """Totals counting each payment once, beside totals counting it once per product."""
    rows = unpivot_groups(t.pay, [ID, AMOUNT], "Product_", PRODUCT_GROUPS, 3, "slot")
    fanned = rows.groupBy(ID).agg(F.sum(AMOUNT).cast("double").alias("fanned_amount"))
    return agg_sum_by_key(t).join(fanned, ID, "left").na.fill({"fanned_amount": 0.0})


@query(
    """SELECT Company_ID, s AS positives FROM (SELECT Company_ID, CAST(sum(CASE WHEN
    Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS s FROM pay GROUP BY 1)
    WHERE s > 0"""
)
def agg_global_sum_of_flags(t):
    sums = t.pay.groupBy(COMPANY).agg(F.sum(yes_no(F.col(LABEL))).alias("positives"))
    return sums.filter(F.col("positives") > 0)


@query(
    """SELECT Physician_ID AS id, CAST(max(CASE WHEN p = 0 THEN p END) AS INTEGER) AS pred_0,
    CAST(max(CASE WHEN p = 1 THEN p END) AS INTEGER) AS pred_1 FROM
    (SELECT Physician_ID, CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%'
    THEN 1 ELSE 0 END AS p FROM pay) GROUP BY 1"""
)
def agg_duplicate_max(t):
    """Predicted classes as columns, duplicates reduced by max."""
    rows = row_predictions(t.pay).select(F.col(ID).alias("id"), "prediction")
    wide = rows.groupBy("id").pivot("prediction", [0, 1]).agg(F.max("prediction"))
    return wide.select("id", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query(
    """SELECT Physician_ID, CAST(sum(CASE WHEN Charity = 'No' THEN 1 END) AS BIGINT)
    AS skipping, CASE WHEN count(Charity) = count(*) THEN
    CAST(sum(CASE WHEN Charity = 'No' THEN 1 END) AS BIGINT) END AS strict
    FROM pay GROUP BY 1"""
)
def agg_sum_strict_nulls(t):
    """Sums that skip nulls beside sums that are null once an input is."""
    no = F.when(F.col("Charity") == "No", 1)
    return t.pay.groupBy(ID).agg(F.sum(no).alias("skipping"), strict_sum(no).alias("strict"))


# --- window values ---------------------------------------------------------------------


@query(
    f"""SELECT Record_ID, CAST(sum({AMOUNT}) OVER (PARTITION BY Physician_ID) AS DOUBLE)
    AS Payment_Physician, CAST(sum({N_PAYMENTS}) OVER (PARTITION BY Physician_ID) AS BIGINT)
    AS NumberOfPayments_Physician FROM pay"""
)
def win_partition_total(t):
    joined = attach_totals(
        t.pay.select(RECORD, ID, AMOUNT, N_PAYMENTS),
        [ID],
        RECORD,
        Payment_Physician=F.sum(AMOUNT),
        NumberOfPayments_Physician=F.sum(N_PAYMENTS),
    )
    return joined.select(RECORD, _dbl("Payment_Physician"), "NumberOfPayments_Physician")


def _over(*keys: str) -> str:
    part = f"sum({AMOUNT}) OVER (PARTITION BY Physician_ID{''.join(', ' + k for k in keys)})"
    return f"CAST({part} AS DOUBLE)"


@query(
    f"""SELECT Record_ID, {_over()} AS total, round({_over(COMPANY, NATURE)}
    / nullif({_over()}, 0) * 100, 6) AS pct_nature, round({_over(FORM)}
    / nullif({_over()}, 0) * 100, 6) AS pct_form, round({_over(COMPANY)}
    / nullif({_over()}, 0) * 100, 6) AS pct_company FROM pay"""
)
def win_nested_partitions(t):
    """Totals at four grains on every payment.

    Grains are summed over category rows of a recipient; the payments meet them in one join.
    """
    grain = [ID, COMPANY, NATURE, FORM]
    cells = t.pay.groupBy(*grain).agg(F.sum(AMOUNT).alias("_s"))

    def over(*keys: str):
        names = ", ".join([ID, *keys])
        return F.expr(f"sum(_s) over (partition by {names})")

    sums = cells.select(
        *grain,
        over().alias("total"),
        over(COMPANY, NATURE).alias("by_nature"),
        over(FORM).alias("by_form"),
        over(COMPANY).alias("by_company"),
    )
    total = F.col("total")
    values = sums.select(
        *grain,
        _dbl("total"),
        F.round(percent(F.col("by_nature"), total), 6).alias("pct_nature"),
        F.round(percent(F.col("by_form"), total), 6).alias("pct_form"),
        F.round(percent(F.col("by_company"), total), 6).alias("pct_company"),
    )
    facts = t.pay.select(RECORD, *grain)
    return join_skewed(facts, values, grain, RECORD, null_safe=True).drop(*grain)


@query(
    """SELECT Physician_ID AS id, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END)
    AS label FROM pay GROUP BY 1"""
)
def win_any_over(t):
    """Any per group kept once per group, written as the grouped aggregate it equals."""
    return t.pay.groupBy(F.col(ID).alias("id")).agg(
        any_known(yes_no(F.col(LABEL))).alias("label")
    )


@query(
    """SELECT id, row_number() OVER (ORDER BY md5('7:' || CAST(id AS VARCHAR)), id)
    AS row_index FROM phys"""
)
def win_row_index(t):
    return with_hash_index(t.phys.select("id"), "id", 7)
