"""Scalar expressions and bins."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.catalog.registry import cut_sql, query
from remitlens.functions import bins
from remitlens.functions.values import (
    count_parts,
    count_present,
    parse_us_date,
    percent,
    prefixed,
    yes_no,
)
from remitlens.operators.aggregates import share_of_total, totals_by
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import number_levels, with_row_index
from remitlens.operators.reshape import levels
from remitlens.operators.splits import lump_companies
from remitlens.plans.clean import named_companies, squash_spaces, split_specialties
from remitlens.plans.rules import row_predictions
from remitlens.schemas import (
    AMOUNT,
    COMPANIES,
    COMPANY,
    FORM,
    ID,
    LABEL,
    LICENSES,
    N_PAYMENTS,
    NATURE,
    PAYMENTS,
    PHYSICIANS,
    PRODUCT_TYPES,
    RECORD,
    SPECIALTIES,
)


def _filled(columns) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)


@query(f"SELECT id, CAST({_filled(LICENSES)} AS INTEGER) AS n_licenses FROM phys")
def count_nonnull_columns(t):
    return t.phys.select("id", count_present(LICENSES).alias("n_licenses"))


@query(f"SELECT Record_ID, CAST({_filled(PRODUCT_TYPES)} AS INTEGER) AS n_products FROM pay")
def count_nonnull_products(t):
    return t.pay.select(RECORD, count_present(PRODUCT_TYPES).alias("n_products"))


@query(
    """SELECT id, CAST(length(Primary_Specialty) - length(replace(Primary_Specialty, '|', ''))
    + 1 AS INTEGER) AS n_parts FROM phys"""
)
def count_delimiters(t):
    return t.phys.select("id", count_parts(F.col("Primary_Specialty")).alias("n_parts"))


@query(f"SELECT Record_ID, replace({NATURE}, ' ', '_') AS nature FROM pay")
def replace_spaces(t):
    return t.pay.select(RECORD, squash_spaces(F.col(NATURE)).alias("nature"))


@query("SELECT Company_ID, lower(Country) AS country FROM comp")
def lowercase(t):
    return t.comp.select(COMPANY, F.lower("Country").alias("country"))


@query(f"SELECT Record_ID, concat('NATURE_ ', {NATURE}) AS label FROM pay")
def concat_label(t):
    return t.pay.select(RECORD, prefixed("NATURE_", F.col(NATURE)).alias("label"))


@query("""SELECT Record_ID, CAST(strptime("Date", '%m/%d/%Y') AS DATE)::VARCHAR AS day FROM pay""")
def parse_date(t):
    return t.pay.select(RECORD, parse_us_date(F.col("Date")).cast("string").alias("day"))


@query(
    """SELECT Record_ID, CAST(month(strptime("Date", '%m/%d/%Y')) AS INTEGER) AS m FROM pay"""
)
def date_month(t):
    return t.pay.select(RECORD, F.month(parse_us_date(F.col("Date"))).alias("m"))


@query("""SELECT Record_ID, CAST(year(strptime("Date", '%m/%d/%Y')) AS INTEGER) AS y FROM pay""")
def date_year(t):
    return t.pay.select(RECORD, F.year(parse_us_date(F.col("Date"))).alias("y"))


@query(
    """SELECT Record_ID, CAST(CASE Ownership_Indicator WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END
    AS INTEGER) AS label, CAST(CASE Charity WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER)
    AS charity FROM pay"""
)
def case_yes_no(t):
    label, charity = yes_no(F.col(LABEL)), yes_no(F.col("Charity"))
    return t.pay.select(RECORD, label.alias("label"), charity.alias("charity"))


@query(
    f"""SELECT Record_ID, CASE WHEN {FORM} LIKE 'Stock%' THEN 1 ELSE 0 END AS prediction
    FROM pay"""
)
def case_prediction_decode(t):
    text = F.when(F.col("prediction") == 1, "Yes").otherwise("No")
    decoded = yes_no(text).alias("prediction")
    return row_predictions(t.pay).select(RECORD, decoded)


@query(
    f"""SELECT Record_ID, CASE WHEN n IN (1, 2, 3, 4) THEN CAST(n AS VARCHAR)
    WHEN n BETWEEN 5 AND 6 THEN '5-6' WHEN n BETWEEN 7 AND 11 THEN '7-11'
    WHEN n BETWEEN 12 AND 16 THEN '12-16' WHEN n BETWEEN 17 AND 20 THEN '17-20'
    ELSE '20+' END AS band FROM (SELECT Record_ID, {N_PAYMENTS} AS n FROM pay)"""
)
def bin_case_counts(t):
    return t.pay.select(RECORD, bins.count_band(F.col(N_PAYMENTS)).alias("band"))


# Labels of the amount bins, in order.
@query(
    f"""SELECT Record_ID, bin, CASE bin WHEN 1 THEN '(0,10]' WHEN 2 THEN '(10,15]'
    WHEN 3 THEN '(15,20]' WHEN 4 THEN '(20,30]' WHEN 5 THEN '(30,40]' WHEN 6 THEN '(40,50]'
    WHEN 7 THEN '(50,60]' WHEN 8 THEN '(60,70]' WHEN 9 THEN '(70,80]' WHEN 10 THEN '(80,90]'
    WHEN 11 THEN '(90,100]' WHEN 12 THEN '(100,Inf)' END AS label FROM
    (SELECT Record_ID, {cut_sql(AMOUNT, bins.AMOUNT_BREAKS)} AS bin FROM pay)"""
)
def bin_cut_amount(t):
    amount = F.col(AMOUNT)
    return t.pay.select(
        RECORD,
        bins.cut(amount, bins.AMOUNT_BREAKS).alias("bin"),
        bins.cut_label(amount, bins.AMOUNT_BREAKS).alias("label"),
    )


@query(f"SELECT Record_ID, {cut_sql(AMOUNT, bins.AMOUNT_BREAKS_WIDE)} AS bin FROM pay")
def bin_cut_amount_wide(t):
    return t.pay.select(RECORD, bins.cut(F.col(AMOUNT), bins.AMOUNT_BREAKS_WIDE).alias("bin"))


@query(
    f"""SELECT Physician_ID, {cut_sql('s', bins.TOTAL_BREAKS)} AS bin,
    {cut_sql('s', bins.TOTAL_BREAKS_FINE)} AS bin_fine FROM
    (SELECT Physician_ID, sum({AMOUNT}) AS s FROM pay GROUP BY 1)"""
)
def bin_cut_total(t):
    total = F.col("total_amount")
    return totals_by(t.pay, ID, AMOUNT, N_PAYMENTS).select(
        ID,
        bins.cut(total, bins.TOTAL_BREAKS).alias("bin"),
        bins.cut(total, bins.TOTAL_BREAKS_FINE).alias("bin_fine"),
    )


@query(
    f"""SELECT Physician_ID, {cut_sql('m', bins.MEAN_BREAKS)} AS bin FROM
    (SELECT Physician_ID, round(CAST(sum({AMOUNT}) AS DOUBLE)
    / nullif(CAST(sum({N_PAYMENTS}) AS DOUBLE), 0), 6) AS m FROM pay GROUP BY 1)"""
)
def bin_cut_mean(t):
    mean = F.round("mean_amount", 6)
    totals = totals_by(t.pay, ID, AMOUNT, N_PAYMENTS)
    return totals.select(ID, bins.cut(mean, bins.MEAN_BREAKS).alias("bin"))


@query(
    f"""SELECT Physician_ID, {FORM}, {cut_sql('v', bins.PERCENT_BREAKS)} AS bin,
    {cut_sql('v', bins.PERCENT_BREAKS_FINE)} AS bin_fine,
    {cut_sql('v', bins.PERCENT_BREAKS_FORM)} AS bin_form FROM
    (SELECT p.Physician_ID, {FORM}, round(CAST(s AS DOUBLE) / nullif(CAST(w AS DOUBLE), 0)
    * 100, 6) AS v FROM (SELECT Physician_ID, {FORM}, sum({AMOUNT}) AS s FROM pay
    GROUP BY 1, 2) p JOIN (SELECT Physician_ID, sum({AMOUNT}) AS w FROM pay GROUP BY 1) q
    ON p.Physician_ID = q.Physician_ID)"""
)
def bin_cut_percent(t):
    v = F.round("pct", 6)  # keeps a full share from passing 100
    return share_of_total(t.pay, ID, [FORM], AMOUNT).select(
        ID,
        FORM,
        bins.cut(v, bins.PERCENT_BREAKS).alias("bin"),
        bins.cut(v, bins.PERCENT_BREAKS_FINE).alias("bin_fine"),
        bins.cut(v, bins.PERCENT_BREAKS_FORM).alias("bin_form"),
    )


@query(
    """SELECT Record_ID, CASE WHEN lower(comp.Country) = lower(phys.Country) THEN 1 ELSE 0 END
    AS same_country FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID"""
)
def flag_same_country(t):
    people = t.phys.select(F.col("id").alias(ID), "Country")
    companies = named_companies(t.comp).select(COMPANY, "Company_Country")
    joined = join_skewed(t.pay.select(RECORD, ID, COMPANY), people, ID, RECORD)
    joined = join_skewed(joined, companies, COMPANY, RECORD, keys_from=t.pay)
    same = F.lower("Company_Country") == F.lower("Country")
    return joined.select(RECORD, F.when(same, 1).otherwise(0).alias("same_country"))


@query(
    f"""SELECT Record_ID, CAST(TRY_CAST({N_PAYMENTS} AS VARCHAR) AS BIGINT) AS n,
    CAST({AMOUNT} AS DOUBLE) AS amount, TRY_CAST(substr("Date", 1, 2) AS INTEGER) AS m,
    TRY_CAST({FORM} AS INTEGER) AS bad FROM pay"""
)
def cast_numeric(t):
    return t.pay.select(
        RECORD,
        F.col(N_PAYMENTS).cast("bigint").alias("n"),
        F.col(AMOUNT).cast("double").alias("amount"),
        F.substring("Date", 1, 2).try_cast("int").alias("m"),
        F.col(FORM).try_cast("int").alias("bad"),
    )


@query(
    """SELECT level, row_number() OVER (ORDER BY level) AS idx FROM (SELECT DISTINCT
    unnest([split_part(Primary_Specialty, '|', 1), split_part(Primary_Specialty, '|', 2),
    split_part(Primary_Specialty, '|', 3)]) AS level FROM phys) WHERE level <> ''"""
)
def factor_index(t):
    """Dictionary of the specialty levels, numbered in name order."""
    return with_row_index(levels(split_specialties(t.phys), SPECIALTIES), "level", name="idx")


def text_columns(schema) -> list[str]:
    return [f.name for f in schema if f.dataType.simpleString() == "string"]


TEXT_COLUMNS = {"phys": PHYSICIANS, "pay": PAYMENTS, "comp": COMPANIES}


@query(
    "SELECT column_name, level, row_number() OVER (PARTITION BY column_name ORDER BY level) AS idx FROM ("
    + " UNION ALL ".join(
        f"""SELECT DISTINCT '{table}.{c}' AS column_name, "{c}" AS level FROM {table}"""
        for table, schema in TEXT_COLUMNS.items()
        for c in text_columns(schema)
    )
    + ") WHERE level IS NOT NULL"
)
def factor_index_all(t):
    """Dictionary of every text column of the three tables, numbered column by column."""

    def pairs(table: str, schema) -> DataFrame:
        entries = [
            F.struct(F.lit(f"{table}.{c}").alias("column_name"), F.col(c).alias("level"))
            for c in text_columns(schema)
        ]
        return getattr(t, table).select(F.inline(F.array(*entries)))

    every = [pairs(table, schema) for table, schema in TEXT_COLUMNS.items()]
    return number_levels(reduce(DataFrame.unionByName, every))


@query(f"SELECT Record_ID, CAST({AMOUNT} AS DOUBLE) / nullif({N_PAYMENTS}, 0) * 100 AS pct FROM pay")
def arith_ratio_percent(t):
    return t.pay.select(RECORD, percent(F.col(AMOUNT), F.col(N_PAYMENTS)).alias("pct"))


@query(
    """SELECT Record_ID, CASE WHEN kept.Company_ID IS NULL THEN 'Dummy'
    ELSE CAST(pay.Company_ID AS VARCHAR) END AS company_level FROM pay LEFT JOIN
    (SELECT Company_ID FROM pay JOIN phys ON pay.Physician_ID = phys.id
    WHERE split_set = 'train' GROUP BY 1
    HAVING sum(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) > 0) kept
    ON pay.Company_ID = kept.Company_ID"""
)
def lump_rare_by_target(t):
    ids = t.phys.filter(F.col("split_set") == "train").select(F.col("id").alias(ID))
    train = join_skewed(t.pay.select(RECORD, ID, COMPANY, LABEL), ids, ID, RECORD, "left_semi")
    lumped = lump_companies(t.pay.select(RECORD, COMPANY), train)
    return lumped.select(RECORD, "company_level")
