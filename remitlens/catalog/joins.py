"""Joins, sorts and set operations."""

from pyspark.sql import functions as F

from remitlens.catalog.registry import query
from remitlens.functions.values import prefixed
from remitlens.models.evaluate import best_run, roll_up, sweep
from remitlens.operators.joins import join_keeping_dimension, join_natural, join_skewed
from remitlens.operators.ordering import bind_by_position
from remitlens.operators.reshape import levels, pivot_values
from remitlens.operators.splits import role
from remitlens.plans.clean import named_companies, split_specialties
from remitlens.plans.features import align, one_sided, payment_blocks
from remitlens.plans.rules import row_predictions, stock_scores
from remitlens.schemas import (
    AMOUNT,
    COMPANY,
    ID,
    LABEL,
    LICENSES,
    NATURE,
    PRODUCT_TYPES,
    RECORD,
    SPECIALTIES,
)

BUCKET = "CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15)) AS BIGINT)"


def sql_bucket(seed, key: str) -> str:
    return BUCKET.format(seed=seed, key=key)


def sql_below(seed, key: str, share: float) -> str:
    return f"{sql_bucket(seed, key)} < {int(share * (1 << 60))}"


@query(
    """SELECT pay.Record_ID, pay.Physician_ID, pay.Company_ID, phys.split_set,
    phys.State, comp.Name AS Company_Name, comp.State AS Company_State
    FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID"""
)
def join_left_natural(t):
    people = t.phys.withColumnRenamed("id", ID).select(ID, "split_set", "State")
    companies = named_companies(t.comp).drop("Company_Country")
    joined = join_natural(t.pay.select(RECORD, ID, COMPANY), people, RECORD)
    return join_natural(joined, companies, RECORD, keys_from=t.pay)


@query(
    f"""SELECT pay.Physician_ID AS id, pay.Record_ID, phys.split_set, phys.Primary_Specialty,
    comp.Country AS Company_Country, CAST(pay.{AMOUNT} AS DOUBLE) AS amount
    FROM pay LEFT JOIN phys ON phys.id = pay.Physician_ID
    LEFT JOIN comp ON comp.Company_ID = pay.Company_ID"""
)
def join_left_renamed_key(t):
    amount = F.col(AMOUNT).cast("double").alias("amount")
    facts = t.pay.select(F.col(ID).alias("id"), RECORD, COMPANY, amount)
    people = t.phys.select("id", "split_set", "Primary_Specialty")
    companies = named_companies(t.comp).select(COMPANY, "Company_Country")
    joined = join_skewed(facts, people, "id", RECORD)
    return join_skewed(joined, companies, COMPANY, RECORD, keys_from=t.pay).drop(COMPANY)


@query(
    f"""SELECT phys.id AS Physician_ID, phys.split_set, pay.Record_ID, pay.{NATURE}
    FROM phys LEFT JOIN pay ON phys.id = pay.Physician_ID"""
)
def join_dim_to_fact_left(t):
    people = t.phys.select(F.col("id").alias(ID), "split_set")
    return join_keeping_dimension(people, t.pay.select(ID, RECORD, NATURE), ID, RECORD)


@query(
    """SELECT phys.id, pay.Company_ID, pay.Record_ID, phys.State AS State_x, comp.State AS State_y,
    phys.Country AS Country_x, comp.Country AS Country_y
    FROM phys JOIN pay ON phys.id = pay.Physician_ID
    JOIN comp ON pay.Company_ID = comp.Company_ID"""
)
def join_inner_merge(t):
    facts = t.pay.select(F.col(ID).alias("id"), COMPANY, RECORD)
    people = t.phys.select(
        "id", F.col("State").alias("State_x"), F.col("Country").alias("Country_x")
    )
    companies = t.comp.select(
        COMPANY, F.col("State").alias("State_y"), F.col("Country").alias("Country_y")
    )
    joined = join_skewed(facts, people, "id", RECORD, "inner")
    return join_skewed(joined, companies, COMPANY, RECORD, "inner", keys_from=t.pay)


@query(
    """SELECT Record_ID, Physician_ID FROM pay WHERE Physician_ID IN
    (SELECT id FROM phys WHERE split_set = 'test')"""
)
def join_semi(t):
    test = t.phys.filter(F.col("split_set") == "test").select(F.col("id").alias(ID))
    return join_skewed(t.pay.select(RECORD, ID), test, ID, RECORD, "left_semi")


@query(
    """SELECT Record_ID, Physician_ID FROM pay WHERE Physician_ID NOT IN
    (SELECT id FROM phys WHERE split_set = 'test')"""
)
def join_anti(t):
    test = t.phys.filter(F.col("split_set") == "test").select(F.col("id").alias(ID))
    return join_skewed(t.pay.select(RECORD, ID), test, ID, RECORD, "left_anti")


@query(
    f"""SELECT ids.Physician_ID, ids.role, pay.Record_ID, pay.Ownership_Indicator FROM
    (SELECT DISTINCT pay.Physician_ID, CASE WHEN {sql_below(1, 'pay.Physician_ID', 0.25)}
    THEN 'test' ELSE 'train' END AS role FROM pay JOIN phys ON pay.Physician_ID = phys.id
    WHERE split_set = 'train') ids LEFT JOIN pay ON ids.Physician_ID = pay.Physician_ID"""
)
def join_split_back(t):
    train = t.phys.filter(F.col("split_set") == "train").select(F.col("id").alias(ID))
    ids = train.join(t.pay.select(ID).distinct(), ID, "left_semi")
    ids = ids.withColumn("role", role(1, ID, 0.25))
    return join_skewed(t.pay.select(RECORD, ID, LABEL), ids, ID, RECORD, "inner")


@query(
    """SELECT Physician_ID, max(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%'
    THEN 1 ELSE 0 END) AS prediction,
    max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS truth
    FROM pay GROUP BY Physician_ID"""
)
def join_prediction_truth(t):
    return roll_up(row_predictions(t.pay), ID)


@query(
    """SELECT Record_ID, Physician_ID AS id, CASE WHEN Form_of_Payment_or_Transfer_of_Value
    LIKE 'Stock%' THEN 1 ELSE 0 END AS prediction,
    CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END AS truth FROM pay"""
)
def attach_scores_to_keys(t):
    return row_predictions(t.pay).select(RECORD, F.col(ID).alias("id"), "prediction", "truth")


@query(
    """SELECT Record_ID, Physician_ID AS id, CASE WHEN Form_of_Payment_or_Transfer_of_Value
    LIKE 'Stock%' THEN 1 ELSE 0 END AS prediction FROM pay"""
)
def bind_scores_by_position(t):
    """Keys and predictions held in two frames of equal order, bound row by row."""
    keys = t.pay.select(RECORD, F.col(ID).alias("id"))
    scores = row_predictions(t.pay).select(F.col(RECORD).alias("_order"), "prediction")
    return bind_by_position(keys, scores, [RECORD], ["_order"]).drop("_order")


@query(
    """SELECT i.id, coalesce(n.v, 0) AS food_pct, coalesce(f.v, 0) AS cash_pct,
    coalesce(l.n, 0) AS n_licenses FROM (SELECT DISTINCT Physician_ID AS id FROM pay) i
    LEFT JOIN (SELECT Physician_ID AS id, round(CAST(sum(CASE WHEN
    Nature_of_Payment_or_Transfer_of_Value = 'Food and Beverage' THEN
    Total_Amount_of_Payment_USDollars ELSE 0 END) AS DOUBLE) * 100
    / nullif(CAST(sum(Total_Amount_of_Payment_USDollars) AS DOUBLE), 0), 6) AS v
    FROM pay GROUP BY 1) n ON i.id = n.id
    LEFT JOIN (SELECT Physician_ID AS id, round(CAST(sum(CASE WHEN
    Form_of_Payment_or_Transfer_of_Value = 'Cash or cash equivalent' THEN
    Total_Amount_of_Payment_USDollars ELSE 0 END) AS DOUBLE) * 100
    / nullif(CAST(sum(Total_Amount_of_Payment_USDollars) AS DOUBLE), 0), 6) AS v
    FROM pay GROUP BY 1) f ON i.id = f.id
    LEFT JOIN (SELECT id, CAST("""
    + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in LICENSES)
    + """ AS INTEGER) AS n FROM phys) l ON i.id = l.id"""
)
def join_chosen_features(t):
    names = {"NATURE_ Food and Beverage": "food_pct", "FORM_ Cash or cash equivalent": "cash_pct"}
    shares = payment_blocks(t.pay).filter(F.col("feature").isin(list(names)))
    shares = shares.withColumn("value", F.round("value", 6))
    wide = pivot_values(shares, "id", "feature", "value", list(names)).withColumnsRenamed(names)
    filled = F.filter(F.array(*LICENSES), lambda s: s.isNotNull())
    licenses = t.phys.select("id", F.size(filled).alias("n_licenses"))
    spine = t.pay.select(F.col(ID).alias("id")).distinct()
    return spine.join(wide, "id", "left").join(licenses, "id", "left").na.fill(0)


# --- sorts and top-1 -------------------------------------------------------------------


@query(
    """SELECT Physician_ID AS id, CAST(sum(Number_of_Payments) AS BIGINT) AS n
    FROM pay GROUP BY 1 ORDER BY 1"""
)
def sort_by_key(t):
    counts = t.pay.groupBy(F.col(ID).alias("id")).agg(F.sum("Number_of_Payments").alias("n"))
    return counts.orderBy("id")


RUN_CUTS = [0.0, 0.02, 0.05, 0.1, 0.2]
SCORES = """scores AS (SELECT Physician_ID,
    CAST(count(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 END)
    AS DOUBLE) / count(*) AS score,
    max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS truth
    FROM pay GROUP BY 1)"""
RUNS = (
    SCORES
    + """, runs AS (SELECT run, cut AS threshold, (CAST(count(CASE WHEN truth = 1 AND
    score > cut THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN truth = 1 THEN 1 END), 0)
    + CAST(count(CASE WHEN truth = 0 AND score <= cut THEN 1 END) AS DOUBLE)
    / nullif(count(CASE WHEN truth = 0 THEN 1 END), 0)) / 2 AS bac
    FROM scores, (VALUES """
    + ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(RUN_CUTS, 1))
    + ") AS c(run, cut) GROUP BY 1, 2)"
)


def numbered_runs(t):
    """Metrics of several cut-offs, numbered in the order they were tried."""
    run = F.array_position(F.array(*[F.lit(c) for c in RUN_CUTS]), F.col("threshold"))
    return sweep(stock_scores(t.pay), RUN_CUTS).withColumn("run", run.cast("int"))


@query(
    """SELECT run, threshold, round(bac, 6) AS bac FROM runs
    WHERE bac IS NOT NULL ORDER BY bac DESC, run LIMIT 1""",
    RUNS,
)
def argmax_best_run(t):
    best = best_run(numbered_runs(t), "threshold")
    return best.select("run", "threshold", F.round("bac", 6).alias("bac"))


# --- set operations --------------------------------------------------------------------


@query(
    "SELECT 'license' AS feature, level FROM ("
    + " UNION ".join(f"SELECT {c} AS level FROM phys" for c in LICENSES)
    + ") WHERE level IS NOT NULL UNION ALL SELECT 'specialty', level FROM ("
    + " UNION ".join(
        f"SELECT split_part(Primary_Specialty, '|', {i}) AS level FROM phys" for i in (1, 2, 3)
    )
    + ") WHERE level <> '' UNION ALL SELECT 'product_type', level FROM ("
    + " UNION ".join(f"SELECT {c} AS level FROM pay" for c in PRODUCT_TYPES)
    + ") WHERE level IS NOT NULL"
)
def levels_union(t):
    def tagged(feature, df, columns):
        return levels(df, columns).select(F.lit(feature).alias("feature"), "level")

    return (
        tagged("license", t.phys, LICENSES)
        .unionByName(tagged("specialty", split_specialties(t.phys), SPECIALTIES))
        .unionByName(tagged("product_type", t.pay, PRODUCT_TYPES))
    )


@query(
    """SELECT 'train' AS only_in, feature FROM (SELECT feature FROM feats WHERE split_set =
    'train' EXCEPT SELECT feature FROM feats WHERE split_set = 'test') UNION ALL
    SELECT 'test', feature FROM (SELECT feature FROM feats WHERE split_set = 'test'
    EXCEPT SELECT feature FROM feats WHERE split_set = 'train')""",
    """feats AS (SELECT split_set, concat('COMP_ ', CAST(Company_ID AS VARCHAR)) AS feature
    FROM pay JOIN phys ON pay.Physician_ID = phys.id
    UNION SELECT split_set, concat('CITY_ ', City) FROM phys)""",
)
def levels_difference_city_company(t):
    """City and company features that only one side of the predefined split has."""
    people = t.phys.select(F.col("id").alias(ID), "split_set", prefixed("CITY_", F.col("City")))
    people = people.toDF(ID, "split_set", "feature")
    pairs = t.pay.select(ID, COMPANY).distinct()
    companies = join_skewed(pairs, people.select(ID, "split_set"), ID, COMPANY, "inner")
    companies = companies.select("split_set", prefixed("COMP_", F.col(COMPANY)).alias("feature"))
    both = companies.unionByName(people.select("split_set", "feature"))
    return one_sided(align(both, F.col("split_set") == "test"))


@query(
    """SELECT 'sweep' AS source, run, round(bac, 6) AS bac FROM runs UNION ALL
    SELECT 'any', 0, (SELECT round(bac, 6) FROM runs WHERE run = 1)""",
    RUNS,
)
def union_runs(t):
    runs = numbered_runs(t)
    swept = runs.select(F.lit("sweep").alias("source"), "run", F.round("bac", 6).alias("bac"))
    any_stock = sweep(stock_scores(t.pay), [0.0]).select(
        F.lit("any").alias("source"), F.lit(0).alias("run"), F.round("bac", 6).alias("bac")
    )
    return swept.unionByName(any_stock)
