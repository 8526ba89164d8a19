"""Missing data, sampling and splitting."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.catalog.joins import sql_below, sql_bucket
from remitlens.catalog.registry import cut_sql, query
from remitlens.functions import bins
from remitlens.functions.values import count_present, yes_no
from remitlens.models.evaluate import evaluate
from remitlens.operators.joins import join_skewed
from remitlens.operators.missing import completeness, fill_sentinel
from remitlens.operators.ordering import hash_folds, with_fold, with_row_index
from remitlens.operators.splits import bootstrap, guard_leak, repeated_roles, role
from remitlens.plans.clean import named_companies, split_specialties
from remitlens.plans.rules import row_predictions, stock_scores
from remitlens.schemas import (
    AMOUNT,
    COMPANY,
    FORM,
    ID,
    LABEL,
    LICENSES,
    PAYMENTS,
    PHYSICIANS,
    PRODUCT_COLUMNS,
    RECORD,
    SPECIALTIES,
)

FOLD = "greatest(1, CAST(ceil((i - 1) * {k} / CAST(n - 1 AS DOUBLE)) AS INTEGER))"
# Columns that are empty by design on most payments: second and third products, codes, travel, notes.
SPARSE = {
    "Charity", "Third_Party_Covered", "Contextual_Information", "City_of_Travel",
    "State_of_Travel", "Country_of_Travel", "Product_Code_1",
    *[c for c in PRODUCT_COLUMNS if not c.endswith("_1")],
}
DENSE = [c for c in PAYMENTS.names if c not in SPARSE]


@query(
    f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS amount' if c == AMOUNT else c for c in DENSE)} "
    f"FROM pay WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DENSE)}"
)
def drop_null_rows(t):
    """Payments lacking none of the columns that a model keeps."""
    kept = t.pay.select(*DENSE).dropna("any")
    return kept.withColumn("amount", F.col(AMOUNT).cast("double")).drop(AMOUNT)


PERSON_TEXT = [f.name for f in PHYSICIANS if isinstance(f.dataType, T.StringType)]
PAYMENT_TEXT = [f.name for f in PAYMENTS if isinstance(f.dataType, T.StringType)]


@query(
    "SELECT Record_ID, Physician_ID, pay.Company_ID, "
    + ", ".join(f"coalesce(pay.\"{c}\", 'DUMMY') AS \"{c}\"" for c in PAYMENT_TEXT)
    + ", "
    + ", ".join(f"coalesce(phys.{c}, 'DUMMY') AS {c}" for c in PERSON_TEXT)
    + """, coalesce(comp.Name, 'DUMMY') AS Company_Name, coalesce(comp.State, 'DUMMY') AS
    Company_State, coalesce(comp.Country, 'DUMMY') AS Company_Country FROM pay
    LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID"""
)
def fill_null_sentinel(t):
    """Every text column of payments with their recipients and companies."""
    people = t.phys.withColumnRenamed("id", ID)
    joined = join_skewed(t.pay.select(RECORD, ID, COMPANY, *PAYMENT_TEXT), people, ID, RECORD)
    joined = join_skewed(joined, named_companies(t.comp), COMPANY, RECORD, keys_from=t.pay)
    return fill_sentinel(joined)


# The text standing for a missing value of each column.
FILLS = {
    "Third_Party_Covered": "Dummy Specialty",
    "Specialty1": "Dummy Specialty",
    "Related_Product_Indicator": "Dummy Product Indicator",
    "Product_Type_1": "Dummy Product",
    "State": "Dummy State",
    "Company_State": "Dummy Company_State",
}


@query(
    f"SELECT Record_ID, {', '.join(f"coalesce({c}, '{v}') AS {c}" for c, v in FILLS.items())} FROM j",
    """j AS (SELECT Record_ID, Third_Party_Covered, Related_Product_Indicator, Product_Type_1,
    nullif(split_part(Primary_Specialty, '|', 1), '') AS Specialty1, phys.State,
    comp.State AS Company_State FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID)""",
)
def fill_null_per_column(t):
    people = split_specialties(t.phys).select(F.col("id").alias(ID), "Specialty1", "State")
    companies = t.comp.select(COMPANY, F.col("State").alias("Company_State"))
    facts = t.pay.select(
        RECORD, ID, COMPANY, "Third_Party_Covered", "Related_Product_Indicator", "Product_Type_1"
    )
    joined = join_skewed(facts, people, ID, RECORD)
    joined = join_skewed(joined, companies, COMPANY, RECORD, keys_from=t.pay)
    return joined.drop(ID, COMPANY).na.fill(FILLS)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(CAST(count("{c}") AS DOUBLE) / count(*), 6)
        AS complete_rate FROM pay"""
        for c in PAYMENTS.names
    )
)
def profile_completeness(t):
    rate = F.round("complete_rate", 6).alias("complete_rate")
    return completeness(t.pay, PAYMENTS.names).select("column_name", rate)


N_LICENSES = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in LICENSES)
N_PARTS = " + ".join(
    f"CASE WHEN split_part(Primary_Specialty, '|', {i}) <> '' THEN 1 ELSE 0 END"
    for i in (1, 2, 3)
)
CLASSED = {
    "form": FORM,
    "amount_bin": f"CAST({cut_sql(AMOUNT, bins.AMOUNT_BREAKS)} AS VARCHAR)",
    "n_specialties": f"CAST({N_PARTS} AS VARCHAR)",
    "n_licenses": f"CAST({N_LICENSES} AS VARCHAR)",
}


@query(
    " UNION ALL ".join(
        f"""SELECT CASE Ownership_Indicator WHEN 'Yes' THEN 1 ELSE 0 END AS label,
        '{name}' AS attribute, {sql} AS category, CAST(count(*) AS BIGINT) AS n
        FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id GROUP BY 1, 3"""
        for name, sql in CLASSED.items()
    )
)
def profile_class_counts(t):
    """Class-conditional counts; payments are counted before recipients are joined."""
    label = yes_no(F.col(LABEL)).alias("label")
    amount_bin = bins.cut(F.col(AMOUNT), bins.AMOUNT_BREAKS).alias("amount_bin")
    cells = t.pay.groupBy(ID, label, F.col(FORM).alias("form"), amount_bin).agg(
        F.count("*").alias("n")
    )
    people = split_specialties(t.phys).select(
        F.col("id").alias(ID),
        count_present(SPECIALTIES).alias("n_specialties"),
        count_present(LICENSES).alias("n_licenses"),
    )
    joined = join_skewed(cells, people, ID, ["form", "amount_bin"])
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("category"))
            for c in CLASSED
        ]
    )
    return (
        joined.select("label", "n", F.inline(pairs))
        .groupBy("label", "attribute", "category")
        .agg(F.sum("n").alias("n"))
    )


def _role_sql(seed, key: str, share: float) -> str:
    return f"CASE WHEN {sql_below(seed, key, share)} THEN 'test' ELSE 'train' END"


@query(f"SELECT Record_ID, {_role_sql(3, 'Record_ID', 0.25)} AS role FROM pay")
def split_holdout_rows(t):
    return t.pay.select(RECORD, role(3, RECORD, 0.25).alias("role"))


@query(f"SELECT id, {_role_sql(4, 'id', 0.2)} AS role FROM phys WHERE split_set = 'train'")
def split_holdout_group(t):
    train = t.phys.filter(F.col("split_set") == "train")
    return train.select("id", role(4, "id", 0.2).alias("role"))


@query(
    """SELECT Record_ID, split_set FROM pay JOIN phys ON pay.Physician_ID = phys.id"""
)
def split_predefined(t):
    sides = t.phys.select(F.col("id").alias(ID), "split_set")
    return join_skewed(t.pay.select(RECORD, ID), sides, ID, RECORD, "inner").drop(ID)


@query(
    f"""SELECT Record_ID, {FOLD.format(k=5)} AS fold FROM (SELECT Record_ID,
    row_number() OVER (ORDER BY Record_ID) AS i, count(*) OVER () AS n FROM pay)"""
)
def kfold_rows(t):
    return with_fold(with_row_index(t.pay.select(RECORD), RECORD), 5).select(RECORD, "fold")


@query(
    f"""SELECT id, {FOLD.format(k=5)} AS fold FROM (SELECT id, row_number() OVER
    (ORDER BY id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT Physician_ID AS id
    FROM pay))"""
)
def kfold_groups(t):
    ids = t.pay.select(F.col(ID).alias("id")).distinct()
    return with_fold(with_row_index(ids, "id"), 5).select("id", "fold")


@query(
    f"""SELECT id, {FOLD.format(k=3)} AS fold FROM (SELECT id, row_number() OVER
    (ORDER BY md5('2021:' || CAST(id AS VARCHAR)), id) AS i, count(*) OVER () AS n
    FROM phys WHERE split_set = 'train')"""
)
def kfold_groups_shuffled(t):
    train = t.phys.filter(F.col("split_set") == "train")
    return hash_folds(train, "id", 2021, 3).select("id", "fold")


@query(
    """SELECT run, tp, fp, fn, tn, round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0)
    + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2, 6) AS bac FROM (SELECT run,
    count(CASE WHEN truth = 1 AND score > 0.05 THEN 1 END) AS tp,
    count(CASE WHEN truth = 0 AND score > 0.05 THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND score <= 0.05 THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND score <= 0.05 THEN 1 END) AS tn
    FROM scores, (VALUES (1), (2), (3), (4), (5)) AS r(run) WHERE """
    + f"{sql_bucket('X', 'Physician_ID')} < {1 << 58} GROUP BY run)".replace(
        "'X:'", "CAST(run AS VARCHAR) || ':'"
    ),
    """scores AS (SELECT Physician_ID, CAST(count(CASE WHEN
    Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 END) AS DOUBLE) / count(*)
    AS score, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS truth
    FROM pay GROUP BY 1)""",
)
def holdout_repeated(t):
    """Metrics of five random holdouts of a quarter of the recipients, in one pass."""
    scores = stock_scores(t.pay)
    held = repeated_roles(scores, ID, 5, 0.25, keep=["score", "truth"])
    cut = (F.col("score") > 0.05).cast("int")
    held = held.filter(F.col("role") == "test").withColumn("prediction", cut)
    bac = F.round("bac", 6).alias("bac")
    return evaluate(held, "run").select("run", "tp", "fp", "fn", "tn", bac)


@query(
    f"""SELECT p.Record_ID, coalesce(d.draws, 0) AS draws,
    CASE WHEN d.draws IS NULL THEN 'train' ELSE 'test' END AS role FROM
    (SELECT Record_ID, row_number() OVER (ORDER BY Record_ID) AS i FROM pay) p LEFT JOIN
    (SELECT {sql_bucket(9, 'i')} % n + 1 AS j, count(*) AS draws FROM
    (SELECT row_number() OVER (ORDER BY Record_ID) AS i, count(*) OVER () AS n FROM pay)
    WHERE i <= n // 5 GROUP BY 1) d ON p.i = d.j"""
)
def sample_with_replacement(t):
    drawn = bootstrap(t.pay.select(RECORD), RECORD, 9, 5)
    side = F.when(F.col("draws") == 0, "train").otherwise("test").alias("role")
    return drawn.select(RECORD, "draws", side)


@query(
    f"""SELECT tp, fp, fn, tn, round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0)
    + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2, 6) AS bac FROM (SELECT
    CAST(count(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS BIGINT) AS tp,
    CAST(count(CASE WHEN y = 0 AND p = 1 THEN 1 END) AS BIGINT) AS fp,
    CAST(count(CASE WHEN y = 1 AND p = 0 THEN 1 END) AS BIGINT) AS fn,
    CAST(count(CASE WHEN y = 0 AND p = 0 THEN 1 END) AS BIGINT) AS tn FROM
    (SELECT {sql_bucket(9, 'i')} % n + 1 AS j FROM
    (SELECT row_number() OVER (ORDER BY Record_ID) AS i, count(*) OVER () AS n FROM pay)
    WHERE i <= n // 5) d JOIN (SELECT row_number() OVER (ORDER BY Record_ID) AS i,
    CASE {LABEL} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS y,
    CASE WHEN {FORM} LIKE 'Stock%' THEN 1 ELSE 0 END AS p FROM pay) r ON d.j = r.i)"""
)
def bootstrap_bac(t):
    """Metrics of a rule over payments drawn with replacement; a row weighs as often as drawn."""
    rows = row_predictions(t.pay).select(RECORD, "prediction", "truth")
    drawn = bootstrap(rows, RECORD, 9, 5)
    bac = F.round("bac", 6).alias("bac")
    return evaluate(drawn, weight="draws").select("tp", "fp", "fn", "tn", bac)


@query(
    f"""SELECT Record_ID, Physician_ID, Ownership_Indicator FROM pay
    WHERE NOT ({sql_below(6, 'Physician_ID', 1 / 6)} AND Ownership_Indicator = 'Yes')"""
)
def leak_guard_anti(t):
    test = t.phys.select(F.col("id").alias(ID)).filter(role(6, ID, 1 / 6) == "test")
    return guard_leak(t.pay.select(RECORD, ID, LABEL), test)
