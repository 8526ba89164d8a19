"""Scans and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.catalog.registry import query
from remitlens.models.evaluate import sweep
from remitlens.plans.rules import stock_prediction, stock_scores
from remitlens.schemas import AMOUNT, FORM, N_PAYMENTS, PAYMENTS, PHYSICIANS, RECORD, SUBMISSION
from remitlens.session import scratch_path
from remitlens.sources.files import (
    append_metrics,
    fill_template,
    read_csv_blank_kept,
    read_csv_typed,
    write_csv,
)

TEXT = [f.name for f in PAYMENTS if isinstance(f.dataType, T.StringType)]
BLANKS = PHYSICIANS.names
QUOTED = "concat(' \"', {c}, '\", then ')"  # quotes, a separator and outer spaces


def _blank_even(df, key: str, columns: list[str]):
    """Nulls of even keys become blank text, so files hold both forms."""
    blank = F.when(F.col(key) % 2 == 0, "")
    return df.withColumns({c: F.coalesce(c, blank) for c in columns})


@query(
    f"""SELECT Record_ID, Physician_ID, Company_ID, CAST({AMOUNT} AS DOUBLE) AS amount,
    CAST({N_PAYMENTS} AS INTEGER) AS {N_PAYMENTS}, {QUOTED.format(c=FORM)} AS quoted,
    {', '.join(f'"{c}"' for c in TEXT if c != FORM)} FROM pay"""
)
def scan_csv_typed(t):
    path = scratch_path(t.spark, "payments.csv")
    rows = _blank_even(t.pay, RECORD, TEXT).withColumn(FORM, F.expr(QUOTED.format(c=FORM)))
    write_csv(rows.select(*PAYMENTS.names), path)
    read = read_csv_typed(t.spark, path, PAYMENTS)
    return read.withColumn("amount", F.col(AMOUNT).cast("double")).drop(AMOUNT).withColumnRenamed(
        FORM, "quoted"
    )


def _blank_sql(c: str) -> str:
    return f"coalesce({c}, CASE WHEN id % 2 = 0 THEN '' END) AS {c}"


@query(f"SELECT id, {', '.join(map(_blank_sql, BLANKS[1:]))} FROM phys")
def scan_csv_blank_kept(t):
    path = scratch_path(t.spark, "physicians.csv")
    write_csv(_blank_even(t.phys, "id", BLANKS[1:]).select(*BLANKS), path)
    return read_csv_blank_kept(t.spark, path, PHYSICIANS)


RULE = """rule AS (SELECT Physician_ID AS id,
    max(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 ELSE 0 END)
    AS prediction FROM pay GROUP BY 1)"""


@query(
    """SELECT p.id, CAST(r.prediction AS INTEGER) AS prediction
    FROM phys p LEFT JOIN rule r ON p.id = r.id WHERE p.split_set = 'test'""",
    RULE,
)
def sink_submission_csv(t):
    path = scratch_path(t.spark, "submission_ V1 .csv")
    test = t.phys.filter(F.col("split_set") == "test").select("id")
    write_csv(test.join(stock_prediction(t.pay), "id", "left"), path)
    return read_csv_typed(t.spark, path, SUBMISSION)


@query(
    """SELECT p.id, CAST(r.prediction AS INTEGER) AS prediction,
    CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS covered
    FROM phys p LEFT JOIN rule r ON p.id = r.id WHERE p.split_set = 'test'""",
    RULE,
)
def submission_template_fill(t):
    template = t.phys.filter(F.col("split_set") == "test")
    return fill_template(template, stock_prediction(t.pay))


@query(
    """SELECT count(*) AS n_template, count(r.id) AS n_covered,
    count(*) - count(r.id) AS n_missing
    FROM phys p LEFT JOIN rule r ON p.id = r.id WHERE p.split_set = 'test'""",
    RULE,
)
def submission_coverage(t):
    filled = submission_template_fill(t)
    n, covered = F.count("*"), F.sum("covered")
    return filled.agg(
        n.alias("n_template"), covered.alias("n_covered"), (n - covered).alias("n_missing")
    )


CUTS = [0.0, 0.1, 0.25]


@query(
    """SELECT run, tp, fp, fn, tn, round((tp * 1.0 / nullif(tp + fn, 0)
    + tn * 1.0 / nullif(tn + fp, 0)) / 2, 6) AS bac FROM
    (SELECT run, count(CASE WHEN truth = 1 AND score > cut THEN 1 END) AS tp,
    count(CASE WHEN truth = 0 AND score > cut THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND score <= cut THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND score <= cut THEN 1 END) AS tn
    FROM scores, (VALUES (1, 0.0), (2, 0.1), (3, 0.25)) AS c(run, cut) GROUP BY run)""",
    """scores AS (SELECT Physician_ID,
    CAST(count(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 END)
    AS DOUBLE) / count(*) AS score,
    max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END) AS truth
    FROM pay GROUP BY 1)""",
)
def metrics_append(t):
    path = scratch_path(t.spark, "metrics")
    run = F.array_position(F.array(*map(F.lit, CUTS)), F.col("threshold")).cast("int")
    append_metrics(sweep(stock_scores(t.pay), CUTS).withColumn("run", run), path)
    bac = F.round("bac", 6).alias("bac")
    return t.spark.read.parquet(path).select("run", "tp", "fp", "fn", "tn", bac)
