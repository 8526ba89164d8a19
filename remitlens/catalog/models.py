"""Models, scoring and evaluation."""

from dataclasses import replace

from pyspark.sql import functions as F

from remitlens.catalog.joins import SCORES, sql_below, sql_bucket
from remitlens.catalog.missing import FOLD
from remitlens.catalog.registry import cut_sql, query
from remitlens.functions.bins import (
    AMOUNT_BREAKS,
    PERCENT_BREAKS_FINE,
    PERCENT_BREAKS_FORM,
    TOTAL_BREAKS_FINE,
)
from remitlens.functions.values import yes_no
from remitlens.models import association_tree, bayes, boosting, trees
from remitlens.models.association import chi_square
from remitlens.models.evaluate import best_run, evaluate, roll_up, sweep
from remitlens.operators.joins import join_skewed
from remitlens.operators.splits import hash_fold, repeated_roles, role
from remitlens.plans import attribute_counts, binned_shares, jobs
from remitlens.plans.clean import BAYES_FEATURES, bayes_rows
from remitlens.plans.rules import row_predictions, stock_scores
from remitlens.session import materialize
from remitlens.schemas import AMOUNT, FORM, ID, LABEL, LICENSES, NATURE, PRODUCT_TYPES, RECORD

def _filled(columns) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)


AMOUNT_BIN = cut_sql(AMOUNT, AMOUNT_BREAKS)
BAND = """CASE WHEN Number_of_Payments IN (1, 2, 3, 4) THEN CAST(Number_of_Payments AS VARCHAR)
    WHEN Number_of_Payments BETWEEN 5 AND 6 THEN '5-6'
    WHEN Number_of_Payments BETWEEN 7 AND 11 THEN '7-11'
    WHEN Number_of_Payments BETWEEN 12 AND 16 THEN '12-16'
    WHEN Number_of_Payments BETWEEN 17 AND 20 THEN '17-20' ELSE '20+' END"""
N_PARTS = " + ".join(
    f"CASE WHEN split_part(Primary_Specialty, '|', {i}) <> '' THEN 1 ELSE 0 END"
    for i in (1, 2, 3)
)

# Rows of the Naive Bayes features, their levels, and the long form of complete rows.
BASE = f"""base AS (SELECT Record_ID, Physician_ID, split_set,
    CASE Ownership_Indicator WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS class,
    CAST({AMOUNT_BIN} AS VARCHAR) AS amount_bin, {BAND} AS payments_band,
    replace({FORM}, ' ', '_') AS form, replace({NATURE}, ' ', '_') AS nature,
    replace(Third_Party_Recipient, ' ', '_') AS third_party,
    Related_Product_Indicator AS related_product,
    CAST({_filled(LICENSES)} AS VARCHAR) AS n_licenses,
    CAST({_filled(PRODUCT_TYPES)} AS VARCHAR) AS n_products,
    CAST({N_PARTS} AS VARCHAR) AS n_specialties,
    CAST(month(strptime("Date", '%m/%d/%Y')) AS VARCHAR) AS month,
    CASE WHEN lower(comp.Country) = lower(phys.Country) THEN '1' ELSE '0' END AS same_country
    FROM pay LEFT JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID)"""
LONG = (
    "alllong AS ("
    + " UNION ALL ".join(
        f"SELECT Record_ID, '{f}' AS feature, {f} AS value FROM base" for f in BAYES_FEATURES
    )
    + """), levels AS (SELECT DISTINCT feature, value FROM alllong WHERE value IS NOT NULL
    UNION SELECT 'amount_bin', CAST(b AS VARCHAR) FROM range(1, 13) r(b)),
    nlev AS (SELECT feature, count(*) AS n_levels FROM levels GROUP BY 1),
    complete AS (SELECT * FROM base WHERE class IS NOT NULL AND """
    + " AND ".join(f"{f} IS NOT NULL" for f in BAYES_FEATURES)
    + """), long AS (SELECT c.Record_ID, c.Physician_ID, c.split_set, c.class, l.feature,
    l.value FROM complete c JOIN alllong l ON c.Record_ID = l.Record_ID)"""
)
PARAMS = (
    BASE
    + ", "
    + LONG
    + """, cls AS (SELECT class, count(*) AS n FROM complete WHERE split_set = 'train'
    GROUP BY 1), counts AS (SELECT class, feature, value, count(*) AS n FROM long
    WHERE split_set = 'train' GROUP BY 1, 2, 3),
    params AS (SELECT l.feature, l.value, cls.class, coalesce(c.n, 0) AS n,
    cls.n AS n_class, n_levels, (coalesce(c.n, 0) + 1.0) / (cls.n + n_levels) AS p
    FROM levels l CROSS JOIN cls JOIN nlev ON l.feature = nlev.feature
    LEFT JOIN counts c ON c.class = cls.class AND c.feature = l.feature AND c.value = l.value)"""
)
POSTERIOR = """, post AS (SELECT l.Record_ID, l.Physician_ID, p.class,
    sum(ln(CAST(p.p AS DOUBLE))) + max(ln(CAST(pr.prior AS DOUBLE))) AS lp
    FROM long l JOIN params p ON l.feature = p.feature AND l.value = p.value
    JOIN (SELECT class, (n + {s}) / (CAST((SELECT sum(n) FROM cls) AS DOUBLE) + 2 * {s})
    AS prior FROM cls) pr ON pr.class = p.class WHERE l.split_set = 'test' GROUP BY 1, 2, 3),
    scored AS (SELECT Record_ID, Physician_ID, max(CASE WHEN class = 0 THEN lp END) AS log_0,
    max(CASE WHEN class = 1 THEN lp END) AS log_1 FROM post GROUP BY 1, 2)"""


def rows_of(t):
    return bayes_rows(t.phys, t.pay, t.comp)


@query(
    """SELECT feature, value, class, n, n_class, n_levels, round(CAST(p AS DOUBLE), 9) AS p
    FROM params""",
    PARAMS,
)
def nb_fit(t):
    model = jobs.fit_bayes(rows_of(t), prior_smooth=0.0)
    p = F.round("p", 9).alias("p")
    return model.conditionals().select("feature", "value", "class", "n", "n_class", "n_levels", p)


@query(
    """SELECT class, n, round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM cls), 9) AS prior,
    round((CAST(n AS DOUBLE) + 1) / ((SELECT sum(n) FROM cls) + 2), 9) AS prior_smoothed
    FROM cls""",
    PARAMS,
)
def nb_priors(t):
    """Class priors without and with smoothing."""
    train = rows_of(t).filter(F.col("complete") & (F.col("split_set") == "train"))
    counts = materialize(bayes.count_levels(train, "label", ["form"]), "counts")
    plain = bayes.fit_counts(counts, ["form"]).priors()
    smoothed = bayes.fit_counts(counts, ["form"], prior_smooth=1.0).priors()
    return plain.join(
        smoothed.select("class", F.round("prior", 9).alias("prior_smoothed")), "class"
    ).select("class", "n", F.round("prior", 9).alias("prior"), "prior_smoothed")


@query(
    f"""SELECT class, feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM
    (SELECT class, feature, x FROM (SELECT CASE Ownership_Indicator WHEN 'Yes' THEN 1
    WHEN 'No' THEN 0 END AS class, CAST({AMOUNT} AS DOUBLE) AS amount,
    CAST(Number_of_Payments AS DOUBLE) AS n_payments FROM pay
    JOIN phys ON Physician_ID = phys.id WHERE split_set = 'train')
    UNPIVOT (x FOR feature IN (amount, n_payments)) WHERE class IS NOT NULL) GROUP BY 1, 2"""
)
def nb_gaussian_params(t):
    train = t.phys.filter(F.col("split_set") == "train").select(F.col("id").alias(ID))
    rows = join_skewed(t.pay, train, ID, RECORD, "left_semi").select(
        yes_no(F.col(LABEL)).alias("label"),
        F.col(AMOUNT).alias("amount"),
        F.col("Number_of_Payments").alias("n_payments"),
    )
    found = bayes.gaussian(rows.filter("label IS NOT NULL"), "label", ["amount", "n_payments"])
    return found.select(
        "class", "feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")
    )


@query(
    """SELECT Record_ID, round(log_0, 6) AS log_0, round(log_1, 6) AS log_1,
    CASE WHEN log_1 > log_0 THEN 1 ELSE 0 END AS prediction FROM scored""",
    PARAMS + POSTERIOR.format(s="0.0"),
)
def nb_predict(t):
    rows = rows_of(t)
    scored = jobs.score_bayes(rows, jobs.fit_bayes(rows, prior_smooth=0.0))
    return scored.select(
        RECORD, F.round("log_0", 6).alias("log_0"), F.round("log_1", 6).alias("log_1"), "prediction"
    )


FOLDED = (
    BASE
    + ", "
    + LONG
    + f""", f AS (SELECT *, CAST({sql_bucket(5, 'Record_ID')} % 10 + 1 AS INTEGER) AS fold
    FROM long WHERE split_set = 'train'), fr AS (SELECT DISTINCT Record_ID, class, fold FROM f),
    cls AS (SELECT k.fold, fr.class, count(*) AS n FROM fr, range(1, 11) k(fold)
    WHERE fr.fold <> k.fold GROUP BY 1, 2),
    counts AS (SELECT k.fold, class, feature, value, count(*) AS n FROM f, range(1, 11) k(fold)
    WHERE f.fold <> k.fold GROUP BY 1, 2, 3, 4),
    params AS (SELECT cls.fold, l.feature, l.value, cls.class,
    ln((coalesce(c.n, 0) + CAST(1 AS DOUBLE)) / (cls.n + n_levels)) AS lp
    FROM levels l CROSS JOIN cls JOIN nlev ON l.feature = nlev.feature LEFT JOIN counts c
    ON c.fold = cls.fold AND c.class = cls.class AND c.feature = l.feature
    AND c.value = l.value),
    pri AS (SELECT fold, class, ln((n + CAST(1 AS DOUBLE))
    / (sum(n) OVER (PARTITION BY fold) + 2)) AS lp FROM cls),
    post AS (SELECT f.Record_ID, f.fold, f.class AS truth, p.class, sum(p.lp) + max(pri.lp) AS lp
    FROM f JOIN params p ON f.fold = p.fold AND f.feature = p.feature AND f.value = p.value
    JOIN pri ON pri.fold = f.fold AND pri.class = p.class GROUP BY 1, 2, 3, 4),
    scored AS (SELECT Record_ID, fold, truth, max(CASE WHEN class = 1 THEN lp END)
    > max(CASE WHEN class = 0 THEN lp END) AS yes FROM post GROUP BY 1, 2, 3)"""
)


@query(
    """SELECT fold, round(avg(CASE WHEN yes = (truth = 1) THEN 1.0 ELSE 0.0 END), 6)
    AS accuracy, count(*) AS n FROM scored GROUP BY 1""",
    FOLDED,
)
def nb_cv_accuracy(t):
    found = jobs.bayes_cv_accuracy(t.phys, t.pay, t.comp, hash_fold(5, RECORD, 10), 10)
    return found.select("fold", F.round("accuracy", 6).alias("accuracy"), "n")


@query(
    """SELECT Physician_ID AS id, max(CASE WHEN log_1 > log_0 THEN 1 ELSE 0 END) AS prediction
    FROM scored GROUP BY 1""",
    PARAMS + POSTERIOR.format(s="1.0"),
)
def end_to_end_nb(t):
    return jobs.bayes_job(t.phys, t.pay, t.comp)


# --- trees -----------------------------------------------------------------------------


@query()
def gbt_fit(t):
    """Importance of every feature of boosted trees over recipients."""
    table = jobs.recipient_table(t.phys, t.pay)
    fit = boosting.fit_continued(table.train, trees.RECIPIENT_RUNS[0], trees.PATIENCE)
    return trees.importances(fit.model, table.dictionary)


@query(
    """SELECT p.id, label, CASE WHEN label = 1 THEN
    round((SELECT count(CASE WHEN label = 0 THEN 1 END) * CAST(1 AS DOUBLE)
    / count(CASE WHEN label = 1 THEN 1 END) FROM lab), 6) ELSE 1.0 END AS weight
    FROM lab p""",
    """lab AS (SELECT Physician_ID AS id, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1
    ELSE 0 END) AS label FROM pay JOIN phys ON Physician_ID = phys.id
    WHERE split_set = 'train' GROUP BY 1)""",
)
def class_weight_column(t):
    """Weights of training recipients, by the ratio of their classes."""
    train = t.phys.filter(F.col("split_set") == "train").select("id")
    scores = stock_scores(t.pay).select(F.col(ID).alias("id"), F.col("truth").alias("label"))
    rows = scores.join(train, "id", "left_semi")
    return rows.withColumn("weight", F.round(trees.class_weight(rows, None), 6))


@query()
def early_stopping(t):
    """Rounds allowed, tried and used by a fit that stops on its training loss, with its predictions.

    The loss is that of the training recipients, each counting once; boosting ends after 5 rounds
    without a lower one, and the trees up to the best round predict.
    """
    table = jobs.recipient_table(t.phys, t.pay)
    setting = trees.RECIPIENT_RUNS[0]
    stopped = boosting.fit_continued(table.train, setting, trees.PATIENCE)
    scored = trees.score(stopped.model, table.test)
    return scored.groupBy("prediction").agg(
        F.count("*").alias("n"),
        F.lit(setting.rounds).alias("rounds_allowed"),
        F.lit(len(stopped.losses)).alias("rounds_tried"),
        F.lit(stopped.rounds).alias("rounds_used"),
    )


@query()
def score_probability(t):
    table = jobs.recipient_table(t.phys, t.pay, unseen="drop")
    setting = trees.RECIPIENT_RUNS[0]
    model = jobs.fit_stopped(table.train, setting)
    return trees.score(model, table.test, setting.threshold).select("id", "score", "prediction")


@query()
def tree_fit(t):
    """Importance of every feature of a single tree over recipients."""
    table = jobs.recipient_table(t.phys, t.pay, summary=True)
    return trees.importances(trees.fit_tree(table.train, weight=None), table.dictionary)


@query(
    """SELECT feature, round(sum(CAST((n - e) * (n - e) / e AS DOUBLE)), 6) AS chi2,
    (count(DISTINCT value) - 1) * (count(DISTINCT class) - 1) AS df FROM
    (SELECT g.feature, g.value, g.class, coalesce(c.n, 0) AS n,
    CAST(r.n AS DOUBLE) * k.n / (SELECT count(*) FROM complete) AS e FROM
    (SELECT DISTINCT feature, value, kk.class FROM long, (SELECT DISTINCT class FROM complete)
    kk) g JOIN (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2) r
    ON r.feature = g.feature AND r.value = g.value
    JOIN (SELECT class, count(*) AS n FROM complete GROUP BY 1) k ON k.class = g.class
    LEFT JOIN (SELECT feature, value, class, count(*) AS n FROM long GROUP BY 1, 2, 3) c
    ON c.feature = g.feature AND c.value = g.value AND c.class = g.class) GROUP BY 1""",
    BASE + ", " + LONG.replace("base WHERE class", "base WHERE split_set = 'train' AND class"),
)
def association_chi2(t):
    complete = rows_of(t).filter("complete AND split_set = 'train'")
    return chi_square(complete, "label", BAYES_FEATURES).withColumn("chi2", F.round("chi2", 6))


INDICATORS = """lab AS (SELECT Physician_ID AS id, max(CASE WHEN Ownership_Indicator = 'Yes'
    THEN 1 ELSE 0 END) AS y FROM pay JOIN phys ON Physician_ID = phys.id
    WHERE split_set = 'train' GROUP BY 1), owned AS (
    SELECT DISTINCT id, concat('LICENSE_ ', v) AS feature FROM (""" + " UNION ALL ".join(
    f"SELECT id, {c} AS v FROM phys" for c in LICENSES
) + """) WHERE v IS NOT NULL UNION SELECT DISTINCT id, concat('SPEC_ ', v) FROM (""" + (
    " UNION ALL ".join(
        f"SELECT id, nullif(split_part(Primary_Specialty, '|', {i}), '') AS v FROM phys"
        for i in (1, 2, 3)
    )
) + """) WHERE v IS NOT NULL), cells AS (SELECT feature,
    CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS a,
    CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS b,
    (SELECT CAST(count(*) AS DOUBLE) FROM lab WHERE y = 1) AS p,
    (SELECT CAST(count(*) AS DOUBLE) FROM lab WHERE y = 0) AS q
    FROM owned JOIN lab ON owned.id = lab.id GROUP BY 1)"""


@query(
    """SELECT feature, round((p + q) * (a * (q - b) - b * (p - a)) * (a * (q - b) - b * (p - a))
    / ((a + b) * (p + q - a - b) * p * q), 6) AS statistic, CAST(1 AS INTEGER) AS df
    FROM cells""",
    INDICATORS,
)
def association_indicators(t):
    """Chi-square of license and specialty indicators of recipients."""
    found = jobs.indicator_p_values(t.phys, t.pay)
    return found.select("feature", F.round("statistic", 6).alias("statistic"), "df")


@query()
def association_indicator_p_values(t):
    found = jobs.indicator_p_values(t.phys, t.pay)
    return found.select("feature", F.round("pValue", 9).alias("p_value"))


@query()
def tree_predict_rollup(t):
    """A single tree over payments, rolled up to recipients."""
    table = jobs.transaction_table(t.phys, t.pay, t.comp)
    model = trees.fit_tree(table.train, weight=None)
    scored = trees.score(model, table.test).withColumn("truth", F.col("label"))
    return roll_up(scored, "id")


def _pct(part: str, breaks) -> str:
    return cut_sql(f"round(CAST({part} AS DOUBLE) / nullif(CAST(t AS DOUBLE), 0) * 100, 6)", breaks)


SHARE_ROWS = f"""cells AS (SELECT Physician_ID, Company_ID, {NATURE} AS nature, {FORM} AS form,
    {LABEL} AS label, sum({AMOUNT}) AS s FROM pay GROUP BY 1, 2, 3, 4, 5),
    sums AS (SELECT *, sum(s) OVER (PARTITION BY Physician_ID) AS t,
    sum(s) OVER (PARTITION BY Physician_ID, Company_ID, nature) AS by_nature,
    sum(s) OVER (PARTITION BY Physician_ID, form) AS by_form,
    sum(s) OVER (PARTITION BY Physician_ID, Company_ID) AS by_company FROM cells),
    lic AS (SELECT id, v AS licensed_in FROM ({" UNION ALL ".join(
        f"SELECT id, {c} AS v FROM phys" for c in LICENSES)}) WHERE v IS NOT NULL),
    spec AS (SELECT id, v AS specialty FROM ({" UNION ALL ".join(
        f"SELECT id, split_part(Primary_Specialty, '|', {i}) AS v FROM phys" for i in (1, 2, 3))})
    WHERE v <> ''),
    shares AS (SELECT p.id, split_set, CASE label WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label,
    s.Company_ID, CAST({_filled(LICENSES)} AS INTEGER) AS n_licenses,
    CAST(length(Primary_Specialty) - length(replace(Primary_Specialty, '|', '')) + 1 AS INTEGER)
    AS n_specialties, licensed_in, specialty, {cut_sql("t", TOTAL_BREAKS_FINE)} AS total_bin,
    {_pct("by_company", PERCENT_BREAKS_FINE)} AS company_bin, nature,
    {_pct("by_nature", PERCENT_BREAKS_FINE)} AS nature_bin, form,
    {_pct("by_form", PERCENT_BREAKS_FORM)} AS form_bin,
    comp.State AS company_state, comp.Country AS company_country
    FROM sums s JOIN phys p ON s.Physician_ID = p.id JOIN lic ON lic.id = p.id
    JOIN spec ON spec.id = p.id LEFT JOIN comp ON s.Company_ID = comp.Company_ID)"""


@query("SELECT * FROM shares", SHARE_ROWS)
def binned_share_rows(t):
    """The rows of the single tree: binned shares with the attributes of recipient and company."""
    return binned_shares.share_rows(t.phys, t.pay, t.comp)


def _share_sides(t):
    """Binned share rows of training and of held-out recipients."""
    rows = binned_shares.share_rows(t.phys, t.pay, t.comp).filter("split_set = 'train'")
    rows = materialize(rows.withColumn("role", role(4, "id", 0.2)), "share_rows")
    return rows.filter("role = 'train'"), rows.filter("role = 'test'")


ROOT_LEVELS = (
    SHARE_ROWS
    + f""", fitted AS (SELECT * FROM shares WHERE split_set = 'train' AND label IS NOT NULL
    AND NOT ({sql_below(4, 'id', 0.2)})), lev AS ("""
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, "
        f"{f'CAST({f} AS DOUBLE)' if f in binned_shares.ORDERED else 'NULL'} AS x, "
        f"CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS a FROM fitted "
        f"WHERE {f} IS NOT NULL GROUP BY {f}"
        for f in binned_shares.FEATURES
    )
    + """), run AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS big_n,
    sum(a) OVER (PARTITION BY feature) AS big_a, sum(n * x) OVER (PARTITION BY feature)
    / sum(n) OVER (PARTITION BY feature) AS mx, sum(n) OVER w AS nl, sum(a) OVER w AS al
    FROM lev WINDOW w AS (PARTITION BY feature ORDER BY coalesce(x, a / n), level)),
    two AS (SELECT feature, nl, CASE WHEN nl >= 7 AND big_n - nl >= 7 THEN
    round((big_n - 1) * (al * (big_n - nl - big_a + al) - (nl - al) * (big_a - al))
    * (al * (big_n - nl - big_a + al) - (nl - al) * (big_a - al))
    / (nl * (big_n - nl) * big_a * (big_n - big_a)), 9) END AS division FROM run),
    top AS (SELECT feature, division, nl, row_number() OVER (PARTITION BY feature
    ORDER BY division DESC, nl) AS i FROM two WHERE division IS NOT NULL)"""
)


@query(
    """SELECT r.feature, round(r.chi2, 6) AS chi2, r.df, round(top.division, 6) AS division,
    CAST(top.nl AS BIGINT) AS n_left FROM (SELECT feature, CASE WHEN count(x) = 0 THEN
    (max(big_n) - 1) / max(big_n) * (sum((a - n * big_a / big_n) * (a - n * big_a / big_n)
    / (n * big_a / big_n)) + sum((a - n * big_a / big_n) * (a - n * big_a / big_n)
    / (n * (big_n - big_a) / big_n))) ELSE (max(big_n) - 1) * pow(sum((a - n * big_a / big_n)
    * (x - mx)), 2) / (sum(n * (x - mx) * (x - mx)) * max(big_a * (big_n - big_a) / big_n)) END
    AS chi2, CAST(CASE WHEN count(x) = 0 THEN count(*) - 1 ELSE 1 END AS INTEGER) AS df FROM run
    WHERE big_a > 0 AND big_a < big_n GROUP BY feature HAVING count(*) > 1) r
    LEFT JOIN top ON top.feature = r.feature AND i = 1""",
    ROOT_LEVELS,
)
def tree_root_tests(t):
    """Association of every feature at the root of the tree, and its best division in two sets."""
    train, _ = _share_sides(t)
    cells = association_tree.collapse(train, "label", binned_shares.FEATURES)
    graded = association_tree.graded_levels(
        cells.withColumn("node", F.lit(0)), binned_shares.FEATURES, binned_shares.ORDERED
    )
    return association_tree.split_tests(graded).select(
        "feature", F.round("chi2", 6).alias("chi2"), "df",
        F.round("division", 6).alias("division"), "n_left",
    )


def _share_tree(train):
    return association_tree.fit(train, "label", binned_shares.FEATURES, binned_shares.ORDERED)


@query()
def tree_fit_association(t):
    """Nodes of a tree on binned shares, divided by tests of association."""
    train, _ = _share_sides(t)
    return _share_tree(train).table(t.spark)


@query()
def tree_predict_binned_shares(t):
    """That tree on held-out recipients, any of its row predictions per recipient."""
    train, test = _share_sides(t)
    scored = _share_tree(train).score(test, ["id", *binned_shares.FEATURES])
    return roll_up(scored.withColumn("truth", F.col("label")), "id")


FOLD_SUMS = f"""known AS (SELECT pay.*, phys.State, nullif(split_part(Primary_Specialty, '|', 1), '')
    AS Specialty1, {_filled(LICENSES)} AS n_licenses, comp.State AS Company_State FROM pay
    JOIN phys ON pay.Physician_ID = phys.id LEFT JOIN comp ON pay.Company_ID = comp.Company_ID
    WHERE split_set = 'train'),
    folds AS (SELECT id, {FOLD.format(k=attribute_counts.FOLDS)} AS fold FROM (SELECT id,
    row_number() OVER (ORDER BY md5('{attribute_counts.SEED}:' || CAST(id AS VARCHAR)), id) AS i,
    count(*) OVER () AS n FROM (SELECT DISTINCT Physician_ID AS id FROM known))),
    fold_sums AS (SELECT c.Company_ID, f.fold,
    CAST(count(CASE WHEN g.fold = f.fold AND {LABEL} = 'Yes' THEN 1 END) AS BIGINT) AS in_fold,
    CAST(count(CASE WHEN g.fold <> f.fold AND {LABEL} = 'Yes' THEN 1 END) AS BIGINT) AS out_of_fold
    FROM known c JOIN folds g ON c.Physician_ID = g.id,
    (SELECT CAST(unnest(range(1, {attribute_counts.FOLDS + 1})) AS INTEGER) AS fold) f
    WHERE c.Company_ID IS NOT NULL GROUP BY 1, 2),
    fold_levels AS (SELECT *, CASE WHEN out_of_fold > 0 THEN CAST(Company_ID AS VARCHAR)
    ELSE '{attribute_counts.OTHER}' END AS level FROM fold_sums)"""


def _count_tables(t):
    return attribute_counts.count_tables(t.phys, t.pay, t.comp)


@query("SELECT * FROM fold_levels", FOLD_SUMS)
def lump_companies_by_fold(t):
    """Label sums of companies inside and outside every fold, and their level in it."""
    return _count_tables(t).sums


def _attribute_sql(prefix: str, column: str) -> str:
    return (
        f"SELECT Physician_ID AS id, concat('{prefix} ', coalesce(CAST({column} AS VARCHAR), "
        f"'{attribute_counts.OTHER}')) AS feature, CAST(count(*) AS DOUBLE) AS value "
        "FROM known LEFT JOIN fold_levels l ON known.Company_ID = l.Company_ID AND l.fold = 1 "
        "GROUP BY 1, 2"
    )


@query(
    " UNION ALL ".join(
        _attribute_sql(p, c)
        for p, c in {
            **attribute_counts.PAYMENT_ATTRIBUTES,
            "COMPSTATE_": "Company_State",
            "SPEC_": "Specialty1",
            "STATE_": "State",
            "COMP_": "level",
        }.items()
    )
    + f""" UNION ALL SELECT Physician_ID, 'AMOUNT', CAST(coalesce(sum({AMOUNT}), 0) AS DOUBLE)
    FROM known GROUP BY 1 UNION ALL SELECT Physician_ID, 'COUNT', CAST(count(*) AS DOUBLE)
    FROM known GROUP BY 1 UNION ALL SELECT DISTINCT Physician_ID, 'N_LICENSES',
    CAST(n_licenses AS DOUBLE) FROM known""",
    FOLD_SUMS,
)
def attribute_count_features(t):
    """Attribute counts of recipients, companies lumped as the training side of fold 1 says."""
    return _count_tables(t).features(1)


@query()
def attribute_count_holdout(t):
    """Boosted trees on attribute counts: scores of the held-out sixth of the recipients.

    The rounds are those of the grouped holdout; the 1500 of the slow setting take too long.
    """
    train, test = _count_tables(t).sides(1)
    setting = trees.GROUP_HOLDOUT
    fit = boosting.fit_continued(train, setting, trees.PATIENCE)
    scored = trees.score(fit.model, test.withColumnRenamed("label", "truth"), setting.threshold)
    return scored.select("id", "truth", "score", "prediction")


HOLDOUTS = 5
#: Share held out and key of either kind of holdout.
ROW_SHARE, GROUP_SHARE = 0.25, 0.2


def _roles_sql(kind: str, key: str, share: float) -> str:
    below = sql_below("X", key, share).replace("X:", "' || CAST(run AS VARCHAR) || ':")
    return f"""SELECT '{kind}' AS kind, run, CASE WHEN {below} THEN 'test' ELSE 'train' END AS role,
    CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN y = 1 THEN 1 END) AS BIGINT) AS n_yes
    FROM rows_known, (SELECT CAST(unnest(range(1, {HOLDOUTS + 1})) AS INTEGER) AS run) r
    GROUP BY 1, 2, 3"""


@query(
    f"{_roles_sql('rows', 'Record_ID', ROW_SHARE)} UNION ALL "
    f"{_roles_sql('groups', 'id', GROUP_SHARE)}",
    f"""rows_known AS (SELECT Record_ID, id, CASE {LABEL} WHEN 'Yes' THEN 1 ELSE 0 END AS y
    FROM pay JOIN phys ON Physician_ID = phys.id
    WHERE split_set = 'train' AND {LABEL} IN ('Yes', 'No'))""",
)
def holdout_model_roles(t):
    """Payments on either side of every holdout that fits a model, and those of label 1."""
    train = t.phys.filter(F.col("split_set") == "train").select(F.col("id").alias(ID))
    known = join_skewed(t.pay, train, ID, RECORD, "left_semi")
    known = known.select(RECORD, F.col(ID).alias("id"), yes_no(F.col(LABEL)).alias("label"))
    known = known.filter(F.col("label").isNotNull())

    def counted(kind, key, share):
        roles = repeated_roles(known, key, HOLDOUTS, share, keep=["label"])
        sides = roles.groupBy(F.lit(kind).alias("kind"), "run", "role")
        return sides.agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("n_yes"))

    return counted("rows", RECORD, ROW_SHARE).unionByName(counted("groups", "id", GROUP_SHARE))


@query()
def holdout_row_models(t):
    """Five random holdouts of a quarter of the payments, 90 rounds of boosting fitted for each."""
    train = jobs.transaction_table(t.phys, t.pay, t.comp).train
    return jobs.repeated_holdouts(train, trees.MANY_ROUNDS, RECORD, HOLDOUTS, ROW_SHARE, rolled=False)


@query()
def holdout_group_models(t):
    """Five random holdouts of a fifth of the recipients, 30 rounds of boosting fitted for each."""
    train = jobs.transaction_table(t.phys, t.pay, t.comp).train
    return jobs.repeated_holdouts(train, trees.GROUP_HOLDOUT, "id", HOLDOUTS, GROUP_SHARE, rolled=True)


# --- evaluation ------------------------------------------------------------------------

CONFUSION = """conf AS (SELECT count(CASE WHEN truth = 1 AND p = 1 THEN 1 END) AS tp,
    count(CASE WHEN truth = 0 AND p = 1 THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND p = 0 THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND p = 0 THEN 1 END) AS tn FROM
    (SELECT Physician_ID, max(CASE WHEN Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%'
    THEN 1 ELSE 0 END) AS p, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1 ELSE 0 END)
    AS truth FROM pay GROUP BY 1))"""


def _rounded(metrics, *keep):
    names = ("sensitivity", "specificity", "bac")
    return metrics.select(
        *keep, "tp", "fp", "fn", "tn", *[F.round(n, 6).alias(n) for n in names]
    )


@query(
    """SELECT tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity,
    round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
    round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0))
    / 2, 6) AS bac FROM conf""",
    CONFUSION,
)
def eval_confusion_bac(t):
    return _rounded(evaluate(roll_up(row_predictions(t.pay), ID)))


@query(
    """SELECT Company_ID, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6)
    AS sensitivity, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
    round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0))
    / 2, 6) AS bac FROM (SELECT Company_ID,
    count(CASE WHEN truth = 1 AND p = 1 THEN 1 END) AS tp,
    count(CASE WHEN truth = 0 AND p = 1 THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND p = 0 THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND p = 0 THEN 1 END) AS tn FROM (SELECT Company_ID, CASE WHEN
    Form_of_Payment_or_Transfer_of_Value LIKE 'Stock%' THEN 1 ELSE 0 END AS p, CASE WHEN
    Ownership_Indicator = 'Yes' AND Related_Product_Indicator = 'No' THEN 1 ELSE 0 END AS truth
    FROM pay) GROUP BY 1)"""
)
def eval_guard_degenerate(t):
    """Metrics per company where some companies lack a class: undefined, not an error."""
    rare = (F.col(LABEL) == "Yes") & (F.col("Related_Product_Indicator") == "No")
    rows = row_predictions(t.pay).withColumn("truth", rare.cast("int"))
    return _rounded(evaluate(rows, "Company_ID"), "Company_ID")


@query(
    """SELECT round((tp + tn) * CAST(1 AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy
    FROM conf""",
    CONFUSION,
)
def eval_accuracy(t):
    hit = (F.col("prediction") == F.col("truth")).cast("double")
    rolled = roll_up(row_predictions(t.pay), ID)
    return rolled.agg(F.round(F.avg(hit), 6).alias("accuracy"))


CUTS = [0.0, 0.01, 0.02, 0.023, 0.05, 0.1, 0.2, 0.5, 0.6]
SWEEP = (
    SCORES
    + """, swept AS (SELECT threshold, count(CASE WHEN truth = 1 AND score > threshold THEN 1
    END) AS tp, count(CASE WHEN truth = 0 AND score > threshold THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND score <= threshold THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND score <= threshold THEN 1 END) AS tn
    FROM scores, (VALUES """
    + ", ".join(f"(CAST({c} AS DOUBLE))" for c in CUTS)
    + ") AS c(threshold) GROUP BY 1)"
)


@query(
    """SELECT threshold, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6)
    AS sensitivity, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
    round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0))
    / 2, 6) AS bac FROM swept""",
    SWEEP,
)
def threshold_sweep(t):
    return _rounded(sweep(stock_scores(t.pay), CUTS), "threshold")


@query(
    """SELECT round(avg((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE)
    / nullif(tn + fp, 0)) / 2), 6) AS mean_bac, count(*) AS runs FROM swept""",
    SWEEP,
)
def eval_mean_over_runs(t):
    swept = sweep(stock_scores(t.pay), CUTS)
    return swept.agg(F.round(F.avg("bac"), 6).alias("mean_bac"), F.count("*").alias("runs"))


IN_HOLDOUT = sql_below(13, "Physician_ID", 0.25)
DENSITY = """ln(CASE WHEN {d} > 0 THEN {d} ELSE 0.001 END)"""
NORMAL = "exp(({x} - {m}) * ({x} - {m}) / ({s} * {s}) / -2) / ({s} * sqrt(2 * pi()))"


def _density(i: int) -> str:
    return DENSITY.format(d=NORMAL.format(x=f"x.x{i}", m=f"g.m{i}", s=f"g.s{i}"))


HELD_OUT = (
    PARAMS.replace("split_set = 'train'", f"split_set = 'train' AND NOT ({IN_HOLDOUT})")
    + f""", xs AS (SELECT c.Record_ID, c.Physician_ID, c.split_set, c.class,
    CAST({AMOUNT} AS DOUBLE) AS x1, CAST(Number_of_Payments AS DOUBLE) AS x2
    FROM complete c JOIN pay ON pay.Record_ID = c.Record_ID),
    g AS (SELECT class, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2,
    coalesce(nullif(stddev_samp(x1), 0), 0.001) AS s1,
    coalesce(nullif(stddev_samp(x2), 0), 0.001) AS s2 FROM xs
    WHERE split_set = 'train' AND NOT ({IN_HOLDOUT}) GROUP BY 1),
    levelled AS (SELECT l.Record_ID, p.class, sum(ln(CAST(p.p AS DOUBLE))) AS lp FROM long l
    JOIN params p ON l.feature = p.feature AND l.value = p.value
    WHERE l.feature NOT IN ('amount_bin', 'payments_band') GROUP BY 1, 2),
    ranked AS (SELECT x.Record_ID, x.Physician_ID, x.class AS truth,
    arg_max(g.class, v.lp + ln(CAST(g.n AS DOUBLE) / (SELECT sum(n) FROM g))
    + {_density(1)} + {_density(2)}) AS p
    FROM xs x JOIN levelled v ON v.Record_ID = x.Record_ID JOIN g ON g.class = v.class
    WHERE x.split_set = 'train' AND {sql_below(13, "x.Physician_ID", 0.25)} GROUP BY 1, 2, 3),
    conf AS (SELECT count(CASE WHEN truth = 1 AND p = 1 THEN 1 END) AS tp,
    count(CASE WHEN truth = 0 AND p = 1 THEN 1 END) AS fp,
    count(CASE WHEN truth = 1 AND p = 0 THEN 1 END) AS fn,
    count(CASE WHEN truth = 0 AND p = 0 THEN 1 END) AS tn FROM (SELECT Physician_ID,
    max(p) AS p, max(truth) AS truth FROM ranked GROUP BY 1))"""
)


@query(
    """SELECT tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity,
    round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
    round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0))
    / 2, 6) AS bac FROM conf""",
    HELD_OUT,
)
def nb_numeric_holdout_bac(t):
    """Naive Bayes with numeric predictors, measured on held-out recipients."""
    return _rounded(jobs.bayes_numeric_holdout(t.phys, t.pay, t.comp, 13, 0.25))


# --- searches and end-to-end jobs ------------------------------------------------------


@query()
def param_search_per_fold(t):
    """Setting i tried on fold i only."""
    table = jobs.recipient_table(t.phys, t.pay)
    return jobs.cross_validate(table.train, trees.RECIPIENT_RUNS, 3, paired=True)


def param_grid_search(t):
    """Every setting on every fold with several cut-offs; mean BAC per combination.

    Not registered: its 24 fits of 1500 rounds take hours (see the README).
    """
    table = jobs.recipient_table(t.phys, t.pay)
    grid = [
        replace(trees.SLOW, eta=e, depth=d) for e in trees.GRID_ETA for d in trees.GRID_DEPTH
    ]
    found = jobs.cross_validate(
        table.train,
        grid,
        2,
        thresholds=trees.GRID_CUTS,
        patience=None,
        rounds=trees.GRID_ROUNDS,
    )
    return found.groupBy("rounds", "eta", "depth", "threshold").agg(
        F.avg("bac").alias("mean_bac"), F.count("*").alias("folds")
    )


@query()
def best_of_search(t):
    """The best fold and setting of a paired search."""
    table = jobs.recipient_table(t.phys, t.pay)
    found = jobs.cross_validate(table.train, trees.RECIPIENT_RUNS, 3, paired=True)
    return best_run(found, "fold", "eta", "subsample", "weight", "depth")


@query()
def end_to_end_flagship(t):
    """Recipient grain: features, alignment, paired search, refit, prediction."""
    return jobs.recipient_job(
        t.phys, t.pay, trees.RECIPIENT_RUNS, trees.RECIPIENT_FINAL_ROUNDS
    )


@query()
def end_to_end_transaction(t):
    """Transaction grain: multi-hot rows, paired search, refit, roll-up."""
    return jobs.transaction_job(
        t.phys, t.pay, t.comp, trees.TRANSACTION_RUNS, trees.TRANSACTION_FINAL_ROUNDS
    )
