"""End-to-end jobs: from the three inputs to one prediction per recipient."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.functions.bins import AMOUNT_BREAKS
from remitlens.functions.values import any_known, prefixed
from remitlens.models import bayes, trees
from remitlens.models.association import chi_square_p_values
from remitlens.models.evaluate import best_run, evaluate, roll_up, sweep
from remitlens.models.trees import BoostSettings
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import hash_folds
from remitlens.operators.reshape import compact_array, feature_dictionary
from remitlens.operators.splits import role
from remitlens.plans.clean import BAYES_FEATURES, bayes_rows, transactions_of_all
from remitlens.plans.features import attribute_blocks, labels, long_features, vectors
from remitlens.schemas import (
    AMOUNT,
    FORM,
    ID,
    LABEL,
    LICENSES,
    NATURE,
    PRODUCT_TYPES,
    RECORD,
    SPECIALTIES,
)
from remitlens.session import materialize

FITS_AT_ONCE = 4  # independent fits of a search whose jobs run side by side, at most
#: Memory that a fit keeps for a training row beside 4 bytes for each feature: objects, errors, draws.
ROW_BYTES = 220
CACHE_SHARE = 0.8  # of the executors' storage memory, for the rows of fits side by side
HELD_OUT = 0.2  # share of the training recipients on which boosting stops


# --- recipient grain -------------------------------------------------------------------


@dataclass(frozen=True)
class ModelTable:
    """Rows ready for a classifier: id, label, split_set, features; plus the dictionary."""

    rows: DataFrame
    dictionary: DataFrame | None = None

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split_set") == "train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("split_set") == "test")


def recipient_table(
    phys: DataFrame, pay: DataFrame, summary: bool = False, unseen: str = "keep"
) -> ModelTable:
    """One sparse vector per recipient with payments.

    ``unseen="keep"`` gives features found only among test recipients a column, which
    is zero in training; ``"drop"`` takes the dictionary from training alone.
    """
    long = materialize(long_features(phys, pay, summary), "features")
    sides = phys.select("id", "split_set")
    known = long
    if unseen == "drop":
        known = long.join(sides.filter(F.col("split_set") == "train"), "id", "left_semi")
    dictionary = feature_dictionary(known)
    spine = labels(pay).join(sides, "id")
    return ModelTable(vectors(long, spine, dictionary, dictionary.count()), dictionary)


def indicator_p_values(phys: DataFrame, pay: DataFrame) -> DataFrame:
    """Chi-square of license and specialty indicators of labelled training recipients."""
    train = phys.filter(F.col("split_set") == "train").select("id")
    known = labels(pay).filter(F.col("label").isNotNull()).join(train, "id", "left_semi")
    known = materialize(known, "known")
    long = materialize(attribute_blocks(phys).join(known, "id", "left_semi"), "indicators")
    dictionary = feature_dictionary(long)
    rows = vectors(long, known, dictionary, dictionary.count())
    return chi_square_p_values(rows, dictionary)


# --- transaction grain -----------------------------------------------------------------


def transaction_entries() -> Column:
    """``(feature, value)`` pairs of a joined payment row, formed inside the row.

    A category level counts as often as it fills a slot, and stands where its first slot does;
    amount and counts are numbers. Slots are compared column by column within their group, which is
    compiled code; a function over all tokens for each of them was most of the work on a payment.
    """

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.cast("double").alias("value"))

    def counted(prefix: str, columns: Sequence[str]) -> list[Column]:
        slots = [F.col(c).cast("string") for c in columns]
        found = []
        for i, level in enumerate(slots):
            same = [F.when(level == other, 1).otherwise(0) for other in slots[i + 1 :]]
            first = level.isNotNull()
            for earlier in slots[:i]:
                first = first & ~level.eqNullSafe(earlier)
            n = reduce(lambda x, y: x + y, same, F.lit(1))
            found.append(F.when(first, entry(prefixed(prefix, level), n)))
        return found

    numbers = [
        entry(F.lit("AMOUNT"), F.coalesce(F.col(AMOUNT).cast("double"), F.lit(0.0))),
        entry(F.lit("N_LICENSES"), F.col("Number_of_licenses")),
        entry(F.lit("N_PRODUCTS"), F.col("Number_of_related_products")),
    ]
    categories = [
        *counted("COUNTRY_", ["Company_Country"]),
        *counted("FORM_", [FORM]),
        *counted("NATURE_", [NATURE]),
        *counted("RELATED_", ["Related_Product_Indicator"]),
        *counted("TYPE_", PRODUCT_TYPES),
        *counted("SPEC_", SPECIALTIES),
        *counted("LICENSE_", LICENSES),
    ]
    return compact_array(numbers + categories)


def transaction_table(phys: DataFrame, pay: DataFrame, comp: DataFrame) -> ModelTable:
    """One sparse vector per payment; levels come from training and stay distributed.

    Recipients without payments keep one row. Levels found only in testing are left out.
    """
    joined = transactions_of_all(phys, pay, comp).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        RECORD,
        "split_set",
        F.col(LABEL).alias("label"),
        transaction_entries().alias("entries"),
    )
    rows = materialize(joined, "entries")  # pins the row numbers
    long = rows.select(F.col("row").alias("id"), "split_set", F.inline("entries"))
    dictionary = feature_dictionary(long.filter(F.col("split_set") == "train"))
    spine = rows.select(
        F.col("row").alias("id"), F.col("id").alias("recipient"), RECORD, "split_set", "label"
    )
    built = vectors(long.drop("split_set"), spine, dictionary, dictionary.count())
    named = built.drop("id").withColumnRenamed("recipient", "id")
    return ModelTable(named, dictionary)


# --- cross-validation ------------------------------------------------------------------


def fit_stopped(train: DataFrame, settings: BoostSettings, patience: int = trees.PATIENCE):
    """Boosting on all rows for as many rounds as held-out recipients ask for."""
    return trees.fit_patient(train, settings, role(11, "id", HELD_OUT) == "test", patience)


def cross_validate(
    train: DataFrame,
    settings: Sequence[BoostSettings],
    k: int,
    seed: int = 2021,
    paired: bool = False,
    thresholds: Sequence[float] | None = None,
    patience: int | None = trees.PATIENCE,
    rounds: Sequence[int] | None = None,
) -> DataFrame:
    """Metrics per fold, setting and cut-off, numbered in the order tried.

    ``paired`` tries setting i on fold i only; otherwise every setting meets every fold.
    ``thresholds`` replaces the cut-off of the settings; trying more costs no refit. Without
    ``patience`` all rounds are fitted; ``rounds`` then tries the first trees of that one fit too.
    A recipient is predicted 1 when any of its rows is, so its highest score decides.
    """
    folds = materialize(hash_folds(train, "id", seed, k).select("id", "fold"), "folds")
    spread = RECORD if RECORD in train.columns else "id"
    keyed = materialize(join_skewed(train, folds, "id", spread, "inner"), "folded")
    cuts_of = lambda used: [float(c) for c in (thresholds or [used.threshold])]
    fits, run = [], 0
    for fold in range(1, k + 1):
        chosen = [settings[(fold - 1) % len(settings)]] if paired else settings
        for setting in chosen:
            fits.append((fold, setting, run))
            run += len(cuts_of(setting)) * (len(rounds or [1]) if patience is None else 1)

    def fitted(fold: int, setting: BoostSettings, run: int) -> DataFrame:
        rest = keyed.filter(F.col("fold") != fold)
        if patience is None:
            longest = replace(setting, rounds=max(rounds or [setting.rounds]))
            whole = trees.fit_boosted(rest, longest)
            models = [
                (replace(setting, rounds=n), trees.first_trees(whole, n))
                for n in (rounds or [setting.rounds])
            ]
        else:
            models = [(setting, fit_stopped(rest, setting, patience))]
        found = []
        for used, model in models:
            held = trees.score(model, keyed.filter(F.col("fold") == fold))
            rolled = held.groupBy("id").agg(
                F.max("score").alias("score"), any_known(F.col("label")).alias("truth")
            )
            cuts = cuts_of(used)
            place = F.array_position(F.array(*map(F.lit, cuts)), F.col("threshold"))
            tried = {n: v for n, v in asdict(used).items() if n != "threshold"}
            row = sweep(rolled, cuts).select(
                (place + run).cast("int").alias("run"),
                F.lit(fold).alias("fold"),
                *[F.lit(v).alias(n) for n, v in tried.items()],
                "threshold",
                "tp",
                "fp",
                "fn",
                "tn",
                "bac",
            )
            run += len(cuts)
            # written fit by fold, so that no plan holds the models of all
            found.append(materialize(row, "run"))
        return reduce(DataFrame.unionByName, found)

    at_once = fits_at_once(keyed)
    found = side_by_side(train.sparkSession, fitted, fits, at_once)
    return materialize(reduce(DataFrame.unionByName, found), "metrics")


def repeated_holdouts(
    train: DataFrame, settings: BoostSettings, key: str, runs: int, share: float, rolled: bool
) -> DataFrame:
    """Metrics of ``runs`` random holdouts, each with a model fitted on the rows it leaves.

    In every run about ``share`` of the keys is held out, with all their rows. The roles follow from
    the digest of run and key, so that no run needs a copy of the table; see ``repeated_roles``.
    ``rolled`` counts recipients, predicted 1 when any of their held-out rows is, instead of rows.
    """
    known = train.filter(F.col("label").isNotNull())

    def one(run: int) -> DataFrame:
        held_out = role(run, key, share) == "test"
        model = trees.fit_boosted(known.filter(~held_out), settings)
        scored = trees.score(model, known.filter(held_out), settings.threshold)
        scored = scored.withColumn("truth", F.col("label"))
        metrics = evaluate(roll_up(scored, "id") if rolled else scored)
        row = metrics.select(F.lit(run).alias("run"), "tp", "fp", "fn", "tn", "bac")
        # written run by run, so that no plan holds the models of all
        return materialize(row, "run")

    calls = [(run,) for run in range(1, runs + 1)]
    found = side_by_side(train.sparkSession, one, calls, fits_at_once(known))
    return reduce(DataFrame.unionByName, found)


def storage_bytes(spark: SparkSession) -> int:
    """Memory for cached rows on all executors; on the driver where it runs the tasks itself."""
    context = spark.sparkContext._jsc.sc()
    driver = context.env().blockManager().blockManagerId().hostPort()
    limits, left = {}, context.getExecutorMemoryStatus().iterator()
    while left.hasNext():
        host = left.next()
        limits[host._1()] = int(host._2()._1())
    executors = [limit for place, limit in limits.items() if place != driver]
    return sum(executors) or limits.get(driver, 0)


def fits_at_once(rows: DataFrame) -> int:
    """Fits whose binned rows the executors can keep in memory side by side; one at least.

    A fit goes over its rows once for each level of each tree. Rows of more fits than fit would be
    driven out to disk by each other and read back level by level.
    """
    first = rows.select("features").first()
    if first is None:
        return FITS_AT_ONCE
    needed = rows.count() * (ROW_BYTES + 4 * first["features"].size)
    return max(1, min(FITS_AT_ONCE, int(CACHE_SHARE * storage_bytes(rows.sparkSession)) // needed))


def side_by_side(
    spark: SparkSession, work: Callable[..., DataFrame], calls: Sequence[tuple], at_once: int = FITS_AT_ONCE
) -> list[DataFrame]:
    """Results of independent calls in their order, ``at_once`` of them at a time.

    Their jobs share the cluster: one fit is a chain of small jobs, several fill the gaps.
    Where the session schedules fairly, each call is a pool of its own.
    """

    def run(call: tuple) -> DataFrame:
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", "_".join(map(str, call[::2])))
        try:
            return work(*call)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, calls))


def best_settings(metrics: DataFrame, base: BoostSettings) -> BoostSettings:
    """Settings of the best run; the first of equals."""
    names = list(asdict(base))
    row = best_run(metrics, *names).first()
    return replace(base, **{n: row[n] for n in names}) if row and row["run"] else base


def search_and_predict(
    table: ModelTable,
    settings: Sequence[BoostSettings],
    k: int = 3,
    final_rounds: int | None = None,
    paired: bool = True,
    patience: int = trees.PATIENCE,
) -> DataFrame:
    """Cross-validate, refit on all training rows with the best settings, predict the rest."""
    metrics = cross_validate(table.train, settings, k, paired=paired, patience=patience)
    best = best_settings(metrics, settings[0])
    if final_rounds:
        best = replace(best, rounds=final_rounds)
    model = fit_stopped(table.train, best, patience)
    scored = trees.score(model, table.test, best.threshold).withColumn("truth", F.col("label"))
    return roll_up(scored, "id").select("id", "prediction")


def recipient_job(
    phys: DataFrame, pay: DataFrame, settings: Sequence[BoostSettings], final_rounds: int
) -> DataFrame:
    return search_and_predict(recipient_table(phys, pay), settings, final_rounds=final_rounds)


def transaction_job(
    phys: DataFrame,
    pay: DataFrame,
    comp: DataFrame,
    settings: Sequence[BoostSettings],
    final_rounds: int,
) -> DataFrame:
    table = transaction_table(phys, pay, comp)
    return search_and_predict(
        table, settings, final_rounds=final_rounds, patience=trees.TRANSACTION_PATIENCE
    )


# --- Naive Bayes -----------------------------------------------------------------------


def bayes_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Level counts of all rows by completeness and side, in one pass over the payments.

    Every amount bin counts as a level, found in the data or not.
    """
    counts = bayes.count_levels(rows, "label", BAYES_FEATURES, "complete", "split_set", *by)
    bins = rows.sparkSession.range(1, len(AMOUNT_BREAKS)).select(
        F.lit("amount_bin").alias("feature"),
        F.col("id").cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return materialize(counts.unionByName(bins, allowMissingColumns=True), "level_counts")


def _usable(side: str) -> Column:
    """Null where the side is unknown, which filters and conditional counts leave out.

    Without a coalesce the filter reaches both inputs of the recipient join.
    """
    return F.col("complete") & (F.col("split_set") == side)


def fit_bayes(rows: DataFrame, prior_smooth: float = 1.0) -> bayes.NaiveBayes:
    """Model of the complete training payments; levels come from all payments."""
    counts = bayes_counts(rows)
    return bayes.fit_counts(
        counts, BAYES_FEATURES, _usable("train"), prior_smooth=prior_smooth
    )


def score_bayes(rows: DataFrame, model: bayes.NaiveBayes) -> DataFrame:
    """Complete test payments with their log posteriors and predictions."""
    return bayes.predict(rows.filter(_usable("test")), model)


def bayes_job(phys: DataFrame, pay: DataFrame, comp: DataFrame) -> DataFrame:
    """Fit on complete training payments, predict test payments, any per recipient."""
    rows = bayes_rows(phys, pay, comp)
    scored = score_bayes(rows, fit_bayes(rows))
    return scored.groupBy(F.col(ID).alias("id")).agg(F.max("prediction").alias("prediction"))


NUMERIC = ("amount", "n_payments")
CATEGORICAL = tuple(f for f in BAYES_FEATURES if f not in ("amount_bin", "payments_band"))


def bayes_numeric_holdout(
    phys: DataFrame, pay: DataFrame, comp: DataFrame, seed: int, test_share: float
) -> DataFrame:
    """Metrics per recipient of Naive Bayes with amount and count as normal predictors.

    A share of the training recipients is held out whole; the rest fit the model.
    """
    rows = bayes_rows(phys, pay, comp).withColumn("role", role(seed, ID, test_share))
    fitting = _usable("train") & (F.col("role") == "train")
    counts = bayes.count_levels(rows, "label", CATEGORICAL, "complete", "split_set", "role")
    model = bayes.fit_counts(materialize(counts, "level_counts"), CATEGORICAL, fitting)
    normal = bayes.gaussian(rows.filter(fitting), "label", NUMERIC)
    held = rows.filter(_usable("train") & (F.col("role") == "test"))
    scored = bayes.add_gaussian(bayes.predict(held, model), normal)
    return evaluate(roll_up(scored.withColumn("truth", F.col("label")), ID))


def bayes_cv_accuracy(
    phys: DataFrame, pay: DataFrame, comp: DataFrame, fold: Column, k: int
) -> DataFrame:
    """Accuracy per fold; ``fold`` is the fold expression over payment rows."""
    rows = bayes_rows(phys, pay, comp)
    folded = rows.withColumn("fold", F.when(_usable("train"), fold))
    model = bayes.fit_folds(
        bayes_counts(folded, "fold"), BAYES_FEATURES, "fold", k, _usable("train"), prior_smooth=1.0
    )
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return (
        bayes.predict(folded.filter(F.col("fold").isNotNull()), model)
        .groupBy("fold")
        .agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))
    )
