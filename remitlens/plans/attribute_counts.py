"""Recipients described by how often each attribute occurs, companies lumped fold by fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.values import count_present, prefixed, yes_no
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import hash_folds
from remitlens.operators.reshape import feature_dictionary
from remitlens.plans.clean import named_companies, split_specialties
from remitlens.plans.features import vectors
from remitlens.schemas import AMOUNT, COMPANY, FORM, ID, LABEL, LICENSES
from remitlens.session import materialize

FOLDS = 6
SEED = 2021
OTHER = "Dummy"

# Attributes of the payment itself; those of recipient and company follow from their keys.
PAYMENT_ATTRIBUTES = {
    "FORM_": FORM,
    "THIRD_": "Third_Party_Recipient",
    "RELATED_": "Related_Product_Indicator",
    "TYPE_": "Product_Type_1",
}


def _named(prefix: str, level: Column) -> Column:
    return prefixed(prefix, F.coalesce(level.cast("string"), F.lit(OTHER)))


def by_company(pay: DataFrame) -> DataFrame:
    """Payments, amount and payments of label 1 per recipient and company."""
    return pay.groupBy(F.col(ID).alias("id"), COMPANY).agg(
        F.count("*").alias("n"),
        F.sum(AMOUNT).alias("amount"),
        F.count(F.when(yes_no(F.col(LABEL)) == 1, 1)).alias("positives"),
    )


def out_of_fold_sums(cells: DataFrame, folds: DataFrame, k: int = FOLDS) -> DataFrame:
    """Company, fold: label sums inside the fold and outside it, and the company's level there.

    One aggregate serves all folds, since a fold's outside is the total less its own. A company
    keeps its level in the folds whose training recipients carry the label; a fold's own labels
    never decide.
    """
    placed = cells.join(folds.select("id", "fold"), "id").filter(F.col(COMPANY).isNotNull())
    own = [F.sum(F.when(F.col("fold") == f, F.col("positives")).otherwise(0)) for f in range(1, k + 1)]
    sums = placed.groupBy(COMPANY).agg(F.array(*own).alias("_own"), F.sum("positives").alias("_all"))
    spread = sums.select(COMPANY, "_all", F.posexplode("_own").alias("_place", "in_fold"))
    outside = F.col("_all") - F.col("in_fold")
    level = F.when(outside > 0, F.col(COMPANY).cast("string")).otherwise(OTHER)
    return spread.select(
        COMPANY,
        (F.col("_place") + 1).alias("fold"),
        "in_fold",
        outside.alias("out_of_fold"),
        level.alias("level"),
    )


def fixed_counts(phys: DataFrame, pay: DataFrame, comp: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, feature, value) of everything that is the same in all folds.

    Payment attributes are counted in one pass. Those of a recipient count as often as it has
    payments, those of a company as often as it pays the recipient: no payment meets another table.
    """
    pairs = F.array(*[_named(p, F.col(c)) for p, c in PAYMENT_ATTRIBUTES.items()])
    counted = pay.select(F.col(ID).alias("id"), F.explode(pairs).alias("feature"))
    counted = counted.groupBy("id", "feature").agg(F.count("*").cast("double").alias("value"))

    states = named_companies(comp).select(COMPANY, F.col("Company_State").alias("_state"))
    paid = join_skewed(cells, states, COMPANY, "id")
    paid = paid.groupBy("id", _named("COMPSTATE_", F.col("_state")).alias("feature"))
    paid = paid.agg(F.sum("n").cast("double").alias("value"))

    people = split_specialties(phys).select(
        "id", "Specialty1", "State", count_present(LICENSES).alias("_licenses")
    )
    whole = cells.groupBy("id").agg(F.sum("n").alias("_n"), F.sum("amount").alias("_amount"))

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.cast("double").alias("value"))

    n = F.col("_n")
    entries = F.array(
        entry(F.lit("AMOUNT"), F.coalesce("_amount", F.lit(0))),
        entry(F.lit("COUNT"), n),
        entry(F.lit("N_LICENSES"), F.col("_licenses")),
        entry(_named("SPEC_", F.col("Specialty1")), n),
        entry(_named("STATE_", F.col("State")), n),
    )
    own = whole.join(people, "id").select("id", F.inline(entries))
    return counted.unionByName(paid).unionByName(own)


def company_counts(cells: DataFrame, sums: DataFrame, fold: int) -> DataFrame:
    """(id, feature, value) of payments by company, lumped as that fold's training side says."""
    levels = sums.filter(F.col("fold") == fold).select(COMPANY, F.col("level").alias("_level"))
    joined = join_skewed(cells, levels, COMPANY, "id")
    named = joined.groupBy("id", _named("COMP_", F.col("_level")).alias("feature"))
    return named.agg(F.sum("n").cast("double").alias("value"))


@dataclass(frozen=True)
class CountTables:
    """Written parts of the job over training recipients of the given split."""

    cells: DataFrame
    folds: DataFrame
    sums: DataFrame
    fixed: DataFrame

    def features(self, fold: int) -> DataFrame:
        return self.fixed.unionByName(company_counts(self.cells, self.sums, fold))

    def sides(self, fold: int) -> tuple[DataFrame, DataFrame]:
        """Vectors (id, label, features) of the recipients outside the fold and inside it.

        The dictionary is that of the outside; a feature only the inside has is left out.
        """
        spine = self.cells.groupBy("id").agg(F.signum(F.sum("positives")).cast("int").alias("label"))
        spine = spine.join(self.folds, "id")
        long = self.features(fold)
        known = long.join(spine.filter(F.col("fold") != fold), "id", "left_semi")
        dictionary = feature_dictionary(known)
        rows = vectors(long, spine, dictionary, dictionary.count())
        return rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)


def count_tables(phys: DataFrame, pay: DataFrame, comp: DataFrame, k: int = FOLDS) -> CountTables:
    """The parts for the labelled recipients of the predefined training split."""
    known = phys.filter(F.col("split_set") == "train")
    ids = known.select(F.col("id").alias(ID))
    facts = join_skewed(pay, ids, ID, "Record_ID", "left_semi")
    cells = materialize(by_company(facts), "cells")
    folds = materialize(hash_folds(cells, "id", SEED, k).select("id", "fold"), "folds")
    sums = materialize(out_of_fold_sums(cells, folds, k), "fold_sums")
    fixed = materialize(fixed_counts(known, facts, comp, cells), "fixed")
    return CountTables(cells, folds, sums, fixed)
