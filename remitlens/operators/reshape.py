"""Rows to columns and back, indicators, and the long feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import with_row_index
from remitlens.session import materialize


def unpivot_slots(
    df: DataFrame, ids: Sequence[str], prefix: str, slot: str, value: str
) -> DataFrame:
    """Numbered columns ``prefix1..n`` to one row per filled slot."""
    slots = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    long = df.unpivot(list(ids), slots, slot, value).filter(F.col(value).isNotNull())
    return long.withColumn(slot, F.substring(slot, len(prefix) + 1, 10).cast("int"))


def unpivot_groups(
    df: DataFrame, ids: Sequence[str], prefix: str, groups: Sequence[str], n: int, slot: str
) -> DataFrame:
    """Several numbered groups side by side: one row per slot with a column per group.

    A slot is kept when at least one of its groups is filled.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias(slot), *[F.col(f"{prefix}{g}_{i}").alias(g) for g in groups]
            )
            for i in range(1, n + 1)
        ]
    )
    return df.select(*ids, F.inline(rows)).filter(
        F.coalesce(*[F.col(g) for g in groups]).isNotNull()
    )


def compact_array(columns: Sequence[str | Column]) -> Column:
    """Filled values of a repeated group as an array."""
    return F.array_compact(F.array(*columns))


def slot_counts(columns: Sequence[str]) -> Column:
    """``(level, n)`` pairs of a repeated group, formed inside the row."""
    slots = compact_array(columns)

    def occurrences(level: Column) -> Column:
        return F.struct(
            level.alias("level"),
            F.size(F.filter(slots, lambda other: other == level)).alias("n"),
        )

    return F.transform(F.array_distinct(slots), occurrences)


def levels(df: DataFrame, columns: Sequence[str], name: str = "level") -> DataFrame:
    """Distinct non-null values shared by a repeated group of columns."""
    return (
        df.select(F.explode(F.array(*columns)).alias(name))
        .filter(F.col(name).isNotNull())
        .distinct()
    )


def pivot_values(
    long: DataFrame, key: str, feature: str, value: str, features: Sequence[str] | None = None
) -> DataFrame:
    """One column per feature, 0 where a key lacks it; a null feature only keeps its key.

    The features are those of the data unless listed. A table has so many columns only;
    Spark raises an error beyond ``spark.sql.pivotMaxValues``. The long form has no limit.
    """
    # marked, so that the column of the null feature is told from one called null
    marked = long.withColumn(feature, F.concat(F.lit("="), F.col(feature).cast("string")))
    listed = None if features is None else [f"={f}" for f in features]
    wide = marked.groupBy(key).pivot(feature, listed).agg(F.max(value))
    wide = wide if features is not None else wide.drop("null")
    found = {c: c[1:] for c in wide.columns if c != key}
    return wide.na.fill(0, subset=list(found)).withColumnsRenamed(found)


def one_hot(
    df: DataFrame, column: str, prefix: str, values: Sequence[str] | None = None
) -> DataFrame:
    """A 0/1 column per level of ``column``; the levels are those of the data unless listed.

    As with a pivot, more than ``spark.sql.pivotMaxValues`` levels are an error.
    """
    if values is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        values = sorted(r.level for r in levels(df, [column]).limit(limit + 1).collect())
        if len(values) > limit:
            raise ValueError(f"{column} has more than {limit} levels (spark.sql.pivotMaxValues)")
    return df.withColumns(
        {f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )


def feature_dictionary(*longs: DataFrame) -> DataFrame:
    """Distinct features of long tables with a 0-based index in name order."""
    names = longs[0].select("feature")
    for other in longs[1:]:
        names = names.unionByName(other.select("feature"))
    indexed = with_row_index(names.distinct(), "feature", name="idx")
    return materialize(indexed.withColumn("idx", (F.col("idx") - 1).cast("int")), "dictionary")


def index_features(long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Long features with their dictionary index; features outside it are dropped."""
    return join_skewed(long, dictionary, "feature", "id", "inner")


def assemble(
    spine: DataFrame, indexed: DataFrame, size: int, name: str = "features"
) -> DataFrame:
    """A written table of one sparse vector per id of ``spine``, empty where an id has no features.

    The vectors are written in their field layout and read back as vectors, so they never leave
    the JVM and keep every value as it is. Null values are left out, which makes them 0. A group
    holds at most one entry per dictionary row.
    """
    entry = F.struct("idx", F.col("value").cast("double").alias("value"))
    known = indexed.filter(F.col("value").isNotNull())
    entries = known.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    filled = F.coalesce("_e", F.array().cast("array<struct<idx:int,value:double>>"))
    layout = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).cast("int").alias("size"),
        F.col("_e.idx").alias("indices"),
        F.col("_e.value").alias("values"),
    )
    joined = spine.join(entries, "id", "left").withColumn("_e", filled)
    return materialize(joined.withColumn(name, layout).drop("_e"), "vectors", {name: VectorUDT()})
