"""CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "NA"
#: Quotes inside quoted text are doubled; outer spaces belong to the value.
QUOTING = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv_typed(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Header CSV where both ``NA`` and blank text are null.

    ``multi_line`` reads values that hold line breaks; each file is then one task.
    """
    reader = spark.read.schema(schema).options(**QUOTING).option("nullValue", NULL_TEXT)
    raw = reader.option("multiLine", multi_line).csv(path)
    return raw.select(
        *[
            F.nullif(f.name, F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else f.name
            for f in schema
        ]
    )


def read_csv_blank_kept(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Header CSV where only ``NA`` is null and blank text stays blank.

    ``multi_line`` reads values that hold line breaks; each file is then one task.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).options(**QUOTING).option("multiLine", multi_line).csv(path)

    def typed(f: T.StructField):
        value = F.when(F.col(f.name) != NULL_TEXT, F.col(f.name))
        if isinstance(f.dataType, T.StringType):
            value = F.when(F.col(f.name).isNull(), F.lit("")).otherwise(value)
        else:
            value = value.try_cast(f.dataType)
        return value.alias(f.name)

    return raw.select(*[typed(f) for f in schema])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV with nulls written as ``NA``, text quoted where it needs to be."""
    df.write.mode(mode).options(**QUOTING).option("nullValue", NULL_TEXT).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def fill_template(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per template id; ``covered`` tells whether a prediction was made for it."""
    made = predictions.select("id", "prediction", F.lit(1).alias("covered"))
    return template.select("id").join(made, "id", "left").na.fill({"covered": 0})
