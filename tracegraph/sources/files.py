"""Reading key columns and event times from delimited files, and keeping vocabularies and metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracegraph.functions import text as T


def read_keys(spark: SparkSession, path: str, header: list[str], key: str = "ioc", sep: str = "\t") -> DataFrame:
    """The key column of a delimited feature file in lower case, as (value); ``header`` names its columns.

    All other columns are pruned before they are parsed. Blank keys stay blank, absent ones are null; a file without rows gives none.
    """
    schema = StructType([StructField(c, StringType()) for c in header])
    rows = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(F.lower(key).alias("value"))


def read_event_times(spark: SparkSession, path: str) -> DataFrame:
    """(event_idx, created) from a comma-separated file; times that cannot be read are null."""
    rows = spark.read.schema("event_idx int, created string").option("header", True).csv(path)
    return rows.select("event_idx", T.parse_ts(F.col("created")).alias("created"))


def save_vocab(vocab: DataFrame, feature: str, path: str) -> None:
    """Writes the vocabulary (value, idx) of a feature under ``path``, a folder for each feature; a vocabulary saved before is replaced."""
    vocab.select("value", "idx").write.mode("overwrite").parquet(f"{path.rstrip('/')}/feature={feature}")


def load_vocab(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """(value, idx) of one feature, or (feature, value, idx) of all; an unknown feature gives no rows."""
    rows = spark.read.schema("value string, idx int, feature string").parquet(path)
    return rows.select("feature", "value", "idx") if feature is None else rows.where(F.col("feature") == feature).select("value", "idx")


def metric_rows(metrics: DataFrame, run: str, fold: Column | None = None) -> DataFrame:
    """The number columns of ``metrics`` as long rows (run, fold, metric, value); columns of other types are left out, nulls stay null."""
    numbers = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short") and f.name != "fold"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers]))
    own = fold if fold is not None else (F.col("fold").cast("int") if "fold" in metrics.columns else F.lit(None).cast("int"))
    return metrics.select(F.lit(run).alias("run"), own.alias("fold"), pairs.alias("x")).select("run", "fold", "x.*")


def write_metrics(rows: DataFrame, path: str) -> None:
    """Writes (run, fold, metric, value) as JSON documents, a folder for each run; a run written again replaces its own rows only."""
    spark = rows.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.select("run", "fold", "metric", "value").write.mode("overwrite").partitionBy("run").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fold int, metric string, value double, run string").json(path).select("run", "fold", "metric", "value")
