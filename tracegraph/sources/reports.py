"""Reports and alias bundles as they land: JSON documents under declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.operators import clean

#: What a report holds; tags come as texts or as objects with a name, so an element is read as text either way.
REPORT = "id string, name string, description string, created string, modified string, tags array<string>, indicators array<struct<indicator: string, type: string, created: string>>"

#: An alias bundle: objects of many types, of which intrusion sets have a name and may have aliases.
BUNDLE = "id string, objects array<struct<type: string, name: string, aliases: array<string>>>"

#: The column of lines that are no JSON, or not of the declared types.
MALFORMED = "malformed"

INTRUSION_SET = "intrusion-set"


def tag_text(tag: Column) -> Column:
    """A tag's text: an object's name (none: empty), another tag as it is; null stays null."""
    name = F.get_json_object(tag, "$.name")
    is_object = F.ltrim(tag).startswith("{") & F.get_json_object(tag, "$").isNotNull()
    return F.when(is_object, F.coalesce(name, F.lit(""))).otherwise(tag)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Documents of ``path``, a line each or (``multi_line``) a file each, with ``schema`` and the text of what cannot be read in ``MALFORMED``.

    Nothing is inferred, so files are read once; unknown fields are skipped, absent ones are null. A field of another type makes the
    document malformed, and its other fields are kept beside the text.
    """
    rows = spark.read.schema(f"{schema}, {MALFORMED} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    return rows.option("multiLine", multi_line).json(path)


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Reports of ``REPORT`` with tags as texts, and ``MALFORMED``; the good ones are those where it is null and there is an id."""
    rows = read_json(spark, path, REPORT, multi_line)
    return rows.withColumn("tags", F.transform("tags", tag_text))


def split_reports(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports that can be used, and the lines (malformed) that cannot: no JSON, other types, or no id."""
    good = F.col(MALFORMED).isNull() & F.col("id").isNotNull()
    rest = rows.where(~good).select(F.coalesce(MALFORMED, F.to_json(F.struct("name", "created"))).alias(MALFORMED))
    return rows.where(good).drop(MALFORMED), rest


def read_aliases(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(alias, group) of the intrusion sets of alias bundles, in lower case; of sets that share an alias the last one of the last bundle (by its id) wins.

    A set without the field has its own name for an alias, one with an empty list none; one without a name counts as ''.
    """
    objects = read_json(spark, path, BUNDLE, multi_line).where(F.col(MALFORMED).isNull()).select(F.coalesce("id", F.lit("")).alias("bundle"), F.posexplode("objects").alias("at", "x"))
    sets = objects.where(F.col("x.type") == INTRUSION_SET).select(F.coalesce("x.name", F.lit("")).alias("name"), "x.aliases", F.struct("bundle", "at").alias("position"))
    return clean.alias_dimension(sets)
