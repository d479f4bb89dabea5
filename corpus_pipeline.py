"""Corpus pipeline: language ID, near-duplicates, repeated passages, mixing to target weights, packing.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import jaccard, langid, mixing, packing, suffix
from tracegraph.llm.shared import cut, small

#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise; a longer row goes alone. Spark's own limit
#: lets a task's whole texts wait in the JVM's and the worker's memory at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_batches(stage: Stage) -> Stage:
    """``stage`` with ``BATCH`` for the session: its rows are made when the caller writes them, so the setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH[0] not in spark.conf.getAll:
            spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all others as one column ``row``, so that an operator may add columns of any name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in columns]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), *columns)


def restored(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``docs`` in their order, after ``carried`` with the same names."""
    return rows.select(*[F.col(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@in_batches
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts and texts without a letter, of whatever id.

    Rows that repeat stay as often as they are there; null ids, languages and sources are no reason to go. An empty table gives no rows.
    """
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2).select("text", "lang"))
    found = langid.identify(carried(docs, "text"), model)
    # without any labelled document there is no language to tell, and only texts without a letter go
    letters = F.col("text").rlike(r"\p{L}") if not model.langs else F.col("lang_pred") != langid.UNKNOWN
    return restored(found.where(letters), docs, "text")


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the smallest id, of equal ids the smallest hash of the text, of rows equal in
    both the least in the order of all other columns.

    Documents without a word (null and empty texts too) belong to no component and stay, repeated ones as often as they are there. A
    null id is larger than any other. An empty table gives no rows.
    """
    key = F.xxhash64("text")
    found = cut(jaccard.jaccard_components(docs.select("doc_id", "text")))
    named = found.where("n_shingles > 0").select("doc_id", "text_key", "group_key")
    first = named.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("w")).select("group_key", F.col("w.doc_id").alias("w_id"), F.col("w.text_key").alias("w_text"))
    judged = named.join(first, "group_key").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("w_id")) & F.col("text_key").eqNullSafe(F.col("w_text")))
    per = judged.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    per = cut(per.where("not stays or n > 1"))
    match = lambda side: F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key").eqNullSafe(F.col("k_text")))
    rows = carried(docs, "doc_id", "text").withColumn("text_key", key)
    kept = rows.join(small(per.select("k_id", "k_text")), match(per), "left_anti")
    again = per.where("stays")
    if not again.isEmpty():
        equal = rows.join(small(again.select("k_id", "k_text")), match(again), "left_semi")
        one = equal.groupBy("doc_id", "text_key").agg(F.min_by(F.struct("row", "text"), F.to_json(F.struct("row"))).alias("x"))
        kept = kept.unionByName(one.select("doc_id", "text_key", "x.row", "x.text").select(*kept.columns))
    return restored(kept, docs, "doc_id", "text")


@in_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that stand anywhere else; documents of which nothing is left go.

    Null and empty texts stay as they are. Texts that occur twice, in rows that repeat or not, go whole. n_chars, where there is such a
    column, is that of the new text; documents without a cut keep theirs. An empty table gives no rows.
    """
    found = suffix.remove_repeats(carried(docs, "text"), as_text=True).where("n_removed = 0 or n_removed < n_bytes")
    cutoff = F.col("n_removed") > 0
    new = {"text": F.when(cutoff, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cutoff, F.length("kept")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@in_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or leaves out documents so that each source's words come near its target.

    Null and empty texts have no words: they come as often as whole copies of their source's shortest documents are certain. A null source is a
    source. Rows that repeat are drawn together. An empty table gives no rows.
    """
    mixed = mixing.pareto_mix(carried(docs, "doc_id", "text", "source"))
    names = ("doc_id", "text", "source")
    return restored(mixed.where("copies > 0").select("row", *names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), docs, *names)


@in_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece of a document, with its place.

    A null or empty text is the closing token alone. Null ids and rows that repeat are documents of their own. An empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashes, shingles and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; odd rows as in the stages, any more columns are carried along."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
