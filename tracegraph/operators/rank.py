"""Ranking, splits and folds (SURVEY E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.operators.lineage import settled, small


def top_label(scores: DataFrame, key: str = "vec_id") -> DataFrame:
    """Class of the largest score of each key, ties to the lower class."""
    best = scores.groupBy(key).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("pred"), F.max("score").alias("p"))
    return best.select(key, "pred", F.round("p", 4).alias("confidence"))


def ranked(df: DataFrame, keys: list[str], order: list, to: str) -> DataFrame:
    """Adds ``to``, the rank from 1 of each row within its keys, without gathering the rows of a key in one task.

    Rows are sorted into ranges by keys and order; what comes before a range is a sum over ranges for each key. Null keys are a key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", *keys, (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))
    before = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    at = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        at = at & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return ranged.withColumn(to, inside).join(before, at).select(*df.columns, (F.col(to) + F.col("_before")).alias(to))


def quantiles(df: DataFrame, column: str, asks: dict[str, tuple[float, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with a column for each of ``asks``: name -> (p, "disc") for the least value that p of the rows do not exceed, or (p,
    "cont") for the value between two rows that p points to. Exact; nulls are left out, and a key without values has no row (without keys there is
    one row, of nulls if there is no value).

    Distinct values with their counts are sorted into ranges; sums over ranges tell in which one each rank lies, and only there
    counts are added up row by row. So no task holds all values of a key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = [f"_k{i}" for i in range(len(keys))]
    counts = df.where(F.col(column).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = settled(counts.repartitionByRange(parts, *k, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *k).agg(F.sum("_n").alias("_size"))
    own = Window.partitionBy(*k)
    sizes = sizes.withColumn("_total", F.sum("_size").over(own)).withColumn("_before", F.sum("_size").over(own.orderBy("_part")) - F.col("_size"))
    total, wanted = F.col("_total"), []
    for name, (p, how) in asks.items():
        at = p * (total - 1)
        ranks = [(F.greatest(F.ceil(p * total - 1e-9), F.lit(1)), F.lit(1.0))] if how == "disc" else [(F.floor(at) + 1, 1 - (at - F.floor(at))), (F.least(F.floor(at) + 2, total), at - F.floor(at))]
        wanted += [F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank"), w.cast("double").alias("weight")) for r, w in ranks]
    lies = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_size"))
    asked = sizes.select("_part", *k, "_before", "_size", F.explode(F.array(*wanted)).alias("x")).select("*", "x.*").where(lies).select(F.col("_part").alias("_p"), *[F.col(c).alias(f"{c}a") for c in k], "_before", "name", "rank", "weight")
    running = ranged.withColumn("_cum", F.sum("_n").over(Window.partitionBy("_part", *k).orderBy("_v")))
    met = F.col("_part") == F.col("_p")
    for c in k:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}a"))
    found = running.join(small(asked), met).where((F.col("rank") > F.col("_before") + F.col("_cum") - F.col("_n")) & (F.col("rank") <= F.col("_before") + F.col("_cum")))
    out = found.groupBy(*k).agg(*[F.sum(F.when(F.col("name") == n, F.col("weight") * F.col("_v"))).alias(n) for n in asks])
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], *[f"`{n}`" for n in asks])


def chrono_split(aged: DataFrame, mode: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``train`` per class: the oldest (forward), newest (backward) or a hashed (random) share, at least one row and not all; a class of one trains."""
    order = {"forward": [F.desc("age_days"), "id"], "backward": ["age_days", "id"], "random": [F.xxhash64("id", F.lit(seed)), "id"]}[mode]
    n = F.col("_n")
    cut = F.greatest(F.least(F.bround(n * share), n - 1), F.lit(1))
    rows = ranked(aged.where("apt is not null"), ["apt"], order, "_r")
    sizes = rows.groupBy("apt").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, "apt").select(*aged.columns, (F.col("_r") <= cut).alias("train"))


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int | None = 42) -> DataFrame:
    """Adds ``fold``, 0 to k - 1, equal in number to one row per class; in order of a hash, or of the id without a seed."""
    order = [F.xxhash64("id", F.lit(seed)), "id"] if seed is not None else ["id"]
    return ranked(df, [label], order, "fold").withColumn("fold", (F.col("fold") - 1) % k)


def nested_folds(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Folds in order of id, and each fold's rows of a class in turn validation and test."""
    folds = stratified_folds(df, label, k, None)
    turn = (F.col("part") - 1) % 2
    return ranked(folds, ["fold", label], ["id"], "part").withColumn("part", F.when(turn == 0, "val").otherwise("test"))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Adds ``idx``, the rank of each distinct key from 0, without gathering the keys in one task.

    Keys are sorted into ranges; what comes before a range is a sum over ranges, a table as small as the number of partitions.
    """
    keys = df.select(key).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(keys.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    index = ranged.withColumn("i", inside).join(F.broadcast(before), "part").select(key, (F.col("i") + F.col("before")).alias("idx"))
    return df.join(index, key)


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r = 1").drop("r")
