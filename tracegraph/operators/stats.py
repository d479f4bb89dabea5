"""Aggregations over graphs, labels, ages and scores (SURVEY D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators.lineage import small
from tracegraph.operators.pooling import pooled
from tracegraph.operators.rank import quantiles

DNS_TYPES = ["A", "AAAA", "MX", "NS", "SOA", "TXT", "CNAME", "PTR", "SRV"]


def seen_span(edges: DataFrame, by: str, as_of: Column, first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """First and last sight per key, with lifespan and recency in days: not below 0, and 0 where an end is missing."""
    seen = edges.groupBy(by).agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))
    days = lambda a, b: F.coalesce(F.greatest(T.days_between(a, b), F.lit(0.0)), F.lit(0.0))
    return seen.select(by, "first_seen", "last_seen", F.round(days(F.col("last_seen"), F.col("first_seen")), 4).alias("lifespan_days"), F.round(days(as_of, F.col("last_seen")), 4).alias("recency_days"))


def top_k_vocab(df: DataFrame, column: str, k: int) -> DataFrame:
    """value -> idx: the k - 1 most frequent values that are not empty at 1 to k - 1, ties by value; 0 stands for all others."""
    counts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k - 1)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "value"))).select("value", "n", "idx")


def event_mean_pool(edges: DataFrame, vecs: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Mean vector of an event's indicators over all its edges of all types; zeros for events without any. Vectors stay where they are (``pooled``)."""
    means = pooled(events.select("id"), edges, vecs, ["id"], ["ioc_type", "ioc"], width)
    zeros = F.array_repeat(F.lit(0.0), width)
    return means.select("id", F.coalesce("vec", zeros).alias("vec"))


def majority_label(votes: DataFrame) -> DataFrame:
    """(ioc, apt, n) for indicators with one most frequent label."""
    top = Window.partitionBy("ioc").orderBy(F.desc("n"))
    first = votes.groupBy("ioc", "apt").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.rank().over(top)).where("r = 1")
    return first.groupBy("ioc").agg(F.count(F.lit(1)).alias("c"), F.min("apt").alias("apt"), F.min("n").alias("n")).where("c = 1").select("ioc", "apt", "n")


def majority_ties(votes: DataFrame) -> DataFrame:
    kept = majority_label(votes).agg(F.count(F.lit(1)).alias("n_kept"))
    return votes.agg(F.countDistinct("ioc").alias("n_iocs")).crossJoin(kept).select("n_iocs", "n_kept", (F.col("n_iocs") - F.col("n_kept")).alias("n_ties"))


def class_confidence(events: DataFrame) -> DataFrame:
    return events.where("apt is not null").groupBy("apt").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def class_weights(events: DataFrame) -> DataFrame:
    """N - n_c per label."""
    counts = events.where("apt is not null").groupBy("apt").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("apt", "n", (F.sum("n").over(Window.partitionBy()) - F.col("n")).alias("weight"))


def event_age(events: DataFrame) -> DataFrame:
    """Adds age_days against the newest event; events without a date get the lower middle age."""
    found = events.agg(F.max("created").alias("newest"), F.count_if(F.col("created").isNull()).alias("undated")).first()
    aged = events.withColumn("age", F.greatest(T.days_between(F.lit(found.newest).cast(events.schema["created"].dataType), F.col("created")), F.lit(0.0)))
    if not found.undated:  # nothing to fill in
        return aged.withColumn("age_days", F.coalesce("age", F.lit(0.0))).drop("age")
    middle = quantiles(aged, "age", {"middle": (0.5, "disc")})
    return aged.crossJoin(F.broadcast(middle)).withColumn("age_days", F.coalesce("age", "middle", F.lit(0.0))).drop("age", "middle")


def decay_overall(aged: DataFrame, tau: float) -> DataFrame:
    """Ages and decay weights of the labelled events."""
    rows = aged.where("apt is not null").withColumn("w", T.decay_weight(F.col("age_days"), tau))
    ages = quantiles(rows, "age_days", {"age_p05": (0.05, "cont"), "age_median": (0.5, "disc"), "age_p95": (0.95, "cont")})
    middle = quantiles(rows, "w", {"w_median": (0.5, "disc")})
    rest = rows.agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.stddev_samp("w").alias("w_std"), F.avg((F.col("w") >= 0.5).cast("double")).alias("share_half"))
    all_ = rest.join(F.broadcast(ages), F.lit(True), "left").join(F.broadcast(middle), F.lit(True), "left")  # single rows
    return all_.select("n", *[F.round(c, 6).alias(c) for c in ("age_p05", "age_median", "age_p95", "w_min", "w_median", "w_max", "w_std", "share_half")])


def decay_by_class(aged: DataFrame, tau: float) -> DataFrame:
    rows = aged.where("apt is not null").withColumn("w", T.decay_weight(F.col("age_days"), tau))
    sums = rows.groupBy("apt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("sum_w"), F.round(F.avg("w"), 6).alias("mean_w"))
    return sums.join(quantiles(rows, "age_days", {"median_age": (0.5, "disc")}, ("apt",)), "apt", "left").select("apt", "n", "sum_w", "mean_w", F.round("median_age", 6).alias("median_age"))


def age_stats(aged: DataFrame, by: str) -> DataFrame:
    ages = quantiles(aged, "age_days", {"median": (0.5, "cont"), "p05": (0.05, "cont"), "p95": (0.95, "cont")}, (by,))
    n = aged.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(ages, by, "left").select(by, "n", *[F.round(c, 6).alias(c) for c in ("median", "p05", "p95")])


def accuracy(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Accuracy and mean recall over the classes that occur in the truth."""
    per = rows.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col(pred) == F.col(truth)).cast("int"), F.lit(0))).alias("hit"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("hit") / F.sum("n"), 6).alias("acc"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("bacc"))


def per_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth").agg(F.sum((F.col("pred") == F.col("truth")).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))


def tier_metrics(rows: DataFrame, tier3: float = 0.45, tier2: float = 0.30, scope: str = "nation_only") -> DataFrame:
    """Top-1, nation and routed accuracy of (truth, pred, p, truth_nation, pred_nation).

    Routed: the class counts at ``tier3`` and above, the nation at ``tier2`` and above, below that the model abstains. With scope
    "reference" exact hits on classes without a nation count in the routed numerator although the denominator leaves them out.
    """
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    exact, same, scoped = F.col("pred") == F.col("truth"), F.col("pred_nation") == F.col("truth_nation"), F.col("truth_nation").isNotNull()
    r3, r2 = F.col("p") >= tier3, (F.col("p") >= tier2) & (F.col("p") < tier3)
    t3 = n(r3 & exact if scope == "reference" else r3 & exact & scoped)
    sums = rows.agg(F.count(F.lit(1)).alias("tier3_total"), n(exact).alias("tier3_correct"), n(scoped).alias("tier2_total"), n(same & scoped).alias("tier2_correct"), (t3 + n(r2 & same & scoped)).alias("hier_correct"),
                    n(r3).alias("n_tier3"), n(r2).alias("n_tier2"), n(F.col("p") < tier2).alias("n_abstain"), n(r3 & exact).alias("routed3"), n(r2 & same & scoped).alias("routed2"))
    rate = lambda a, b, name: F.round(F.try_divide(a, b), 6).alias(name)
    return sums.select("*", rate("tier3_correct", "tier3_total", "tier3_acc"), rate("tier2_correct", "tier2_total", "tier2_acc"), rate("hier_correct", "tier2_total", "hier_acc"), rate("routed3", "n_tier3", "acc_in_tier3"), rate("routed2", "n_tier2", "acc_in_tier2"))


def fold_metrics(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("fold", "truth").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("truth")).cast("long")).alias("hit"))
    return per.groupBy("fold").agg((F.sum("hit") / F.sum("n")).alias("acc"), F.avg(F.col("hit") / F.col("n")).alias("bacc"))


def fold_macro(rows: DataFrame) -> DataFrame:
    return fold_metrics(rows).agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("acc"), 6).alias("acc"), F.round(F.avg("bacc"), 6).alias("bacc"))


def fold_micro(rows: DataFrame) -> DataFrame:
    return per_class(rows).select("truth", "correct", "total", F.round(F.try_divide("correct", "total"), 6).alias("acc"))


def subset_metrics(rows: DataFrame) -> DataFrame:
    """n and accuracy overall, by ``matched``, and by matched and kind, in one pass."""
    cube = rows.withColumn("hit", (F.col("pred") == F.col("truth")).cast("long"))
    sets = cube.groupingSets([[], ["matched"], ["matched", "kind"]], "matched", "kind")
    return sets.agg(F.grouping_id("matched", "kind").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("acc")).select("level", "matched", "kind", "n", "acc")


def match_stats(counts: DataFrame) -> DataFrame:
    """Median, ninetieth percentile (both between rows) and maximum of ``n``."""
    at = quantiles(counts, "n", {"median": (0.5, "cont"), "p90": (0.9, "cont")})
    return counts.agg(F.max("n").alias("max")).join(F.broadcast(at), F.lit(True), "left").select(F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "max")


def rollup_scores(scores: DataFrame, dim: DataFrame, by: str = "nation") -> DataFrame:
    """Class scores summed per nation or cluster; classes without one form a bucket of their own."""
    return scores.join(small(dim.select("class", by)), "class", "left").groupBy("vec_id", by).agg(F.round(F.sum("score"), 5).alias("score"))


def ensemble_mean(scores: DataFrame) -> DataFrame:
    """Mean of the models' probabilities over the models present."""
    return scores.groupBy("vec_id", "class").agg(F.avg("score").alias("score"))


def dns_counts(records: DataFrame, key: str, kind: str, nxdomain: str | None = None) -> DataFrame:
    """Answers per key for each of the nine record types, 0 where there are none.

    ``nxdomain`` names a column that tells whether the answer was that there is no such name: such rows are no answers, and ``is_nxdomain`` is
    added, true if the name's A query was answered so. An A query without such an answer, a null or any other type says nothing.
    """
    absent = F.coalesce(F.col(nxdomain), F.lit(False)) if nxdomain else F.lit(False)
    count = [F.count(F.when((F.col(kind) == t) & ~absent, 1)).alias(t) for t in DNS_TYPES]
    flag = [F.coalesce(F.max((F.col(kind) == "A") & absent), F.lit(False)).alias("is_nxdomain")] if nxdomain else []
    return records.groupBy(key).agg(*count, *flag)


def ioc_sketches(edges: DataFrame, keys: list[str], lg_k: int = 12) -> DataFrame:
    """(*keys, sketch): HyperLogLog sketches of the distinct indicators (ioc_type, ioc) of each key, of one size however many there are; 1.04 / sqrt(2 ** lg_k) is
    their standard error. As a table they can be united over days, sources or reports without the indicators."""
    return edges.groupBy(*keys).agg(F.hll_sketch_agg(F.concat_ws("|", F.col("ioc_type"), F.col("ioc").cast("string")), lg_k).alias("sketch"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_distinct): estimates from stored sketches, united by the keys; without keys one row of all."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("n_distinct"))


def ioc_counts(edges: DataFrame) -> DataFrame:
    """Indicators of each report by type, and in all."""
    n = lambda k: F.count(F.when(F.col("ioc_type") == k, 1)).alias(f"n_{k}")
    return edges.groupBy("id").agg(n("domain"), n("ip"), n("url"), F.countDistinct("ioc_type", "ioc").alias("n_distinct"))
