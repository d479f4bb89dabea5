"""Label evidence, blending and tiers of attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators import link
from tracegraph.operators.lineage import small

#: Indicators at which the evidence is full, and coherence without any hint of a nation.
FULL_EVIDENCE, NO_HINT = 51, 0.5


#: Nations that sponsor actors. Fixed values.
STATES = ("Russia", "North Korea", "China", "Vietnam")


def softmax(scores: DataFrame, keys: list[str], value: str = "logit") -> DataFrame:
    """Adds ``score``: the softmax of ``value`` over each key's rows."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return scores.withColumn("e", e).withColumn("score", F.col("e") / F.sum("e").over(w)).drop("e")


def _beliefs(rows: DataFrame) -> DataFrame:
    """Masses from exclusivity, weight and coherence; belief in the nation includes that in the actor, which is the label's confidence."""
    product = F.col("weight") * F.col("coherence")
    named, nation = F.col("exclusivity") * product, (1 - F.col("exclusivity")) * product * 0.5
    four = lambda c, name: F.round(c, 4).alias(name)
    return rows.select("id", four(named, "label_confidence"), four(named, "belief_named_actor"), four(named + nation, "belief_nation_state"), four(F.greatest(1 - named - nation, F.lit(0.0)), "uncertainty"),
                       four(F.col("exclusivity"), "tag_exclusivity"), four(F.col("weight"), "evidence_weight"), four(F.col("coherence"), "nation_coherence"), "activity_cluster")


def _evidence(n):
    return F.when(n > 0, F.least(F.lit(1.0), F.log2(1 + n) / F.log2(F.lit(float(FULL_EVIDENCE))))).otherwise(F.lit(0.0))


def label_mass_v1(reports: DataFrame, tags: DataFrame, aliases: DataFrame, keywords: DataFrame, mentions: DataFrame, criminal: str = "Cybercrime") -> DataFrame:
    """Evidence of each report (id, target, target_nation, text, n_iocs) for its label, as the collector weighs it.

    Targets without a nation, or with that named ``criminal``, are cybercrime.

    Exclusivity: the squared share of tags of the target among all tags that name a group; without such tags 1 / (1 + groups mentioned in
    the text). Evidence grows with the logarithm of all indicators. Coherence: 1 if the target's nation is among those whose keywords the
    tags or the text hold, 0 if only others are, a half if none is. tags: (id, tag); keywords: (keyword, nation); mentions: (id, n_groups).
    """
    named = tags.join(small(aliases.select(F.col("alias").alias("tag"), "group")), "tag").join(reports.select("id", "target"), "id")
    counts = named.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("group") == F.col("target"), 1)).alias("mine"))
    said = tags.select("id", F.col("tag").alias("text")).unionByName(reports.select("id", F.lower("text").alias("text")))
    said = link.substring_mentions(said, keywords.select(F.col("keyword").alias("pattern"))).join(small(keywords), F.col("pattern") == F.col("keyword")).select("id", F.col("nation").alias("found")).distinct()
    nations = said.join(reports.select("id", "target_nation"), "id").groupBy("id").agg(F.max((F.col("found") == F.col("target_nation")).cast("int")).alias("hit"))
    rows = reports.join(counts, "id", "left").join(nations, "id", "left").join(mentions, "id", "left")
    exclusivity = F.when(F.col("total") > 0, F.pow(F.col("mine") / F.col("total"), 2)).otherwise(1 / (1 + F.greatest(F.coalesce("n_groups", F.lit(0)), F.lit(1))))
    hit = F.col("hit").isNotNull()
    coherence = F.when(~hit, F.lit(NO_HINT)).when(F.col("hit") == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    state = F.col("target_nation").isNotNull() & (F.col("target_nation").cast("string") != criminal)
    cluster = F.when(state, "State-Sponsored").otherwise("Cybercrime")
    return _beliefs(rows.select("id", exclusivity.alias("exclusivity"), _evidence(F.col("n_iocs")).alias("weight"), coherence.alias("coherence"), cluster.alias("activity_cluster")))


def label_mass_v2(reports: DataFrame, tags: DataFrame, aliases: DataFrame, mentions: DataFrame, states=STATES, criminal: str = "Cybercrime") -> DataFrame:
    """The same as it is scored anew: aliases count once each, only network indicators are evidence, and a group of another nation among the tags
    refutes the label (of the same nation: a half). Without network indicators all is uncertain.

    Only the nations of ``states`` sponsor; targets of any other nation, of ``criminal``, or of none are cybercrime."""
    matched = tags.select("id", "tag").distinct().join(small(aliases.select(F.col("alias").alias("tag"), "group", "nation")), "tag").join(reports.select("id", "target", "target_nation"), "id")
    other = F.col("group") != F.col("target")
    counts = matched.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~other, 1)).alias("mine"), F.max(other.cast("int")).alias("other"), F.max((other & ~F.col("nation").eqNullSafe(F.col("target_nation"))).cast("int")).alias("foreign"))
    rows = reports.join(counts, "id", "left").join(mentions, "id", "left")
    exclusivity = F.when(F.col("total") > 0, F.pow(F.col("mine") / F.col("total"), 2)).otherwise(1 / (1 + F.greatest(F.coalesce("n_groups", F.lit(0)), F.lit(1))))
    coherence = F.when(F.col("foreign") == 1, F.lit(0.0)).when(F.col("other") == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    none = F.col("n_network") == 0
    nation = F.col("target_nation").cast("string")
    state = F.coalesce(nation.isin(*[str(x) for x in states]) & (nation != criminal), F.lit(False))
    cluster = F.when(state, "State-Sponsored").otherwise("Cybercrime")
    return _beliefs(rows.select("id", F.when(none, F.lit(0.0)).otherwise(exclusivity).alias("exclusivity"), _evidence(F.col("n_network")).alias("weight"), F.when(none, F.lit(1.0)).otherwise(coherence).alias("coherence"), cluster.alias("activity_cluster")))


def weighted_nll(rows: DataFrame, decay: bool) -> DataFrame:
    """Loss of (p_truth, w): the mean of loss times weight, or with decay their sum over the sum of weights."""
    loss = -F.log("p_truth") * F.col("w")
    value = F.sum(loss) / F.greatest(F.sum("w"), F.lit(1e-6)) if decay else F.avg(loss)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(value, 6).alias("loss"))


def blend(a: DataFrame, b: DataFrame, wa: float = 0.6, wb: float = 0.4) -> DataFrame:
    """Weighted sum of two scorers' (vec_id, class, score), scaled to a sum of one per key, to four places."""
    both = a.select("vec_id", "class", F.col("score").alias("x")).join(b.select("vec_id", "class", F.col("score").alias("y")), ["vec_id", "class"], "full")
    mixed = both.withColumn("s", wa * F.coalesce("x", F.lit(0.0)) + wb * F.coalesce("y", F.lit(0.0)))
    return mixed.select("vec_id", "class", F.round(F.try_divide("s", F.sum("s").over(Window.partitionBy("vec_id"))), 4).alias("score"))


def _tops(scores: DataFrame, dim: DataFrame) -> DataFrame:
    """Best class and best nation of each key with their scores, and all nations' scores; ties go to the lower class and the lower name."""
    best = scores.groupBy("vec_id").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("top"), F.max("score").alias("top_p"))
    named = scores.join(small(dim), "class", "left").groupBy("vec_id", F.coalesce("nation", F.lit("Unknown")).alias("nation")).agg(F.sum("score").alias("s"))
    first = F.array_min(F.collect_list(F.struct((-F.round("s", 9)).alias("neg"), "nation", "s")))
    nations = named.groupBy("vec_id").agg(first.alias("f"), F.map_from_entries(F.collect_list(F.struct("nation", F.round("s", 4)))).alias("nation_scores"))
    return best.join(nations.select("vec_id", F.col("f.nation").alias("nation"), F.col("f.s").alias("nation_p"), "nation_scores"), "vec_id")


def tiered_v1(scores: DataFrame, dim: DataFrame, states: list[str], criminal: str = "Cybercrime", tier3: float = 0.45, tier2: float = 0.30) -> DataFrame:
    """Actor, nation and activity cluster of each key with confidence bands at the two thresholds, the tier to trust and a summary.

    The cluster is the largest of three sums over nations: those in ``states``, the one named ``criminal``, and all others with
    classes that have none. Ties go to the first of the three.
    """
    t = _tops(scores, dim)
    share = lambda keep: F.coalesce(F.aggregate(F.filter(F.map_entries("nation_scores"), lambda e: keep(e["key"])), F.lit(0.0), lambda a, e: a + e["value"]), F.lit(0.0))
    state, crime, rest = share(lambda k: k.isin(states)), share(lambda k: k == criminal), share(lambda k: ~k.isin(*states, criminal))
    t = t.withColumns({"state_p": state, "crime_p": crime, "rest_p": rest})
    cluster_p = F.greatest("state_p", "crime_p", "rest_p")
    cluster = F.when(F.col("state_p") == cluster_p, "State-Sponsored").when(F.col("crime_p") == cluster_p, "Cybercrime").otherwise("Unknown")
    tier = F.when(F.col("top_p") >= tier3, 3).when(F.col("nation_p") >= tier2, 2).otherwise(1)
    summary = (F.when(tier == 3, F.format_string("High confidence: %s (%.0f%%)", F.col("top").cast("string"), F.col("top_p") * 100))
               .when(tier == 2, F.format_string("Moderate confidence %s state-sponsored activity, possibly %s", "nation", F.col("top").cast("string"))).otherwise(F.concat(F.lit("Low confidence — activity cluster: "), cluster)))
    band = lambda p: T.confidence_band(p, tier3, tier2)
    level = lambda x, p: F.struct(x.cast("string").alias("prediction"), F.round(p, 4).alias("confidence"), band(p).alias("assessment"))
    return t.select("vec_id", level(F.col("top"), F.col("top_p")).alias("tier3"), level(F.col("nation"), F.col("nation_p")).alias("tier2"), level(cluster, cluster_p).alias("tier1"), tier.alias("recommended_tier"), summary.alias("summary"), "nation_scores")


def tiered_v2(scores: DataFrame, dim: DataFrame, states: list[str], criminal: str = "Criminal") -> DataFrame:
    """The same with bands at 0.70 and 0.40; the cluster follows from the nation and has its confidence."""
    t = _tops(scores, dim)
    cluster = F.when(F.col("nation").isin(states), F.concat(F.lit("State-sponsored ("), "nation", F.lit(")"))).when(F.col("nation") == criminal, "Financially-motivated criminal group").otherwise("Other / unattributed")
    tier = F.when(F.col("top_p") >= 0.70, 3).when(F.col("nation_p") >= 0.60, 2).otherwise(1)
    level = lambda x, p: F.struct(x.cast("string").alias("prediction"), F.round(p, 4).alias("confidence"), T.confidence_band(p, 0.70, 0.40).alias("assessment"))
    return t.select("vec_id", level(F.col("top"), F.col("top_p")).alias("tier3"), level(F.col("nation"), F.col("nation_p")).alias("tier2"), level(cluster, F.col("nation_p")).alias("tier1"), tier.alias("recommended_tier"), "nation_scores")


def flat(tiers: DataFrame) -> DataFrame:
    """Tiers as plain columns."""
    cols = [F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in ("tier3", "tier2", "tier1") for c in ("prediction", "confidence", "assessment")]
    return tiers.select("vec_id", *cols, "recommended_tier")
