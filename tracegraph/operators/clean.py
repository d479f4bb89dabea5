"""Reading, routing and upserting reports, indicators and lookups (SURVEY A and B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators.lineage import small


def explode_indicators(pulses: DataFrame) -> DataFrame:
    """A row per report and indicator (id, indicator, type, created); blank indicators are dropped, reports without any keep one null row."""
    rows = pulses.select("id", F.explode_outer("indicators").alias("i")).select("id", F.trim("i.indicator").alias("indicator"), F.col("i.type").alias("type"), F.col("i.created").alias("created"))
    return rows.where("indicator is null or indicator <> ''")


def clean_pdns(answers: DataFrame, direction: str) -> DataFrame:
    """Passive-DNS answers (key, hostname, address, record_type, ...) of type A and AAAA with the other end of the relation as ``value``.

    forward: address, else hostname. reverse: hostname, else address, in lower case, without dots at the ends and without numeric hosts.
    """
    first, second = ("address", "hostname") if direction == "forward" else ("hostname", "address")
    value = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    rows = answers.withColumn("record_type", F.upper("record_type")).where(F.col("record_type").isin("A", "AAAA"))
    if direction == "reverse":
        value = F.btrim(F.lower(value), F.lit("."))
    rows = rows.withColumn("value", value).where("value is not null and value <> ''")
    return rows if direction == "forward" else rows.where(~T.is_ipv4_like(F.col("value")))


def alias_dimension(sets: DataFrame) -> DataFrame:
    """alias -> group from (name, aliases, position); a set whose aliases are null has its own name, one with an empty list none; the last set wins a clash."""
    each = sets.withColumn("alias", F.explode(F.coalesce("aliases", F.array("name")))).where("alias is not null")
    return each.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("name", "position").alias("group"))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; the rest is kept."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def store_predictions(events: DataFrame, predictions: DataFrame, stamp: str) -> DataFrame:
    """Events with the predictions for their ids written in; predictions for unknown ids are ignored."""
    p = predictions.select(F.col("id").alias("p_id"), F.col("predicted_apt").alias("new_apt"), F.col("confidence").alias("new_confidence"), F.col("method").alias("new_method"))
    hit = F.col("p_id").isNotNull()
    out = events.join(p, events.id == p.p_id, "left")
    return out.select("id", *[F.when(hit, F.col(n)).alias(c) for c, n in (("predicted_apt", "new_apt"), ("prediction_confidence", "new_confidence"), ("prediction_method", "new_method"))], F.when(hit, F.lit(stamp)).alias("prediction_timestamp"))


def results_top(events: DataFrame, n: int = 500) -> DataFrame:
    """The n predicted events of highest confidence, ties by id."""
    return events.where("predicted_apt is not null").orderBy(F.desc("prediction_confidence"), "id").limit(n)


def merge_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edge: earliest first_seen, latest last_seen, earliest indicator_created; blanks count as absent."""
    have = [c for c, f in (("first_seen", F.min), ("last_seen", F.max), ("indicator_created", F.min)) if c in edges.columns]
    how = {"first_seen": F.min, "last_seen": F.max, "indicator_created": F.min}
    return edges.groupBy(*keys).agg(*[how[c](F.nullif(F.trim(c), F.lit(""))).alias(c) for c in have])


def merge_nodes(nodes: DataFrame, key: str, columns: list[str], version: str) -> DataFrame:
    """One row per node: of each column the latest value that is not blank."""
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    return nodes.groupBy(key).agg(*[F.max_by(value(c), F.when(value(c).isNotNull(), F.col(version))).alias(c) for c in columns])


def route_iocs(rows: DataFrame) -> DataFrame:
    """Kind and value of indicators by their type; other types are dropped; domains in lower case."""
    kind = F.when(F.col("type").isin("domain", "hostname"), "domain").when(F.col("type").isin("IPv4", "IPv6"), "ip").when(F.col("type").isin("URL", "URI"), "url")
    return rows.withColumn("kind", kind).where("kind is not null").withColumn("value", F.when(F.col("kind") == "domain", F.lower("indicator")).otherwise(F.col("indicator")))


def in_window(df: DataFrame, column: str, since: str, until: str) -> DataFrame:
    """since <= column < until."""
    return df.where((F.col(column) >= F.lit(since).cast("timestamp_ntz")) & (F.col(column) < F.lit(until).cast("timestamp_ntz")))


def encode_labels(events: DataFrame, label_dim: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Adds ``y``: the label's index, -1 for none and for labels out of scope. Labels of ``scope`` must be in the dimension."""
    dim = label_dim.select(F.col("label").alias("apt"), "idx")
    if scope is not None:
        known = {r.apt for r in dim.where(F.col("apt").isin(scope)).select("apt").collect()}
        if unknown := sorted(set(scope) - known):
            raise ValueError(f"labels without an entry: {unknown}")
        dim = dim.where(F.col("apt").isin(scope))
    return events.join(dim, "apt", "left").withColumn("y", F.coalesce("idx", F.lit(-1))).drop("idx")


def in_vocab(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Events whose label is in the dimension, whatever its case."""
    return events.withColumn("k", F.upper("apt")).join(dim.select(F.upper("label").alias("k")).distinct(), "k", "left_semi").drop("k")


def public_suffix(df: DataFrame, key: str, host: str, suffixes: DataFrame) -> DataFrame:
    """Adds ``suffix``: of the supplied rules (s) the one that prevails for the host; else its last label; null for no host.

    A rule fits a host that is it or ends with it after a dot. ``*.x`` stands for any one label before x, ``!y.x`` is an exception from that, whose suffix is x. An
    exception prevails over all others, of which the one of most labels prevails.
    """
    parts = F.split(host, r"\.")
    tail = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    at = lambda rule, suffix, i, rank: F.struct(rule.alias("s"), suffix.alias("of"), F.struct(F.lit(rank).alias("exception"), (-i).alias("labels")).alias("rank"))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array(at(tail(i), tail(i), i, 0), at(F.concat(F.lit("*."), tail(i + 1)), tail(i), i, 0), at(F.concat(F.lit("!"), tail(i)), tail(i + 1), i, 1))))
    asked = df.where(F.col(host).isNotNull()).select(key, F.explode(each).alias("x")).select(key, "x.*")
    found = asked.join(small(suffixes.select("s").distinct()), "s").groupBy(key).agg(F.max_by("of", "rank").alias("hit"))
    return df.join(found, key, "left").withColumn("suffix", F.coalesce("hit", F.element_at(parts, -1))).drop("hit")


def network_iocs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("type").isin("domain", "hostname", "IPv4", "URL"))


def sample_confidence(a: Column, b: Column) -> Column:
    """a, or b where a is zero or absent; at least 0.1; 1 where neither is known."""
    known = F.coalesce(F.nullif(a, F.lit(0.0)), b)
    return F.when(known.isNotNull(), F.greatest(known, F.lit(0.1))).otherwise(F.lit(1.0))


def select_targets(events: DataFrame, ids: DataFrame | None = None, include_labeled: bool = False) -> DataFrame:
    """The asked ids if there are any asked, else unlabelled events, or all."""
    if ids is not None:
        return events.join(ids.select("id").distinct(), "id", "left_semi")
    return events if include_labeled else events.where("apt is null")


def drop_mask(events: DataFrame, mode: str, n: int = 970, seed: int = 42) -> DataFrame:
    """Adds ``dropped`` (supervision only): A none, B year 2018, C 2018 and 2019, D the n least hashes of id and seed. No date counts as no year."""
    year = F.coalesce(F.year("created"), F.lit(-1))
    if mode == "D":
        least = events.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).withColumn("dropped", F.lit(True))
        return events.join(least, "id", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))
    years = {"A": (), "B": (2018,), "C": (2018, 2019)}[mode]
    return events.withColumn("dropped", year.isin(*years) if years else F.lit(False))


def supervised(events: DataFrame, source: str) -> DataFrame:
    return events.where((F.col("source") == source) & (F.col("y") != -1))


def zero_slots(vec: Column, ranges: list[tuple[int, int]]) -> Column:
    """The vector with the slots of the half-open ranges set to zero."""
    return F.transform(vec, lambda x, i: F.when(F.greatest(*[(i >= a) & (i < b) for a, b in ranges], F.lit(False)), F.lit(0.0)).otherwise(x))
