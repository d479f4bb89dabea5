"""Joins: labels and aliases, indicator matching, enrichment, event adjacency, near-duplicate titles (SURVEY C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators.lineage import settled, small


def resolve_edges(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges (src, dst) with both ends among the nodes (id); multiplicity is kept."""
    return edges.join(src.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(dst.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Adds the turned edges under ``rev_`` names; relations that have one already are not turned again."""
    there = edges.where(F.col("rel").startswith("rev_")).select(F.substring("rel", 5, 1000).alias("rel")).distinct()
    turned = edges.where(~F.col("rel").startswith("rev_")).join(there, "rel", "left_anti").select(F.col("dst").alias("src"), F.concat(F.lit("rev_"), "rel").alias("rel"), F.col("src").alias("dst"))
    return edges.select("src", "rel", "dst").unionByName(turned)


def unambiguous(tags: DataFrame, targets: DataFrame, aliases: DataFrame, scope: list[str]) -> DataFrame:
    """Targets (id, target) whose tags (id, tag) name one group in scope, the target, or none but the target's own name."""
    named = tags.join(small(aliases.where(F.col("group").isin(scope)).select(F.col("alias").alias("tag"), "group")), "tag", "left")
    per = named.groupBy("id").agg(F.countDistinct("group").alias("n_groups"), F.min("group").alias("only"), F.collect_set("tag").alias("tags"))
    keep = F.when(F.coalesce("n_groups", F.lit(0)) == 0, F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), F.lower("target"))).otherwise((F.col("n_groups") == 1) & (F.col("only") == F.col("target")))
    return targets.join(per, "id", "left").withColumn("keep", F.coalesce(keep, F.lit(False))).select("id", "target", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "keep")


#: Characters of the grams that patterns and texts are joined by.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def substring_mentions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): which patterns (pattern) stand anywhere in the texts (id, text), letter for letter; empty patterns nowhere, null texts have none.

    A pattern is looked for where the rarest of its grams stands: of ``GRAM`` characters, or the pattern itself if it is shorter. So texts and patterns meet
    by equal grams, whatever their number, and ``contains`` is asked of those alone; a pattern with a gram that no text has is never looked for. Texts are read
    twice, and stay where they are while the chosen grams, one of each pattern, are few enough to be sent to them.
    """
    texts = texts.select("id", "text").where("text is not null")
    known = settled(patterns.select("pattern").where("pattern <> ''").distinct().withColumn("n", F.least(F.length("pattern"), F.lit(GRAM))))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # at most GRAM numbers
    out = texts.select("id", F.lit(None).cast("string").alias("pattern")).limit(0)
    for n in sizes:
        own = settled(known.where(F.col("n") == n).select("pattern", F.explode(grams(F.col("pattern"), n)).alias("gram")))
        met = texts.select(F.explode(grams(F.col("text"), n)).alias("gram")).join(small(own.select("gram").distinct()), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
        rare = own.join(settled(met), "gram", "left").groupBy("pattern").agg(F.min_by(F.struct("gram", "often"), F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("x"))
        rare = settled(rare.where("x.often is not null").select("pattern", F.col("x.gram").alias("gram")))
        asked = texts.select("id", "text", F.explode(grams(F.col("text"), n)).alias("gram")).join(small(rare), "gram")
        out = out.unionByName(asked.where(F.contains("text", "pattern")).select("id", "pattern"))
    return out.distinct()


def alias_mentions(texts: DataFrame, aliases: DataFrame, min_len: int = 0) -> DataFrame:
    """(id, n_groups): distinct groups with an alias of more than ``min_len`` characters somewhere in each text (id, text), which is lower-cased; a mention need not
    begin or end with a word."""
    known = settled(aliases.where(F.length("alias") > min_len).select(F.col("alias").alias("pattern"), "group").distinct())
    met = substring_mentions(texts.select("id", F.lower("text").alias("text")), known.select("pattern"))
    found = met.join(small(known), "pattern").groupBy("id").agg(F.countDistinct("group").alias("n_groups"))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def match_iocs(iocs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_id of the first node (ioc_type, value, node_id) of the same type and value, whatever its case, and ``matched``."""
    first = nodes.groupBy("ioc_type", F.lower("value").alias("k")).agg(F.min("node_id").alias("node_id"))
    return iocs.withColumn("k", F.lower("value")).join(first, ["ioc_type", "k"], "left").drop("k").withColumn("matched", F.col("node_id").isNotNull())


def attach_temporal(nodes: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Adds lifespan_days and recency_days, 0 where a node was never seen."""
    return nodes.join(seen.select(key, "lifespan_days", "recency_days"), key, "left").fillna(0.0, ["lifespan_days", "recency_days"])


def title_sets(titles: DataFrame, key: str, label: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Titles by what they say: members (k, l, rep), where rep is the least key of a label with the same set of tokens, and sets (l, rep, s). Titles without a token are in neither."""
    tokens = titles.select(F.col(key).alias("k"), F.col(label).alias("l"), F.array_sort(T.title_tokens(F.col(text))).alias("s")).where(F.size("s") > 0)
    tokens = settled(tokens.withColumn("digest", F.sha2(F.array_join("s", " "), 256)))
    first = settled(tokens.groupBy("l", "digest").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m")))
    same = F.col("l").eqNullSafe(F.col("fl")) & (F.col("digest") == F.col("fd"))
    named = tokens.join(first.where("m > 1").select(F.col("l").alias("fl"), F.col("digest").alias("fd"), "rep"), same, "left")
    members = settled(named.select("k", "l", F.coalesce("rep", "k").alias("rep"), "s"))
    return members.select("k", "l", "rep"), members.where(F.col("k") == F.col("rep")).select("l", "rep", "s")


def set_pairs(sets: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(l, x, y, similarity): pairs of sets (l, rep, s) of one label with Jaccard at the threshold or above, x before y.

    Prefix filter: sets that reach the threshold share one of their first |x| - ceil(t |x|) + 1 tokens in order of rarity. Of sets that meet in one, those of too
    different a length go, and those whose tokens after the place where they meet cannot bring enough in common. Sets of a token that many begin with are dealt to
    tasks in blocks.
    """
    each = sets.where("l is not null").select("l", "rep", F.size("s").alias("n"), F.explode("s").alias("t"))
    often = each.groupBy("l", "t").agg(F.count(F.lit(1)).alias("f"))
    rare = Window.partitionBy("rep").orderBy("f", "t")
    prefix = each.join(often, ["l", "t"]).withColumn("r", F.row_number().over(rare)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    prefix = settled(prefix.select("l", "t", "rep", "n", "r"))
    blocks = prefix.groupBy("l", "t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("l", "t", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = prefix.join(blocks, ["l", "t"])
    one = met.select("l", "t", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"))
    two = met.select("l", "t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"))
    long_enough = F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9
    # the first token in common stands at rx and ry, so at most the fewer of what follows is in common besides it
    common = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) + F.least("rx", "ry")
    enough = common >= threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9
    near = one.join(two, ["l", "t", "b"]).where((F.col("x") < F.col("y")) & long_enough & enough).select("l", "x", "y").distinct()
    body = lambda at, to: sets.select(F.col("rep").alias(at), F.col("s").alias(to))
    checked = near.join(body("x", "sx"), "x").join(body("y", "sy"), "y")
    return checked.select("l", "x", "y", T.jaccard(F.col("sx"), F.col("sy")).alias("similarity")).where(F.col("similarity") >= threshold)


def title_pairs(titles: DataFrame, key: str, label: str, text: str, threshold: float = 0.92) -> DataFrame:
    """Pairs of titles of one label with token-set Jaccard at the threshold or above: (label, a, b, similarity), a before b.

    Every pair of rows is written out, also of equal sets; ``title_sets`` and ``set_pairs`` say the same by representatives and members. Rows of null
    labels pair with nothing.
    """
    members, sets = title_sets(titles, key, label, text)
    members = members.where("l is not null")
    checked = set_pairs(sets, threshold).select("x", "y", "similarity")
    one, two = members.select("l", F.col("k").alias("p"), F.col("rep").alias("x")), members.select(F.col("k").alias("q"), F.col("rep").alias("y"))
    unequal = checked.join(one, "x").join(two, "y").select("l", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    equal = one.join(two, one.x == two.y).where("p < q").select("l", F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    return unequal.unionByName(equal).withColumnRenamed("l", label)


def title_dedup(titles: DataFrame, key: str, label: str, text: str, threshold: float = 0.92) -> DataFrame:
    """Keeps a title unless an earlier kept one of its label is a near-duplicate; dropped titles drop no other.

    Of titles with equal sets all but the first go at once: it is kept, or what drops it drops them too. Each round decides the titles
    whose earlier matches are all decided, so there are as many rounds as the longest chain of matches.
    """
    members, sets = title_sets(titles, key, label, text)
    copies = members.where("l is not null and k > rep").select(F.col("k").alias(key))
    titles = titles.join(copies, key, "left_anti")
    pairs = settled(set_pairs(sets, threshold).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    decided = pairs.select(F.col("a").alias("k")).distinct().join(pairs.select(F.col("b").alias("k")), "k", "left_anti").withColumn("kept", F.lit(True))
    while True:
        known = pairs.join(decided.select(F.col("k").alias("a"), "kept"), "a", "left").join(decided.select(F.col("k").alias("b")), "b", "left_anti")
        per = known.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("n_known"), F.coalesce(F.max("kept"), F.lit(False)).alias("any_kept"))
        more = settled(per.where("any_kept or n = n_known").select(F.col("b").alias("k"), (~F.col("any_kept")).alias("kept")))
        if more.isEmpty():
            break
        decided = decided.unionByName(more)
    return titles.join(decided.where("not kept").select(F.col("k").alias(key)), key, "left_anti")


#: Events of an indicator that one task pairs with as many, on average; those of more are dealt to tasks in blocks.
BLOCK = 4096


def event_adjacency(edges: DataFrame, events: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(i, j): events that share an indicator of one type, both ways, and every event with itself.

    edges: (id, ioc_type, ioc). With ``max_degree`` indicators of more events than that are left out; ``skipped_hubs`` tells which.
    Indicators of one event pair nothing, so they are dropped before the self-join. The events of a hub are cut into blocks, each of which
    meets all of them, so its pairs are made by many tasks.
    """
    e = edges.select("id", "ioc_type", "ioc").distinct()
    degree = e.groupBy("ioc_type", "ioc").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    if max_degree is not None:
        degree = degree.where(F.col("d") <= max_degree)
    e = e.join(degree.select("ioc_type", "ioc", F.ceil(F.col("d") / BLOCK).cast("int").alias("blocks")), ["ioc_type", "ioc"])
    one = e.select("ioc_type", "ioc", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("i"))
    all_ = e.select("ioc_type", "ioc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("j"))
    pairs = one.join(all_, ["ioc_type", "ioc", "block"]).where("i <> j").select("i", "j").distinct()
    return pairs.unionByName(events.select(F.col("id").alias("i"), F.col("id").alias("j")))


def skipped_hubs(edges: DataFrame, max_degree: int) -> DataFrame:
    return edges.groupBy("ioc_type", "ioc").agg(F.countDistinct("id").alias("d")).where(F.col("d") > max_degree)


def with_nation(df: DataFrame, dim: DataFrame, label: str = "label") -> DataFrame:
    """Adds the label's nation, null for labels without one."""
    return df.join(small(dim.select(F.col("label").alias(label), "nation")), label, "left")


def enrich_asn(ips: DataFrame, lookups: DataFrame, as_of: Column, ttl_days: float = 1.0) -> DataFrame:
    """The latest lookup (ip, asn_text, country, fetched_at) of each ip not older than the time to live; those without a number are ignored."""
    age = T.days_between(as_of, F.col("fetched_at"))
    fresh = lookups.where((age >= 0) & (age <= ttl_days) & T.asn_number(F.col("asn_text")).isNotNull())
    last = fresh.groupBy("ip").agg(F.max_by(F.struct("asn_text", "country"), F.struct("fetched_at", "asn_text")).alias("l"))
    return ips.join(last, "ip", "left").select("ip", T.asn_number(F.col("l.asn_text")).alias("asn_number"), T.asn_name(F.coalesce("l.asn_text", F.lit(""))).alias("asn_name"), F.upper("l.country").alias("country"))


def as_of(rows: DataFrame, lookups: DataFrame, key: str, at: str, fetched: str, ttl_days: float) -> DataFrame:
    """``rows`` with ``found``: of the lookups of their key the last one that was fetched by the row's own time ``at`` and not more than ``ttl_days`` before it, as a struct of the
    other columns and the time; null without any, without a time, or without a key. Of lookups of one time the largest counts.

    Both are sorted together, and a row takes the last lookup before it. As none holds for longer than the time to live, rows and lookups of a key meet within
    spans of that length alone (a lookup in its own and the next one), so a key that most rows have is dealt to as many tasks as it has spans.
    """
    others = [c for c in lookups.columns if c not in (key, fetched)]
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    span = lambda c: F.floor(seconds(c) / (ttl_days * 86400.0)).cast("long")
    left = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("_key"), seconds(at).alias("_at"), F.when(F.col(key).isNotNull(), span(at)).alias("_span"), F.lit(None).cast(lookups.select(F.struct(*others, fetched)).schema[0].dataType).alias("_found"))
    known = lookups.where(F.col(key).isNotNull() & F.col(fetched).isNotNull())
    right = known.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(key).alias("_key"), seconds(fetched).alias("_at"), F.explode(F.array(span(fetched), span(fetched) + 1)).alias("_span"), F.struct(*others, fetched).alias("_found"))
    timed = left.where("_span is not null").unionByName(right)
    before = Window.partitionBy("_key", "_span").orderBy("_at", F.col("row").isNotNull(), "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = timed.withColumn("last", F.last("_found", ignorenulls=True).over(before)).where("row is not null")
    held = F.when(F.col("_at") - F.col(f"last.{fetched}").cast("timestamp").cast("double") <= ttl_days * 86400.0, F.col("last"))
    out = last.select("row", held.alias("found")).unionByName(left.where("_span is null").select("row", F.col("_found").alias("found")))
    return out.select("row.*", "found")


def top_n_per(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each group before it is shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def report_hosts(iocs: DataFrame) -> DataFrame:
    """Domains and ips of reports (id, ioc_type, ioc, pos) with the hosts of their urls: (id, ioc_type, ioc, pos). Hosts come after all that a report lists itself, in the
    order of their urls; what is listed twice stands at its first place."""
    own = iocs.where(F.col("ioc_type").isin("domain", "ip")).select("id", "ioc_type", "ioc", F.struct(F.lit(0).alias("later"), F.col("pos").cast("long").alias("pos")).alias("pos"))
    hosts = url_edges(iocs.where("ioc_type = 'url'").select("id", F.col("ioc").alias("url"), "pos")).where("edge is not null")
    hosts = hosts.select("id", F.col("edge").alias("ioc_type"), F.col("host").alias("ioc"), F.struct(F.lit(1).alias("later"), F.col("pos").cast("long").alias("pos")).alias("pos"))
    return own.unionByName(hosts).groupBy("id", "ioc_type", "ioc").agg(F.min("pos").alias("pos"))


def expand_pdns(iocs: DataFrame, pdns: DataFrame, caps: tuple[int, int, int] = (40, 20, 30), lookups: DataFrame | None = None, times: DataFrame | None = None, ttl_days: float = 1.0) -> DataFrame:
    """Passive DNS and networks around a report's indicators (id, ioc_type, ioc, pos): (id, hop, domain, ip, asn_number).

    Hop 1: the first ``caps[0]`` domains of a report, in its order and with the hosts of its urls after them, lead to ``caps[1]`` ips each. Hop 2: those ips and the report's own
    lead to ``caps[2]`` domains each. Hop 3, with ``lookups`` (ip, asn_text, fetched_at) and ``times`` (id, at): each of those ips has one network, as it was last looked up by the
    report's own time within ``ttl_days``; ips without one are left out. pdns: (domain, ip), no pair twice.
    """
    listed = settled(report_hosts(iocs))
    domains = top_n_per(listed.where("ioc_type = 'domain'").select("id", "pos", F.col("ioc").alias("domain")), ["id"], ["pos", "domain"], caps[0])
    forward = top_n_per(pdns.select("domain", "ip"), ["domain"], ["ip"], caps[1]).select("domain", "ip")
    one = settled(domains.select("id", "domain").join(forward, "domain").select("id", F.lit(1).alias("hop"), "domain", "ip", F.lit(None).cast("int").alias("asn_number")))
    reverse = top_n_per(pdns.select("domain", "ip"), ["ip"], ["domain"], caps[2]).select("domain", "ip")
    ips = settled(one.select("id", "ip").unionByName(listed.where("ioc_type = 'ip'").select("id", F.col("ioc").alias("ip"))).distinct())
    out = one.unionByName(ips.join(reverse, "ip").select("id", F.lit(2).alias("hop"), "domain", "ip", F.lit(None).cast("int").alias("asn_number")))
    if lookups is None:
        return out
    numbered = lookups.where(T.asn_number(F.col("asn_text")).isNotNull()).select("ip", "asn_text", "fetched_at")
    found = as_of(ips.join(times.select("id", "at"), "id"), numbered, "ip", "at", "fetched_at", ttl_days).where("found is not null")
    return out.unionByName(found.select("id", F.lit(3).alias("hop"), F.lit(None).cast(out.schema["domain"].dataType).alias("domain"), "ip", T.asn_number(F.col("found.asn_text")).alias("asn_number")))


def pending(reports: DataFrame, done: DataFrame) -> DataFrame:
    return reports.join(done.select("id").distinct(), "id", "left_anti")


def url_edges(urls: DataFrame) -> DataFrame:
    """Host of each url and the kind of its edge: ip for numeric hosts, domain for others, none without a host."""
    host = T.url_host(F.col("url"))
    return urls.withColumn("host", host).withColumn("edge", F.when(F.col("host").isNull(), F.lit(None)).when(T.is_ipv4_like(F.col("host")), "ip").otherwise("domain"))


def hop2_share(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Share of events that share an indicator with another event; by degrees, without pairs."""
    e = edges.select("id", "ioc_type", "ioc").distinct()
    shared = e.groupBy("ioc_type", "ioc").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    linked = e.join(shared, ["ioc_type", "ioc"], "left_semi").select("id").distinct()
    return _share(events, linked)


def hop4_share(edges: DataFrame, groups: DataFrame, events: DataFrame) -> DataFrame:
    """Share of events that reach another event over event, ip, network, ip, event."""
    e = edges.where("ioc_type = 'ip'").select("id", F.col("ioc").alias("ip")).join(groups.select("ip", "asn"), "ip").select("id", "asn").distinct()
    shared = e.groupBy("asn").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    return _share(events, e.join(shared, "asn", "left_semi").select("id").distinct())


def _share(events: DataFrame, linked: DataFrame) -> DataFrame:
    hit = events.select("id").join(linked.withColumn("hit", F.lit(1)), "id", "left")
    return hit.agg(F.count(F.lit(1)).alias("n_events"), F.count("hit").alias("n_linked"), F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 6).alias("share"))


def attach_queries(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ad-hoc requests (request_id, ioc_type, value): an event per request, linked to matched nodes, and to new ones for the rest."""
    found = match_iocs(requests.select("request_id", "ioc_type", "value").distinct(), nodes)
    node = F.when(F.col("matched"), F.concat("ioc_type", F.lit(":"), "node_id")).otherwise(F.concat(F.lit("new:"), "ioc_type", F.lit(":"), "value"))
    return found.select(F.concat(F.lit("request:"), "request_id").alias("event"), "ioc_type", node.alias("node"), "matched")


def per_ioc_events(iocs: DataFrame, nodes: DataFrame, keep_unmatched: bool) -> DataFrame:
    """One event per distinct indicator, with or without those that no node has."""
    found = match_iocs(iocs.select("ioc_type", "value").distinct(), nodes)
    found = found if keep_unmatched else found.where("matched")
    return found.select(F.concat("ioc_type", F.lit("|"), "value").alias("event"), "ioc_type", "node_id", "matched")
