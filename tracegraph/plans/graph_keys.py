"""Queries over reports, indicators and edges (SURVEY A, B, C, G), each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators import clean, implicit, link, rank, stats
from tracegraph.sources.fixtures import Tables, sql

Q: dict = {}
SQL: dict = {}


def key(name: str, twin: str | None = None, *views: str):
    """Registers a query of (Tables), and its SQL after the views it needs."""

    def put(f):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if twin is not None:
            SQL[name] = sql(twin, *views)
        return f

    return put


def pulses(t: Tables):
    """Orders as reports whose indicators are their parts; every ninth indicator is blank."""
    li = t.lineitem
    name = F.when(F.col("l_partkey") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" D"), "l_partkey"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("domain", "hostname", "IPv4", "URL", "CVE")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    ind = li.select(F.col("l_orderkey").alias("id"), F.struct(name.alias("indicator"), kind.alias("type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created")).alias("i"))
    return t.orders.select(F.col("o_orderkey").alias("id")).join(ind.groupBy("id").agg(F.collect_list("i").alias("indicators")), "id", "left")


INDICATORS = """i AS (SELECT l_orderkey AS id, trim(CASE WHEN l_partkey % 9 = 0 THEN '  ' ELSE ' D' || l_partkey END) AS indicator,
  ['domain','hostname','IPv4','URL','CVE'][l_linenumber % 5 + 1] AS type, strftime(l_shipdate, '%Y-%m-%d') AS created FROM lineitem)"""


@key("graph_load_counts", "SELECT 'event' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'domain', count(*) FROM part UNION ALL SELECT 'ip', count(*) FROM supplier UNION ALL SELECT 'url', count(*) FROM pages UNION ALL SELECT 'asn', count(*) FROM nation")
def graph_load_counts(t):
    of = {"event": t.orders, "domain": t.part, "ip": t.supplier, "url": t.pages, "asn": t.nation}
    rows = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, df in of.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@key("pulse_explode", f"WITH {INDICATORS} SELECT o_orderkey AS id, indicator, type, created FROM orders LEFT JOIN i ON id = o_orderkey WHERE indicator IS NULL OR indicator <> ''")
def pulse_explode(t):
    return clean.explode_indicators(pulses(t))


@key("pdns_clean", """WITH a AS (SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Host' || l_partkey || '.Example.' END AS hostname, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE '10.0.' || (l_suppkey % 256) || '.1' END AS address, ['a','AAAA','MX','txt'][l_suppkey % 4 + 1] AS record_type FROM lineitem),
f AS (SELECT 'forward' AS direction, k, upper(record_type) AS record_type, coalesce(nullif(address, ''), nullif(hostname, '')) AS value FROM a WHERE upper(record_type) IN ('A', 'AAAA')),
r AS (SELECT 'reverse' AS direction, k, upper(record_type) AS record_type, trim(lower(coalesce(nullif(hostname, ''), nullif(address, ''))), '.') AS value FROM a WHERE upper(record_type) IN ('A', 'AAAA'))
SELECT * FROM f WHERE value <> '' UNION ALL SELECT * FROM r WHERE value <> '' AND NOT regexp_full_match(replace(value, '.', ''), '[0-9]+')""")
def pdns_clean(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("a", "AAAA", "MX", "txt")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    host = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("Host"), "l_partkey", F.lit(".Example.")))
    address = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("10.0."), F.col("l_suppkey") % 256, F.lit(".1")))
    a = t.lineitem.select(F.col("l_partkey").alias("k"), host.alias("hostname"), address.alias("address"), kind.alias("record_type"))
    both = [clean.clean_pdns(a, d).select(F.lit(d).alias("direction"), "k", "record_type", "value") for d in ("forward", "reverse")]
    return both[0].unionByName(both[1])


@key("alias_dim", "WITH s AS (SELECT p_type AS name, lower(p_brand) AS alias, p_partkey AS position FROM part) SELECT alias, arg_max(name, position) AS \"group\" FROM s GROUP BY alias")
def alias_dim(t):
    sets = t.part.select(F.col("p_type").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_partkey").alias("position"))
    return clean.alias_dimension(sets)


@key("upsert_results", "SELECT n_nationkey AS config, 'old' AS run, n_regionkey AS v FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 'new', n_nationkey * 2 FROM nation WHERE n_nationkey % 3 = 0")
def upsert_results(t):
    old = t.nation.select(F.col("n_nationkey").alias("config"), F.lit("old").alias("run"), F.col("n_regionkey").alias("v"))
    new = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("config"), F.lit("new").alias("run"), (F.col("n_nationkey") * 2).alias("v"))
    return clean.upsert_by_key(old, new, ["config"])


def predicted(t: Tables):
    """Unlabelled events predicted by their customer's segment, with a confidence from the price."""
    p = t.orders.where("o_orderstatus = 'P'").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return p.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("predicted_apt"), F.round(F.col("o_totalprice") / 600000, 4).alias("confidence"), F.lit("lp").alias("method"))


STORED = """s AS (SELECT o.o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN c_mktsegment END AS predicted_apt, CASE WHEN o_orderstatus = 'P' AND c_mktsegment IS NOT NULL THEN round(o_totalprice / 600000, 4) END AS prediction_confidence,
 CASE WHEN o_orderstatus = 'P' AND c_custkey IS NOT NULL THEN 'lp' END AS prediction_method, CASE WHEN o_orderstatus = 'P' AND c_custkey IS NOT NULL THEN '2024-01-01T00:00:00Z' END AS prediction_timestamp FROM orders o LEFT JOIN customer ON o_custkey = c_custkey)"""


@key("store_predictions", f"WITH {STORED} SELECT * FROM s")
def store_predictions(t):
    return clean.store_predictions(t.event().select("id"), predicted(t), "2024-01-01T00:00:00Z")


@key("results_top", f"WITH {STORED} SELECT id, predicted_apt, prediction_confidence FROM s WHERE predicted_apt IS NOT NULL ORDER BY prediction_confidence DESC, id LIMIT 500")
def results_top(t):
    return clean.results_top(store_predictions(t)).select("id", "predicted_apt", "prediction_confidence")


@key("results_by_label", f"WITH {STORED} SELECT predicted_apt, count(*) AS n FROM s WHERE predicted_apt IS NOT NULL GROUP BY 1")
def results_by_label(t):
    return store_predictions(t).where("predicted_apt is not null").groupBy("predicted_apt").agg(F.count(F.lit(1)).alias("n"))


@key("merge_edge_seen", """WITH e AS (SELECT l_partkey AS domain, l_suppkey AS ip, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS s FROM lineitem)
SELECT domain, ip, min(nullif(trim(s), '')) AS first_seen, max(nullif(trim(s), '')) AS last_seen FROM e GROUP BY 1, 2""")
def merge_edge_seen(t):
    s = F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return clean.merge_edges(t.lineitem.select(F.col("l_partkey").alias("domain"), F.col("l_suppkey").alias("ip"), s.alias("first_seen"), s.alias("last_seen")), ["domain", "ip"])


@key("ioc_route", f"WITH {INDICATORS} SELECT id, CASE WHEN type IN ('domain', 'hostname') THEN 'domain' WHEN type = 'IPv4' THEN 'ip' ELSE 'url' END AS kind, CASE WHEN type IN ('domain', 'hostname') THEN lower(indicator) ELSE indicator END AS value FROM i WHERE indicator <> '' AND type <> 'CVE'")
def ioc_route(t):
    return clean.route_iocs(pulse_explode(t).where("indicator is not null")).select("id", "kind", "value")


@key("refang", "SELECT page_id, replace(replace(url, 'http', 'hxxp'), '.', '[.]') AS masked, url AS clean_url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS clean_domain FROM pages")
def refang(t):
    masked = F.replace(F.replace("url", F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]"))
    p = t.pages.select("page_id", "url", masked.alias("masked"))
    host = F.concat(F.lit(" "), F.upper(F.replace(T.url_host(F.col("url")), F.lit("."), F.lit("(.)"))), F.lit(" "))
    return p.select("page_id", "masked", T.refang(F.col("masked"), "url").alias("clean_url"), T.refang(host, "domain").alias("clean_domain"))


@key("date_window", "SELECT id, created FROM fx_event WHERE created >= TIMESTAMP '1997-01-01' AND created < TIMESTAMP '1998-07-01'", "fx_event")
def date_window(t):
    return clean.in_window(t.event(), "created", "1997-01-01", "1998-07-01").select("id", "created")


@key("label_encode", "SELECT id, apt, coalesce(idx, -1) AS y FROM fx_event LEFT JOIN (SELECT * FROM fx_label_dim WHERE label IN ('1-URGENT', '3-MEDIUM', '5-LOW')) ON apt = label", "fx_event", "fx_label_dim")
def label_encode(t):
    return clean.encode_labels(t.event(), t.label_dim(), ["1-URGENT", "3-MEDIUM", "5-LOW"]).select("id", "apt", "y")


@key("in_vocab", "SELECT id, apt FROM fx_event WHERE apt IN (SELECT label FROM fx_label_dim WHERE nation IS NOT NULL)", "fx_event", "fx_label_dim")
def in_vocab(t):
    return clean.in_vocab(t.event(), t.label_dim().where("nation is not null").select(F.lower("label").alias("label"))).select("id", "apt")


@key("label_confidence", "SELECT id, CASE WHEN k IS NULL THEN 1.0::DOUBLE ELSE greatest(k, 0.1::DOUBLE) END AS confidence FROM (SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE WHEN id % 3 = 1 THEN label_confidence END, 0.0::DOUBLE), CASE WHEN id % 5 <> 0 THEN label_confidence / 2 END) AS k FROM fx_event)", "fx_event")
def label_confidence(t):
    a = F.when(F.col("id") % 3 == 0, F.lit(0.0)).when(F.col("id") % 3 == 1, F.col("label_confidence"))
    b = F.when(F.col("id") % 5 != 0, F.col("label_confidence") / 2)
    return t.event().select("id", clean.sample_confidence(a, b).alias("confidence"))


@key("asn_parse", "SELECT ip, asn AS asn_number, substr(asn_text, length('AS' || asn) + 2) AS asn_name FROM fx_in_group WHERE ip % 2 = 0 UNION ALL SELECT ip, NULL, '' FROM fx_in_group WHERE ip % 2 = 1", "fx_in_group")
def asn_parse(t):
    text = F.when(F.col("ip") % 2 == 0, F.lower("asn_text")).otherwise(F.concat(F.lit("no "), "asn_text"))
    return t.in_group().select("ip", text.alias("x"), "asn_text").select("ip", T.asn_number(F.col("x")).alias("asn_number"), F.upper(T.asn_name(F.col("x"))).alias("asn_name"))


@key("predict_targets", "SELECT 'open' AS ask, id FROM fx_event WHERE apt IS NULL UNION ALL SELECT 'ids', id FROM fx_event WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)", "fx_event")
def predict_targets(t):
    ids = t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("id"))
    return clean.select_targets(t.event()).select(F.lit("open").alias("ask"), "id").unionByName(clean.select_targets(t.event(), ids).select(F.lit("ids").alias("ask"), "id"))


@key("year_drop_b", "SELECT id, coalesce(year(created) = 2018, false) AS dropped FROM (SELECT id, created + INTERVAL 20 YEAR AS created FROM fx_event)", "fx_event")
def year_drop_b(t):
    return clean.drop_mask(t.event().withColumn("created", F.col("created") + F.expr("interval 20 years")), "B").select("id", "dropped")


@key("year_drop_c", "SELECT id, coalesce(year(created) IN (2018, 2019), false) AS dropped FROM (SELECT id, created + INTERVAL 20 YEAR AS created FROM fx_event)", "fx_event")
def year_drop_c(t):
    return clean.drop_mask(t.event().withColumn("created", F.col("created") + F.expr("interval 20 years")), "C").select("id", "dropped")


@key("random_drop")
def random_drop(t):
    return clean.drop_mask(t.event(), "D").select("id", "dropped")


@key("url_host_split", "SELECT page_id, host, CASE WHEN regexp_full_match(replace(host, '.', ''), '[0-9]+') THEN 'ip' ELSE 'domain' END AS edge FROM fx_hosted_on", "fx_hosted_on")
def url_host_split(t):
    return link.url_edges(t.pages.select("page_id", "url")).select("page_id", "host", "edge")


@key("supervised_mask", "SELECT id, idx AS y FROM fx_event JOIN fx_label_dim ON apt = label WHERE source = 'F'", "fx_event", "fx_label_dim")
def supervised_mask(t):
    return clean.supervised(clean.encode_labels(t.event(), t.label_dim()), "F").select("id", "y")


@key("zero_temporal", "SELECT vec_id, i::INT AS slot, CASE WHEN i >= 62 THEN 0::DOUBLE ELSE embedding[i + 1]::DOUBLE END AS value FROM embeddings, range(64) r(i)")
def zero_temporal(t):
    v = t.embeddings.select("vec_id", clean.zero_slots(F.col("embedding").cast("array<double>"), [(62, 64)]).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("slot", "value"))


@key("edge_resolve", "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def edge_resolve(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return link.resolve_edges(edges, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), t.part.where("p_size <= 25").select(F.col("p_partkey").alias("id")))


@key("edge_reverse", "SELECT domain AS src, 'resolves_to' AS rel, ip AS dst FROM fx_resolves_to UNION ALL SELECT ip, 'rev_resolves_to', domain FROM fx_resolves_to", "fx_resolves_to")
def edge_reverse(t):
    return link.with_reverse(t.resolves_to().select(F.col("domain").alias("src"), F.lit("resolves_to").alias("rel"), F.col("ip").alias("dst")))


SCOPE = ["G0", "G1", "G2", "G3"]
TARGET = 'fx_target AS (SELECT id, arg_min("group", line::VARCHAR || tag) AS target, arg_min(nation, line::VARCHAR || tag) AS target_nation, count(*) AS n_iocs, string_agg(p_name, \' \' ORDER BY line, p_name) AS text FROM fx_tags JOIN fx_aliases ON tag = alias GROUP BY id)'


def reports(t: Tables):
    """Orders with lines as reports: the group of the first line as target, its nation, number of lines, names as text."""
    rows = t.tags().join(t.aliases().withColumnRenamed("alias", "tag"), "tag")
    first = F.min_by(F.struct("group", "nation"), F.struct("line", "tag"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "p_name"))), lambda x: x["p_name"]), " ")
    return rows.groupBy("id").agg(first.alias("f"), F.count(F.lit(1)).alias("n_iocs"), text.alias("text")).select("id", F.col("f.group").alias("target"), F.col("f.nation").alias("target_nation"), "n_iocs", "text")


@key("unambiguous_label", f"""WITH {{V}}, {TARGET},
g AS (SELECT id, count(DISTINCT CASE WHEN "group" IN ('G0','G1','G2','G3') THEN "group" END) AS n_groups, min(CASE WHEN "group" IN ('G0','G1','G2','G3') THEN "group" END) AS only_one FROM fx_tags JOIN fx_aliases ON tag = alias GROUP BY id)
SELECT id, target, n_groups, n_groups = 1 AND only_one = target AS keep FROM fx_target JOIN g USING (id)""")
def unambiguous_label(t):
    return link.unambiguous(t.tags().select("id", "tag"), reports(t).select("id", "target"), t.aliases(), SCOPE)


@key("alias_mentions", """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias, p_type AS "group" FROM part), x AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part)
SELECT id, count(DISTINCT "group") AS n_groups FROM x LEFT JOIN a ON contains(lower(text), alias) AND length(alias) > 3 GROUP BY id""")
def alias_mentions(t):
    aliases = t.part.select(F.split("p_name", " ")[0].alias("alias"), F.col("p_type").alias("group")).distinct()
    return link.alias_mentions(t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("text")), aliases, 3)


NODES = "fx_nodes AS (SELECT 'url' AS ioc_type, lower(url) AS k, min(page_id) AS node_id FROM pages GROUP BY 2)"


@key("ioc_match", f"WITH {{V}}, {NODES} SELECT request_id, r.ioc_type, value, node_id, node_id IS NOT NULL AS matched FROM fx_requests r LEFT JOIN fx_nodes ON k = lower(value)")
def ioc_match(t):
    return link.match_iocs(t.requests().select("request_id", "ioc_type", "value"), t.url_nodes())


AS_OF = "1999-06-01"


def node_spans(name: str, nodes: str, of: str, key_: str) -> str:
    return f"SELECT {name}{nodes} AS {key_}, round(coalesce(epoch_us(max(last_seen)) - epoch_us(min(first_seen)), 0) / 8.64e10, 4) AS lifespan_days, round(greatest(coalesce(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(last_seen)), 0) / 8.64e10, 0), 4) AS recency_days FROM {of} LEFT JOIN fx_resolves_to ON {nodes} = fx_resolves_to.{'domain' if of == 'part' else 'ip'} GROUP BY {nodes}"


def temporal(t, nodes, key_: str):
    seen = stats.seen_span(t.resolves_to(), key_, F.lit(AS_OF).cast("timestamp"))
    return link.attach_temporal(nodes, seen, key_)


@key("node_temporal", "WITH {V} " + node_spans("", "s_suppkey", "supplier", "ip"))
def node_temporal(t):
    """Spans of all ips, over all resolution edges."""
    return temporal(t, t.supplier.select(F.col("s_suppkey").alias("ip")), "ip")


@key("node_temporal_all", "WITH {V} " + node_spans("'domain' AS kind, ", "p_partkey", "part", "id") + " UNION ALL " + node_spans("'ip' AS kind, ", "s_suppkey", "supplier", "id"))
def node_temporal_all(t):
    """Spans of domains and ips."""
    of = lambda nodes, k: temporal(t, nodes, k).select(F.lit(k).alias("kind"), F.col(k).alias("id"), "lifespan_days", "recency_days")
    return of(t.part.select(F.col("p_partkey").alias("domain")), "domain").unionByName(of(t.supplier.select(F.col("s_suppkey").alias("ip")), "ip"))


@key("title_pairs", """WITH {V}, s AS (SELECT doc_id, lang, list_distinct(list_transform(list_filter(regexp_extract_all(title, '[A-Za-z0-9]+'), lambda x: length(x) >= 3), lambda x: lower(x))) AS s FROM fx_title)
SELECT * FROM (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity
 FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0) WHERE similarity >= 0.92""")
def title_pairs(t):
    return link.title_pairs(t.title(), "doc_id", "lang", "title").select("lang", "a", "b", F.round("similarity", 6).alias("similarity"))


@key("text_pairs", """WITH s AS (SELECT doc_id, lang, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) >= 3), lambda x: lower(x))) AS s FROM documents)
SELECT * FROM (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity
 FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0) WHERE similarity >= 0.92""")
def text_pairs(t):
    """Pairs of whole texts; ``title_pairs`` is over the titles of pages."""
    return link.title_pairs(t.whole_text(), "doc_id", "lang", "title").select("lang", "a", "b", F.round("similarity", 6).alias("similarity"))


@key("text_sets", """WITH s AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) >= 3), lambda x: lower(x)))) AS s FROM documents),
r AS (SELECT lang, s, min(doc_id) AS rep, count(*) AS members FROM s WHERE len(s) > 0 AND lang IS NOT NULL GROUP BY lang, s), p AS (SELECT a.rep AS x, b.rep AS y FROM r a JOIN r b ON a.lang = b.lang AND a.rep < b.rep WHERE round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) >= 0.92)
SELECT rep, members, (SELECT count(*) FROM p WHERE x = rep OR y = rep) AS near FROM r""")
def text_sets(t):
    """Whole texts by representatives of equal token sets: their members and the representatives near them, without a row for each pair of texts."""
    members, sets = link.title_sets(t.whole_text(), "doc_id", "lang", "title")
    pairs = link.set_pairs(sets)
    near = pairs.select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("near"))
    per = members.where("l is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    return per.join(near, "rep", "left").select("rep", "members", F.coalesce("near", F.lit(0)).alias("near"))


@key("title_dedup")
def title_dedup(t):
    return link.title_dedup(t.title(), "doc_id", "lang", "title")


@key("event_adjacency", """WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ioc FROM lineitem), p AS (SELECT DISTINCT a.id AS i, b.id AS j FROM e a JOIN e b ON a.ioc = b.ioc WHERE a.id <> b.id)
SELECT i, count(*) AS degree, sum(j)::BIGINT AS sum_j FROM (SELECT * FROM p UNION ALL SELECT o_orderkey, o_orderkey FROM orders) GROUP BY i""")
def event_adjacency(t):
    return link.event_adjacency(t.in_report("domain"), t.event()).groupBy("i").agg(F.count(F.lit(1)).alias("degree"), F.sum("j").alias("sum_j"))


PAIRS = "p AS (SELECT DISTINCT a.id AS i, b.id AS j FROM fx_in_report a JOIN fx_in_report b ON a.ioc_type = b.ioc_type AND a.ioc = b.ioc WHERE a.id <> b.id)"


@key("event_adjacency_all", f"WITH {{V}}, {PAIRS} SELECT i, count(*) AS degree, sum(j)::BIGINT AS sum_j FROM (SELECT * FROM p UNION ALL SELECT o_orderkey, o_orderkey FROM orders) GROUP BY i")
def event_adjacency_all(t):
    """Adjacency over indicators of all types by products, without pairs; ``event_adjacency`` makes the pairs of domains."""
    s = implicit.shared(t.in_report(), t.event())
    ids = s.members.groupBy("node").agg(F.sum("id").alias("value"))
    met = implicit.product(s, ids, []).join(implicit.degrees(s), "node").select("node", F.col("degree").cast("long").alias("degree"), F.col("value").alias("sum_j"))
    return s.members.join(met, "node").select(F.col("id").alias("i"), "degree", "sum_j")


@key("label_nation", "SELECT id, apt, nation FROM fx_event LEFT JOIN fx_label_dim ON apt = label", "fx_event", "fx_label_dim")
def label_nation(t):
    return link.with_nation(t.event(), t.label_dim(), "apt").select("id", "apt", "nation")


@key("asn_enrich", """WITH {V}, l AS (SELECT l_suppkey AS ip, asn_text, 'cc' || (l_suppkey % 5) AS country, l_shipdate AS fetched_at FROM lineitem JOIN fx_in_group ON ip = l_suppkey),
f AS (SELECT ip, max(asn_text) AS asn_text, max(country) AS country FROM l WHERE fetched_at <= TIMESTAMP '1998-06-01' AND fetched_at >= TIMESTAMP '1998-06-01' - INTERVAL 10 DAY GROUP BY ip)
SELECT s_suppkey AS ip, regexp_extract(asn_text, '^AS([0-9]+)', 1)::INT AS asn_number, coalesce(trim(regexp_extract(asn_text, '^AS[0-9]+ *(.*)$', 1)), '') AS asn_name, upper(country) AS country FROM supplier LEFT JOIN f ON ip = s_suppkey""")
def asn_enrich(t):
    looked = t.lineitem.select(F.col("l_suppkey").alias("ip"), F.concat(F.lit("cc"), F.col("l_suppkey") % 5).alias("country"), F.col("l_shipdate").alias("fetched_at")).join(t.in_group().select("ip", "asn_text"), "ip")
    return link.enrich_asn(t.supplier.select(F.col("s_suppkey").alias("ip")), looked, F.lit("1998-06-01").cast("timestamp"), 10.0)


LISTED = """li AS (SELECT l_orderkey AS id, 'domain' AS ioc_type, 'd' || l_partkey AS ioc, l_linenumber AS pos FROM lineitem UNION ALL SELECT l_orderkey, 'ip', '10.' || l_suppkey, l_linenumber FROM lineitem
 UNION ALL SELECT l_orderkey, 'url', CASE WHEN l_orderkey % 5 = 0 THEN 'http://10.' || (l_suppkey % 50) || '/x' ELSE 'http://D' || (l_partkey * 7 % 500) || '/x' END, l_linenumber FROM lineitem WHERE l_linenumber <= 2)"""


def listed(t):
    """Orders' lines as listed domains, ips and, of the first two, urls, with their places."""
    li = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey")
    url = F.when(F.col("id") % 5 == 0, F.concat(F.lit("http://10."), F.col("l_suppkey") % 50, F.lit("/x"))).otherwise(F.concat(F.lit("http://D"), F.col("l_partkey") * 7 % 500, F.lit("/x")))
    of = lambda k, v: F.struct(F.lit(k).alias("ioc_type"), v.alias("ioc"))
    each = F.array_compact(F.array(of("domain", F.concat(F.lit("d"), "l_partkey")), of("ip", F.concat(F.lit("10."), "l_suppkey")), F.when(F.col("pos") <= 2, of("url", url))))
    return li.select("id", "pos", F.explode(each).alias("x")).select("id", "x.ioc_type", "x.ioc", "pos")


AROUND = f"""{LISTED}, h AS (SELECT id, ioc_type, ioc, [0, pos] AS pos FROM li WHERE ioc_type <> 'url' UNION ALL SELECT id, CASE WHEN host LIKE '10.%' THEN 'ip' ELSE 'domain' END, host, [1, pos] FROM (SELECT id, pos, lower(regexp_extract(ioc, '//([^/]+)/', 1)) AS host FROM li WHERE ioc_type = 'url')),
u AS (SELECT id, ioc_type, ioc, min(pos) AS pos FROM h GROUP BY ALL), d AS (SELECT id, ioc AS domain FROM u WHERE ioc_type = 'domain' QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, ioc) <= 3),
p AS (SELECT 'd' || domain AS domain, '10.' || ip AS ip FROM fx_resolves_to), f AS (SELECT domain, ip FROM p QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ip) <= 20), r AS (SELECT domain, ip FROM p QUALIFY row_number() OVER (PARTITION BY ip ORDER BY domain) <= 30),
one AS (SELECT id, 1 AS hop, domain, ip FROM d JOIN f USING (domain)), ips AS (SELECT id, ip FROM one UNION SELECT id, ioc FROM u WHERE ioc_type = 'ip')"""


def around(t, *more):
    """Three domains of a report in its order, with its urls' hosts, over passive DNS."""
    pdns = t.resolves_to().select(F.concat(F.lit("d"), "domain").alias("domain"), F.concat(F.lit("10."), "ip").alias("ip"))
    return link.expand_pdns(listed(t), pdns, (3, 20, 30), *more)


def number(c: str, at: int):
    return F.sum(F.substring(c, at, 20).cast("long"))


@key("pdns_expand", f"""WITH {{V}}, {AROUND}, x AS (SELECT id, hop, domain, ip FROM one UNION ALL SELECT id, 2, domain, ip FROM ips JOIN r USING (ip))
SELECT id, hop, count(*) AS n, sum(substr(domain, 2)::BIGINT)::BIGINT AS sum_domain, sum(substr(ip, 4)::BIGINT)::BIGINT AS sum_ip FROM x GROUP BY 1, 2""")
def pdns_expand(t):
    """To ips and domains."""
    return around(t).groupBy("id", "hop").agg(F.count(F.lit(1)).alias("n"), number("domain", 2).alias("sum_domain"), number("ip", 4).alias("sum_ip"))


@key("pdns_networks", f"""WITH {{V}}, {AROUND}, l AS (SELECT '10.' || l_suppkey AS ip, l_shipdate AS fetched_at, max(asn) AS asn FROM lineitem JOIN fx_in_group g ON g.ip = l_suppkey WHERE l_linenumber = 1 AND asn % 7 <> 0 GROUP BY 1, 2), a AS (SELECT i.id, i.ip, o_orderdate AS at FROM ips i JOIN orders ON o_orderkey = i.id)
SELECT a.id, count(*) AS n, sum(substr(a.ip, 4)::BIGINT)::BIGINT AS sum_ip, sum(l.asn)::BIGINT AS sum_asn FROM a ASOF JOIN l ON a.ip = l.ip AND a.at >= l.fetched_at WHERE epoch_us(a.at) - epoch_us(l.fetched_at) <= 10 * 8.64e10 GROUP BY a.id""")
def pdns_networks(t):
    """To the ips' networks as they were looked up by the report's date."""
    name = F.when(F.col("asn") % 7 != 0, F.col("asn_text")).otherwise("unknown")
    looked = t.lineitem.where("l_linenumber = 1").select(F.col("l_suppkey").alias("ip"), F.col("l_shipdate").alias("fetched_at")).join(t.in_group().select("ip", name.alias("asn_text")), "ip")
    looked = looked.select(F.concat(F.lit("10."), "ip").alias("ip"), "asn_text", "fetched_at")
    out = around(t, looked, t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), 10.0).where("hop = 3")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), number("ip", 4).alias("sum_ip"), F.sum(F.col("asn_number").cast("long")).alias("sum_asn"))


@key("pending_reports", "SELECT id FROM fx_event WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)", "fx_event")
def pending_reports(t):
    return link.pending(t.event(), t.lineitem.where("l_linenumber = 2").select(F.col("l_orderkey").alias("id"))).select("id")


@key("hop2_share", "WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ioc FROM lineitem), s AS (SELECT ioc FROM e GROUP BY ioc HAVING count(*) > 1), l AS (SELECT count(DISTINCT id) AS n FROM e WHERE ioc IN (SELECT ioc FROM s)) SELECT count(*) AS n_events, (SELECT n FROM l) AS n_linked, round((SELECT n FROM l) / count(*), 6) AS share FROM orders")
def hop2_share(t):
    return link.hop2_share(t.in_report("domain"), t.event())


@key("hop2_share_all", "WITH {V}, s AS (SELECT ioc_type, ioc FROM fx_in_report GROUP BY ioc_type, ioc HAVING count(*) > 1), l AS (SELECT count(DISTINCT id) AS n FROM fx_in_report JOIN s USING (ioc_type, ioc)) SELECT count(*) AS n_events, (SELECT n FROM l) AS n_linked, round((SELECT n FROM l) / count(*), 6) AS share FROM orders")
def hop2_share_all(t):
    """Share over indicators of all types; ``hop2_share`` is over domains, as its SQL is."""
    return link.hop2_share(t.in_report(), t.event())


@key("hop4_share", "WITH e AS (SELECT DISTINCT l_orderkey AS id, s_nationkey AS asn FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT asn FROM e GROUP BY asn HAVING count(*) > 1), l AS (SELECT count(DISTINCT id) AS n FROM e WHERE asn IN (SELECT asn FROM s)) SELECT count(*) AS n_events, (SELECT n FROM l) AS n_linked, round((SELECT n FROM l) / count(*), 6) AS share FROM orders")
def hop4_share(t):
    return link.hop4_share(t.in_report("ip"), t.in_group(), t.event())


@key("adhoc_attach", f"WITH {{V}}, {NODES} SELECT DISTINCT 'request:' || request_id AS event, r.ioc_type, CASE WHEN node_id IS NOT NULL THEN 'url:' || node_id ELSE 'new:url:' || value END AS node, node_id IS NOT NULL AS matched FROM fx_requests r LEFT JOIN fx_nodes ON k = lower(value)")
def adhoc_attach(t):
    return link.attach_queries(t.requests(), t.url_nodes())


@key("per_ioc_events", f"WITH {{V}}, {NODES} SELECT DISTINCT 'all' AS variant, 'url|' || value AS event, node_id IS NOT NULL AS matched FROM fx_requests LEFT JOIN fx_nodes ON k = lower(value) UNION ALL SELECT DISTINCT 'known', 'url|' || value, true FROM fx_requests JOIN fx_nodes ON k = lower(value)")
def per_ioc_events(t):
    of = lambda keep, name: link.per_ioc_events(t.requests(), t.url_nodes(), keep).select(F.lit(name).alias("variant"), "event", "matched")
    return of(True, "all").unionByName(of(False, "known"))


@key("ioc_union", "SELECT DISTINCT id, ioc_type, ioc FROM fx_edge", "fx_edge")
def ioc_union(t):
    parts = [t.in_report(k).select("id", "ioc_type", "ioc") for k in ("domain", "ip", "url")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@key("top_n_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem QUALIFY rank <= 20")
def top_n_per_key(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return link.top_n_per(rows, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 20).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@key("dense_index", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS idx FROM orders")
def dense_index(t):
    return rank.dense_index(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "idx")


@key("first_seen", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_seen(t):
    return rank.first_seen(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


def _views(name: str, *views: str) -> None:
    """Puts the views where the SQL has ``WITH {V}``."""
    body = SQL[name]
    head = sql("", *views).removeprefix("WITH ").rstrip("\n")
    SQL[name] = body.replace("{V}", head)


for _n, _v in {"unambiguous_label": ("fx_tags", "fx_aliases"), "ioc_match": ("fx_requests",), "node_temporal": ("fx_resolves_to",), "node_temporal_all": ("fx_resolves_to",), "title_pairs": ("fx_title",), "event_adjacency_all": ("fx_in_report",), "hop2_share_all": ("fx_in_report",), "asn_enrich": ("fx_in_group",), "pdns_expand": ("fx_resolves_to",), "pdns_networks": ("fx_resolves_to", "fx_in_group"), "adhoc_attach": ("fx_requests",), "per_ioc_events": ("fx_requests",)}.items():
    _views(_n, *_v)
