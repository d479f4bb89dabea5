"""Views that give the driver tables the roles of reports, indicators, edges and scores, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.functions import text as T


class Tables:
    """The tables of one folder; each attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # reports
    def event(self) -> DataFrame:
        o = self.orders
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(o.o_orderstatus != "P", o.o_orderpriority).alias("apt"), (o.o_totalprice / 600000).alias("label_confidence"), F.col("o_orderstatus").alias("source"))

    def label_dim(self) -> DataFrame:
        idx = F.substring("label", 1, 1).cast("int") - 1
        labels = self.orders.select(F.col("o_orderpriority").alias("label")).distinct().select("label", idx.alias("idx"))
        return labels.withColumn("nation", F.when(F.col("idx").isin(0, 1), "expedite").when(F.col("idx").isin(2, 4), "routine"))

    # edges
    def in_report(self, *kinds: str) -> DataFrame:
        """(id, ioc_type, ioc, indicator_created): the indicators of each order, of the asked types or all, in one scan."""
        line = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        of = {"domain": F.col("l_partkey"), "ip": F.col("l_suppkey")}
        kinds = kinds or ("domain", "ip", "url")
        if "url" in kinds:
            line = line.crossJoin(F.broadcast(self.pages.agg(F.count(F.lit(1)).alias("n_pages"))))
            of["url"] = F.when(F.col("l_linenumber") == 1, F.col("l_partkey") % F.col("n_pages"))
        each = F.array(*[F.struct(F.lit(k).alias("ioc_type"), of[k].alias("ioc")) for k in kinds])
        # repeats are few, so lines go to their event as they are, before they become a row per type, and what is done by event needs no second shuffle
        line = line.withColumnRenamed("l_orderkey", "id").repartition("id")
        rows = line.select("id", "l_shipdate", F.explode(each).alias("x")).select("id", "x.ioc_type", "x.ioc", "l_shipdate").where("ioc is not null")
        return rows.groupBy("id", "ioc_type", "ioc").agg(F.min("l_shipdate").alias("indicator_created"))

    def url_sights(self) -> DataFrame:
        """(ioc, l_shipdate): every sight of a url; a report that lists it twice saw it twice."""
        n = F.broadcast(self.pages.agg(F.count(F.lit(1)).alias("n_pages")))
        return self.lineitem.where("l_linenumber = 1").crossJoin(n).select((F.col("l_partkey") % F.col("n_pages")).alias("ioc"), "l_shipdate")

    def resolves_to(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_partkey").alias("domain"), F.col("l_suppkey").alias("ip")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))

    def in_group(self) -> DataFrame:
        n = self.nation.select(F.col("n_nationkey").alias("asn"), F.concat(F.lit("AS"), F.col("n_nationkey"), F.lit(" "), F.col("n_name")).alias("asn_text"))
        return self.supplier.select(F.col("s_suppkey").alias("ip"), F.col("s_nationkey").alias("asn")).join(n, "asn").select("ip", "asn", "asn_text")

    def hosted_on(self) -> DataFrame:
        return self.pages.select("page_id", "url", T.url_host(F.col("url")).alias("host"))

    # features and scores
    def node_vec(self) -> DataFrame:
        n = self.embeddings.agg(F.count(F.lit(1)).alias("n_vecs"))
        ids = self.part.select(F.lit("domain").alias("ioc_type"), F.col("p_partkey").alias("ioc")).unionByName(self.supplier.select(F.lit("ip").alias("ioc_type"), F.col("s_suppkey").alias("ioc"))).unionByName(self.pages.select(F.lit("url").alias("ioc_type"), F.col("page_id").alias("ioc")))
        keyed = ids.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("ioc") % F.col("n_vecs"))
        return keyed.join(self.embeddings.select("vec_id", "embedding"), "vec_id").select("ioc_type", "ioc", F.col("embedding").cast("array<double>").alias("vec"))

    def logits(self) -> DataFrame:
        """A row per vector, model and class with the logit; truth, fold and subset columns of the vector. Seven models of ten classes take all 64 components in
        turn, and the last one the first six again."""
        take = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.get("embedding", F.pmod(i, F.lit(64))))
        e = self.embeddings.select("vec_id", F.col("label").alias("truth"), (F.col("vec_id") % 5).alias("fold"), (F.col("vec_id") % 3 == 0).alias("matched"), F.when(F.col("vec_id") % 2 == 0, "domain").otherwise("url").alias("kind"), take.alias("x"))
        long = e.select("vec_id", "truth", "fold", "matched", "kind", F.posexplode("x").alias("pos", "value"))
        return long.select("vec_id", "truth", "fold", "matched", "kind", F.expr("pos div 10").cast("int").alias("model"), (F.col("pos") % 10).cast("int").alias("class"), (F.col("value").cast("double") * 4).alias("logit"))

    def class_dim(self) -> DataFrame:
        c = F.col("id").cast("int")
        return self.spark.range(10).select(c.alias("class"), F.when(c < 9, F.concat(F.lit("n"), c % 3)).alias("nation"))

    # reports as text
    def tags(self) -> DataFrame:
        brands = self.part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("tag"), "p_name")
        return self.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_partkey").join(brands, "l_partkey").select("id", "line", "tag", "p_name")

    def aliases(self) -> DataFrame:
        number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
        return self.part.select(F.lower("p_brand").alias("alias"), F.concat(F.lit("G"), number % 8).alias("group")).distinct().withColumn("nation", (F.substring("group", 2, 1).cast("int") % 3))

    def title(self) -> DataFrame:
        """Whole titles of pages, with the page's language."""
        of = lambda pattern: F.regexp_extract("html", pattern, 1)
        return self.pages.select(F.col("page_id").alias("doc_id"), of('<html lang="([^"]*)"').alias("lang"), of("<title>([^<]*)</title>").alias("title"))

    def whole_text(self) -> DataFrame:
        """Texts to be compared whole, under the columns of ``title``."""
        return self.documents.select("doc_id", "lang", F.col("text").alias("title"))

    def votes(self) -> DataFrame:
        return self.lineitem.select("l_orderkey", F.col("l_partkey").alias("ioc")).join(self.event().where("apt is not null").select(F.col("id").alias("l_orderkey"), "apt"), "l_orderkey").select("ioc", "apt")

    def requests(self) -> DataFrame:
        """URLs asked for: even pages as they are, odd ones altered so that no node has them; a request per ten pages."""
        value = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/other")))
        return self.pages.select(F.expr("page_id div 10").alias("request_id"), F.lit("url").alias("ioc_type"), value.alias("value"), "page_id")

    def url_nodes(self) -> DataFrame:
        return self.pages.select(F.lit("url").alias("ioc_type"), F.col("url").alias("value"), F.col("page_id").alias("node_id"))


#: The same views in DuckDB SQL, each with the views it needs.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_event": ((), "SELECT o_orderkey AS id, o_orderdate AS created, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS apt, o_totalprice / 600000 AS label_confidence, o_orderstatus AS source FROM orders"),
    "fx_label_dim": ((), "SELECT label, idx, CASE WHEN idx IN (0, 1) THEN 'expedite' WHEN idx IN (2, 4) THEN 'routine' END AS nation FROM (SELECT DISTINCT o_orderpriority AS label, substr(o_orderpriority, 1, 1)::INT - 1 AS idx FROM orders)"),
    "fx_edge": ((), "SELECT l_orderkey AS id, 'domain' AS ioc_type, l_partkey AS ioc, l_shipdate FROM lineitem UNION ALL SELECT l_orderkey, 'ip', l_suppkey, l_shipdate FROM lineitem UNION ALL SELECT l_orderkey, 'url', l_partkey % (SELECT count(*) FROM pages), l_shipdate FROM lineitem WHERE l_linenumber = 1"),
    "fx_in_report": (("fx_edge",), "SELECT id, ioc_type, ioc, min(l_shipdate) AS indicator_created FROM fx_edge GROUP BY ALL"),
    "fx_resolves_to": ((), "SELECT l_partkey AS domain, l_suppkey AS ip, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL"),
    "fx_in_group": ((), "SELECT s_suppkey AS ip, s_nationkey AS asn, 'AS' || n_nationkey || ' ' || n_name AS asn_text FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "fx_hosted_on": ((), "SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages"),
    "fx_node_vec": ((), "SELECT ioc_type, ioc, embedding::DOUBLE[] AS vec FROM (SELECT 'domain' AS ioc_type, p_partkey AS ioc FROM part UNION ALL SELECT 'ip', s_suppkey FROM supplier UNION ALL SELECT 'url', page_id FROM pages) JOIN embeddings ON vec_id = ioc % (SELECT count(*) FROM embeddings)"),
    "fx_logits": ((), "SELECT vec_id, label AS truth, vec_id % 5 AS fold, vec_id % 3 = 0 AS matched, CASE WHEN vec_id % 2 = 0 THEN 'domain' ELSE 'url' END AS kind, (i // 10)::INT AS model, (i % 10)::INT AS class, embedding[i % 64 + 1]::DOUBLE * 4 AS logit FROM embeddings, range(70) r(i)"),
    "fx_class_dim": ((), "SELECT c::INT AS class, CASE WHEN c < 9 THEN 'n' || (c % 3) END AS nation FROM range(10) r(c)"),
    "fx_tags": ((), "SELECT l_orderkey AS id, l_linenumber AS line, lower(p_brand) AS tag, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "fx_aliases": ((), "SELECT DISTINCT lower(p_brand) AS alias, 'G' || (regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 8) AS \"group\", (regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 8) % 3 AS nation FROM part"),
    "fx_title": ((), """SELECT page_id AS doc_id, coalesce(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages"""),
    "fx_votes": (("fx_event",), "SELECT l_partkey AS ioc, apt FROM lineitem JOIN fx_event ON id = l_orderkey WHERE apt IS NOT NULL"),
    "fx_requests": ((), "SELECT page_id // 10 AS request_id, 'url' AS ioc_type, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/other' END AS value, page_id FROM pages"),
}


def sql(body: str, *views: str) -> str:
    """``body`` after the views that it names, each before those that need it."""
    names: list[str] = []

    def add(name: str) -> None:
        if name not in names:
            for n in SQL[name][0]:
                add(n)
            names.append(name)

    for v in views:
        add(v)
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({SQL[n][1]})' for n in names)}\n{body}" if names else body
