"""Queries that go through files: delimited keys, saved vocabularies, metrics documents, attributed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.operators import stats
from tracegraph.operators.lineage import shared_folder
from tracegraph.plans.graph_keys import _views, key
from tracegraph.plans.score_keys import TOP, tops
from tracegraph.sources import files


@key("csv_keys", "SELECT lower(p_name) AS value, count(*) AS n FROM part GROUP BY 1")
def csv_keys(t):
    """Parts as a tab-separated feature file, of which only the key column is read."""
    path = shared_folder(t.spark)
    t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("ioc"), "p_brand").write.option("sep", "\t").option("header", True).csv(path)
    return files.read_keys(t.spark, path, ["node", "ioc", "p_brand"]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@key("event_times", "SELECT o_orderkey AS event_idx, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created FROM orders")
def event_times(t):
    """Orders' dates written as text, of which every seventh cannot be read, and read back as times."""
    path = shared_folder(t.spark)
    text = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    t.orders.select(F.col("o_orderkey").alias("event_idx"), text.alias("created")).write.option("header", True).csv(path)
    return files.read_event_times(t.spark, path).select(F.col("event_idx").cast("long").alias("event_idx"), F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


VOCABS = (("brand", "part", "p_brand", 10), ("type", "part", "p_type", 5), ("segment", "customer", "c_mktsegment", 4), ("event", "events", "event_type", 4))


@key("vocab_saved", " UNION ALL ".join(f"(SELECT '{f}' AS feature, value, (row_number() OVER (ORDER BY n DESC, value))::INT AS idx FROM (SELECT {c} AS value, count(*) AS n FROM {tb} GROUP BY 1 HAVING value <> '' ORDER BY n DESC, value LIMIT {k - 1}))" for f, tb, c, k in VOCABS))
def vocab_saved(t):
    """Vocabularies of four columns saved as one table and loaded again."""
    path = shared_folder(t.spark)
    for feature, table, column, k in VOCABS:
        files.save_vocab(stats.top_k_vocab(getattr(t, table), column, k), feature, path)
    return files.load_vocab(t.spark, path)


@key("metrics_document", f"""WITH {{V}}, {TOP}, f AS (SELECT fold, sum(hit) / sum(n) AS acc, avg(hit / n) AS bacc FROM (SELECT fold, truth, count(*) AS n, sum((pred = truth)::INT) AS hit FROM q GROUP BY 1, 2) GROUP BY fold)
SELECT r.run, fold::INT AS fold, metric, round(CASE WHEN metric = 'acc' THEN acc ELSE bacc END, 6)::DOUBLE AS value FROM f, (VALUES ('one'), ('two')) r(run), (VALUES ('acc'), ('bacc')) m(metric)""")
def metrics_document(t):
    """Metrics of the folds written as documents of two runs, one of which is written again, and read back."""
    path = shared_folder(t.spark)
    per = stats.fold_metrics(tops(t)).select("fold", F.round("acc", 6).alias("acc"), F.round("bacc", 6).alias("bacc"))
    for run in ("one", "two", "one"):
        files.write_metrics(files.metric_rows(per, run), path)
    return files.read_metrics(t.spark, path)


_views("metrics_document", "fx_logits", "fx_class_dim")
