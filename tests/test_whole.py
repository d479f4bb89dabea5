"""Queries take all rows and edges, on tables small enough to work by hand."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.operators import features, link, rank
from tracegraph.plans import registry, score_keys
from tracegraph.sources.fixtures import Tables

DAY = datetime(1998, 1, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders 1 (labelled) and 2 share a supplier only, 3 and 4 a url only, 5 nothing."""
    out = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/{name}.parquet")

    put("orders", [(k, k, "P" if k in (2, 4) else "F", DAY, f"{min(k, 5)}-X", 300000.0) for k in range(1, 6)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string, o_totalprice double")
    lines = [(1, 1, 101, 7), (2, 2, 102, 7), (3, 1, 204, 8), (4, 1, 214, 9), (5, 2, 105, 10)]
    put("lineitem", [(*x, DAY) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp")
    put("customer", [(k, "S") for k in range(1, 6)], "c_custkey long, c_mktsegment string")
    put("pages", [(k, f"http://h{k}.example/") for k in range(10)], "page_id long, url string")
    put("part", [(k,) for k in (101, 102, 204, 214, 105)], "p_partkey long")
    put("supplier", [(k,) for k in (7, 8, 9, 10)], "s_suppkey long")
    put("embeddings", [(k, [float(k)] * 64) for k in range(300)], "vec_id long, embedding array<double>")
    return out


def test_events_are_linked_by_every_type(spark, folder):
    q = registry.queries()
    assert {r.i: r.degree for r in q["event_adjacency_all"](spark, folder).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    assert q["hop2_share_all"](spark, folder).first().n_linked == 4
    t = Tables(spark, folder)
    w = {(r.i, r.j) for r in link.event_adjacency(t.in_report(), t.event()).collect()}
    assert {r.i: r.n for r in score_keys.weights(t).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    assert {(1, 2), (2, 1), (3, 4), (4, 3)} <= w and (1, 3) not in w


def test_predict_batch_reads_ips_and_urls(spark, folder):
    q = registry.queries()
    near = {r.id: r.predicted[0] for r in q["lp_predict"](spark, folder).collect()}
    assert near == {2: "1", 4: "3"}  # the labels of the events that share an ip and a url with them
    # both scorers have a say: the classifier is trained on the three labelled events, which are fewer than folds
    got = {r.vec_id: r for r in q["predict_batch"](spark, folder).collect()}
    assert got.keys() == near.keys() and all(0 < r.tier3_confidence <= 1 for r in got.values())


def test_pooled_neighbours_of_every_type(spark, folder):
    t = Tables(spark, folder)
    got = {r.id: r.vec for r in features.hop_means(t.in_report(), t.node_vec(), t.event(), 64, 2).collect()}
    near = {1: (101 + 7 + 1) / 3, 2: (102 + 7) / 2, 3: (204 + 8 + 4) / 3, 4: (214 + 9 + 4) / 3, 5: (105 + 10) / 2}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(near) and all(len(v) == 192 for v in got.values())
    mid = ((101 + 7 + 1) / 3 + (102 + 7) / 2) / 2
    assert got[2][64] == pytest.approx(((102 + 7) / 2 + mid) / 2)
    far = {1: (2 * near[1] + mid) / 3, 2: (near[2] + mid) / 2}
    assert got[1][128] == pytest.approx((2 * far[1] + (far[1] + far[2]) / 2) / 3) and got[5][128] == pytest.approx(near[5])


def test_compression_keeps_what_axes_span(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, vec array<double>")
    code, error = features.compress(rows, "k", 2)
    assert {len(r.code) for r in code.collect()} == {2} and error.first().n == 60 and error.first().mse == pytest.approx(0, abs=1e-9)
    few = features.compress(rows, "k", 1)[1].first().mse
    axes = np.linalg.svd(x - x.mean(0))[2][:1]
    assert few == pytest.approx(float(np.mean((x * x).sum(1) - ((x @ axes.T) ** 2).sum(1)) / 6), rel=1e-6)
    assert features.compress(rows.limit(0), "k")[0].count() == 0


def test_regression_by_folds(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from tracegraph.operators import models

    rows = spark.createDataFrame([(i, [float(i % 2), 1.0 if i % 7 else -1.0], float(i % 2), 1.0, i % 5) for i in range(60)], "id int, v array<double>, y double, weight double, fold int")
    rows = rows.select("id", array_to_vector("v").alias("features"), "y", "weight", "fold").cache()
    store = models.ModelStore(spark, str(tmp_path / "m"))
    out = store.train(rows).collect()
    assert sorted(r.fold for r in out) == [0, 1, 2, 3, 4] and all(r.acc == r.bacc == 1.0 and r.n == 12 for r in out) and [r.fold for r in out if r.best] == [0]
    # a model that was saved and loaded scores as the one that was fitted, and the best one is that of its fold
    fitted = models.fit(rows.where("fold <> 0"))
    p = lambda m: {(r.id, r["class"]): r.score for r in models.scores(m, rows).collect()}
    assert p(store.load()) == p(store.load(0)) == pytest.approx(p(fitted), abs=1e-9) and len(p(fitted)) == 120
    assert p(store.load(3)) != p(store.load(0))
    few = models.ModelStore(spark, str(tmp_path / "few")).train(rows.limit(3)).collect()
    assert [(r.fold, r.n, r.best) for r in few] == [(models.WHOLE, 3, True)] and models.ModelStore(spark, str(tmp_path / "few")).load().numClasses == 2


def test_relation_wise_network(spark):
    """Four layers over five kinds of nodes against matrices, the last one bare; nodes without neighbours, kinds without relations into them."""
    from tracegraph.operators import propagate

    rng = np.random.default_rng(4)
    kinds = {"event": 5, "domain": 4, "ip": 3, "url": 2, "asn": 2}
    relations = {"d>e": ("domain", "event"), "i>e": ("ip", "event"), "u>e": ("url", "event"), "e>d": ("event", "domain"), "u>d": ("url", "domain"), "e>i": ("event", "ip"), "d>i": ("domain", "ip"), "i>a": ("ip", "asn"), "e>u": ("event", "url")}
    edges = {r: [(int(rng.integers(kinds[s])), int(rng.integers(kinds[d] - 1))) for _ in range(5)] for r, (s, d) in relations.items()}
    x = {k: rng.normal(size=(n, 6)) for k, n in kinds.items()}
    layers, widths = [], [6, 4, 4, 4, 3]
    for a, b in zip(widths, widths[1:], strict=False):
        layers.append(propagate.Layer({r: (rng.normal(size=(a, b)), rng.normal(size=b)) for r in relations}, {r: rng.normal(size=(a, b)) for r in relations}, {k: (rng.normal(size=b), rng.normal(size=b)) for k in kinds} if len(layers) < 3 else None))
    nodes = spark.createDataFrame([(k, i, [float(v) for v in row]) for k, m in x.items() for i, row in enumerate(m)], "kind string, id int, vec array<double>")
    table = spark.createDataFrame([(r, relations[r][0], s, d) for r, es in edges.items() for s, d in es], "rel string, src_kind string, src int, dst int")
    got = {(r.kind, r.id): r.vec for r in propagate.relation_network(nodes, table, layers, {r: d for r, (_, d) in relations.items()}).collect()}
    for layer in layers:
        new = {}
        for k in kinds:
            into = [r for r, (_, d) in relations.items() if d == k]
            z = np.zeros((kinds[k], layer.own[into[0]].shape[1]))
            for r in into:
                for i in range(kinds[k]):
                    near = [x[relations[r][0]][s] for s, d in edges[r] if d == i]
                    m = np.mean(near, axis=0) if near else np.zeros(x[k].shape[1])
                    z[i] += (m @ layer.neighbors[r][0] + layer.neighbors[r][1] + x[k][i] @ layer.own[r]) / len(into)
            if layer.norms:
                z = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5) * layer.norms[k][0] + layer.norms[k][1]
                z = np.maximum(z, 0)
                z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            new[k] = z
        x = new
    assert {k for k, _ in got} == set(kinds)
    assert all(np.allclose(got[k, i], x[k][i], atol=1e-9) for k in kinds for i in range(kinds[k]))


@pytest.mark.parametrize("width", [3, 300])
def test_sums_and_means_of_vectors(spark, width):
    from tracegraph.operators.vectors import vector_means, vector_sums

    rows = [(i % 3, [float(i + j) for j in range(width)] if i % 4 else None) for i in range(9)] + [(7, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    for f, how in ((vector_sums, np.sum), (vector_means, np.mean)):
        want = {k: how([v for j, v in rows if j == k and v], axis=0) for k in range(3)}
        got = {r.k: r.x for r in f(df, ["k"], "x", width).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    from tracegraph.operators.lineage import small

    df = spark.range(100).select("id", F.lit("x" * 50).alias("t"))
    hinted = lambda d: "ResolvedHint (strategy=broadcast)" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, rows=99)) and not hinted(small(df, size=5000)) and hinted(small(df.limit(0)))


def test_public_suffixes(spark):
    from tracegraph.operators import clean

    hosts = spark.createDataFrame([(1, "a.b.co.uk"), (2, "co.uk"), (3, "x.notco.uk"), (4, "lone"), (5, None), (6, "y.uk")], "k int, host string")
    given = spark.createDataFrame([("co.uk",), ("uk",), ("b.co.uk",), ("uk",)], "s string")
    assert {r.k: r.suffix for r in clean.public_suffix(hosts, "k", "host", given).collect()} == {1: "b.co.uk", 2: "co.uk", 3: "uk", 4: "lone", 5: None, 6: "uk"}
    hosts = spark.createDataFrame([(1, "a.b.ck"), (2, "www.ck"), (3, "x.www.ck"), (4, "b.ck"), (5, "ck"), (6, "d.city.kobe.jp")], "k int, host string")
    rules = spark.createDataFrame([("*.ck",), ("!www.ck",), ("jp",), ("*.kobe.jp",), ("!city.kobe.jp",)], "s string")
    assert {r.k: r.suffix for r in clean.public_suffix(hosts, "k", "host", rules).collect()} == {1: "b.ck", 2: "ck", 3: "ck", 4: "b.ck", 5: "ck", 6: "kobe.jp"}


def test_smote_neighbours_are_those_of_the_whole_class(spark):
    rng = np.random.default_rng(3)
    x = {i: [float(v) for v in rng.integers(0, 4, 3)] for i in range(90)}
    of = lambda i: "a" if i < 50 else "b"
    rows = spark.createDataFrame([(i, of(i), v, 1.0) for i, v in x.items()], "k int, y string, v array<double>, w double")
    got = {}
    for r in features.smote_neighbors(rows, "y", "v", "k", block=7).orderBy("a", "r").collect():
        got.setdefault(r.a, []).append(r.b)
    d = lambda i, j: sum((p - q) ** 2 for p, q in zip(x[i], x[j], strict=True))
    assert got == {i: sorted((j for j in range(50, 90) if j != i), key=lambda j, i=i: (d(i, j), j))[:5] for i in range(50, 90)}
    alone = spark.createDataFrame([(i, "a" if i < 6 else "b", [float(i)], 1.0) for i in range(9)], "k int, y string, v array<double>, w double")
    assert features.smote(alone, "y", "v", "k", "w", block=1).count() == 3


def test_node_temporal_takes_all_edges(spark, folder, tmp_path):
    out = str(tmp_path)
    lines = [(1, 7, datetime(1998, 1, 2)), (2, 7, datetime(1998, 1, 5)), (8, 8, datetime(1999, 5, 31))]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_shipdate timestamp").write.parquet(f"{out}/lineitem.parquet")
    spark.read.parquet(f"{folder}/supplier.parquet").write.parquet(f"{out}/supplier.parquet")
    got = {r.ip: (r.lifespan_days, r.recency_days) for r in registry.queries()["node_temporal"](spark, out).collect()}
    assert got == {7: (3.0, 512.0), 8: (0.0, 1.0), 9: (0.0, 0.0), 10: (0.0, 0.0)}


def test_titles_and_texts_are_compared_whole(spark, tmp_path):
    head, body, other = (" ".join(f"{c}{i:03d}" for i in range(n)) for c, n in (("head", 12), ("body", 60), ("other", 60)))
    texts = [(1, "en", f"{head} {body}"), (2, "en", f"{head} {other}"), (3, "en", f"early {body} {head}"), (4, "de", f"{head} {body}"), (5, "en", f"{body} {head}"), (6, "en", "")]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(k, f'<!DOCTYPE html><html lang="{lang}"><head><title>{text}</title></head><body>x</body></html>') for k, lang, text in texts] + [(7, None), (8, "no title")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.doc_id for r in registry.queries()["title_dedup"](spark, str(tmp_path)).collect()) == [1, 2, 4, 6, 7, 8]
    assert {(r.a, r.b) for r in registry.queries()["title_pairs"](spark, str(tmp_path)).collect()} == {(1, 3), (1, 5), (3, 5)}
    assert {(r.a, r.b) for r in registry.queries()["text_pairs"](spark, str(tmp_path)).collect()} == {(1, 3), (1, 5), (3, 5)}


def test_external_indicators_are_matched(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("pages", [(k, f"http://h{k}.example/") for k in (0, 1, 2, 3, 6)], "page_id long, url string")
    put("embeddings", [(k, 0 if k < 3 else 1, [1.0 if i % 10 == 0 else 0.0 for i in range(64)]) for k in range(10)], "vec_id long, label int, embedding array<double>")
    got = {(r.level, r.matched): (r.n, r.acc) for r in registry.queries()["eval_external_matched"](spark, str(tmp_path)).collect()}
    third = pytest.approx(2 / 3, abs=1e-6)
    assert got == {(3, None): (5, 0.6), (1, True): (3, third), (1, False): (2, 0.5), (0, True): (3, third), (0, False): (2, 0.5)}


def test_ranks_within_a_class_come_from_several_ranges(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 390, "a").when(F.col("id") < 395, "b").alias("y"), F.lit(1).alias("x"))
    got = rank.ranked(df, ["y"], [F.desc("id")], "r")
    want = {i: 390 - i if i < 390 else 395 - i if i < 395 else 400 - i for i in range(400)}
    assert {r.id: r.r for r in got.collect()} == want
    plan = rank.stratified_folds(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
