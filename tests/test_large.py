"""What differed or did not fit on larger tables: queries against their SQL on tables with odd rows, and operators against plain forms."""

import os
import re

import duckdb
import numpy as np
import pytest
from conftest import SF
from test_oracle import canon

from tracegraph.operators import implicit, link, propagate, stats
from tracegraph.operators.pooling import pooled
from tracegraph.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


def tables(folder, **changed):
    """A copy of the smallest tables, where a table that is named is made by its SQL instead."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for f in os.listdir(SF):
        name = f.split(".")[0]
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{f}' (FORMAT parquet)")
    return str(folder)


def same(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = registry.queries()[name](spark, folder)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(cur.fetchall(), names)


def test_url_seen_twice_by_one_report(spark, tmp_path):
    """The later of two sights of a url by one report ends its span."""
    later = "SELECT l_orderkey, l_partkey, l_suppkey, 1 AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate + INTERVAL 9999 DAY AS l_shipdate FROM lineitem WHERE l_orderkey % 50 = 1"
    same(spark, tables(tmp_path, lineitem=f"SELECT * FROM lineitem UNION ALL {later}"), "vec_url")


def moved(df):
    """Joins of the plan by an indicator's type, which move the vectors to the edges."""
    return re.findall(r"Join \[(?:ioc_type|rel|src_kind)#.*", df._jdf.queryExecution().executedPlan().toString())


def rows_of(spark, df):
    """The same as rows, of whose columns the planner does not know that they hold one value."""
    return spark.createDataFrame(df.collect(), df.schema)


def test_pool_moves_no_vectors(spark):
    """More vectors than are sent to every executor: neither they nor a row per edge and vector are shuffled."""
    vecs = spark.range(60_000).selectExpr("'d' AS ioc_type", "id AS ioc", "array(double(id), double(-id)) AS vec")
    edges = rows_of(spark, spark.range(3_000).selectExpr("id % 100 AS id", "'d' AS ioc_type", "id * 21 AS ioc"))
    got = stats.event_mean_pool(edges, vecs, spark.range(101), 2)
    assert not moved(got)
    want = {i: [np.mean([21.0 * k for k in range(i, 3_000, 100) if 21 * k < 60_000])] for i in range(100)} | {100: [0.0]}
    assert {r.id: r.vec for r in got.collect()} == {i: [pytest.approx(x), pytest.approx(-x)] for i, (x,) in want.items()}


def test_pooled_as_plain(spark):
    """Means by relation with repeated and missing keys, keys of other types, nulls, and vectors that stand twice or are short."""
    rng = np.random.default_rng(1)
    edges = [(int(rng.integers(40)), "abc"[rng.integers(3)], int(rng.integers(60))) for _ in range(500)] + [(41, "a", None), (42, None, 3)]
    vecs = [("abc"[rng.integers(3)], int(k), None if k % 11 == 0 else [float(x) for x in rng.normal(size=3)][: 2 if k % 7 == 0 else 3]) for k in rng.integers(50, size=120)]
    of = {}
    for r, k, v in vecs:
        if v is not None:
            of.setdefault((r, k), []).append(v + [0.0] * (3 - len(v)))
    e, v = spark.createDataFrame(edges, "id int, rel string, src long").repartition(3), spark.createDataFrame(vecs, "rel string, src int, vec array<double>").repartition(2)
    got = {total: {r.id: r.vec for r in pooled(spark.range(50), e, v, ["id"], ["rel", "src"], 3, relation="rel", total=total).collect()} for total in (False, True)}
    for i in range(50):
        means = [np.mean(x, axis=0) for r in "abc" if (x := [v for d, q, k in edges if d == i and q == r for v in of.get((r, k), [])])]
        assert got[False][i] == (pytest.approx(np.mean(means, axis=0)) if means else None)
        assert got[True][i] == (pytest.approx(np.sum(means, axis=0)) if means else None)


def test_neighbour_means_move_no_vectors(spark):
    vecs = spark.range(60_000).selectExpr("'d' AS rel", "id AS src", "array(double(id), double(-id)) AS vec")
    got = propagate.neighbor_mean(rows_of(spark, spark.range(200).selectExpr("id % 10 AS dst", "'d' AS rel", "id * 7 AS src")), vecs, 2)
    assert not moved(got)
    assert {r.dst: r.vec for r in got.collect()} == {i: [pytest.approx(7 * (i + 95.0)), pytest.approx(-7 * (i + 95.0))] for i in range(10)}


def test_relation_layer_moves_no_neighbours(spark):
    nodes = spark.range(100).selectExpr("'d' AS kind", "id", "array(double(id), 1D) AS vec").unionByName(spark.range(5).selectExpr("'e' AS kind", "id", "array(double(id), 2D) AS vec"))
    nodes, edges = rows_of(spark, nodes), rows_of(spark, spark.range(40).selectExpr("'d>e' AS rel", "'d' AS src_kind", "id AS src", "id % 4 AS dst"))
    layer = propagate.Layer({"d>e": (2 * np.eye(2), np.array([0.5, 0.0]))}, {"d>e": np.eye(2)})
    got = propagate.relation_layer(nodes, edges, layer, {"d>e": "e"})
    assert not moved(got)
    assert {r.id: r.vec for r in got.collect()} == {i: [pytest.approx(i + 0.5 + 2 * (i + 18)), pytest.approx(4.0)] for i in range(4)} | {4: [4.5, 2.0]}


def test_domain_propagation_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(link, "event_adjacency", None)
    same(spark, SF, "label_prop_domains")


def test_requests_of_a_hub_make_no_pairs(spark, monkeypatch):
    """Requests that ask for what very many events have, one of them for nothing else, and one for more than can be dealt with by keys of two."""
    n, tables = 300, []
    kept = implicit.settled
    monkeypatch.setattr(implicit, "settled", lambda df: tables.append(kept(df)) or tables[-1])
    heads = spark.range(n).selectExpr("id AS node", "'d' AS ioc_type", "explode(array(-1L, id, (id + 1) % 300)) AS ioc")
    nodes = spark.range(n).selectExpr("id AS node", "1 + id % 3 AS size")
    sent = spark.range(n).selectExpr("id AS node", "'x' AS label", "0 AS step", "double(id + 1) AS value")
    asks = {i: [-1, i] for i in range(n)} | {400: [-1], 401: [*range(60), -5], 402: [-5]}
    requests = spark.createDataFrame([(i, "d", k) for i, ks in asks.items() for k in ks], "id long, ioc_type string, ioc long")
    labels = spark.createDataFrame([("x",), ("y",)], "label string")
    got = {(r.id, r.label): r.score for r in implicit.score_requests(requests, implicit.Standing(heads, nodes, sent, 2), labels).collect()}
    assert max(d.count() for d in tables) < 3 * n + 100
    of = {v: {-1, v, (v + 1) % n} for v in range(n)}
    for i, ks in asks.items():
        near = [v for v in range(n) if of[v] & set(ks)]
        degree = 1 + sum(1 + v % 3 for v in near)
        x = np.exp(sum(v + 1 for v in near) / np.sqrt(degree) / degree)
        assert (got[i, "x"], got[i, "y"]) == (pytest.approx(x / (x + 1)), pytest.approx(1 / (x + 1)))


def test_standing_graph_takes_no_round_too_many(spark, monkeypatch):
    """Four rounds of sending need the degrees and three rounds of scores."""
    products, kept = [], implicit.product
    monkeypatch.setattr(implicit, "product", lambda *a: products.append(a) or kept(*a))
    edges = spark.range(6).selectExpr("id", "'d' AS ioc_type", "explode(array(id, id + 1)) AS ioc")
    graph = implicit.standing(implicit.shared(edges, spark.range(6)), spark.createDataFrame([(0, "x")], "id long, label string"), 4)
    assert sorted(r.step for r in graph.sent.select("step").distinct().collect()) == [0, 1, 2, 3]
    assert len(products) == 4
