"""Landed documents, stored graphs and keyed tables, with what can be wrong in them."""

import json

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import attribute, features, stats
from tracegraph.sources import reports
from tracegraph.sources.graph import RELATIONS, Graph
from tracegraph.sources.stored import KeyedTable


def test_reports_of_all_shapes(spark, tmp_path):
    docs = [
        {"id": "1", "name": "n", "tags": ["A", {"name": "B", "id": 7}, {"id": 1}, "{odd", None], "indicators": [{"indicator": " x ", "type": "domain", "created": "c", "more": 1}]},
        {"id": "2", "tags": None, "indicators": [], "unknown": {"a": [1]}},
        {"id": "3"},
        {"name": "no id"},
        {"id": "4", "indicators": "none"},
        [1, 2],
    ]
    (tmp_path / "r.json").write_text("\n".join([*map(json.dumps, docs), '{"id": "5", "na', "", "no json"]))
    good, bad = reports.split_reports(reports.read_reports(spark, str(tmp_path / "r.json")).cache())
    got = {r.id: r for r in good.collect()}
    assert sorted(got) == ["1", "2", "3"] and got["1"].tags == ["A", "B", "", "{odd", None] and got["1"].indicators[0].indicator == " x " and got["3"].tags is None and got["2"].indicators == []
    assert bad.count() == 5 and bad.where("malformed is null").count() == 0
    (tmp_path / "one.json").write_text(json.dumps(docs[0], indent=2))
    assert reports.read_reports(spark, str(tmp_path / "one.json"), multi_line=True).first().tags[1] == "B"


def test_aliases_of_bundles(spark, tmp_path):
    sets = [{"type": "intrusion-set", "name": "G1", "aliases": ["Foo", "BAR"]}, {"type": "malware", "name": "M", "aliases": ["foo"]}, {"type": "intrusion-set", "name": "Own"}, {"type": "intrusion-set", "name": "None", "aliases": []}, {"type": "intrusion-set", "name": "G2", "aliases": ["bar"]}, {"type": "intrusion-set", "aliases": ["nameless"]}]
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "objects": sets}, indent=1))
    got = {r.alias: r.group for r in reports.read_aliases(spark, str(tmp_path / "b.json"), multi_line=True).collect()}
    assert got == {"foo": "G1", "bar": "G2", "own": "Own", "nameless": ""}


def test_graph_reads_the_files_of_one_relation(spark, tmp_path, capsys):
    g = Graph(spark, str(tmp_path))
    for kind, ids in {"event": [1, 2], "domain": [10, 11], "ip": [20], "url": [30], "asn": [40]}.items():
        g.save_nodes(kind, spark.createDataFrame([(i, f"{kind}{i}") for i in [*ids, ids[0], None]], "id long, name string"))
    edges = [("event", "in_report", "domain", "1", "10"), ("event", "in_report", "domain", "1", "10"), ("event", "in_report", "domain", "2", "99"), ("domain", "resolves_to", "ip", "10", "20"), ("ip", "in_group", "asn", "20", "40")]
    g.save_edges(spark.createDataFrame(edges, "src_type string, rel string, dst_type string, src string, dst string"))
    n = {r.rel: r.n for r in g.counts().collect()}
    assert len(n) == 2 * len(RELATIONS) == len(g.names()) and set(n) == set(g.names())
    assert n["event-in_report-domain"] == n["domain-rev_in_report-event"] == 2 and n["url-hosted_on-domain"] == 0 and n["asn-rev_in_group-ip"] == 1
    assert g.edges("event", "in_report", "domain", resolved=False).count() == 3 and g.nodes("event").count() == 2
    turned = g.edges("ip", "rev_resolves_to", "domain", resolved=False)
    assert turned.first()[:2] == ("20", "10") and all("resolves_to-ip" in r[0] for r in turned.select(F.input_file_name()).collect())
    turned.explain("formatted")
    assert "PartitionFilters: [isnotnull(rel" in capsys.readouterr().out
    g.save_edges(spark.createDataFrame([("ip", "in_group", "asn", "20", "40")] * 2, "src_type string, rel string, dst_type string, src string, dst string"))
    assert {r.rel: r.n for r in g.counts().collect()} == n | {"ip-in_group-asn": 2, "asn-rev_in_group-ip": 2}  # other relations stay
    with pytest.raises(Exception, match="unknown relation"):
        g.save_edges(spark.createDataFrame([("ip", "owns", "asn", "20", "40")], "src_type string, rel string, dst_type string, src string, dst string"))
    with pytest.raises(ValueError, match="unknown relation"):
        g.edges("ip", "owns", "asn")


EDGE = "a string, b string, first_seen string, last_seen string"


def test_keyed_table_touches_its_buckets_alone(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["a", "b"], {"first_seen": "min", "last_seen": "max"}, EDGE, buckets=16)
    rows = lambda *r: spark.createDataFrame(r, EDGE)
    assert t.rows().count() == 0 and t.merge(rows(*[(str(i), "x", "2024-02", "2024-02") for i in range(60)], (None, "x", None, "")), "1")
    held, _ = t.listed(t.newest())
    assert t.merge(rows(("3", "x", "2024-01", " "), ("3", "x", " ", "2024-03"), ("new", "y", "", None)), "2")
    now, batches = t.listed(t.newest())
    touched = set(t.touched(rows(("3", "x", "", ""), ("new", "y", "", ""))))
    assert batches == ["1", "2"] and {b for b in now if now[b] == 2} == touched and len(touched) <= 2 and all(now[b] == v for b, v in held.items() if b not in touched)
    got = {(r.a, r.b): (r.first_seen, r.last_seen) for r in t.rows().collect()}
    assert len(got) == 62 and got["3", "x"] == ("2024-01", "2024-03") and got["new", "y"] == (None, None) and got[None, "x"] == (None, None)
    assert all(f"bucket={b}/" in "".join(t.rows([b]).inputFiles()) and t.rows([b]).inputFiles()[0].count("bucket") == 1 for b in touched)
    before = sorted(map(str, t.rows().collect()))
    assert not t.merge(rows(("3", "x", "1999", "1999")), "2") and sorted(map(str, t.rows().collect())) == before
    # a merge that stopped before its list is not seen, and is written over
    (tmp_path / "versions" / "3").mkdir()
    (tmp_path / "data" / "version=3" / "bucket=0").mkdir(parents=True)
    assert t.newest() == 2 and sorted(map(str, t.rows().collect())) == before
    assert t.merge(rows(("3", "x", "2023", "")), "3") and t.newest() == 3 and t.vacuum() > 0
    assert {(r.a, r.b): r.first_seen for r in t.rows().collect()}["3", "x"] == "2023" and t.rows().count() == 62
    assert t.merge(rows(), "4") and t.rows().count() == 62


def test_keyed_table_takes_what_came_last(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["ip"], {"country": "latest", "n": "latest"}, "ip string, country string, n int", "at", buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "ip string, country string, n int, at string")
    t.merge(rows(("1", "de", 1, "5"), ("1", "fr", None, "4"), ("2", " ", 2, "1")), "1")
    t.merge(rows(("1", "", 7, "1"), ("1", None, 8, None), ("2", "us", None, None)), "2")
    assert {r.ip: (r.country, r.n) for r in t.rows().collect()} == {"1": ("de", 7), "2": ("us", 2)}


def test_defaults_of_every_property(spark):
    for kind, (texts, numbers) in features.PROPERTIES.items():
        none = features.with_defaults(spark.createDataFrame([(1,)], "id int"), kind).first()
        null = features.with_defaults(spark.createDataFrame([(1, *[None] * (len(texts) + len(numbers)))], "id int, " + ", ".join([f"{c} string" for c in texts] + [f"{c} boolean" for c in numbers])), kind).first()
        for r in (none, null):
            assert all(r[c] == "" for c in texts) and {c: r[c] for c in numbers} == {c: 1.0 if c == "head_failed" else 0.0 for c in numbers}
        kept = features.with_defaults(spark.createDataFrame([(1, *["x"] * len(texts), *[0.0] * len(numbers))], "id int, " + ", ".join([f"{c} string" for c in texts] + [f"{c} double" for c in numbers])), kind).first()
        assert all(kept[c] == "x" for c in texts) and all(kept[c] == 0 for c in numbers)
    empty = spark.createDataFrame([], "value string, idx int")
    v = features.url_vector(spark.createDataFrame([(1,)], "id int"), empty, empty, empty, empty).first().features
    assert v[1136] == 1.0 and v.size == 1517


def test_clusters_and_missing_names(spark):
    rows = [("a", "X", "Russia"), ("b", "X", "Cybercrime"), ("c", "X", "Iran"), ("d", "X", None)]
    r = spark.createDataFrame([(*x, "", 3) for x in rows], "id string, target string, target_nation string, text string, n_network int")
    aliases = spark.createDataFrame([("x", "X", "Russia")], "alias string, group string, nation string")
    none = spark.createDataFrame([], "id string, n_groups int")
    got = attribute.label_mass_v2(r, spark.createDataFrame([], "id string, tag string"), aliases, none, ["Russia", "China", "North Korea", "Vietnam"])
    assert {x.id: x.activity_cluster for x in got.collect()} == {"a": "State-Sponsored", "b": "Cybercrime", "c": "Cybercrime", "d": "Cybercrime"}
    dns = spark.createDataFrame([("a", "A", True), ("a", "MX", True), ("b", "A", False), ("b", "AAAA", True), ("c", None, None)], "d string, k string, nx boolean")
    assert {x.d: (x.A, x.MX, x.is_nxdomain) for x in stats.dns_counts(dns, "d", "k", "nx").collect()} == {"a": (0, 0, True), "b": (1, 0, False), "c": (0, 0, False)}


def test_sketches_unite_to_what_one_sketch_gives(spark):
    e = spark.range(30_000).select((F.col("id") % 50).alias("id"), F.when(F.col("id") % 3 == 0, "ip").otherwise("url").alias("ioc_type"), (F.col("id") % 20_000).alias("ioc"))
    exact = e.select("ioc_type", "ioc").distinct().count()
    n = stats.united(stats.ioc_sketches(e, ["id"]), []).first().n_distinct
    assert n == stats.united(stats.ioc_sketches(e, []), []).first().n_distinct and abs(n - exact) <= 3 * 1.04 / 64 * exact
    assert stats.ioc_sketches(e.limit(0), ["id"]).count() == 0
