"""Mentions, lookups as of a time, expansion and near neighbours against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.operators import features, link


def test_mentions_are_substrings(spark, capsys):
    rng = random.Random(3)
    letters = "abcä .#"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, "")]
    patterns = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(80)} | {"", "zzz", "a", "ab", "中"}
    got = link.substring_mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in [*patterns, "a", None]], "pattern string"))
    want = {(i, p) for i, t in texts for p in patterns if t and p and p in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert link.substring_mentions(spark.createDataFrame([], "id int, text string"), spark.createDataFrame([("a",)], "pattern string")).count() == 0
    aliases = spark.createDataFrame([("ab", "g1"), ("b", "g2"), ("b", "g3"), ("c", "g1")], "alias string, group string")
    found = {r.id: r.n_groups for r in link.alias_mentions(spark.createDataFrame([(1, "xABx"), (2, "B"), (3, None), (4, "q")], "id int, text string"), aliases).collect()}
    assert found == {1: 3, 2: 2, 3: 0, 4: 0}


@pytest.mark.parametrize("ttl", [1.0, 3.5])
def test_lookups_as_of_each_row(spark, ttl):
    rng = random.Random(5)
    day = datetime(2024, 1, 1)
    when = lambda: day + timedelta(hours=rng.randint(0, 400))
    looked = [(rng.choice(["a", "b", "hot"]), f"v{i % 40}", when()) for i in range(150)] + [(None, "v", day), ("a", "v", None)]
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot", "new"]), when()) for i in range(200)] + [(900, None, day), (901, "a", None)]
    rows += [(902, looked[0][0], looked[0][2]), (903, looked[1][0], looked[1][2] + timedelta(days=ttl)), (904, looked[1][0], looked[1][2] + timedelta(days=ttl, seconds=1))]
    got = link.as_of(spark.createDataFrame(rows, "id int, ip string, at timestamp"), spark.createDataFrame(looked, "ip string, name string, fetched timestamp"), "ip", "at", "fetched", ttl)
    found = {r.id: r.found and (r.found.name, r.found.fetched) for r in got.collect()}
    assert len(found) == len(rows)
    for i, ip, at in rows:
        fresh = [(f, n) for k, n, f in looked if k == ip and ip is not None and at and f and timedelta(0) <= at - f <= timedelta(days=ttl)]
        assert found[i] == ((m := max(fresh))[::-1] if fresh else None), (i, fresh and m)


def test_expansion_in_report_order(spark):
    iocs = [(1, "domain", "z.ex", 1), (1, "domain", "b.ex", 2), (1, "url", "http://A.ex/1", 3), (1, "url", "http://9.9.9.9/", 4), (1, "ip", "1.1.1.1", 5), (1, "url", "http://z.ex/", 6), (1, "url", "nothing at", 0), (2, "ip", "1.1.1.1", 1)]
    pdns = spark.createDataFrame([("z.ex", "2.2.2.2"), ("b.ex", "3.3.3.3"), ("a.ex", "4.4.4.4"), ("y.ex", "1.1.1.1"), ("z.ex", "1.1.1.1")], "domain string, ip string")
    day = datetime(2024, 3, 10)
    looked = spark.createDataFrame([("1.1.1.1", "AS1 one", day - timedelta(hours=5)), ("1.1.1.1", "AS2 two", day - timedelta(hours=2)), ("1.1.1.1", "AS3 later", day + timedelta(hours=1)), ("2.2.2.2", "none", day), ("9.9.9.9", "AS9", day - timedelta(days=3))], "ip string, asn_text string, fetched_at timestamp")
    times = spark.createDataFrame([(1, day), (2, day + timedelta(hours=3))], "id int, at timestamp")
    df = spark.createDataFrame(iocs, "id int, ioc_type string, ioc string, pos int")
    hosts = {(r.id, r.ioc_type, r.ioc) for r in link.report_hosts(df).collect()}
    assert (1, "domain", "a.ex") in hosts and (1, "ip", "9.9.9.9") in hosts
    got = {tuple(r) for r in link.expand_pdns(df, pdns, (2, 20, 30), looked, times).collect()}
    assert {x for x in got if x[1] == 1} == {(1, 1, "z.ex", "1.1.1.1", None), (1, 1, "z.ex", "2.2.2.2", None), (1, 1, "b.ex", "3.3.3.3", None)}  # the third domain is beyond the two
    assert {x[2] for x in got if x[0] == 1 and x[1] == 2} == {"z.ex", "b.ex", "y.ex"} and {x[2] for x in got if x[0] == 2 and x[1] == 2} == {"y.ex", "z.ex"}
    assert {x for x in got if x[1] == 3} == {(1, 3, None, "1.1.1.1", 2), (2, 3, None, "1.1.1.1", 3)}  # one network for each ip, as of each report
    assert {x[2] for x in {tuple(r) for r in link.expand_pdns(df, pdns).collect()} if x[1] == 1} == {"z.ex", "b.ex", "a.ex"}


@pytest.mark.parametrize("block", [4096, 3])
def test_title_sets_and_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(link, "BLOCK", block)
    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    base = [rng.sample(words, rng.randint(12, 30)) for _ in range(6)]
    titles = [(i, "ab"[i % 2] if i % 9 else None, " ".join([w for w in base[i % 6] if rng.random() > 0.02] + (["extra"] if i % 5 == 0 else []))) for i in range(90)] + [(100, "a", "x y"), (101, "a", None)]
    df = spark.createDataFrame(titles, "k int, lab string, t string")
    sets = {i: frozenset(w for w in (t or "").lower().split() if len(w) > 2) for i, _, t in titles}
    lab = {i: x for i, x, _ in titles}
    want = {(lab[a], a, b) for a in sets for b in sets if a < b and lab[a] and lab[a] == lab[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.92 - 1e-9}
    assert {tuple(r)[:3] for r in link.title_pairs(df, "k", "lab", "t").collect()} == want and len(want) > 50
    members, reps = link.title_sets(df, "k", "lab", "t")
    m = {r.k: r.rep for r in members.collect()}
    assert m == {i: min(j for j in sets if sets[j] == s and lab[j] == lab[i]) for i, s in sets.items() if s}
    kept, gone = set(), set()
    for i in sorted(sets):
        near = [a for _, a, b in want if b == i and a in kept]
        (gone if near else kept).add(i)
    assert {r.k for r in link.title_dedup(df, "k", "lab", "t").collect()} == kept


def test_neighbours_by_buckets(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24)) * 4
    x = np.concatenate([c + rng.normal(size=(50, 24)) * 0.4 for c in centres])
    rows = spark.createDataFrame([(i, "big" if i < 2900 else "few", [float(v) for v in r]) for i, r in enumerate(x)], "row_key int, label string, row_vec array<double>")
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, "label").withColumn("k", F.lit(5)).select("label", "n", "k", "row_key", "row_vec").cache()
    exact = {(r.a, r.b) for r in features.nearest_in_class(rows, "label").collect()}
    got = features.nearest_by_buckets(rows, "label", bucket=150).collect()
    assert all(r.d == pytest.approx(float(((x[r.a] - x[r.b]) ** 2).sum())) and r.r <= 5 for r in got) and len(got) == len({(r.a, r.b) for r in got}) <= 15000
    assert len(exact & {(r.a, r.b) for r in got}) / len(exact) >= 0.9
    assert {(r.a, r.b) for r in got if r.label == "few"} == {p for p in exact if p[0] >= 2900}  # a class of one bucket is exact
    assert features.TABLES * 150 * 2900 < 2900**2
