"""Hand-worked cases of the operators on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators import attribute, clean, features, link, propagate, rank, stats


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def value(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("url,host", [("http://A.example.com:80/x", "a.example.com"), ("example.org/y", "example.org"), ("http://[::1]/", "::1"), ("http://1.2.3.4/a", "1.2.3.4"), ("http://a_b.example/", "a_b.example"), ("http://", None), (None, None)])
def test_url_host(spark, url, host):
    assert value(spark, url, T.url_host) == host


@pytest.mark.parametrize("s,want", [("2020-01-02T03:04:05Z", "2020-01-02 03:04:05"), ("2020-01-02T03:04:05+09:00", "2020-01-01 18:04:05"), ("2020-01-02T03:04:05+0000", "2020-01-02 03:04:05"), ("2020-01-02", "2020-01-02 00:00:00"), ("soon", None), ("2020-13-45", None), ("", None), (None, None)])
def test_parse_ts(spark, s, want):
    assert value(spark, s, lambda c: T.parse_ts(c).cast("string")) == want


def test_entropy_and_ext(spark):
    assert value(spark, "", T.shannon_entropy) == 0
    assert value(spark, "aabb", T.shannon_entropy) == pytest.approx(1.0)
    assert value(spark, "añb", T.shannon_entropy) == pytest.approx(math.log2(3))
    assert value(spark, "/a.b/c", T.file_extension) == "b/c"
    assert value(spark, "/a.b/c", lambda c: T.file_extension(c, strict=True)) == ""
    assert value(spark, "/x.HTML", T.file_extension) == "html"


def test_refang_and_asn(spark):
    assert value(spark, " Evil[.]Example(.)COM ", lambda c: T.refang(c, "domain")) == "evil.example.com"
    assert value(spark, "hxxp://a[.]b", lambda c: T.refang(c, "url")) == "http://a.b"
    assert value(spark, "as12 NAME x", T.asn_number) == 12 and value(spark, "none", T.asn_number) is None and value(spark, "none", T.asn_name) == ""


def test_indicators(spark):
    p = spark.createDataFrame([("a", [(" X ", "domain", "1"), ("  ", "URL", "2")]), ("b", []), ("c", None)], "id string, indicators array<struct<indicator:string,type:string,created:string>>")
    assert sorted(clean.explode_indicators(p).select("id", "indicator").collect()) == [("a", "X"), ("b", None), ("c", None)]
    routed = clean.route_iocs(spark.createDataFrame([("Ab.C", "hostname"), ("1.1.1.1", "IPv6"), ("u", "URI"), ("h", "md5")], "indicator string, type string"))
    assert rows(routed, "kind", "value") == [("domain", "ab.c"), ("ip", "1.1.1.1"), ("url", "u")]


def test_merges_ignore_blanks(spark):
    e = spark.createDataFrame([(1, "", "2020"), (1, "2019", " "), (1, "2021", None)], "k int, first_seen string, last_seen string")
    assert rows(clean.merge_edges(e, ["k"]), "first_seen", "last_seen") == [("2019", "2020")]
    assert rows(clean.merge_edges(clean.merge_edges(e, ["k"]), ["k"]), "first_seen", "last_seen") == [("2019", "2020")]
    n = spark.createDataFrame([("x", "old", 1), ("x", "new", 2), ("x", " ", 3)], "k string, name string, v int")
    assert rows(clean.merge_nodes(n, "k", ["name"], "v"), "k", "name") == [("x", "new")]


def test_labels(spark):
    dim = spark.createDataFrame([("A", 0, "n"), ("B", 1, None)], "label string, idx int, nation string")
    ev = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "Z")], "id int, apt string")
    assert rows(clean.encode_labels(ev, dim), "id", "y") == [(1, 0), (2, 1), (3, -1), (4, -1)]
    with pytest.raises(ValueError):
        clean.encode_labels(ev, dim, ["A", "Q"])
    c = spark.createDataFrame([(0.0, 0.5), (None, None), (0.01, None), (None, 0.7)], "a double, b double").select(clean.sample_confidence(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in c.collect()] == [0.5, 1.0, 0.1, 0.7]


def test_unambiguous(spark):
    aliases = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")], "alias string, group string")
    tags = spark.createDataFrame([(1, "a1"), (1, "a2"), (2, "a1"), (2, "b1"), (3, "a"), (4, "b1")], "id int, tag string")
    targets = spark.createDataFrame([(i, "A") for i in (1, 2, 3, 4, 5)], "id int, target string")
    assert rows(link.unambiguous(tags, targets, aliases, ["A", "B"]), "id", "keep") == [(1, True), (2, False), (3, True), (4, False), (5, False)]


def test_title_dedup_keeps_first_and_dropped_drop_no_other(spark):
    words = [f"word{i}" for i in range(30)]
    t = [(1, " ".join(words)), (2, " ".join(words[:29] + ["x01"])), (3, " ".join(words[:28] + ["x01", "x02"])), (4, ""), (5, ""), (6, " ".join(words))]
    df = spark.createDataFrame([(k, "en", s) for k, s in t], "k int, lang string, title string")
    pairs = {(r.a, r.b) for r in link.title_pairs(df, "k", "lang", "title").collect()}
    assert pairs == {(1, 2), (2, 3), (1, 6), (2, 6)}
    assert rows(link.title_dedup(df, "k", "lang", "title"), "k") == [(1,), (3,), (4,), (5,)]


def test_adjacency_is_symmetric_with_a_diagonal(spark):
    e = spark.createDataFrame([(1, "ip", 7), (2, "ip", 7), (3, "url", 7)], "id int, ioc_type string, ioc int")
    ev = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    assert rows(link.event_adjacency(e, ev), "i", "j") == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]
    assert rows(link.event_adjacency(e, ev, 1), "i", "j") == [(i, i) for i in (1, 2, 3, 4)]
    assert rows(link.skipped_hubs(e, 1), "ioc_type", "ioc", "d") == [("ip", 7, 2)]


def test_reverse_edges_once(spark):
    e = spark.createDataFrame([(1, "r", 2)], "src int, rel string, dst int")
    once = link.with_reverse(e)
    assert rows(once, "src", "rel", "dst") == [(1, "r", 2), (2, "rev_r", 1)] == rows(link.with_reverse(once), "src", "rel", "dst")


def test_majority_tie_is_dropped(spark):
    v = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "ioc int, apt string")
    assert rows(stats.majority_label(v), "ioc", "apt", "n") == [(2, "a", 2)]
    assert rows(stats.majority_ties(v), "n_iocs", "n_kept", "n_ties") == [(2, 1, 1)]


def test_chrono_split_sizes(spark):
    d = [(f"{c}{i}", c, float(i)) for c, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for i in range(n)]
    df = spark.createDataFrame(d, "id string, apt string, age_days double")
    for mode in ("forward", "backward", "random"):
        out = {r.apt: r.n for r in rank.chrono_split(df, mode).where("train").groupBy("apt").agg(F.count("*").alias("n")).collect()}
        assert out == {"a": 1, "b": 1, "c": 2, "d": 7}
    oldest = {r.id for r in rank.chrono_split(df, "forward").where("train and apt = 'c'").collect()}
    assert oldest == {"c2", "c1"}


def test_folds_partition(spark):
    df = spark.range(103).withColumn("y", F.col("id") % 4)
    out = rank.stratified_folds(df, "y").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in out) == 103
    by = {}
    for r in out:
        by.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())
    assert rows(rank.dense_index(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string"), "k"), "k", "idx") == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_tier_metrics_with_a_label_without_nation(spark):
    d = [(0, 0, 0.9, "n", "n"), (1, 0, 0.35, "n", "n"), (2, 2, 0.8, None, None), (0, 2, 0.1, "n", None)]
    df = spark.createDataFrame(d, "truth int, pred int, p double, truth_nation string, pred_nation string")
    m = stats.tier_metrics(df).first()
    assert (m.tier3_correct, m.tier2_total, m.tier2_correct, m.hier_correct, m.n_tier3, m.n_tier2, m.n_abstain) == (2, 3, 2, 2, 2, 1, 1)
    assert stats.tier_metrics(df, scope="reference").first().hier_correct == 3


def test_propagation_on_a_path(spark):
    a = [(i, j) for i in range(4) for j in range(4) if abs(i - j) <= 1]
    pairs = spark.createDataFrame(a, "i int, j int")
    m = np.array([[1.0 if abs(i - j) <= 1 else 0.0 for j in range(4)] for i in range(4)])
    d = m.sum(1)
    norm = m / np.sqrt(d[:, None] * d[None])
    f = np.array([[1.0, 0], [0, 0], [0, 0], [0, 1.0]])
    for _ in range(4):
        f = norm @ f
        f[0], f[3] = [1, 0], [0, 1]
    want = np.exp(f) / np.exp(f).sum(1, keepdims=True)
    assert all(r.w == pytest.approx(norm[r.i, r.j]) for r in propagate.sym_normalize(pairs).collect())
    got = propagate.label_propagation(pairs, spark.createDataFrame([(0, "x"), (3, "y")], "id int, label string"), spark.createDataFrame([("x",), ("y",)], "label string"))
    for r in got.collect():
        assert r.score == pytest.approx(want[r.id, "xy".index(r.label)], abs=1e-12)


def test_mean_pool_without_indicator_is_zero(spark):
    e = spark.createDataFrame([(1, "ip", 1), (1, "url", 1)], "id int, ioc_type string, ioc int")
    v = spark.createDataFrame([("ip", 1, [1.0, 3.0]), ("url", 1, [3.0, 5.0])], "ioc_type string, ioc int, vec array<double>")
    assert rows(stats.event_mean_pool(e, v, spark.createDataFrame([(1,), (2,)], "id int"), 2), "id", "vec") == [(1, [2.0, 4.0]), (2, [0.0, 0.0])]


def test_mass_cases(spark):
    aliases = spark.createDataFrame([("alpha", "A", 0), ("beta", "B", 1), ("alfa", "A", 0)], "alias string, group string, nation int")
    r = spark.createDataFrame([(1, "A", 0, "", 50, 50), (2, "A", 0, "", 0, 0), (3, "A", None, "about alpha", 50, 50), (4, "A", 0, "", 50, 50)], "id int, target string, target_nation int, text string, n_iocs int, n_network int")
    tags = spark.createDataFrame([(1, "alpha"), (1, "alfa"), (2, "alpha"), (4, "alpha"), (4, "beta")], "id int, tag string")
    words = spark.createDataFrame([("russia", 0)], "keyword string, nation int")
    mentions = link.alias_mentions(r.select("id", "text"), aliases, 3)
    v1 = {x.id: x for x in attribute.label_mass_v1(r, tags, aliases, words, mentions).collect()}
    assert (v1[1].tag_exclusivity, v1[1].evidence_weight, v1[1].nation_coherence, v1[1].belief_named_actor) == (1.0, 1.0, 0.5, 0.5)
    assert v1[2].belief_nation_state == 0 and v1[2].uncertainty == 1
    assert v1[3].tag_exclusivity == 0.5 and v1[3].activity_cluster == "Cybercrime" and v1[4].tag_exclusivity == 0.25
    v2 = {x.id: x for x in attribute.label_mass_v2(r, tags, aliases, mentions, [0, 1]).collect()}
    assert (v2[2].tag_exclusivity, v2[2].nation_coherence, v2[2].uncertainty) == (0.0, 1.0, 1.0)
    assert v2[4].nation_coherence == 0 and v2[1].belief_named_actor == 1.0
    for m in (v1, v2):
        assert all(x.belief_named_actor <= x.belief_nation_state <= 1 for x in m.values())


def test_vectors_and_smote(spark):
    vocab = spark.createDataFrame([("com", 1), ("org", 250)], "value string, idx int")
    d = spark.createDataFrame([(1, "com"), (2, "net"), (3, None), (4, "org")], "id int, country string").withColumns({"issuer": F.lit("x"), "lifespan_days": F.lit(2.0), "recency_days": F.lit(None).cast("double")})
    out = {r.id: r.features.toArray() for r in features.ip_vector(d, vocab, vocab).collect()}
    assert len(out[1]) == 509 and out[1][1] == 1 and out[2][0] == 1 and out[3][0] == 1 and out[4][0] == 1 and out[1][507] == 2
    x = spark.createDataFrame([(i, "a" if i < 6 else "b", [float(i), 1.0], 0.5) for i in range(9)], "k int, y string, v array<double>, w double")
    made = features.smote(x, "y", "v", "k", "w").collect()
    assert len(made) == 3 and all(r.y == "b" and 6 <= r.vec[0] <= 8 and r.vec[1] == 1 and r.weight == 0.5 for r in made)
    zero = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(clean.zero_slots(F.col("v"), [(1, 3)]).alias("v")).first().v
    assert zero == [1.0, 0.0, 0.0]


def test_layer_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id int, vec array<double>")
    z = x @ w + y
    z = np.maximum((z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5), 0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for r in propagate.sage_layer(frame(x), frame(y), w_self=w).collect():
        assert np.allclose(r.vec, z[r.id])


def test_mentions_are_substrings(spark):
    aliases = spark.createDataFrame([("bear", "A"), ("fancy bear", "A"), ("apt-28", "B"), ("ear", "C"), ("++", "D"), ("y b", "E")], "alias string, group string")
    texts = [(1, "The FANCY BEARS came"), (2, "by apt-281"), (3, "apt 28"), (4, None), (5, ""), (6, "c++ heart"), (7, "fancy  bear")]
    got = dict(rows(link.alias_mentions(spark.createDataFrame(texts, "id int, text string"), aliases), "id", "n_groups"))
    want = {i: len({g for a, g in map(tuple, aliases.collect()) if a in (t or "").lower()}) for i, t in texts}
    assert got == want == {1: 3, 2: 1, 3: 0, 4: 0, 5: 0, 6: 2, 7: 2}
    assert dict(rows(link.alias_mentions(spark.createDataFrame(texts, "id int, text string"), aliases, 3), "id", "n_groups"))[6] == 0


@pytest.mark.parametrize("block", [4096, 2])
def test_adjacency_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(link, "BLOCK", block)
    edges = [(1, "ip", 7), (2, "ip", 7), (2, "ip", 7), (3, "ip", 7), (4, "ip", 7), (4, "url", 7), (5, "url", 7), (6, "ip", 9)]
    events = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    got = rows(link.event_adjacency(spark.createDataFrame(edges, "id int, ioc_type string, ioc int"), events), "i", "j")
    hub = [(i, j) for i in range(1, 5) for j in range(1, 5) if i != j]
    assert got == sorted([*hub, (4, 5), (5, 4), *((i, i) for i in range(1, 8))])


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    values = {"a": [1.0], "b": [2.0, 2.0], None: list(rng.integers(0, 9, 40).astype(float)), "c": list(rng.normal(size=101))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v double")
    asks = {f"{how}{p}": (p, how) for p in (0.0, 0.05, 0.5, 0.9, 1.0) for how in ("disc", "cont")}
    got = {r.k: r for r in rank.quantiles(df, "v", asks, ("k",)).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, (p, how) in asks.items():
            want = sorted(vs)[max(math.ceil(p * len(vs) - 1e-9), 1) - 1] if how == "disc" else np.quantile(vs, p)
            assert got[k][name] == pytest.approx(want, abs=1e-12), (k, name)
    assert rank.quantiles(df, "v", {"m": (0.5, "disc")}).count() == 1 and rank.quantiles(df.limit(0), "v", {"m": (0.5, "disc")}).first().m is None


def test_blend_sums_to_one(spark):
    a = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1)], "vec_id int, class int, score double")
    b = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "vec_id int, class int, score double")
    out = attribute.blend(a, b)
    assert sum(r.score for r in out.collect()) == pytest.approx(1, abs=1e-3) and out.count() == 3
    dim = spark.createDataFrame([(0, "n0"), (1, None), (2, "n0")], "class int, nation string")
    t = attribute.flat(attribute.tiered_v1(out, dim, ["n0"])).first()
    assert (t.tier3_prediction, t.recommended_tier, t.tier2_prediction, t.tier1_prediction) == ("0", 3, "n0", "State-Sponsored")
    assert attribute.flat(attribute.tiered_v1(out, dim, [], "n0")).first().tier1_prediction == "Cybercrime"
    assert attribute.flat(attribute.tiered_v1(out, dim, [], "n1")).first().tier1_prediction == "Unknown"
