"""Files, prediction and external evaluation on literal rows."""

import pytest

from tracegraph.operators import clean, predict, stats
from tracegraph.sources import files


def test_keys_and_times(spark, tmp_path):
    (tmp_path / "domains.csv").write_text("node\tioc\tlen\n1\tEvil.Example\t3\n2\t\t0\n")
    (tmp_path / "times.csv").write_text("event_idx,created\n0,2020-01-02T03:04:05Z\n1,soon\n2,\n")
    assert [r.value for r in files.read_keys(spark, str(tmp_path / "domains.csv"), ["node", "ioc", "len"]).collect()] == ["evil.example", None]
    assert [str(r.created) for r in files.read_event_times(spark, str(tmp_path / "times.csv")).orderBy("event_idx").collect()] == ["2020-01-02 03:04:05", "None", "None"]
    plan = files.read_keys(spark, str(tmp_path / "domains.csv"), ["node", "ioc", "len"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ioc:string>" in plan


def test_vocabularies(spark, tmp_path):
    path = str(tmp_path / "vocab")
    v = lambda rows: spark.createDataFrame(rows, "value string, idx int")
    files.save_vocab(v([("com", 1), ("org", 2)]), "tld", path)
    files.save_vocab(v([("US", 1)]), "country", path)
    files.save_vocab(v([("net", 1)]), "tld", path)
    assert [tuple(r) for r in files.load_vocab(spark, path, "tld").collect()] == [("net", 1)]
    assert {tuple(r) for r in files.load_vocab(spark, path).collect()} == {("tld", "net", 1), ("country", "US", 1)} and files.load_vocab(spark, path, "none").count() == 0


def test_metrics_documents(spark, tmp_path):
    path = str(tmp_path / "metrics")
    m = lambda acc: spark.createDataFrame([(0, acc, 3), (1, None, 4)], "fold long, acc double, n long")
    files.write_metrics(files.metric_rows(m(0.5), "a"), path)
    files.write_metrics(files.metric_rows(m(0.25), "b"), path)
    files.write_metrics(files.metric_rows(m(0.75), "a"), path)
    got = {(r.run, r.fold, r.metric): r.value for r in files.read_metrics(spark, path).collect()}
    assert len(got) == 8 and got["a", 0, "acc"] == 0.75 and got["b", 0, "acc"] == 0.25 and got["a", 1, "acc"] is None and got["b", 1, "n"] == 4


DIM = [(0, "x"), (1, "y"), (2, None)]


def test_predict_selects_and_blends(spark):
    events = spark.createDataFrame([(1, "L"), (2, None), (3, None)], "id int, apt string")
    s = lambda rows: spark.createDataFrame(rows, "vec_id int, class int, score double")
    model, graph = s([(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5)]), s([(2, 1, 1.0), (1, 1, 1.0)])
    dim = spark.createDataFrame(DIM, "class int, nation string")
    run = lambda **k: {r.vec_id: r.tier3.prediction for r in predict.predict(events, model, graph, dim, ["x"], **k).collect()}
    assert run() == {2: "1"} and run(include_labeled=True) == {1: "0", 2: "1"} and run(weights=(0.0, 1.0), ids=events.where("id = 1").select("id")) == {1: "1"}


def test_external_evaluation(spark):
    iocs = spark.createDataFrame([("e1", "url", "A"), ("e1", "url", "b"), ("e1", "url", "b"), ("e2", "url", "c"), ("e3", "url", "none"), ("e4", "url", "a"), ("e5", "url", "a")], "event string, ioc_type string, value string")
    truth = spark.createDataFrame([("e1", 0), ("e2", 1), ("e3", 0), ("e4", 2), ("e5", 9)], "event string, truth int")
    nodes = spark.createDataFrame([("url", "a", 1), ("url", "B", 2), ("url", "c", 3), ("url", "C", 4)], "ioc_type string, value string, node_id int")
    scores = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.4), (2, 1, 0.6), (3, 0, 0.5), (3, 1, 0.5)], "node_id int, class int, score double")
    dim = spark.createDataFrame(DIM, "class int, nation string")
    found = {r.event: (r.n_iocs, r.n_matched, r.pred) for r in predict.event_predictions(iocs, nodes, scores).collect()}
    assert found == {"e1": (2, 2, 0), "e2": (1, 1, 0), "e3": (1, 0, None), "e4": (1, 1, 0), "e5": (1, 1, 0)}
    got = {r.level: r for r in predict.evaluate_external(iocs, truth, nodes, scores, dim).collect()}
    # e5's class is unknown, e3 has no match; of e1, e2 and e4 only e1 is right
    assert (got["class"].n_events, got["class"].n, got["class"].acc, got["class"].max) == (4, 3, pytest.approx(1 / 3, abs=1e-6), 2)
    assert (got["nation"].n, got["nation"].acc, got["nation"].bacc, got["nation"].median) == (2, 0.5, 0.5, 1.0)


def test_decay_is_of_labelled_events(spark):
    aged = spark.createDataFrame([("a", 0.0), ("a", 10.0), (None, 1000.0)], "apt string, age_days double")
    assert stats.decay_overall(aged, 10.0).first().n == 2
    c = spark.createDataFrame([(None, None), (0.0, None)], "a double, b double")
    assert [r.x for r in c.select(clean.sample_confidence(c.a, c.b).alias("x")).collect()] == [1.0, 1.0]
