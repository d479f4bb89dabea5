"""Queries against their SQL twins on the smallest tables, a few of each family."""

import os

import duckdb
import pytest
from conftest import SF

from tracegraph.plans import registry

KEYS = ["pulse_explode", "merge_edge_seen", "label_encode", "title_pairs", "hop2_share", "seen_ip", "vocab_tld", "decay_overall", "split_forward", "tier_metrics", "subset_metrics", "dst_mass_v2", "lex_url_v2", "vec_url", "lp_predict", "tiered_v1", "stream_seen",
        "report_json", "report_json_bad", "alias_bundle", "graph_load", "merge_stored_edges", "merge_stored_nodes", "stream_attribution", "request_scores", "request_new_urls", "hetero_layer", "neighbor_mean", "pdns_networks", "ioc_sketch", "text_sets", "sym_normalize_all", "event_adjacency_all", "vec_domain", "dst_mass_v1", "graph_stats"]


def canon(rows, names):
    def one(v):
        return f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(float(r[i]) if hasattr(r[i], "as_tuple") else r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", KEYS)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(cur.fetchall(), names)


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
