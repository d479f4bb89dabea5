"""Embeddings, archives, packing and the pipeline against brute force, and on odd rows."""

import gzip
import json
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import ann, embedding_dedup, packing, shared, warc
from tracegraph.llm.tokens import word_ids

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16))
    x[:200] = x[0] + 0.25 * rng.normal(size=(200, 16))
    x[200:240] = x[200]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x.astype(np.float32))]
    odd = [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, rows[0][1], None), (805, [], 0), (806, [float("inf")] * 16, 2)]
    return rows + odd


def linked(rows, threshold=0.93):
    ok = [r for r in rows if r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in ok])
    hit = (x @ x.T >= threshold) & (lab[:, None] == lab[None])
    np.fill_diagonal(hit, False)
    comp = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i in range(len(ok)):
            m = min([comp[ok[i][0]], *(comp[ok[j][0]] for j in np.flatnonzero(hit[i]))])
            if m != comp[ok[i][0]]:
                comp[ok[i][0]], changed = m, True
    n = {r[0]: 0 for r in rows} | {r[0]: int(hit[i].sum()) for i, r in enumerate(ok)}
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize("cell,block", [(4000, 1000), (60, 25)])
def test_embedding_links(spark, vectors, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(vectors, VEC))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == linked(vectors)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


@pytest.mark.parametrize("cell", [4096, 100])
def test_nearest_recall(spark, vectors, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    df = spark.createDataFrame(vectors, VEC)
    out = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {r[0]: np.array(r[1], float) for r in vectors[:700]} | {804: np.array(vectors[0][1], float)}
    hit = 0
    assert sorted(out) == [i for i in range(0, 700, 20)]
    for q, found in out.items():
        want = sorted(((-float(v @ x[q]), i) for i, v in x.items() if i != q))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(s == pytest.approx(float(x[i] @ x[q]), abs=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i in want} & {i for _, i, _ in found})
    assert hit / (20 * len(out)) >= 0.9
    few = spark.createDataFrame(vectors[:5] + vectors[700:], VEC)
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 5
    assert ann.nearest(df.limit(0), df).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_nearest_recall_on_the_given_embeddings(spark):
    """Every query of the 64-wide table against all of its rows."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in ann.op9(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    assert sorted(found) == sorted(int(i) for i in ids if i % 20 == 0) and x.shape[1] == 64
    for q, got in found.items():
        own = x @ x[ids == q][0]
        best = sorted((-v, i) for v, i in zip(own, ids, strict=True) if i != q)[:20]
        assert sorted(g[0] for g in got) == list(range(1, 21)) and all(s == pytest.approx(float(own[ids == i][0]), abs=1e-9) for _, i, s in got)
        hit, total = hit + len({i for _, i in best} & {i for _, i, _ in got}), total + 20
    assert hit / total >= 0.9


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3) and ann.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big = "<p>" + "x\r\n\r\nWARC/1.1 " * 60_000
    rows = [(i, f"http://e/{i}", f"<a>{i % 4}</a>é", 1) for i in range(12)] + [(20, None, None, 1), (21, "u v", "", 1), (None, "n", "<a>0</a>é", 1), (None, None, "lone", 1), (30, "b", big, 1), (9, "http://e/9", "<a>1</a>é", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, extra int")
    folder = f"file://{tmp_path}/w"
    got = warc.archive_round_trip(pages, folder)
    seen = got.collect()
    best = {}
    for p, _, h, _ in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    want = Counter()
    for p, _, h, _ in rows:
        k = best.get(h or "")
        first = k is None or p == k
        want[(p, len((h or "").encode()), warc.digest((h or "").encode()), "response" if first else "revisit", None if first else k)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in seen) == want
    assert {bytes(r.payload) for r in seen if r.page_id == 30} == {big.encode()}
    files = sorted((tmp_path / "w").glob("*[0-9].warc.gz"))
    assert len(files) > 1
    for f in files:  # every record is a member, at its offset
        index = [json.loads(x) for x in f.with_name(f.name + ".idx.json").read_text().splitlines()]
        data = f.read_bytes()
        assert sum(x["length"] for x in index) == len(data) and all(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1") for x in index)
    again = warc.archive_round_trip(pages, folder)  # as after a lost task: names in use are written anew
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in again.collect()) == want
    small = warc.archive_round_trip(pages, f"{folder}2", min_bytes=10**9)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    texts = ["", None, "Hello, it's  a\x1ctest", "ΣΑΣ İx 日本", "<|endoftext|>", "don't ² ½ é é", "word " * 9000, "it"] + [f"some words number {i} " * (i % 40) for i in range(300)]
    docs = spark.createDataFrame([(i if i else None, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, extra int")
    out = packing.pack(docs, tokenizer()).collect()
    pieces, places = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id or 0, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in places.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 4096
        padding += 4096 - end
    assert padding <= 4096 + 0.02 * sum(r.length for r in out)
    assert packing.pack(docs.limit(0), tokenizer()).count() == 0


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = Counter(int(v) for v in rng.integers(1, 65, 400))
        patterns = packing.shortest_pack_first(dict(h), 64)
        found = Counter()
        for packs, pattern in patterns:
            assert sum(n * m for n, m in pattern) <= 64
            for n, m in pattern:
                found[n] += packs * m
        assert found == h and len(patterns) <= 2 * 64 + 2


def test_cache_start_over():
    w = word_ids(tokenizer())
    import tracegraph.llm.tokens as tokens

    keep, tokens.CACHE_WORDS = tokens.CACHE_WORDS, 5
    try:
        for text in ("one two three four five six seven", "six seven eight one", "one one"):
            assert w.encode([text, text])[1] == w.whole(text)
    finally:
        tokens.CACHE_WORDS = keep


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    v = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 200]], "id long")
    got = {r.id: r.component for r in shared.components(v, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 40 else 100 if i < 200 else 200 for i in got}


@pytest.mark.parametrize("histogram", [{40: 1_000_000}, {k: 500_000 // 60 for k in range(1, 61)}, {30: 500_000, 20: 100_000, 900: 1_000}, {4096: 3, 4095: 2, 1: 2}, {3000: 10, 1097: 10}])
def test_padding_of_short_documents(histogram):
    patterns = packing.shortest_pack_first(histogram, 4096)
    packs, tokens = sum(n for n, _ in patterns), sum(k * n for k, n in histogram.items())
    assert packs * 4096 - tokens <= 4096 + (0.02 * tokens if 3000 not in histogram else packs * 2000)
    found = Counter()
    for n, pattern in patterns:
        assert sum(k * m for k, m in pattern) <= 4096
        for k, m in pattern:
            found[k] += n * m
    assert found == histogram and len(patterns) <= 4 * len(histogram) + 2


def test_rows_that_repeat_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    docs = spark.createDataFrame([(7, "the same words")] * 300 + [(None, None)] * 5, "doc_id long, text string")
    out = packing.pack(docs, tokenizer()).collect()
    places = {(r.sequence_id, r.offset) for r in out}
    assert len(out) == len(places) == 305 and max(r.sequence_id for r in out) == 0
