"""Every stage of the corpus pipeline against a plain version of it, on one small corpus with odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_text import brute_components, brute_repeats, prose

import corpus_pipeline as cp
from tracegraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(12)
    texts = [prose(rng, rng.randint(40, 160)) for _ in range(40)]
    passage = prose(rng, 80)
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(100 + i, t + " tail", "en", "s0") for i, t in enumerate(texts[:6])]  # near copies
    rows += [(200 + i, t, None, "s1") for i, t in enumerate(texts[3:9])]  # exact copies
    rows += [(300 + i, prose(rng, 50) + " " + passage + " " + prose(rng, 50), "en", "s1") for i in range(5)]  # a shared passage
    rows += [(3, texts[3], "en", "s1"), (400, None, "en", "s0"), (401, "1 2 3", "en", "s0"), (402, "", None, None), (None, prose(rng, 90), "en", "s1"), (403, passage, "en", "s0"), (403, passage, "en", "s0")]
    return [(*r, 7, "R") for r in rows]


def kept(df):
    return Counter(tuple(r) for r in df.collect())


def test_languages(spark, corpus):
    got = cp.languages(spark, spark.createDataFrame(corpus, SCHEMA), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept(got) == Counter(r for r in corpus if r[1] and any(c.isalpha() for c in r[1]))


def test_near_duplicates(spark, corpus):
    rows = [r for r in corpus if r[1] and r[0] is not None]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    want = {c for _, _, c in brute_components(rows)}
    found = kept(got)
    assert Counter(r[0] for r in found.elements()) == Counter(want) and all(r in rows for r in found)
    nothing = [(1, None, None, None, None, None), (1, None, None, None, None, None), (None, "", None, None, 0, None)]
    assert kept(cp.near_duplicates(spark, spark.createDataFrame(nothing, SCHEMA), "")) == Counter(nothing)  # without a word all stay


def cut_texts(texts, length=200):
    """What is left of each text, byte by byte."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def test_repeated_passages(spark, corpus):
    got = kept(cp.repeated_passages(spark, spark.createDataFrame(corpus, SCHEMA), ""))
    want = Counter()
    for r, left in zip(corpus, cut_texts([r[1] for r in corpus]), strict=True):
        before = (r[1] or "").encode()
        if left == before:
            want[r] += 1
        elif left:
            text = left.decode("utf-8", "ignore")
            want[(r[0], text, *r[2:4], len(text), r[5])] += 1
    assert got == want and sum(x[1] > 0 for x in brute_repeats([r[1] for r in corpus], 200)) > 10


def test_mix(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    copies = Counter()
    for r in mixing.pareto_mix(docs.drop("row")).collect():  # the sample itself is tested in test_text
        copies[(r.doc_id, r.text, r.lang, r.source, r.n_chars, "R")] += r.copies
    assert kept(cp.mix(spark, docs, "")) == +copies


def test_pack_and_run(spark, corpus, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(corpus, SCHEMA)
    want = Counter()
    for r in corpus:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r[0], 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.pack(spark, docs, "").collect()) == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole, staged = cp.run(spark, str(tmp_path)).collect(), docs
    for _, stage in cp.STAGES:
        staged = stage(spark, staged, "").cache()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in staged.collect())
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
