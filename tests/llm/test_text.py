"""Near-duplicates, repeated passages, languages, toxicity and mixing against brute force and on odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracegraph.llm import jaccard, langid, mixing, rollup, shared, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, extra int"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "vo", "sel", "dro") for c in ("n", "s", "rim")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Plain, copied, nearly copied, tiny, empty, null, very long and repetitive texts, and null ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(12)]
    texts = list(base)
    for t in base[:5]:
        w = t.split()
        for k in range(3):
            x = list(w)
            x[(7 * k) % len(x)] = "changed"
            texts.append(" ".join(x))
    passage = prose(rng, 60)
    texts += [prose(rng, 50) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    texts += [base[0], base[0].upper(), "one two three", "one  two\tthree", "one two", "", " \t", None, None, "é" * 300, "a" * 5000, "ab " * 900, "1 2 3 . ,"]
    texts.append(" ".join(prose(rng, 20) for _ in range(400)))
    rows = [(i if i % 9 != 8 else None, t, "xx" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(texts)]
    return rows + rows[3:5]


def sets_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    s = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if s[i] and r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s[i]), least.get(root(i)) if s[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_components(spark, corpus):
    got = jaccard.jaccard_components(spark.createDataFrame(corpus, DOCS))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(corpus)
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_of_a_large_near_copy_group_and_common_tokens(spark):
    rng = random.Random(1)
    shared, base = prose(rng, 40), prose(rng, 120).split()
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    rows += [(1000 + i, shared + " " + prose(rng, rng.choice((5, 12, 300)))) for i in range(60)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_repeats(spark, corpus, length):
    got = suffix.remove_repeats(spark.createDataFrame(corpus, DOCS), length=length).withColumn("h", F.sha2("kept", 256))
    want = Counter((r[0], *x) for r, x in zip(corpus, brute_repeats([r[1] for r in corpus], length), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.collect()) == want
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_over_stretches(spark, monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 101) for _ in range(9000)).decode()
    rows = [(0, text), (1, text[1500:4200] + "x" + text[5000:5190] + "y" + text[200:420])]
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 200), strict=True))
    for bits in (18, 11):
        monkeypatch.setattr(suffix, "STEP_BITS", bits)
        assert [len(list(suffix.stretches(9000, 200)))] == [1 if bits == 18 else 5]
        got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("h", F.sha2("kept", 256))
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.collect()) == want


def test_languages_on_held_out_documents(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcde äö", "bb": "fghij kl", "cc": "aeiou mn"}
    rows = [(i, "".join(rng.choice(kinds[k]) for _ in range(rng.randint(20, 200))), k, "s", 1) for i in range(360) for k in [sorted(kinds)[i % 3]]]
    rows += [(1000, None, "aa", None, 1), (1001, "12 .,!", None, None, 1), (1002, "", "bb", "s", 1), (None, "abc de abc", None, "s", 1)]
    got = {r.doc_id: r for r in langid.language_of(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows) and {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0 and got[None].held_out is False
    held = [(got[r[0]].lang_pred, r[2]) for r in rows[:360] if got[r[0]].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    none = langid.language_of(spark.createDataFrame([(1, "abc", None, "s", 1)], DOCS)).collect()
    assert none[0].lang_pred == "und" and langid.language_of(spark.createDataFrame([], DOCS)).count() == 0


def test_the_language_sample_is_held_once_and_packed(spark):
    rng = random.Random(6)
    rows = [("".join(chr(rng.randrange(0x4E00 + 3000 * (i % 2), 0x4E00 + 3000 * (i % 2) + 3000)) for _ in range(2500)), "ab"[i % 2]) for i in range(400)]
    table = spark.createDataFrame(rows, "text string, lang string").cache()
    grams = sum(len({t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)}) for t, _ in rows)
    tracemalloc.start()
    model = langid.train(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * grams + (16 << 20), (peak, grams)
    assert {r.lang: r.lang_pred for r in langid.identify(table, model).collect()} == {"a": "a", "b": "b"}


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        t = prose(rng, 40).split()
        for _ in range(2 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["zarkface", "zarkface", "blem" + rng.choice(WORDS), "blem" + rng.choice(WORDS)]))
        rows.append((i, " ".join(t), "xx", "s", 1))
        labels.append((i, int(toxic)))
    rows += [(9001, None, None, None, None), (9002, "", "xx", "s", 1), (None, "you zarkface", None, None, 1)]
    labels += [(9001, 1), (None, 1), (3, None)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), lab).collect()}
    held = [i for i in range(500) if got[i].held_out]
    assert len(got) == len(rows) and held and sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert got[9001].predicted == 0 and got[None].predicted == 1
    plain = toxicity.toxicity(spark.createDataFrame(rows[:5], DOCS), lab.limit(0)).collect()
    assert {r.predicted for r in plain} == {0} and toxicity.toxicity(spark.createDataFrame([], DOCS), lab).count() == 0


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "blem*": 4.0}, toxicity.np.array([1.0, 1.2, 0.3, 0.3, 1.0, 0.3]), -4.0)
    said = {c.strip(): [k for k, *_ in s] for c, s in g.clauses("you idiot. he is not an idiot! she said idiot, i will kill you; blemish, idiots")}
    assert said == {"you idiot": ["aimed insult"], "he is not an idiot": ["negated insult"], "she said idiot": ["reported insult"], "i will kill you": ["threat"], "blemish": ["insult"]}
    score = lambda t: g.read(t)[1]
    assert score("you idiot") > score("not an idiot") > score("fine") and score("") == score(None)


def test_composition_is_one_after_the_other():
    weights = toxicity.np.arange(1.0, 7.0)
    parts = [toxicity.threats(), toxicity.insults(), toxicity.negation(2), toxicity.reports(), toxicity.targets(), toxicity.weighed(weights)]
    whole = parts[0]
    for t in parts[1:]:
        whole = toxicity.compose(whole, t)
    for symbols in itertools.product(toxicity.SYMBOLS, repeat=4):
        out, total = list(symbols), [0.0] * 4
        for t in parts:
            path = t.run(out)
            out, total = [y for y, _ in path], [a + w for a, (_, w) in zip(total, path, strict=True)]
        assert whole.run(symbols) == list(zip(out, total, strict=True))
        # and what the grammar means, written out
        reported = aimed = intent = False
        negated = 0
        for x, y in zip(symbols, out, strict=True):
            want = "other"
            if x == "insult":
                want = "reported insult" if reported else "negated insult" if negated else "aimed insult" if aimed else "insult"
            elif x == "harm" and intent and not negated:
                want = "reported threat" if reported else "threat"
            assert y == want
            negated = 2 if x == "negation" else max(0, negated - 1)
            reported, aimed, intent = reported or x == "report", aimed or x == "target", intent or x == "intent"


def test_mixing_reaches_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "xx", f"s{i % 4}" if i % 11 else None, 1) for i in range(3000)] + [(5000, None, None, "s1", 1), (5001, "", None, None, 1), (None, "a b", None, "s2", 1)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, DOCS))
    per = {r.source: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("s"), F.max("target").alias("t"), F.sum("taken").alias("k"), F.max(F.expr("taken - 3 * size")).alias("over")).collect()}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while True:  # cap, and deal the rest anew
        share = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            rest -= target[k]
        open_ -= over
    for k in order:
        assert per[k].size == per[k].s == sizes[k] and per[k].t == pytest.approx(target[k]) and per[k].over <= 0
        assert abs(per[k].k - per[k].t) <= 30
    again = mixing.pareto_mix(spark.createDataFrame(rows[::-1], DOCS)).select("doc_id", "taken")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.select("doc_id", "taken").collect()))
    assert mixing.pareto_mix(spark.createDataFrame([], DOCS)).count() == 0


def test_rollup_is_idempotent(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/state")
    assert r.totals().count() == 0
    rows = lambda d: spark.createDataFrame(d, "op string, source string, lang string, tokenizer_version string, old_tokens long, tokens long")
    first = rows([("insert", "a", "en", "v1", None, 10), ("insert", "a", "en", "v1", None, 5), ("insert", None, None, "v1", None, None)])
    assert r.commit("1", first) and not r.commit("1", first)
    assert r.commit("2", rows([("revise", "a", "en", "v1", 10, 7), ("delete", "a", "en", "v1", 5, None)]))
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v1", 1, 7), (None, None, "v1", 1, 0)}
    with pytest.raises(Exception):
        r.commit("3", rows([("drop", "a", "en", "v1", None, 1)]))
    assert not r.committed("3") and r.totals().count() == 2 and r.commit("3", rows([]))
    # a revision may move a document to other keys, and what is compacted counts once
    moved = spark.createDataFrame([("revise", "b", "de", "v2", 7, 9, "a", "en", "v1")], "op string, source string, lang string, tokenizer_version string, old_tokens long, tokens long, old_source string, old_lang string, old_tokenizer_version string")
    want = {("b", "de", "v2", 1, 9), (None, None, "v1", 1, 0)}
    assert r.compact() == 3 and r.names("batches") == [] and r.commit("4", moved) and not r.commit("2", first)
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.compact() == 1 and r.compact() == 0 and not r.commit("1", first) and not r.commit("4", moved)
    assert {tuple(x) for x in r.totals().collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the tables")
def test_token_count_query(spark):
    """The whole query against the tokenizers' own counts of the texts that are left in the end."""
    public = pytest.importorskip("public_tokenizers")
    import tiktoken
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    words = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    from tiktoken.load import load_tiktoken_bpe

    pieces = tiktoken.Encoding("given", pat_str=public.PATTERN, mergeable_ranks=load_tiktoken_bpe(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang", "text").collect():
        text = r.text or ""
        if len(re.findall(r"[^\x20\x09-\x0D]+", text)) < 20:
            continue
        clean = re.sub("[0-9]+", "", text)
        for version, n in (("word_bpe_49k", len(words.encode(clean, add_special_tokens=False).ids)), ("byte_bpe_multi_50k", len(pieces.encode_ordinary(clean)))):
            want[r.source, r.lang, version, "docs"] += 1
            want[r.source, r.lang, version, "tokens"] += n
    got = Counter()
    for r in rollup.op3(spark, sf).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] += r.n_tokens
    assert got == want and len(want) > 20


def test_tokens_are_those_of_the_tokenizers(spark):
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    texts = ["", None, "Plain words, 12 of them", "Größe ÉTÉ it's 1999", "日本 <|endoftext|> x", "word " * 3000]
    docs = spark.createDataFrame([(i, t, t and t.replace("1", ""), "K") for i, t in enumerate(texts)], "row long, text string, clean string, counts string")
    versions = {"word": (public.path("word_bpe_49k.json"), None), "byte": (public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)}
    word = Tokenizer.from_file(versions["word"][0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(versions["byte"][0], "rb"))}
    byte = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = {"word": lambda t: len(word.encode(t, add_special_tokens=False).ids), "byte": lambda t: len(byte.encode_ordinary(t))}
    for r in rollup.tokenizer_counts(docs, ["text", "clean"], versions).collect():
        t = texts[r.row] or ""
        assert {x.tokenizer_version: x.tokens for x in r.counts} == {v: [f(t), f(t.replace("1", ""))] for v, f in count.items()}
    n = {x.tokenizer_version: x.tokens for x in rollup.pattern_counts(spark.createDataFrame([("a b, 12",)], "text string"), ["text"]).first().counts}
    assert n == {"words-1": [3], "pieces-1": [4]}
    assert rollup.tokenizer_counts(docs.limit(0), ["text"], versions).count() == 0


def test_repeats_of_real_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d.doc_id, *x) for d, x in zip(docs, brute_repeats([d.text for d in docs], 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op5(spark, folder).collect()) == want


def test_phrases_of_one_letter_are_one_row(spark):
    text = "a" * 300_000
    p = suffix.phrases(suffix.np.frombuffer(text[:4000].encode(), suffix.np.uint8), 200)
    one, two = p.keys()
    assert len(p.first) > 3000 and len({*zip(one.tolist(), two.tolist(), strict=True)}) == 1
    got = suffix.remove_repeats(spark.createDataFrame([(1, text), (2, "b" * 100 + text[:250])], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in got} == {(1, 300_000, 1), (2, 250, 1)}


def test_the_sample_is_paretos(spark):
    """Copies of every document by a second, plain version of the plan."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), "xx", f"s{i % 3}", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    u = {r.doc_id: r.u for r in docs.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.pareto_mix(docs).collect()}
    for source in ("s0", "s1", "s2"):
        own = [(i, len(t.split())) for i, t, _, s, _ in rows if s == source]
        target = got[own[0][0]].target
        weight = {i: 1 + (int(math.log2(n)) if n else 0) for i, n in own}
        low, high = 0.0, 10.0
        for _ in range(200):  # the level at which copies in proportion to weight, 3 at most, make the target
            level = (low + high) / 2
            low, high = (level, high) if sum(n * min(3.0, level * weight[i]) for i, n in own) < target else (low, level)
        wish = {i: min(3.0, high * weight[i]) for i, _ in own}
        certain = {i: math.floor(w + 1e-9) for i, w in wish.items()}
        p = {i: max(0.0, wish[i] - certain[i]) for i in wish}
        assert len({round(x, 6) for x in p.values()}) > 2  # inclusion probabilities differ from document to document
        left = target - sum(certain[i] * n for i, n in own)
        size, copies = dict(own), dict(certain)
        drawn = sorted(((u[i] / (1 - u[i])) / (p[i] / (1 - p[i])), i) for i in p if p[i] > 1e-9)
        rest = []
        for k, (_, i) in enumerate(drawn):
            if size[i] > left + 1e-6:
                rest = drawn[k:]
                break
            copies[i] += 1
            left -= size[i]
        more = {i: got[i].copies - copies[i] for i, _ in own if got[i].copies != copies[i]}
        gaps = [abs(size[i] - left) for _, i in rest if abs(size[i] - left) < left]
        # one more document closes the gap, and none comes nearer to it
        assert list(more.values()) == [1] * bool(gaps) and all(abs(size[i] - left) == pytest.approx(min(gaps), abs=1e-6) for i in more)
        copies |= {i: copies[i] + 1 for i in more}
        assert abs(sum(copies[i] * n for i, n in own) - target) <= 60


def test_a_large_group_of_repeated_rows_does_not_overshoot(spark):
    rows = [(1, "a b c d e f g h", None, "s0", 1)] * 4000 + [(i, "w " * (i % 40), None, "s0" if i % 2 else "s1", 1) for i in range(2, 1500)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.expr("taken - 3 * size")).alias("over")).collect()
    for r in got:
        assert r.over <= 0 and abs(r.taken - r.target) <= 0.03 * r.target


def test_mixing_does_not_depend_on_how_a_table_is_split(spark, tmp_path):
    """The end of a sample falls among rows that repeat; some of them differ in a column that is only carried along."""
    rows = [(1, "a b c d e f g h", None, "s0", i % 3 if i < 2500 else 7) for i in range(4000)] + [(i, "w " * (i % 40), None, "s0" if i % 2 else "s1", 1) for i in range(2, 1500)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = []
    for size, deal in (("128m", lambda d: d), ("8k", lambda d: d), ("128m", lambda d: d.repartition(7, "extra")), ("8k", lambda d: d.orderBy(F.desc("doc_id"), F.rand(3)))):
        with shared.settings(spark, spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes="1k"):
            found.append(Counter(tuple(r) for r in mixing.pareto_mix(deal(table)).select("doc_id", "extra", "size", "taken").collect()))
    assert found[0] == found[1] == found[2] == found[3]
    extra = {k: v for k, v in found[0].items() if k[0] == 1}
    assert sum(extra.values()) == 4000 and len({k[3] for k in extra}) == 2  # some of the repeated rows are taken once more


def test_toxicity_scores_a_second_way():
    g = toxicity.Grammar({"zark": 3.0, "blem*": 2.0, "mudface": 4.0}, toxicity.np.array([0.9, 1.3, 0.2, 0.3, 1.1, 0.4]), -2.0)
    rng = random.Random(9)
    pool = ["zark", "zarks", "blemish", "blem", "mudface", "you", "not", "said", "kill", "will", "\u201c", "der", "x", ".", ",", "!", "ne", "tu"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        sums = dict.fromkeys(toxicity.KINDS, 0.0)
        for clause in re.split(r"[.!?;:,\n]", text.lower()):
            reported = aimed = intent = False
            negated = 0
            for t in re.findall(r"[^\W\d_]+|\u201c", clause):
                w = {"zark": 3.0, "mudface": 4.0}.get(t, 2.0 if t.startswith("blem") and len(t) >= 4 else 0.0)
                if w:
                    sums["reported insult" if reported else "negated insult" if negated else "aimed insult" if aimed else "insult"] += w
                elif t == "kill" and intent and not negated:
                    sums["reported threat" if reported else "threat"] += 1.0
                negated = 3 if t in ("not", "ne") else max(0, negated - 1)
                reported, aimed, intent = reported or t in ("said", "\u201c"), aimed or t in ("you", "der", "tu") and t != "der", intent or t == "will"
        x = [math.log1p(sums[k]) for k in toxicity.KINDS]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, g.weights, strict=True)) - 2.0)))
        assert g.read(text)[1] == pytest.approx(want, abs=1e-12), text


def test_language_scores_a_second_way():
    np = langid.np
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.FEATURES + 1, 3)), rng.normal(size=3), 1.7)
    model.weights[langid.FEATURES] = 0
    texts = ["Straße É x", "a", "", "日本 ab", "x" * 50]
    data, lengths = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
    got = model.scores(data, lengths)

    def feature(gram):
        c = [int(langid.LOWER[0][ord(x)]) for x in gram]
        m = 0xFFFFFFFF
        h = (c[0] * 0x9E3779B1 + len(c)) & m
        for x in c[1:]:
            h = (((h ^ (h >> 15)) * 0x85EBCA6B & m) + x * 0xC2B2AE35) & m
        h ^= h >> 16
        return (h * 0x7FEB352D & m) >> 16

    for t, p in zip(texts, got, strict=True):
        grams = [t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)]
        logits = langid.SCALE * sum((model.weights[feature(g)] for g in grams), np.zeros(3)) / max(len(grams), 1)
        e = np.exp((logits + model.bias) / 1.7)
        assert np.allclose(p, e / e.sum())


#: Names that operators use inside or add, as columns of the input.
CLASH = ["row", "body", "key", "also", "size", "u", "bin", "p", "kept", "spans", "n_bytes", "score", "predicted", "lang_pred", "copies", "taken", "target", "class", "rank_key", "x", "counts", "node", "token", "ranges"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, equal and repeated texts under columns of any name."""
    texts = [None, "", " \t\n", "a", "word " * 30_000, "Ein kleiner Satz.", "Ein kleiner Satz.", "éé" * 400, "\x00 \U0001f600"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(texts)] + [(None, None, None, None), (5, "Ein kleiner Satz.", "en", None)]
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASH)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_odd_rows(spark, odd):
    n, held = odd.count(), [c for c in CLASH]
    model = langid.train(odd.select("text", "lang"))
    outs = {
        "score": toxicity.score_rows(odd, toxicity.Grammar({"satz": 2.0})),
        "lang_pred": langid.identify(odd, model),
        "copies": mixing.pareto_mix(odd),
        "kept": suffix.remove_repeats(odd),
        "counts": rollup.pattern_counts(odd, ["text"]),
    }
    for name, df in outs.items():
        got = df.collect()
        assert len(got) == n and name in df.columns and len(set(df.columns)) == len(df.columns)
        new = set(df.columns) - {*held, "doc_id", "text", "lang", "source"} | {"score", "predicted", "clauses", "lang_pred", "size", "source_size", "target", "copies", "taken", "n_bytes", "n_removed", "n_spans", "spans", "kept", "counts"}
        for c in set(held) & set(df.columns) - new:
            assert {r[c] for r in got} == {f"{c}!"}, (name, c)
    plain = odd.select("doc_id", "text", "lang", "source")
    for f in (lambda d: jaccard.jaccard_components(d), lambda d: toxicity.toxicity(d, spark.createDataFrame([(5, 1), (None, 0), (4, 0)], "doc_id long, toxic int")), lambda d: langid.language_of(d)):
        assert Counter(r.doc_id for r in f(odd).collect()) == Counter(r.doc_id for r in plain.collect())
        assert f(odd.limit(0)).count() == 0
