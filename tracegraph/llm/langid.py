"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegraph.llm.shared import buffers, carried, chunks, restored, tidy, trim_heap

#: Hashed n-gram features; n-grams of these lengths.
FEATURES, ORDERS = 1 << 16, (1, 2, 3)

#: Factor on the relative frequencies, so that typical gradients are near one.
SCALE = 20.0

#: How the features of a sampled text (below ``FEATURES``) and their counts are packed on their way to the driver.
IDS, COUNTS = "<u2", "<u4"

UNKNOWN = "und"


def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


LOWER: list[np.ndarray] = []


def grams(data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For UTF-8 bytes of joined texts and their lengths in characters: per n-gram length the hashed feature at each character
    (``FEATURES`` where the n-gram would run over its text's end), and the first character of each text."""
    if not LOWER:
        LOWER.append(_lower())
    c = LOWER[0][np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    ends = np.cumsum(lengths)
    for n in ORDERS:
        h = c * np.uint32(0x9E3779B1) + np.uint32(n)
        for k in range(1, n):
            h[:-k] = (h[:-k] ^ (h[:-k] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[k:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        ids = ((h * np.uint32(0x7FEB352D)) >> np.uint32(16)).astype(np.int32)
        for k in range(1, n):
            ids[(ends - k)[(lengths >= k)]] = FEATURES
        yield ids, ends - lengths


@dataclass
class Model:
    """Languages, weights on the features' relative frequencies (one more row of zeros), bias and temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities, one row per text."""
        logits = np.zeros((len(lengths), len(self.langs)))
        total = np.maximum(sum(np.maximum(lengths - n + 1, 0) for n in ORDERS), 1)
        for ids, starts in grams(data, lengths):
            for k in range(len(self.langs)):
                run = np.concatenate(([0.0], np.cumsum(self.weights[ids, k], dtype=np.float64)))
                logits[:, k] += run[starts + lengths] - run[starts]
        logits = (SCALE * logits / total[:, None] + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def fit(rows: list[tuple[int, int, bytes, bytes]], langs: list[str], idf: np.ndarray, *, l1: float = 0.02, l2: float = 0.05, alpha: float = 0.3, beta: float = 1.0, epochs: int = 3) -> Model:
    """Follow-the-regularised-leader (proximal, per coordinate) with an elastic net on (class, n-grams of the text, features, counts).

    Features are packed as ``IDS`` and counts as ``COUNTS``; a row is unpacked when its turn comes, so that the rows are held once and packed. Every fifth row is kept out of the fit and calibrates the temperature by the least negative log-likelihood.
    """
    classes = len(langs)
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def of(ids: np.ndarray) -> np.ndarray:
        zi, ni = z[ids], n[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    def unpacked(total: int, features: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(features, IDS).astype(np.int64)
        return np.append(ids, FEATURES), np.append(SCALE * (np.frombuffer(counts, COUNTS) / total) * idf[ids], 1.0)

    learn, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    for _ in range(epochs):
        for y, *row in learn:
            ids, x = unpacked(*row)
            w = of(ids)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            old = n[ids]
            new = old + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[ids] = new
    w = of(np.arange(FEATURES + 1))
    best, temperature = np.inf, 1.0
    logits, truth = np.array([x @ w[ids] for ids, x in (unpacked(*row) for _, *row in held)]).reshape(-1, classes), np.array([y for y, *_ in held], int)
    for t in np.geomspace(0.05, 20, 61) if len(truth) else []:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))
        if loss < best:
            best, temperature = loss, float(t)
    bias = w[FEATURES].copy()
    weights = w * np.append(idf, 0.0)[:, None]
    weights[FEATURES] = 0.0
    return Model(langs, weights, bias, temperature)


#: Bytes of texts whose grams are held at a time.
TOGETHER = 1 << 18


def train(labelled: DataFrame, fit_rows: int = 3000) -> Model:
    """Fits on rows (text, lang): document frequencies over all of them, weights on a sample of about ``fit_rows``.

    The sample takes up to ``fit_rows`` / languages rows of each language (20 at least), chosen by a hash of the text, copies once; its
    rows are hashed sparse vectors of at most ``FEATURES`` numbers, six bytes each, which come to the driver. Null texts and null languages are
    left out; without any other row the model knows no language.
    """
    known = labelled.where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((FEATURES + 1, 0)), np.zeros(0), 1.0)
    quota = max(20, fit_rows // len(langs))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, rows = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, bool), 0
        for batch in batches:
            for _, _, ids in vectors(batch.column(0)):
                for x in ids:
                    seen[x] = True
                found += seen
                seen[:] = False
                rows += 1
        found[FEATURES] = rows
        keep = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(found[keep])], ["id", "n"])

    table = known.select("text").mapInArrow(tidy(frequencies), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(FEATURES + 1)
    found[table["id"].to_numpy()] = table["n"].to_numpy()
    idf = np.log((1 + found[FEATURES]) / (1 + found[:FEATURES])) + 1.0

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, n, ids in vectors(batch.column(1)):
                u, c = np.unique(np.concatenate(ids), return_counts=True)
                at = u < FEATURES
                out.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), n, u[at].astype(IDS).tobytes(), c[at].astype(COUNTS).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "h", "n", "ids", "counts"])

    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("lang") == k, F.lit(min(1.0, quota / n))).otherwise(rate)
    order = F.xxhash64("text", "lang")
    picked = known.select("lang", "text", order.alias("h")).where((F.shiftrightunsigned("h", 11) + 0.5) / float(1 << 53) < rate).dropDuplicates(["h"])
    sample = picked.select("lang", "text", "h").mapInArrow(tidy(sparse), "lang string, h long, n long, ids binary, counts binary").toArrow()
    at = {k: i for i, k in enumerate(langs)}
    rows = sorted(zip(*(sample[c].to_pylist() for c in ("h", "lang", "n", "ids", "counts")), strict=True), key=lambda r: r[:2])
    del sample
    model = fit([(at[lang], *row) for _, lang, *row in rows], langs, idf)
    del rows
    pa.default_memory_pool().release_unused()
    trim_heap()
    return model


def vectors(col: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For each text: its row, the number of its n-grams (1 at least), and its features by n-gram length."""
    data, offsets = buffers(col)
    lengths = np.asarray(pc.fill_null(pc.utf8_length(col), 0)).astype(np.int64)
    for i, j in chunks(offsets, TOGETHER):
        n = lengths[i:j]
        by = list(grams(data[offsets[i] : offsets[j]], n))
        for k in range(j - i):
            a = int(by[0][1][k])
            yield i + k, max(1, sum(max(0, int(n[k]) - m + 1) for m in ORDERS)), [ids[a : a + int(n[k])] for ids, _ in by]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the calibrated probability) to every row; ``und`` with score 0 for null texts and texts without a letter.

    Input columns of these two names are replaced, others stay. Without a learnt language every row is ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                col = part.column(1)
                data, offsets = buffers(col)
                lengths = np.asarray(pc.fill_null(pc.utf8_length(col), 0)).astype(np.int64)
                letter = np.asarray(pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False))
                pred, score = np.full(len(lengths), UNKNOWN, object), np.zeros(len(lengths))
                for i, j in chunks(offsets, TOGETHER) if m.langs else ():
                    p = m.scores(data[offsets[i] : offsets[j]], lengths[i:j])
                    best = p.argmax(1)
                    yes = letter[i:j]
                    pred[i:j][yes] = np.array(m.langs, object)[best[yes]]
                    score[i:j][yes] = p[np.arange(j - i), best][yes]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], ["row", "body", "lang_pred", "score"])

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = carried(docs, body=text_col)
    out = rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields]))
    return restored(out, docs, {"body": text_col}, ["lang_pred", "score"])


def remainder(id_col: str, of: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def language_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, with a model learnt from rows whose crc32(id) mod 4 is not 2.

    Null text or no letter: ``und``, score 0. A null id is neither held out nor learnt from; a null lang is not learnt. Without any
    learnt language everything is ``und``. Repeated rows are rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(remainder("doc_id", 4) != 2).select("text", "lang"), fit_rows)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(rows.select("doc_id", held, "text"), model).drop("text")


def op7(spark, sf_dir: str) -> DataFrame:
    """``language_of`` over all documents; null texts, ids and languages as there."""
    return language_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
