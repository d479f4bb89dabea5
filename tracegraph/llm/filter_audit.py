"""How filters act together: each row as a word of the filter subsets that it survives, counted bit by bit with carry-save adders."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.shared import WORD, cut, small, tidy

#: Parts whose counts a task holds before it hands them on.
PARTS = 4096


def containing(f: int, filters: int) -> int:
    """The word of all subsets (bit t: subset t of the filters) that contain filter ``f``."""
    return sum(1 << t for t in range(1 << filters) if t >> f & 1)


def survival_word(failures: list[Column]) -> Column:
    """The truth table of a row: bit t is set if it fails no filter of subset t. Five filters make a 32-bit word. A null condition is no failure."""
    k = len(failures)
    full = (1 << (1 << k)) - 1
    word = F.lit(full).cast("long")
    for f, fails in enumerate(failures):
        word = word.bitwiseAND(F.when(fails, F.lit(full & ~containing(f, k)).cast("long")).otherwise(F.lit(full).cast("long")))
    return word


def popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit.

    Carry-save adders take three words to one of sums and one of carries that count twice, for all 32 bits at once, until two words or
    fewer of a weight are left; only those are read bit by bit. Work is linear in the words.
    """
    out, level, weight = np.zeros(32, np.int64), words.astype(np.uint32, copy=False), 1
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        for w in level.tolist():
            out += weight * ((w >> np.arange(32)) & 1)
        level, weight = (np.concatenate(carries) if carries else level[:0]), 2 * weight
    return out


def subset_survivors(rows: DataFrame, marks: int) -> DataFrame:
    """Rows (part, word, mark: bits of the row's marks) to one row per part with ``counts``, an array of arrays of 32 numbers: how many
    rows survive each subset, of all rows and then of those with each mark.

    A task adds the words of each part and mark up by ``popcounts`` and hands on its counts alone, so that a part of any size is summed where
    its rows are.
    """
    size = 32 * (1 + marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size, np.int64))

        def handed_on() -> pa.RecordBatch:
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *held.values()]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(held) + 1, size, dtype=np.int32)), flat)
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), lists], ["part", "n"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, word, mark = coded.dictionary.to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            key = np.asarray(coded.indices).astype(np.int64) << marks | mark
            order = np.argsort(key, kind="stable")
            key, word = key[order], word[order].astype(np.uint32)
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else []
            start = 0
            for end in ends:
                n, own = popcounts(word[start:end]), held[names[key[start] >> marks]]
                own[:32] += n
                for m in range(marks):
                    if key[start] >> m & 1:
                        own[32 * (m + 1) : 32 * (m + 2)] += n
                start = end
            if len(held) > PARTS:
                yield handed_on()
        if held:
            yield handed_on()

    counted = rows.select("part", "word", F.col("mark").cast("int").alias("mark")).mapInArrow(tidy(run), "part string, n array<bigint>")
    sums = counted.select("part", F.posexplode("n").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    flat = sums.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n"))
    return flat.select("part", F.array(*[F.slice("n", 32 * i + 1, 32) for i in range(1 + marks)]).alias("counts"))


def order_report(survivors: DataFrame, names: str, marks: dict[str, str]) -> DataFrame:
    """For each part, order of all filters (``names``, a letter each) and step: what the filter of that step does there.

    All numbers come from survivors of subsets: with b the filters before a step and f its own, kept is the survivors of b + f, removed those of b
    less kept, redundant the rows that fail f less removed, unique_fails the survivors of all but f less those of all. shapley sums removed over
    all orders: a subset before f stands there in |b|! (k - 1 - |b|)! of them. ``marks`` names the columns of marked rows removed.
    """
    k = len(names)
    orders = F.lit(["".join(p) for p in permutations(names)])
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substr("filter_order", at, F.lit(1))) - 1)
    of = lambda m, subset: F.get(F.get("counts", F.lit(m)), subset)
    rows = survivors.select("part", "counts", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("after", F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i))))
    rows = rows.withColumn("before", F.col("after") - F.col("own")).withColumn("removed", of(0, F.col("before")) - of(0, F.col("after")))
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda t: t.bitwiseAND(F.col("own")) == 0)
    weight = lambda t: F.factorial(F.bit_count(t)) * F.factorial(F.lit(k - 1) - F.bit_count(t))
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda a, t: a + weight(t) * (of(0, t) - of(0, t + F.col("own"))))
    full = (1 << k) - 1
    return rows.select(
        "part", "filter_order", "step", of(0, F.col("after")).alias("kept"), "removed",
        (of(0, F.lit(0)) - of(0, F.col("own")) - F.col("removed")).alias("redundant"),
        (of(0, F.lit(full) - F.col("own")) - of(0, F.lit(full))).alias("unique_fails"),
        *[(of(i + 1, F.col("before")) - of(i + 1, F.col("after"))).alias(c) for i, c in enumerate(marks.values())],
        shapley.alias("shapley"),
    )


def side(table: DataFrame) -> DataFrame:
    """The other side of a join: sent to all if its rows are few, else sorted and merged, whatever its files make Spark believe of its size."""
    sent = small(table)
    return sent if sent is not table else table.hint("merge")


def with_repeat(rows: DataFrame, id_col: str = "doc_id", digest_col: str = "digest") -> DataFrame:
    """Adds ``repeat``: whether a smaller id has the same digest. ``rows`` is a written table, so that Spark may split a digest that many rows share."""
    first = rows.groupBy(digest_col).agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("last_id > first_id").drop("last_id")
    return rows.join(side(cut(first)), digest_col, "left").withColumn("repeat", F.coalesce(F.col(id_col) > F.col("first_id"), F.lit(False))).drop("first_id")


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Interaction of five filters, for each part and all 120 orders of them, step by step.

    A: under 50 words. B: distinct words under 65 % of the words. C: capitals A-Z over 5 % of the code points. D: one of ``#$%&*|``. E: the
    text of a smaller id. Texts are read once, for four conditions and a digest; E and the labels are joined to that slim table.

    Null text: empty, so it fails A, and E if a smaller id has a null or empty text. A row without id neither fails E nor makes others fail it, and
    has no label. A null part is the part ''. Rows that repeat (id and text) count each and do not fail E by each other. Several labels of
    an id: any of them counts. An empty table gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n", F.size("tokens"))
    slim = cut(rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.col("n") < 50).alias("a"),
        (F.size(F.array_distinct("tokens")) * F.lit(100).cast("long") < 65 * F.col("n")).alias("b"),
        (F.regexp_count("text", F.lit("[A-Z]")) * F.lit(100).cast("long") > 5 * F.length("text")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"),
    ))
    any_of = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = cut(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(any_of("quality"), any_of("toxic")).where("quality or toxic"))
    judged = with_repeat(slim).drop("digest").join(side(known), "doc_id", "left")
    mark = F.coalesce(F.col("quality").cast("int") + 2 * F.col("toxic").cast("int"), F.lit(0))
    words = judged.select("part", survival_word([F.col(c) for c in ("a", "b", "c", "d", "repeat")]).alias("word"), mark.alias("mark"))
    return order_report(subset_survivors(words, 2), "ABCDE", {"quality": "good_lost", "toxic": "toxic_lost"})


def op11(spark, sf_dir: str) -> DataFrame:
    """``filter_audit`` of all documents and labels; null, empty and repeated rows as there."""
    return filter_audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
        [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
k AS (SELECT i::INT AS i, chr(64 + i::INT) AS c FROM range(1, 6) r(i)),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, k.i AS step, o[k.i] AS own, o[1:k.i - 1] AS before, o FROM p, k),
x AS (SELECT part, filter_order, step, own, n, good, bad, fails[own] AS hit, len(list_filter(before, lambda z: fails[z])) > 0 AS gone, len(list_filter([1, 2, 3, 4, 5], lambda z: fails[z])) = 1 AS alone FROM g, s),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""
