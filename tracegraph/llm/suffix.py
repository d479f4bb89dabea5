"""Removal of repeated passages by prefix-free parsing.

Rolling hashes of ``K`` bytes trigger phrases: every ``length``-byte string is anchored at the first of its windows whose hash meets the trigger
condition (in a string without any, at its window of least hash), so equal strings are anchored at equal places. The strings of
one anchor are a phrase: it holds them whole, from the bytes before the trigger to those after it. The distinct phrases are the
dictionary; which phrase stands where is the parse.

Phrases that occur twice in the parse hold only strings that repeat. For the others two suffix arrays are made, of those phrases whose
bytes next to the trigger others have too: the dictionary's, of what ends in a trigger, read backwards, and the parse's, of what goes on from it. Both
are sorts of bytes into ranges over all tasks, and the common lengths of neighbours tell for every phrase and length the first
one in order with which it agrees so far. A string is its part up to the trigger and its part from there, so the two
ranks combined are its place in corpus order: equal pairs of ranks are equal strings, by their bytes and not by a hash. The
parse carries what the dictionary shows back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegraph.llm.shared import bit_table, buffers, carried, cut, discard, has_bit, mix64, restored, tidy

#: Bytes of a trigger, and low bits of its hash that are zero: a trigger comes every 2 ** ``SPARSE`` bytes on average.
K, SPARSE = 32, 6

#: Text positions hashed at a time; the low bits of a window's key hold a position among them.
STEP_BITS = 18

#: Bits of a mark that hold how many strings follow the first; the mark of a whole phrase or text.
MORE, WHOLE = 20, -1

_rng = np.random.default_rng(20240611)
LETTERS = [_rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
POWERS: list[list[np.ndarray]] = []


def powers(n: int) -> list[list[np.ndarray]]:
    """For each base its powers and those of its inverse modulo 2 ** 64, n of them at least."""
    if not POWERS or len(POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        POWERS[:] = [[np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64))] for base in BASES]
    return POWERS


@dataclass
class Phrases:
    """Phrases of one stretch of text: strings ``first`` to ``last`` (their starts) with the trigger at ``at``."""

    sums: list[np.ndarray]
    length: int
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each phrase's bytes, strings and place of the trigger, as two numbers."""
        a, b = self.first, self.last + self.length
        salt = (self.at - self.first + ((self.last - self.first) << 16)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        one, two = (mix64((s[b] - s[a]) * p[1][a] + salt).view(np.int64) for s, p in zip(self.sums, powers(len(self.sums[0])), strict=True))
        return one, two

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the core behind and before the trigger, 0 where no string of the phrase has it.

        A string reaches at least half of what it has besides the trigger to one of its sides, so it holds one of the two whole.
        """
        half = (self.length - K) // 2
        out = []
        for a, b, there in ((self.at, self.at + self.length - half, self.at - self.last <= half), (self.at - half - 1, self.at + K, self.at - self.first > half)):
            a, b = np.where(there, a, 0), np.where(there, b, 0)
            out.append(np.where(there, mix64((self.sums[0][b] - self.sums[0][a]) * powers(len(self.sums[0]))[0][1][a] + np.uint64(len(out) + 1)), np.uint64(0)).view(np.int64))
        return out[0], out[1]

    def pick(self, which: np.ndarray) -> Phrases:
        return Phrases(self.sums, self.length, self.first[which], self.last[which], self.at[which])


def phrases(d: np.ndarray, length: int) -> Phrases:
    """Cuts at most 2 ** ``STEP_BITS`` bytes, ``length`` at least, into phrases."""
    tables = powers(len(d) + 1)
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(letter[d] * up[: len(d)]))) for letter, (up, _) in zip(LETTERS, tables, strict=True)]
    m, w, n = len(d) - K + 1, length - K + 1, len(d) - length + 1
    h = mix64((sums[0][K:] - sums[0][:-K]) * tables[0][1][:m])
    place = np.arange(m)
    # the next window from each place on that meets the condition
    after = np.where(h & np.uint64((1 << SPARSE) - 1) == 0, place, m + w)
    at = np.minimum.accumulate(after[::-1])[::-1][:n]
    none = np.flatnonzero(at >= place[:n] + w)
    if len(none):  # the least hash among the string's windows
        low = np.uint64((1 << STEP_BITS) - 1)
        key = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[:m] = (h & ~low) | place.astype(np.uint64)
        rows = key.reshape(-1, w)
        before = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        at = at.copy()
        at[none] = (np.minimum(behind[none], before[none + w - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return Phrases(sums, length, first, np.append(first[1:], n) - 1, at[first])


def stretches(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text of ``size`` bytes that hold each ``length``-byte string once."""
    step = 1 << STEP_BITS
    for a in range(0, max(size - length + 1, 0), step - length + 1):
        yield a, min(size, a + step)


def parsed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[tuple[int, int], int, np.ndarray, Phrases]]:
    """For batches of (key, also, text): the text's keys, start of the stretch, its bytes, phrases. A text that a task has seen is not parsed again."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        data, offsets = buffers(batch.column(2))
        for i, key in enumerate(keys):
            if offsets[i + 1] - offsets[i] < length or key in seen:
                continue
            seen.add(key)
            for a, b in stretches(int(offsets[i + 1] - offsets[i]), length):
                d = data[offsets[i] + a : offsets[i] + b]
                yield key, a, d, phrases(d, length)


def gathered(rows: Iterator[tuple[np.ndarray, ...]], names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Tuples of arrays joined into batches of about ``most`` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def mark(first: str | Column, more: str | Column) -> Column:
    """A range of strings as one number: its first start, and how many more follow."""
    first, more = (F.col(c) if isinstance(c, str) else c for c in (first, more))
    return (first.cast("long") * F.lit(1 << MORE) + more.cast("long")).alias("mark")


def common(rows: list[bytes], width: int) -> np.ndarray:
    """Common length of each row but the first with the one before it."""
    sizes = np.array([len(r) for r in rows])
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    same = m[1:] == m[:-1]
    out = np.where(same.all(1), width, same.argmin(1)) if width else np.zeros(len(rows) - 1, np.int64)
    return np.minimum(out, np.minimum(sizes[1:], sizes[:-1]))


def suffix_array(rows: DataFrame, width: int) -> DataFrame:
    """Sorts (p, q, bytes) of at most ``width`` bytes, and tells for each row and each depth the first row in order that agrees with it so far.

    p, q, part, most, depths, leaders: from depths[i] on the leader is number leaders[i] of range ``part``; ``most`` is the depth up to which
    the row agrees with a neighbour. Rows that agree may lie in several ranges; leader 0 of a range may so have one before it,
    for which each range gives one more row (p null) with its first and last bytes and its last row's leaders (see ``Chain``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None
        depths: list[int] = []
        leaders: list[int] = []
        number, held = 0, None  # held: the row whose next neighbour has not come

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([*made[:2], pa.array(np.full(len(out), part, np.int32)), *made[2:]], ["p", "q", "part", "most", "depths", "leaders", "first", "last"])

        for batch in batches:
            raw = batch.column(2).to_pylist()
            if not raw:
                continue
            first = raw[0] if first is None else first
            agree = common([raw[0] if last is None else last, *raw], width)
            if last is None:
                agree[0] = 0
            out = []
            for p, q, x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw, agree.tolist(), strict=True):
                while depths and depths[-1] > c:
                    depths.pop()
                    leaders.pop()
                if c < len(x):
                    depths.append(c + 1)
                    leaders.append(number)
                if held is not None:
                    out.append((*held[:2], max(held[2], c), *held[3:], None, None))
                held = (p, q, c if number else len(x), depths[:], leaders[:])  # what comes before the range may agree with all of its first row
                number += 1
                last = x
            yield batch_of(out)
        if held is not None:
            yield batch_of([(*held[:2], len(last), *held[3:], None, None), (None, None, 0, depths, leaders, first, last)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "bytes", "p").sortWithinPartitions("bytes", "p").select("p", "q", "bytes")
    return cut(ranged.mapInArrow(tidy(run), "p long, q long, part int, most int, depths array<int>, leaders array<long>, first binary, last binary"))


class Chain:
    """Which class leader 0 of each range belongs to at each depth: a table of (ranges, ``width`` + 1), as one number for range and leader."""

    def __init__(self, table: DataFrame, width: int):
        ends = sorted(table.where("p is null").select("part", "depths", "leaders", "first", "last").collect(), key=lambda r: r.part)
        self.row = {r.part: i for i, r in enumerate(ends)}
        self.of = np.zeros((len(ends), width + 1), np.int64)
        for i, r in enumerate(ends):
            self.of[i] = r.part << 40
            if i:
                before = ends[i - 1]
                agree = int(common([bytes(before.last), bytes(r.first)], width)[0])
                d = np.arange(1, agree + 1)
                self.of[i, 1 : agree + 1] = self.number(before.part, np.array(before.depths), np.array(before.leaders), d)

    def number(self, part: int, depths: np.ndarray, leaders: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class of a row at the depths ``at``."""
        own = leaders[np.searchsorted(depths, at, "right") - 1]
        return np.where(own == 0, self.of[self.row[part], at], (part << 40) + own)


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """For (key, also, text) rows: (key, also, mark), marks of ranges of starts of ``length``-byte strings that start anywhere else too.

    Strings of texts that are repeated whole may be missing; the caller knows those by their keys.
    """
    spark = texts.sparkSession

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for (key, also), a, _, p in parsed(batches, length):
                one, two = p.keys()
                more = p.last - p.first
                # equal phrases in a row, as in a text of one letter, are one row
                new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                run = np.diff(np.append(new, len(one)))
                behind, before = p.cores()
                yield np.full(len(new), key), np.full(len(new), also, np.int32), a + p.first[new], more[new].astype(np.int32), run.astype(np.int32), one[new], two[new], behind[new], before[new]

        yield from gathered(rows(), ["key", "also", "start", "more", "run", "p", "q", "behind", "before"])

    parse_ = cut(texts.mapInArrow(tidy(parse), "key long, also int, start long, more int, run int, p long, q long, behind long, before long"))
    dictionary = cut(parse_.groupBy("p", "q").agg(F.first("behind").alias("behind"), F.first("before").alias("before"), F.sum("run").alias("n")))
    cores = dictionary.select(F.explode(F.array("behind", "before")).alias("key")).where("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cores = cut(cores.select("key"))
    several = spark.sparkContext.broadcast(bit_table(cores))
    discard(cores)
    full = cut(dictionary.where("n > 1").select("p", "q", F.lit(WHOLE).cast("long").alias("mark")))
    discard(dictionary)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases that share a core with another one, each once a task: their bytes up to the trigger, backwards, and from it on."""
        seen: set[tuple[int, int]] = set()
        out: list[tuple] = []
        names = ["p", "q", "least", "left", "right"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for _, _, d, p in parsed(batches, length):
            behind, before = p.cores()
            which = np.flatnonzero((behind != 0) & has_bit(several.value, behind) | (before != 0) & has_bit(several.value, before))
            if len(which):
                p = p.pick(which)
                raw = d.tobytes()
                for one, two, first, last, at in zip(*(c.tolist() for c in (*p.keys(), p.first, p.last, p.at)), strict=True):
                    if (one, two) not in seen:
                        seen.add((one, two))
                        out.append((one, two, at - last, raw[first : at + K][::-1], raw[at : last + length]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    entry = cut(texts.mapInArrow(tidy(entries), "p long, q long, least int, left binary, right binary").dropDuplicates(["p", "q"]))
    several.destroy()
    left, right = suffix_array(entry.select("p", "q", F.col("left").alias("bytes")), length), suffix_array(entry.select("p", "q", F.col("right").alias("bytes")), length)
    chains = spark.sparkContext.broadcast((Chain(left, length), Chain(right, length)))
    side = lambda t, s: t.where("p is not null").select("p", "q", *[F.col(c).alias(f"{s}_{c}") for c in ("part", "most", "depths", "leaders")])
    both = entry.select("p", "q", "least", (F.length("left") - K).alias("top")).join(side(left, "l"), ["p", "q"]).join(side(right, "r"), ["p", "q"])
    # bytes before the trigger that a string of the phrase has, and that some other phrase may share with it
    both = both.withColumn("low", F.greatest(F.col("least"), length - F.col("r_most"))).withColumn("high", F.least(F.col("top"), F.col("l_most") - K)).where("low <= high")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of a phrase by their pairs of classes: a row for each run of strings (``low`` to ``high`` bytes before the trigger) with one pair."""
        before, behind = chains.value

        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                of = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                flat = {c: (np.asarray(of[c].offsets), np.asarray(of[c].values)) for c in ("l_depths", "l_leaders", "r_depths", "r_leaders")}
                cut_ = lambda c, i: flat[c][1][flat[c][0][i] : flat[c][0][i + 1]]
                for i, (p, q, low, high, top, lp, rp) in enumerate(zip(*(of[c].to_pylist() for c in ("p", "q", "low", "high", "top", "l_part", "r_part")), strict=True)):
                    a = np.arange(low, high + 1)
                    x = before.number(lp, cut_("l_depths", i), cut_("l_leaders", i), a + K)
                    y = behind.number(rp, cut_("r_depths", i), cut_("r_leaders", i), length - a)
                    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                    n = len(new)
                    yield x[new], y[new], a[new].astype(np.int32), np.append(a[new[1:]] - 1, high).astype(np.int32), np.full(n, p), np.full(n, q), np.full(n, top, np.int32)

        yield from gathered(rows(), ["x", "y", "low", "high", "p", "q", "top"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the runs of a pair of classes (at most length ** 2 different ones) the parts that two phrases at least have."""
        last, held, out = None, [], []

        def close() -> None:
            if held and sum(n for *_, n in held) > 1:
                many = np.zeros(length + 2, np.int64)
                for low, high, n in held:
                    many[low] += n
                    many[high + 1] -= n
                shared = np.flatnonzero(np.diff((np.cumsum(many) > 1).astype(np.int8), prepend=0))
                for low, high, _ in held:
                    for s, e in zip(shared[::2].tolist(), shared[1::2].tolist(), strict=True):
                        if s <= high and e > low:
                            out.append((*last, low, high, max(s, low), min(e - 1, high)))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["x", "y", "low", "high", "least", "most"])

        for batch in batches:
            for x, y, low, high, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (x, y) != last:
                    close()
                    last, held = (x, y), []
                held.append((low, high, n))
            if len(out) > 20_000:
                yield flush()
        close()
        yield flush()

    cols = ["p", "q", "low", "high", "top", *[f"{s}_{c}" for s in "lr" for c in ("part", "depths", "leaders")]]
    runs = cut(both.select(*cols).mapInArrow(tidy(strings), "x long, y long, low int, high int, p long, q long, top int"))
    chains.destroy()
    discard(entry, left, right)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = runs.groupBy("x", "y", "low", "high").agg(F.count(F.lit(1)).alias("n")).repartition(parts, "x", "y").sortWithinPartitions("x", "y", "low", "high")
    shared = kinds.select("x", "y", "low", "high", "n").mapInArrow(tidy(twice), "x long, y long, low int, high int, least int, most int")
    same = cut(runs.join(shared, ["x", "y", "low", "high"]).select("p", "q", mark(F.col("top") - F.col("most"), F.col("most") - F.col("least"))))
    discard(runs)
    marks = cut(full.unionByName(same).groupBy("p", "q").agg(F.collect_set("mark").alias("marks")))
    discard(full, same)
    hits = parse_.join(marks, ["p", "q"]).select("key", "also", "start", "more", "run", F.explode("marks").alias("m"))
    # equal phrases in a row end where the last of them does
    all_ = mark("start", F.col("run") * (F.col("more") + 1) - 1)
    return hits.select("key", "also", F.when(F.col("m") == WHOLE, all_).otherwise(F.col("start") * F.lit(1 << MORE) + F.col("m")).alias("mark"))


def remove_repeats(docs: DataFrame, *, length: int = 200, text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans (start, end of the removed bytes) and kept (the bytes left) to every row.

    With ``as_text`` kept is a string, without the bytes of characters that a cut has split.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else in the table, in the same text or another.
    Strings never run over the end of a text, and are judged on the input. Texts are known by 96 bits of hashes and phrases by 128;
    strings of different phrases are compared by their bytes. Texts are read three times and shuffled once, to meet their ranges.

    Null text: empty. Texts shorter than ``length`` bytes stay whole. Texts that occur twice go whole. Rows that repeat are texts
    that do. An empty table gives no rows. Other columns stay as they are, but for those with the names of the new ones, which are replaced.
    """
    if not K < length < 1 << 12:
        raise ValueError(f"length must be between {K} and {1 << 12}")
    body = F.coalesce("body", F.lit(""))
    rows = carried(docs, body=text_col).withColumn("key", F.xxhash64(body, F.octet_length(body))).withColumn("also", F.hash(body))
    texts = rows.where(F.octet_length("body") >= length).select("key", "also", F.col("body").alias("text"))
    whole = texts.groupBy("key", "also").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "also", F.lit(WHOLE).cast("long").alias("mark"))
    ranges = cut(repeated_ranges(texts, length).unionByName(whole).groupBy("key", "also").agg(F.collect_set("mark").alias("ranges")))
    met = rows.join(ranges, ["key", "also"], "left").select("row", "body", "ranges")
    kind = "string" if as_text else "binary"
    added = StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept {kind}")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                data, offsets = buffers(part.column(1))
                sizes, removed, counts, spans, kept = [], [], [], [], []
                for i, found in enumerate(part.column(2).to_pylist()):
                    d = data[offsets[i] : offsets[i + 1]]
                    runs: list[list[int]] = []
                    for a, b in sorted((0, len(d)) if m == WHOLE else (m >> MORE, (m >> MORE) + (m & (1 << MORE) - 1) + length) for m in found or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(d)]
                    sizes.append(len(d))
                    removed.append(sum(b - a for a, b in runs))
                    counts.append(len(runs))
                    spans.append([{"start": a, "stop": b} for a, b in runs])
                    kept.append(b"".join(d[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], ["row", "body", *added.names])

    out = met.mapInArrow(tidy(run), StructType([*rows.select("row", "body").schema.fields, *added.fields]))
    return restored(out, docs, {"body": text_col}, added.names)


def op5(spark, sf_dir: str) -> DataFrame:
    """``remove_repeats`` over all documents, with a digest of what is left; null, empty and repeated texts as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
