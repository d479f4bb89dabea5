"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.shared import bit_table, buffers, chunks, components, cut, has_bit, mix64, tidy

#: Slots of the shingle frequency table (hashed, so its size does not grow), and of them in one shipped part.
SLOTS, PART = 1 << 20, 1 << 14

#: Entries of a token that a task compares with as many others, on average; more are cut into blocks.
BLOCK = 1000

#: Pairs per entry that a group gives out at once; of a group with more, edges that span it first.
GIVEN = 2

#: Rounds after which all pairs that are left are given out; they are so before, if spanning edges hold less than this share of links.
ROUNDS, LIKELY = 8, 0.9

#: Words of parity bits per set that pairs of entries are compared by.
ODD = 16

#: Items between two pivots of the suffix filter, on average.
PER_BUCKET = 6

WORDS = [f"odd_{k}" for k in range(ODD)]

_rng = np.random.default_rng(20240607)
LETTER = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct ``width``-word shingles (fewer words: of the whole sequence)."""
    base, texts = int(offsets[0]), len(offsets) - 1
    d = LOWER[data[base : offsets[-1]]]
    cuts = offsets - base
    inside = ~BLANK[d]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts_of = cuts[:-1][cuts[:-1] < len(d)]
    begin[starts_of] = inside[starts_of]
    starts = np.flatnonzero(begin)
    words = np.searchsorted(starts, cuts)
    if len(starts):
        letters = d[inside]
        first = np.flatnonzero(begin[inside])
        sizes = np.diff(np.append(first, len(letters)))
        rel = np.arange(len(letters)) - np.repeat(first, sizes)
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(sizes.max()) - 1, BASE, np.uint64))))
        word = mix64(np.add.reduceat(LETTER[letters] * powers[rel], first) + sizes.astype(np.uint64))
        n = len(word)
        joined = np.zeros(max(n - width + 1, 0), np.uint64)
        for k in range(width):
            joined += word[k : k + len(joined)] * PLACE[k]
        joined = mix64(joined)
    for i in range(texts):
        a, b = int(words[i]), int(words[i + 1])
        if a == b:
            yield np.zeros(0, np.uint64)
        elif b - a < width:
            yield mix64(np.array([sum(int(word[a + k]) * int(PLACE[k]) for k in range(b - a)) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            yield np.unique(joined[a : b - width + 1])


def hashed(s: np.ndarray, seed: int) -> int:
    return int(mix64(np.array([np.sum(mix64(s ^ np.uint64(seed)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def key_of(s: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """A signed 64-bit key of a set, by which equal sets are one node; for keys in ``clashes``, which different sets have, another one."""
    key = hashed(s, 0x9E3779B97F4A7C15)
    return key if key not in clashes else hashed(s, 0xD1B54A32D192ED03)


def sketch_of(s: np.ndarray) -> bytes:
    """How many items of a set lie in each of about n / ``PER_BUCKET`` equal parts of the hash space, a power of two; a byte each, at most 255."""
    bits = max(0, int(np.ceil(np.log2(max(len(s), 1) / PER_BUCKET))))
    at = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 64 * ``ODD`` parts of the hash space whether the set has an odd number of items there, as ``ODD`` words.

    Two sets differ in at least as many items as their words differ in bits.
    """
    odd = np.bincount((s >> np.uint64(64 - int(np.log2(64 * ODD)))).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def far_apart(x: bytes, y: bytes, na: int, nb: int, least: int) -> bool:
    """Suffix filter: whether the numbers of items between fixed pivots differ by more than the pair's items that may be unshared."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if a.max() == 255 or b.max() == 255:
        return False
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.abs(a - b).sum()) > na + nb - 2 * least


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that reaches the similarity."""
    return -(-n * percent // 100)


def sets_of(col: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = buffers(col)
    for i, j in chunks(offsets):
        for k, s in enumerate(shingle_sets(data, offsets[i : j + 1], width)):
            yield i + k, s


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """Pass one. A row per document (doc_id, text_key, n, node, again, sketch; node null for empty sets), and rows (part, counts) of shingle frequencies.

    ``again`` is a second key of the set; where it differs under one node, the node's sets do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.uint32)
        names = ["doc_id", "text_key", "n", "node", "again", "sketch", "part", "counts", *WORDS]

        def count(held: list[np.ndarray]) -> None:
            table[:] += np.bincount((np.concatenate(held) >> np.uint64(44)).astype(np.int64), minlength=SLOTS).astype(np.uint32)

        for batch in batches:
            ns, nodes, again, sketches, odds, held, size = [], [], [], [], [], [], 0
            for _, s in sets_of(batch.column(1), width):
                ns.append(len(s))
                nodes.append(key_of(s) if len(s) else None)
                again.append(key_of(s, frozenset(nodes[-1:])) if len(s) else None)
                sketches.append(sketch_of(s) if len(s) else None)
                odds.append(parities(s))
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    count(held)
                    held, size = [], 0
            if held:
                count(held)
            m = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(again, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *[pa.array(c) for c in np.array(odds, np.int64).reshape(m, ODD).T.copy()]], names)
        parts = [k for k in range(SLOTS // PART) if table[k * PART : (k + 1) * PART].any()]
        for k in parts:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([table[k * PART : (k + 1) * PART].tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * ODD], names)

    return cut(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(run), "doc_id long, text_key long, n long, node long, again long, sketch binary, part int, counts binary, " + ", ".join(f"{w} long" for w in WORDS)))


def frequencies(table: DataFrame) -> np.ndarray:
    """The summed table of pass one; its size is fixed. Tasks add up in two steps, so that no task gets a row of every other."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(c, np.uint32 if len(c) == 4 * PART else np.uint64).astype(np.uint64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "counts"])

    rows = table.where("part is not null").select("part", "counts").mapInArrow(add, "part int, counts binary")
    rows = rows.repartition(SLOTS // PART, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(SLOTS, np.uint64)
    for r in rows.toLocalIterator():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.uint64)
    return out


def prefix_entries(docs: DataFrame, counts: np.ndarray, width: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """Pass two, over the rarest shingles of each set: pairs (a, b) and entries (token, node, pos, n), in one table.

    Order of shingles: frequency by the table, then hash; a total order, the same for all. The entries meet by token, and as the sorted
    rows go by, each set is paired with the first of its token if the filters allow it. Entries of one or two sets are then done with;
    the others stay. Tokens whose slot is far above the mean are dealt over many tasks; all their entries stay and none is paired.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
    often = int(8 * counts.mean() + 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = shared.value
        for batch in batches:
            out: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32))]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "node", "pos", "n", "salt"])

            for _, s in sets_of(batch.column(0), width):
                if not len(s) or (node := key_of(s, clashes)) in seen:
                    continue
                seen.add(node)
                n = len(s)
                p = n - needed(n, percent) + 1
                f = table[(s >> np.uint64(44)).astype(np.int64)]
                best = np.lexsort((s, f))[:p] if p * 4 >= n or n < 64 else None
                if best is None:
                    edge = np.partition(f, p - 1)[p - 1]
                    some = np.flatnonzero(f <= edge)
                    best = some[np.lexsort((s[some], f[some]))][:p]
                salt = np.where(f[best] > often, 1 + (node & 63), 0).astype(np.int32)
                out.append((s[best].view(np.int64), np.full(p, node, np.int64), np.arange(p, dtype=np.int32), np.full(p, n, np.int32), salt))
                size += p
                if size > 100_000:
                    yield flush()
                    out, size = [], 0
            yield flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", "pos", "n", "salt"]
        # of the token that the last batch ended with: its first entry, its second one while no third has come, and how many there were
        kept: list[np.ndarray] | None = None
        count, last_node = 0, None
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in names]
            if not len(cols[0]):
                continue
            fresh = np.ones(len(cols[0]), bool)  # not a set that two tasks gave out
            fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            fresh[0] = kept is None or cols[0][0] != kept[0][0] or cols[1][0] != last_node
            cols = [c[fresh] for c in cols]
            if not len(cols[0]):
                continue
            old, before = (0, 0) if kept is None else (len(kept[0]), count)
            token, node, pos, n, salt = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            first = np.concatenate(([True], token[1:] != token[:-1]))
            run = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(token)))
            if old:
                size[0] += before - old
            lead = starts[run]
            new = np.arange(len(token)) >= old
            pair = new & ~first & (salt == 0)
            pair[pair] = close(pos[lead[pair]], n[lead[pair]], pos[pair], n[pair], percent)
            stays = ((size[run] >= 3) | (salt > 0)) & (new | (run == 0) & (before < 3) & (salt == 0))
            ab = np.unique(np.stack([np.minimum(node[lead[pair]], node[pair]), np.maximum(node[lead[pair]], node[pair])], 1), axis=0)
            yield rows_of(ab[:, 0], ab[:, 1], None)
            yield rows_of(None, None, [token[stays], node[stays], pos[stays], n[stays]])
            a = int(starts[-1])
            count, last_node = int(size[-1]), node[-1]
            kept = [c[a : a + (2 if count == 2 else 1)] for c in (token, node, pos, n, salt)]

    def rows_of(a, b, entry) -> pa.RecordBatch:
        m = len(a) if entry is None else len(entry[0])
        pair = [pa.array(a), pa.array(b)] if entry is None else [pa.nulls(m, pa.int64())] * 2
        rest = [pa.nulls(m, pa.int64())] * 2 + [pa.nulls(m, pa.int32())] * 2 if entry is None else [pa.array(x) for x in entry]
        return pa.RecordBatch.from_arrays([*pair, *rest], ["a", "b", "token", "node", "pos", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = docs.select("text").mapInArrow(tidy(run), "token long, node long, pos int, n int, salt int")
    out = cut(entries.repartition(parts, "token", "salt").sortWithinPartitions("token", "node").mapInArrow(tidy(met), "a long, b long, token long, node long, pos int, n int"))
    shared.destroy()
    return out


def close(pa_: np.ndarray, na: np.ndarray, pb: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter on two entries of a token: what is left after it bounds the overlap."""
    overlap = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1).astype(np.int64)
    return (100 * np.minimum(na, nb).astype(np.int64) >= percent * np.maximum(na, nb)) & ((100 + percent) * overlap >= percent * (na + nb).astype(np.int64))


def candidate_sets(docs: DataFrame, nodes: DataFrame, width: int, clashes: frozenset[int]) -> DataFrame:
    """Pass three. Node and set of every row of ``nodes`` (node, text_key). A filter by their number spares the other texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(nodes.select(F.col("text_key").alias("key")), (24, 28)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(shared.value, np.asarray(batch.column(1)))))
            keys, rows, size = [], [], 0
            for _, s in sets_of(batch.column(0), width):
                if not len(s) or (node := key_of(s, clashes)) in seen:
                    continue
                seen.add(node)
                keys.append(node)
                rows.append(s.view(np.int64))
                size += len(s)
                if size > 500_000:
                    yield batch_of(keys, rows)
                    keys, rows, size = [], [], 0
            yield batch_of(keys, rows)

    def batch_of(keys: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        at = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(at, np.concatenate(rows) if rows else np.zeros(0, np.int64))], ["node", "items"])

    sets = docs.select("text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(run), "node long, items array<long>")
    out = cut(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    shared.destroy()
    return out


def unlike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that the suffix filter leaves; it reads sketches of the sets, a hundredth of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                least = -(-(na + nb) * percent // (100 + percent))  # overlap o with 100 o >= percent (n - o)
                keep.append(min(na, nb) >= least and not far_apart(x, y, na, nb, least))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    side = lambda s: reps.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ao, av), (bo, bv) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column(2), batch.column(3)))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                keep[i] = (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= percent * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def agree(pos: np.ndarray, n: np.ndarray, odd: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Those of the entries j of a token that the length, positional and parity filters leave for its entry i, the likest first.

    Differing parity bits bound the unshared items from below, and their share of all items orders the entries.
    """
    j = j[close(np.full(len(j), pos[i]), np.full(len(j), n[i]), pos[j], n[j], percent)]
    total = n[i].astype(np.int64) + n[j]
    differ = np.bitwise_count((odd[j] ^ odd[i]).view(np.uint64)).sum(1, dtype=np.int64)
    ok = (100 + percent) * (total - differ) >= 2 * percent * total
    return j[ok][np.argsort(differ[ok] / total[ok], kind="stable")]


def group_pairs(node: np.ndarray, comp: np.ndarray, pos: np.ndarray, n: np.ndarray, odd: np.ndarray, side: np.ndarray, failed: set[tuple[int, int]], percent: int, every: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (a < b) of a token's entries that may link two components, and whether there are more.

    All of them if they are at most ``GIVEN`` per entry (or ``every``), else edges that span what they connect. Only entries
    outside the largest component look at the others, since a pair within it is linked already. With two sides, pairs are across.
    """
    sets = np.unique(comp, return_inverse=True)[1]
    main = int(np.bincount(sets).argmax())
    whole = len(np.unique(side)) == 1
    most = GIVEN * len(node)

    def fits(i: int, label: np.ndarray) -> np.ndarray:
        j = np.flatnonzero(label != label[i] if whole else (label != label[i]) & (side != side[i]))
        j = agree(pos, n, odd, i, j, percent)
        if failed and len(j):
            a = int(node[i])
            j = j[[(min(a, b), max(a, b)) not in failed for b in node[j].tolist()]]
        return j

    outer = np.flatnonzero(sets != main)
    found: list[tuple[int, int]] = []
    for i in outer.tolist():
        j = fits(i, sets)
        found += [(i, k) for k in j[(sets[j] == main) | (j > i)].tolist()]
        if not every and len(found) > most:
            break
    else:
        return [pair(node, i, k) for i, k in found], False
    found, label = [], sets.copy()
    for i in outer.tolist():
        if label[i] == main:
            continue
        j = fits(i, label)
        if len(j):
            seen, first = np.unique(label[j], return_index=True)
            found += [(i, k) for k in j[first].tolist()]
            label[np.isin(label, [*seen, label[i]])] = main if main in seen else label[i]
    return [pair(node, i, k) for i, k in found], True


def pair(node: np.ndarray, i: int, k: int) -> tuple[int, int]:
    a, b = int(node[i]), int(node[k])
    return (a, b) if a < b else (b, a)


def compared(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (token, part, a, b) of groups (token, part), and a row without a pair for each group that has more.

    ``rows`` are the entries (kind 1, or 2 for a second block) and pairs of the group that have failed before (kind 0: node, other).
    """
    names = ["token", "part", "kind", "node", "other", "comp", "pos", "n", *WORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        out: list[tuple] = []

        def close_group() -> None:
            if not held:
                return
            token, part, kind, node, other, comp, pos, n, *odd = (np.concatenate(c) for c in zip(*held, strict=True))
            failed = set(zip(node[kind == 0].tolist(), other[kind == 0].tolist(), strict=True))
            e = np.flatnonzero(kind > 0)
            if len(e) < 2 or (comp[e] == comp[e[0]]).all():
                return
            pairs, more = group_pairs(node[e], comp[e], pos[e], n[e], np.stack([c[e] for c in odd], 1), kind[e], failed, percent, every)
            key = int(token[0]), int(part[0])
            out.extend((*key, a, b) for a, b in pairs)
            if more:
                out.append((*key, None, None))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["token", "part", "a", "b"])

        last = None
        for batch in batches:
            cols = [np.asarray(batch.column(k).fill_null(0)) for k in names]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))).tolist()
            for a, b in zip(starts, [*starts[1:], len(cols[0])], strict=True):
                now = int(cols[0][a]), int(cols[1][a])
                if now != last:
                    close_group()
                    held, last = [], now
                held.append([c[a:b] for c in cols])
            if len(out) > 50_000:
                yield flush()
        close_group()
        yield flush()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*names).repartition(parts, "token", "part").sortWithinPartitions("token", "part", "kind", "node").mapInArrow(tidy(run), "token long, part int, a long, b long")


def linked_sets(docs: DataFrame, reps: DataFrame, met: DataFrame, width: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """Component (node, comp) of every node of ``reps``, over all pairs of sets that reach the similarity.

    The first pairs are those of pass two. Then the entries of each token that still has several components meet in a task, in blocks
    if they are many, and are compared there by the filters; what passes is verified. A group gives out at most ``GIVEN`` pairs an
    entry, or else the likest pairs that span it, and comes again with the components and failed pairs so far. When few such pairs
    hold, what passes the filters between components is mostly no link, and all of it is verified. So no pair that could join
    two components is left out, and copies of each other in thousands do not make all their pairs.
    """
    entries = met.where("a is null").select("token", "node", "pos", "n")
    nodes = reps.select(F.col("node").alias("id"))
    sets = done = links = None
    likely = True

    def check(pairs: DataFrame) -> DataFrame:
        """Verifies pairs and returns the components over all links so far."""
        nonlocal sets, done, links, likely
        asked = pairs.select("a", "b").distinct()
        pairs = cut(unlike(asked if done is None else asked.join(done, ["a", "b"], "left_anti"), reps, percent))
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        need = need if sets is None else need.join(sets.select("node"), "node", "left_anti")
        more = candidate_sets(docs, cut(need.join(reps.select("node", "text_key"), "node")), width, clashes)
        sets = more if sets is None else sets.unionByName(more)
        found = cut(verify(pairs, sets, percent))
        likely = found.count() >= LIKELY * pairs.count()
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        return cut(components(nodes, links).where("id <> component").select(F.col("id").alias("node"), F.col("component").alias("comp")))

    comp = check(met.where("a is not null"))
    groups = failed = None
    for round_ in range(ROUNDS + 1):
        now = entries if groups is None else entries.join(groups.select("token").distinct(), "token", "left_semi")
        now = now.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = now.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        now = now.join(open_, "token").join(reps.select("node", *WORDS), "node")
        block = F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        now = now.withColumn("own", block).withColumn("with", other).withColumn("part", (F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")).cast("int"))
        now = now.select("token", "part", F.when(F.col("own") > F.col("with"), 2).otherwise(1).alias("kind"), "node", F.lit(None).cast("long").alias("other"), "comp", "pos", "n", *WORDS)
        if groups is not None:
            now = now.join(groups, ["token", "part"], "left_semi").unionByName(failed.select("token", "part", F.lit(0).alias("kind"), F.col("a").alias("node"), F.col("b").alias("other")), allowMissingColumns=True)
        found = cut(compared(now, percent, every=round_ == ROUNDS or round_ > 0 and not likely))
        pairs = found.where("a is not null")
        if pairs.isEmpty():
            break
        comp = check(pairs)
        groups = found.where("a is null").select("token", "part")
        if groups.isEmpty():
            break
        tried = pairs.join(groups, ["token", "part"], "left_semi").join(links, ["a", "b"], "left_anti")
        failed = cut(tried if failed is None else failed.unionByName(tried))
    return comp


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable over pairs with 100 * overlap >= ``percent`` * union) per document.

    Also text_key, a hash of the text, and group_key, a key of the component that does not depend on ids (null for empty sets).

    Texts are read in three passes: sets are counted and keyed, the rare prefixes of distinct sets meet by token, and the sets
    that share one are made again for the check. Documents with equal sets are one node throughout, so copies cost one row each.
    Shingles are compared by 64-bit hashes, and only within a pair of sets. Equal sets are recognised by a 64-bit key; a second key tells
    where different sets share one, and those (n ** 2 / 2 ** 65 of n sets are to be expected) get keys of their own.

    No word or null text: an empty set, linked with nothing. Fewer than ``width`` words: the whole sequence is the one shingle. A null
    id never names a component that has another id. Repeated rows are rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = keyed(rows, width)
    per = table.where("part is null").select("doc_id", "text_key", "n", "node", "again", "sketch", *WORDS)
    first = F.min(F.struct("text_key", "n", "sketch", *WORDS)).alias("r")
    reps = cut(per.where("node is not null").groupBy("node").agg(first, F.min("again").alias("x"), F.max("again").alias("y")).select("node", "r.*", (F.col("x") != F.col("y")).alias("clash")))
    clashes = frozenset(r.node for r in reps.where("clash").select("node").collect())
    if clashes:
        per = per.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("again")).otherwise(F.col("node")))
        reps = cut(per.where("node is not null").groupBy("node").agg(first).select("node", "r.*"))
    entries = prefix_entries(rows, frequencies(table), width, percent, clashes)
    comp = linked_sets(rows, reps, entries, width, percent, clashes)
    ids = per.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(ids.join(names, "comp").select("node", F.col("comp").alias("group_key"), "component_id"))
    out = per.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key", "group_key")


def op10(spark, sf_dir: str) -> DataFrame:
    """``jaccard_components`` over all documents; null, empty and short texts, null ids and repeated rows as there."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
