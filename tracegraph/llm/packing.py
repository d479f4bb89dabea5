"""Packing documents into training sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.llm.shared import cut, small, tidy

#: Pieces of one length that one ranking group holds at most, on average.
RANKED = 4_000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, salt long"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (number of packs, [(length, how many)] in order of place) for a histogram of lengths.

    Lengths go longest first, each into the shortest packs that still have room, else into new packs, which are filled one after the
    other. A pattern is a multiset of lengths with the number of packs that have it; a placement moves a whole pattern or splits one,
    so each length brings a few new patterns, however many pieces there are.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # filled, tie-break, packs, pattern
    serial = 0

    def put(filled: int, packs: int, pattern: list[tuple[int, int]]) -> None:
        nonlocal serial
        if filled == capacity:
            done.append((packs, pattern))
        else:
            heapq.heappush(open_, (filled, serial, packs, pattern))
            serial += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= capacity:
                filled, _, packs, pattern = heapq.heappop(open_)
                fit = (capacity - filled) // length  # how many of this length one pack takes before it is no longer the shortest
                if len(open_) and fit > 1:
                    fit = min(fit, max(1, -(-(open_[0][0] - filled) // length)))
                take = min(packs, left // fit) if left >= fit else 0
                if not take:
                    fit, take = left, 1
                if take < packs:
                    put(filled, packs - take, pattern)
                put(filled + fit * length, take, [*pattern, (length, fit)])
                left -= take * fit
            else:  # a new pack is the shortest one until it is full, so full ones come first and one holds the rest
                fit = min(left, capacity // length)
                take = left // fit
                put(length * fit, take, [(length, fit)])
                left -= take * fit
    return done + [(packs, pattern) for _, _, packs, pattern in sorted(open_)]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For each pattern and length: length, first rank, ranks, pieces in a pack, first sequence, offset of the first in the pack."""
    used: dict[int, int] = {}
    base = 0
    for packs, pattern in patterns:
        at = 0
        for length, many in pattern:
            first = used.get(length, 0)
            yield length, first, packs * many, many, base, at
            used[length] = first + packs * many
            at += length * many
        base += packs


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenizes whole texts and cuts what is longer than ``capacity``: one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracegraph.llm.tokens import word_ids

        ids, end, given = word_ids(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[tuple] = []
                for doc, raw in zip(part.column(0).to_pylist(), ids.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    n, view = len(raw) // 4, memoryview(raw)
                    for a in range(0, n, capacity):
                        b = min(n, a + capacity)
                        out.append((doc, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n, given))
                        given += 1
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``; what is longer than ``capacity`` is cut into full pieces and a rest. The
    histogram of lengths (``capacity`` rows at most, whatever the corpus) comes to the driver, where packing patterns are counted;
    they go back as ranges of ranks, and each piece joins its pattern by its rank among the pieces of its length. Ranks are counted
    in groups of about ``RANKED`` pieces, dealt by a hash of id, start and a running number of the task that is written with them, so
    that neither a common length nor a row that repeats a million times is ranked by one task.

    Null or empty text: one piece that holds ``end_id`` alone. Null or repeated ids and repeated texts are documents of their own.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    p = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    histogram = {r.length: r.n for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = list(slots(shortest_pack_first(histogram, capacity)))
    groups = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length int, groups int")
    p = p.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.col("groups")).cast("int"))
    counts = p.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n")
    counts = counts.select("length", "grp", before.alias("before"))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "start", "ids_crc32", "salt")
    ranked = p.withColumn("rank", F.row_number().over(order) - 1).join(small(cut(counts)), ["length", "grp"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranges = {}
    for length, first, n, many, base, at in places:
        ranges.setdefault(length, []).append((first, n, many, base, at))
    lookup = {k: [np.array(c, np.int64) for c in zip(*v, strict=True)] for k, v in ranges.items()}
    shared = spark.sparkContext.broadcast(lookup)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                first, _, many, base, at = table[int(k)]
                j = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[j]
                seq[mine] = base[j] + inside // many[j]
                off[mine] = at[j] + inside % many[j] * k
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            keep[2] = keep[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    return ranked.select(*cols).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8(spark, sf_dir: str) -> DataFrame:
    """``pack`` over all documents; null, empty and repeated texts as there."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
