"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.shared import components, cut, small, tidy
from tracegraph.llm.vectors import matrix, unit, usable

#: Distinct vectors a cell has on average, and of a block of a cell at most on average.
CELL, BLOCK = 4000, 1000

#: Numbers of a product of vectors and centroids that are held at a time.
NUMBERS = 1 << 22

#: Cells of all labels together, and vectors for each that centroids are fitted to; larger tables get larger cells of more blocks.
CELLS, FIT = 4096, 32


def spherical_kmeans(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors, each the direction of its vectors' sum; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    rows = max(1, NUMBERS // len(c)) if len(c) else 1
    for _ in range(steps):
        own = np.concatenate([np.zeros(0, np.int64), *((x[i : i + rows] @ c.T).argmax(1) for i in range(0, len(x), rows))])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors of the label with cosine >= ``threshold``), component_id and kept (is the component's first id) per vector.

    Equal vectors of a label are one row with a count. Per label, a k-means on a bounded sample sets the cells (one cell up to ``CELL``
    distinct vectors). A vector belongs to its nearest centroid, and visits each other cell that a vector as near as the threshold may
    lie in: two unit vectors of the cosine are at most r = sqrt(2 - 2 * threshold) apart, so across the plane between two centroids neither is
    further than r from it. Of two cells only the later one's vectors visit the earlier, so a pair meets once. Cells are cut into
    blocks by a hash; each (cell, block) multiplies its members by the visitors in batches, and gives out link counts and the edges
    of a spanning forest rather than pairs. No pair is missed, in any cell size.

    Null labels and unusable vectors (null, empty, zero, null or non-finite components): no links, a component of their own. Vectors
    of another width link only with their own width. Null ids: the vector counts for others, its own component_id may be null.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("ok", usable("v") & F.col("label").isNotNull()))
    other = F.xxhash64("v", "label")  # a second key, which tells different vectors under one copy
    for seed in range(4):  # and then keys are dealt anew
        copy = F.xxhash64(F.lit(seed), "label", "v")
        keyed = rows.where("ok").select("vec_id", copy.alias("copy"), "label", "v")
        met = keyed.groupBy("copy").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min(other).alias("one"), F.max(other).alias("two"))
        distinct = cut(met.withColumn("group", F.xxhash64(F.col("label"), F.size("v"))))
        if distinct.where("one <> two").isEmpty():
            break
    total = distinct.count()
    # groups of more than one cell: at most CELLS / 2 of them, however many labels there are
    large = distinct.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > CELL) & (F.col("n") * CELLS >= 2 * total)).collect()
    many = {r.group: min(-(-r.n // CELL), CELLS * r.n // total) for r in large}
    rates = spark.createDataFrame([(r.group, min(1.0, FIT * many[r.group] / r.n)) for r in large], "group long, rate double")
    centroids: dict[int, np.ndarray] = {}
    if many:
        picked = distinct.join(F.broadcast(rates), "group").where((F.shiftrightunsigned(F.xxhash64("copy"), 11) + 0.5) / float(1 << 53) < F.col("rate")).select("group", "copy", "v").toArrow().combine_chunks().sort_by("copy")
        of = np.asarray(picked.column("group"))
        for g, k in many.items():
            x = picked.filter(pa.array(of == g)).column("v")
            centroids[g] = spherical_kmeans(unit(matrix(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)), k, 7)
    shared = spark.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per vector and cell: home rows and visits. Vectors meet the centroids some rows at a time."""
        gaps = {g: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)).astype(np.float32) for g, c in shared.value.items()}
        for batch in batches:
            group = np.asarray(batch.column(0))
            for g in np.unique(group):
                part = batch.take(pa.array(np.flatnonzero(group == g)))
                c = shared.value.get(int(g))
                who, cell, home = [np.arange(len(part))], [np.zeros(len(part), np.int64)], [np.ones(len(part), bool)]
                if c is not None:
                    x, rows = unit(matrix(part.column(2))), max(1, NUMBERS // len(c))
                    for at in range(0, len(x), rows):
                        dots = x[at : at + rows] @ c.T
                        own = dots.argmax(1)
                        cell[0][at : at + rows] = own
                        across = dots[np.arange(len(own)), own][:, None] - dots <= reach * gaps[int(g)][own] + 1e-5  # gaps are single, so rounded by less than that
                        across &= np.arange(len(c))[None] < own[:, None]
                        i, j = np.nonzero(across)
                        who.append(i + at), cell.append(j), home.append(np.zeros(len(i), bool))
                out = part.take(pa.array(np.concatenate(who)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(home))], ["group", "copy", "v", "m", "cell", "home"])

    placed = cut(distinct.select("group", "copy", "v", "m").mapInArrow(tidy(assign), "group long, copy long, v array<double>, m long, cell long, home boolean"))
    cells = placed.where("home").groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n")).select("group", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(small(cut(cells)), ["group", "cell"])
    block = F.pmod(F.xxhash64("copy", F.lit(3)), F.col("blocks")).cast("int")
    members = dealt.where("home").withColumn("block", block)
    # a member also visits the blocks of its cell before its own; a visitor from another cell visits all
    visits = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), block).otherwise(F.col("blocks") - 1)))).where(~F.col("home") | (F.col("block") < block))
    sides = members.withColumn("visitor", F.lit(False)).unionByName(visits.withColumn("visitor", F.lit(True))).select("group", "cell", "block", "copy", "v", "m", "visitor")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, ma: np.ndarray, mb: np.ndarray, same: bool) -> pa.RecordBatch:
            hit = xa @ xb.T >= threshold
            if same:
                np.fill_diagonal(hit, False)
            ca = (hit * mb[None]).sum(1)
            cb = np.zeros(len(b), np.int64) if same else (hit * ma[:, None]).sum(0)
            edges_a, edges_b = forest(hit, same)
            one, two = a[ca > 0], b[cb > 0]  # counts are rows of a copy with itself, edges have no count
            cols = np.concatenate((one, two, a[edges_a])), np.concatenate((ca[ca > 0], cb[cb > 0], np.zeros(len(edges_a), np.int64))), np.concatenate((one, two, b[edges_b]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "n", "b"])

        for part in (part for batch in batches for part in runs(batch)):
            now = tuple(part.column(k)[0].as_py() for k in range(3))
            if now != key:
                key, held = now, []
            mine = np.asarray(part.column(3)), unit(matrix(part.column(4))), np.asarray(part.column(5))
            for ids, x, m in held:
                yield links(ids, mine[0], x, mine[1], m, mine[2], False)
            if not part.column(6)[0].as_py():  # members come before visitors
                yield links(mine[0], mine[0], mine[1], mine[1], mine[2], mine[2], True)
                held.append(mine)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(sides.repartition(parts, "group", "cell", "block").sortWithinPartitions("group", "cell", "block", "visitor").select("group", "cell", "block", "copy", "v", "m", "visitor").mapInArrow(tidy(multiply), "a long, n long, b long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    ids = keyed.groupBy("copy").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    comp = components(ids.select(F.col("copy").alias("id")), found.where("a <> b").select("a", "b"))
    named = ids.join(comp, ids.copy == comp.id).select("copy", "least", "m", "component")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per = named.join(names, "component").join(counts, F.col("copy") == F.col("a"), "left").select("copy", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    per = cut(per)
    out = rows.select("vec_id", F.when(F.col("ok"), copy).alias("copy")).join(per, "copy", "left")
    component = F.when(F.col("copy").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def runs(batch: pa.RecordBatch, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a sorted batch with one (group, cell, block, visitor) each, of ``most`` rows at most."""
    if not batch.num_rows:
        return
    cols = [np.asarray(batch.column(k).cast(pa.int64()) if k < 3 else batch.column(k).cast(pa.int8())) for k in (0, 1, 2, 6)]
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
        for i in range(a, b, most):
            yield batch.slice(i, min(most, b - i))


def forest(hit: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of edges that connect what the hits connect, one for each row or column at most but for the first of each group."""
    rows, cols = np.nonzero(hit)
    if not len(rows):
        return rows, cols
    n = hit.shape[0]
    parent = list(range(n if same else n + hit.shape[1]))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = []
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    for k, (i, j) in enumerate(zip(rows.tolist(), (cols if same else cols + n).tolist(), strict=True)):
        if first[k] or parent[j] == j or root(i) != root(j):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                keep.append(k)
    return rows[keep], cols[keep]


def op2(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over all embeddings; null labels, unusable vectors and repeated rows as there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
