"""Adjacency normalisation, label propagation and neighbour means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.operators.lineage import settled
from tracegraph.operators.pooling import pooled


def sym_normalize(adjacency: DataFrame) -> DataFrame:
    """(i, j, w) with w = 1 / sqrt(degree i * degree j); ``adjacency`` holds both directions and the diagonal."""
    degree = adjacency.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    one, two = degree.select("i", F.col("d").alias("di")), degree.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    return adjacency.join(one, "i").join(two, "j").select("i", "j", (1 / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def label_propagation(adjacency: DataFrame, seeds: DataFrame, labels: DataFrame, iters: int = 4, normalize: str = "softmax") -> DataFrame:
    """(id, label, score) after ``iters`` rounds of passing scores along (i, j), seeds (id, label) set back to one each round.

    ``adjacency`` holds both directions and the diagonal. Its symmetric normalisation is done on scores, which are divided by the root of
    the sender's degree before and of the receiver's after each sum, so no weight is kept for a pair. Scores stay sparse: a row per
    event and label that has any. At the end every event has every label, under a softmax over all labels (seeds keep
    e / (e + labels - 1)), or with "l1" as shares.
    """
    pairs = settled(adjacency.select("i", "j"))
    degree = settled(pairs.groupBy(F.col("i").alias("id")).agg((1 / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("root")))
    start = seeds.select("id", "label").join(degree, "id").select("id", "label", F.lit(1.0).alias("score"), F.col("root").alias("sent"))
    now = start
    for _ in range(iters):
        passed = pairs.join(now.select(F.col("id").alias("j"), "label", "sent"), "j").groupBy(F.col("i").alias("id"), "label").agg(F.sum("sent").alias("sum"))
        fresh = passed.join(seeds.select("id"), "id", "left_anti").join(degree, "id").select("id", "label", (F.col("sum") * F.col("root")).alias("score"), (F.col("sum") * F.col("root") * F.col("root")).alias("sent"))
        now = settled(fresh.unionByName(start))
    dense = degree.select("id").crossJoin(F.broadcast(labels.select("label"))).join(now.select("id", "label", "score"), ["id", "label"], "left").fillna(0.0, ["score"])
    value = F.exp("score") if normalize == "softmax" else F.col("score")
    size = F.sum(value).over(Window.partitionBy("id"))
    return dense.select("id", "label", F.coalesce(F.try_divide(value, size), F.lit(0.0)).alias("score"))


def lp_predict(scores: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """Best label of each unlabelled event, its score, and the scores of all labels; ties to the first label."""
    rows = scores.join(unlabeled.select("id"), "id", "left_semi")
    four = F.round("score", 4)
    best = F.array_min(F.collect_list(F.struct((-F.round("score", 9)).alias("neg"), "label", four.alias("score"))))
    return rows.groupBy("id").agg(best.alias("b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", four)))).alias("all_scores")).select("id", F.col("b.label").alias("predicted"), F.col("b.score").alias("confidence"), "all_scores")


def neighbor_mean(edges: DataFrame, vecs: DataFrame, width: int) -> DataFrame:
    """(dst, vec): for each node the mean over its relations of the mean over the relation's neighbours.

    edges: (dst, rel, src); vecs: (rel, src, vec), the neighbours' vectors by relation, all of ``width``. Neither mean moves a vector (``pooled``).
    """
    return pooled(None, edges, vecs, ["dst"], ["rel", "src"], width, relation="rel").where("vec is not null")


def dense_product(df: DataFrame, column: str, weights: np.ndarray, to: str) -> DataFrame:
    """Adds ``to`` = vector times matrix, a batch at a time; the matrix is a model's, so its size does not grow with the data."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def product(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(list(np.stack(x.to_numpy()) @ shared.value), index=x.index) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(to, product(column))


def activate(vec: Column, last: bool = False, eps: float = 1e-5, scale: Column | None = None, shift: Column | None = None) -> Column:
    """Layer norm (with arrays ``scale`` and ``shift`` where given), ReLU and unit length of an array column; a last layer stays as it is."""
    if last:
        return vec
    total = lambda c, f=lambda x: x: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    n = F.size(vec).cast("double")
    centred = F.transform(F.array(F.struct(vec.alias("v"), (total(vec) / n).alias("mean"))), lambda s: F.transform(s["v"], lambda x: x - s["mean"]))[0]
    # what a row is divided by is found once for the row, not for every slot
    divided = lambda c, by: F.transform(F.array(c), lambda v: F.transform(F.array(F.struct(v.alias("v"), by(v).alias("by"))), lambda s: F.transform(s["v"], lambda x: x / s["by"]))[0])[0]
    normed = divided(centred, lambda v: F.sqrt(total(v, lambda y: y * y) / n + eps))
    for other, f in ((scale, lambda x, y: x * y), (shift, lambda x, y: x + y)):
        normed = F.zip_with(normed, other, f) if other is not None else normed
    scaled = F.transform(normed, lambda x: F.greatest(x, F.lit(0.0)))
    return divided(scaled, lambda v: F.greatest(F.sqrt(total(v, lambda y: y * y)), F.lit(1e-12)))


def sage_layer(own: DataFrame, neighbors: DataFrame, w_self: np.ndarray | None = None, w_neighbor: np.ndarray | None = None, last: bool = False) -> DataFrame:
    """One layer for nodes (id, vec) with neighbour means (id, vec): own part plus neighbour part, then ``activate``. No matrix: identity."""
    a = dense_product(own, "vec", w_self, "x") if w_self is not None else own.withColumn("x", F.col("vec"))
    b = dense_product(neighbors, "vec", w_neighbor, "y") if w_neighbor is not None else neighbors.withColumn("y", F.col("vec"))
    met = a.select("id", "x").join(b.select("id", "y"), "id", "left")
    total = F.when(F.col("y").isNull(), F.col("x")).otherwise(F.zip_with("x", "y", lambda p, q: p + q))
    return met.withColumn("z", total).select("id", activate(F.col("z"), last).alias("vec"))


@dataclass
class Layer:
    """Weights of one layer of a relation-wise network; matrices are in x out.

    neighbors: relation -> (matrix of the neighbours' mean, bias); own: relation -> matrix of the node itself; norms: node type -> (scale, shift) of the layer norm,
    absent in a last layer, which stays linear.
    """

    neighbors: dict[str, tuple[np.ndarray, np.ndarray]]
    own: dict[str, np.ndarray]
    norms: dict[str, tuple[np.ndarray, np.ndarray]] | None = None


def _by_kind(df: DataFrame, kind: str, column: str, matrices: dict[str, np.ndarray], shifts: dict[str, np.ndarray]) -> DataFrame:
    """``df`` with ``column`` times the matrix of its ``kind`` and the shift added, a batch at a time; kinds without a matrix are left out."""
    shared = df.sparkSession.sparkContext.broadcast((matrices, shifts))  # a model's weights, which do not grow with the data

    @F.pandas_udf("array<double>")
    def product(kinds: pd.Series, vecs: pd.Series) -> pd.Series:
        of, more = shared.value
        out = pd.Series([None] * len(kinds), dtype=object)
        for k in kinds.unique():
            at = np.flatnonzero((kinds == k).to_numpy())
            made = np.stack(vecs.iloc[at].to_numpy()) @ of[k] + more[k]
            for i, row in zip(at, made, strict=True):
                out.iat[i] = row
        return out

    return df.where(F.col(kind).isin(*matrices)).withColumn(column, product(F.col(kind), F.col(column)))


def relation_layer(nodes: DataFrame, edges: DataFrame, layer: Layer, targets: dict[str, str]) -> DataFrame:
    """One layer for nodes (kind, id, vec) over edges (rel, src_kind, src, dst): (kind, id, vec).

    targets: relation -> kind of its target. For each relation into a node's kind, the neighbours' mean (zero without neighbours) times the relation's matrix,
    its bias, and the node times the relation's own matrix; the mean over those relations; then layer norm, ReLU and unit length, unless the
    layer is the last. Products are taken before means, which is the same: neighbours are fewer than edges, and means move no vectors (``pooled``). Kinds without a relation into them drop out.
    """
    into: dict[str, list[str]] = {}
    for rel, kind in targets.items():
        into.setdefault(kind, []).append(rel)
    share = {r: 1.0 / len(into[k]) for r, k in targets.items()}
    own = _by_kind(nodes, "kind", "vec", {k: sum(layer.own[r] for r in rs) / len(rs) for k, rs in into.items()}, {k: sum(layer.neighbors[r][1] for r in rs) / len(rs) for k, rs in into.items()})
    outer = next(iter(layer.own.values())).shape[1]
    kinds = F.create_map(*[x for r, k in targets.items() for x in (F.lit(r), F.lit(k))])
    known = edges.where(F.col("rel").isin(*targets)).select("rel", "src_kind", "src", F.element_at(kinds, F.col("rel")).alias("kind"), F.col("dst").alias("id"))
    pairs = {(r.rel, r.src_kind) for r in known.select("rel", "src_kind").distinct().collect()}  # the schema of the graph
    of = F.create_map(*[x for k in {k for _, k in pairs} for x in (F.lit(k), F.array(*[F.lit(r) for r, q in sorted(pairs) if q == k]))])
    sender = nodes.where(F.col("kind").isin(*{k for _, k in pairs})).select(F.explode(F.element_at(of, F.col("kind"))).alias("rel"), F.col("kind").alias("src_kind"), F.col("id").alias("src"), "vec") if pairs else None
    if sender is None:
        total = own.select("kind", "id", "vec")
    else:
        sent = _by_kind(sender, "rel", "vec", {r: layer.neighbors[r][0] * share[r] for r in targets}, {r: np.zeros(outer) for r in targets})
        met = pooled(own.select("kind", "id", F.col("vec").alias("own")), known, sent, ["kind", "id"] if len(into) > 1 else ["id"], ["rel", "src_kind", "src"], outer, relation="rel", total=True)
        total = met.select("kind", "id", F.when(F.col("vec").isNull(), F.col("own")).otherwise(F.zip_with("own", "vec", lambda x, y: x + y)).alias("vec"))
    if layer.norms is None:
        return total
    return total.withColumn("vec", activate(F.col("vec"), scale=_of_kind(layer.norms, 0), shift=_of_kind(layer.norms, 1)))


def _of_kind(norms: dict[str, tuple[np.ndarray, np.ndarray]], which: int) -> Column:
    return F.element_at(F.create_map(*[x for k, v in norms.items() for x in (F.lit(k), F.lit([float(y) for y in v[which]]))]), F.col("kind"))


def relation_network(nodes: DataFrame, edges: DataFrame, layers: list[Layer], targets: dict[str, str]) -> DataFrame:
    """All layers in turn; the vectors of each are written before the next, as every one reads them twice."""
    for layer in layers:
        nodes = settled(relation_layer(nodes, edges, layer, targets))
    return nodes
