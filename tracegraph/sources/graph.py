"""A graph as stored tables: a node table per type, edges by relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relations as they are stored: source type, name, target type. Fixed values.
RELATIONS = (
    ("event", "in_report", "domain"),
    ("event", "in_report", "ip"),
    ("event", "in_report", "url"),
    ("domain", "resolves_to", "ip"),
    ("url", "hosted_on", "domain"),
    ("url", "resolves_to_ip", "ip"),
    ("ip", "in_group", "asn"),
)

EDGE = ("src", "dst", "first_seen", "last_seen", "indicator_created")


def relation(src: str, rel: str, dst: str) -> str:
    return f"{src}-{rel}-{dst}"


class Graph:
    """Under one folder ``nodes/<type>`` (id and what a type has) and ``edges/rel=<source>-<name>-<target>`` (``EDGE``), all ids as texts.

    Reading a relation reads its own files alone. Reverse relations (``rev_`` names) are the same files with the ends exchanged.
    """

    def __init__(self, spark: SparkSession, folder: str, relations=RELATIONS):
        self.spark, self.folder, self.relations = spark, folder.rstrip("/"), tuple(relations)

    def save_nodes(self, kind: str, nodes: DataFrame) -> None:
        """Replaces the node table of a type; ``id`` becomes text, repeated ids keep one row."""
        rows = nodes.withColumn("id", F.col("id").cast("string")).where("id is not null").dropDuplicates(["id"])
        rows.write.mode("overwrite").parquet(f"{self.folder}/nodes/{kind}")

    def save_edges(self, edges: DataFrame) -> None:
        """Replaces the relations that ``edges`` (src_type, rel, dst_type, and of ``EDGE`` what there is) hold; an unknown relation is an error.

        One pass and no shuffle by relation, so that a relation that holds most edges is written by all tasks.
        """
        known = F.concat_ws("-", "src_type", "rel", "dst_type")
        checked = F.when(known.isin(*[relation(*r) for r in self.relations]), known).otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), F.coalesce(known, F.lit("null")))).cast("string"))
        have = [(F.col(c) if c in edges.columns else F.lit(None)).cast("string").alias(c) for c in EDGE]
        rows = edges.select(*have, checked.alias("rel"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rel").parquet(f"{self.folder}/edges")

    def nodes(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes/{kind}")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(", ".join(f"{c} string" for c in (*EDGE, "rel"))).parquet(f"{self.folder}/edges")

    def names(self) -> list[str]:
        """Relations and their reverses."""
        return [relation(*r) for r in self.relations] + [relation(d, f"rev_{r}", s) for s, r, d in self.relations]

    def edges(self, src: str, rel: str, dst: str, resolved: bool = True) -> DataFrame:
        """Edges (src, dst, ...) of one relation or reverse relation; ``resolved``: only those with both ends among the nodes. Multiplicity is kept."""
        turned = rel.startswith("rev_")
        s, r, d = (dst, rel.removeprefix("rev_"), src) if turned else (src, rel, dst)
        if (s, r, d) not in self.relations:
            raise ValueError(f"unknown relation: {relation(src, rel, dst)}")
        rows = self.stored().where(F.col("rel") == relation(s, r, d)).drop("rel")
        if resolved:
            for end, kind in (("src", s), ("dst", d)):
                rows = rows.join(self.nodes(kind).select(F.col("id").alias(end)), end, "left_semi")
        return rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *EDGE[2:]) if turned else rows.select(*EDGE)

    def counts(self) -> DataFrame:
        """(rel, n): resolved edges of all relations and reverses, in one plan."""
        out = None
        for s, r, d in self.relations:
            both = F.explode(F.array(F.lit(relation(s, r, d)), F.lit(relation(d, f"rev_{r}", s))))
            one = self.edges(s, r, d).agg(F.count(F.lit(1)).alias("n")).select(both.alias("rel"), "n")
            out = one if out is None else out.unionByName(one)
        return out
