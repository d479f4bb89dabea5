"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.llm.shared import WORD, carried, cut, restored, small

#: Bits of the rank key that each of the two histogram levels resolves.
BITS = 13


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (key, source_size).

    Sources in order of ``key`` get ``weights`` in turn and share the sum of all sizes by weight; a target stops at ``cap`` times
    its source's size and what is above goes to the others by weight. That is the water level: with sources in order of
    cap * size / weight, the first one whose share of the rest does not exceed its own cap fixes the share per weight of all after it.
    Sources are a dimension table, so the two ordered windows hold one row per source.
    """
    order = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    t = t.withColumn("rest", F.sum("source_size").over(whole) - (F.sum("limit").over(filled) - F.col("limit")))
    t = t.withColumn("rest_weight", F.sum("weight").over(whole) - (F.sum("weight").over(filled) - F.col("weight")))
    t = t.withColumn("level", F.try_divide("rest", "rest_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("limit") * (1 + 1e-12)  # levels fall from the first that fits on
    t = t.withColumn("level", F.coalesce(F.max(F.when(fits, F.col("level"))).over(whole), F.lit(0.0)))
    return t.select("key", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def copies_wanted(classes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source and length class (key, class, words) with source_size, target, certain copies and inclusion probability p.

    A document of class b weighs b + 1, and a source's documents are wanted in copies in proportion to their weights, ``cap`` at most, so
    that the words wanted are the target: the level per weight is found like the sources' own. Whole copies are certain, and the
    fraction is the probability of one more. Sources and classes (64 at most) are a small table.
    """
    per = classes.groupBy("key").agg(F.sum("words").alias("source_size"))
    t = classes.join(small(source_targets(per, weights, cap)), "key").withColumn("w", F.col("class") + F.lit(1.0))
    order = Window.partitionBy("key").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("key")
    words, weight = F.col("words"), F.col("words") * F.col("w")
    t = t.withColumn("rest", F.col("target") - cap * (F.sum(words).over(order) - words)).withColumn("rest_weight", F.sum(weight).over(own) - (F.sum(weight).over(order) - weight))
    t = t.withColumn("level", F.coalesce(F.try_divide("rest", "rest_weight"), F.lit(0.0)))
    fits = F.col("level") * F.col("w") <= cap * (1 + 1e-12)  # the heaviest classes reach the cap first
    level = F.coalesce(F.max(F.when(fits, F.col("level"))).over(own), F.lit(0.0))
    t = t.withColumn("wish", F.least(level * F.col("w"), F.lit(float(cap)))).withColumn("certain", F.floor(F.col("wish") + 1e-9))
    p = F.greatest(F.col("wish") - F.col("certain"), F.lit(0.0))
    return t.select("key", "class", "words", "source_size", "target", "certain", F.when(p > 1e-9, p).otherwise(0.0).alias("p"))


def rank_key(u: Column, p: Column) -> Column:
    """Pareto's ranking variable, random odds over inclusion odds, as q / (1 + q) between 0 and 1; null where nothing is to be drawn."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, q / (1 + q))


def sample_ends(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each source's sample ends in rank order: cut_bin, last_key, part_key with the part_rows of its rows that are taken, close_key with its rows.

    ``drawn`` has the rows (key, size, rank_key) that may be drawn, ``wanted`` the words per source. The end is found from histograms of
    the rank key, one of 2 ** ``BITS`` bins per source and then one within the bin where it lies; only distinct rank keys of one
    bin in 2 ** (2 * ``BITS``) are ordered, so neither a source nor a row that repeats a million times is gathered in a task. Of
    rows that repeat at the very end as many as fit are taken. Words left over are closed by the document whose size comes nearest.
    """
    bins = drawn.withColumn("bin", F.floor(F.col("rank_key") * float(1 << 2 * BITS)).cast("long"))

    def crossing(sums: DataFrame) -> DataFrame:
        """For each source the first bin (key, at) whose running words reach what is wanted, and the words before it."""
        running = F.sum("words").over(Window.partitionBy("key").orderBy("at"))
        reached = sums.withColumn("running", running + F.col("base")).where(F.col("running") > F.col("wanted"))
        return reached.groupBy("key").agg(F.min_by(F.struct("at", (F.col("running") - F.col("words")).alias("base")), "at").alias("x")).select("key", "x.*")

    first = bins.groupBy("key", F.shiftright("bin", BITS).alias("at")).agg(F.sum("size").alias("words")).join(small(wanted), "key")
    one = cut(crossing(first.withColumn("base", F.lit(0.0))))
    inner = bins.join(small(one), "key").where(F.shiftright("bin", BITS) == F.col("at"))
    second = inner.groupBy("key", F.col("bin").alias("at")).agg(F.sum("size").alias("words"), F.first("base").alias("base")).join(small(wanted), "key")
    two = cut(crossing(second))
    last = bins.join(small(two), "key").where("bin = at").groupBy("key", "rank_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.first("at").alias("at"))
    order = Window.partitionBy("key").orderBy("rank_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.join(small(wanted), "key").withColumn("done", F.sum("words").over(order) + F.col("base"))
    fit, over = F.col("done") <= F.col("wanted"), F.col("done") > F.col("wanted")
    ends = last.groupBy("key").agg(F.first("at").alias("cut_bin"), F.max(F.when(fit, F.col("rank_key"))).alias("last_key"), F.coalesce(F.max(F.when(fit, F.col("done"))), F.first("base")).alias("done"), F.min_by(F.struct("rank_key", "words", "rows"), F.when(over, F.col("rank_key"))).alias("x"), F.first("wanted").alias("wanted"))
    whole = F.floor((F.col("wanted") - F.col("done")) * F.col("x.rows") / F.col("x.words"))
    ends = ends.withColumn("part_rows", F.when(F.col("x.rows") > 1, F.coalesce(whole, F.lit(0))).otherwise(0).cast("long"))
    ends = cut(ends.select("key", "cut_bin", "last_key", F.col("x.rank_key").alias("part_key"), "part_rows", (F.col("wanted") - F.col("done") - F.col("part_rows") * F.col("x.words") / F.col("x.rows")).alias("left")))
    gap = F.abs(F.col("size") - F.col("left"))
    spare = bins.join(small(ends), "key").where(~taken() & (gap < F.col("left")) & ~(F.col("rank_key").eqNullSafe(F.col("part_key")) & (F.col("part_rows") > 0)))
    closing = spare.groupBy("key").agg(F.min_by("rank_key", F.struct(gap, "rank_key")).alias("close_key"))
    rows = bins.join(small(cut(closing)), "key").where("rank_key = close_key").groupBy("key").agg(F.first("close_key").alias("close_key"), F.count(F.lit(1)).alias("close_rows"))
    return ends.drop("left").join(rows, "key", "left")


def taken() -> Column:
    """Whether rank order takes a row whole before the sample's end; without an end it takes all."""
    return F.coalesce((F.col("bin") < F.col("cut_bin")) | (F.col("bin") == F.col("cut_bin")) & F.coalesce(F.col("rank_key") <= F.col("last_key"), F.lit(False)), F.lit(True))


#: Repeated rows that one task brings back.
TOGETHER = 1000


def dealt(rows: DataFrame) -> DataFrame:
    """Adds ``dealt``: 1 for ``to_deal`` rows of those with one (key, u), 0 for the others.

    Rows that agree in all columns are counted and come back as often as they were there, in blocks that any task may take, the first ones with a
    1; which of them makes no difference. Rows that agree in id, text and source alone take turns by a hash of all columns, whose bins
    are summed first, so that a task orders one bin in 2 ** ``BITS``.
    """
    names = rows.columns
    others = F.to_json("row") if "map<" in rows.schema["row"].dataType.simpleString() else F.col("row")  # maps have no hash
    counted = cut(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("turn", F.xxhash64(others, "doc", "body", "origin")).withColumn("part", F.shiftright("turn", 64 - BITS)))
    running = Window.partitionBy("key", "u").orderBy("part")
    parts = counted.groupBy("key", "u", "part").agg(F.sum("n").alias("in_part")).withColumn("before", F.sum("in_part").over(running) - F.col("in_part")).drop("in_part")
    order = Window.partitionBy("key", "u", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(parts, ["key", "u", "part"]).withColumn("first", F.col("before") + F.sum("n").over(order) - F.col("n"))
    blocks = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TOGETHER).cast("long"))).alias("start")).repartition("key", "u", "turn", "start")
    each = blocks.select("*", F.explode(F.sequence("start", F.least(F.col("start") + TOGETHER, F.col("n")) - 1)).alias("place"))
    return each.select(*names, (F.col("first") + F.col("place") < F.col("to_deal")).cast("long").alias("dealt"))


def pareto_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies * size) to every row, so that each source's words come near its target.

    The number of copies wanted of a document rises with its length class, floor(log2(size)), and is ``cap`` at most; over a source
    the words wanted are its target. The whole part is certain. With the fraction as inclusion probability p, which so differs from
    document to document, and u uniform from a hash of id and text, documents are ranked by (u / (1 - u)) / (p / (1 - p)) and
    taken in rank order as long as they fit the words wanted; one more document closes the gap. So the sample's size is fixed in
    words. Given the plan per source, a row's copies depend on the row alone: nothing is shuffled to hand them out, and reruns agree.

    Null or empty text: size 0, taken 0. A null source is a source of its own, last in order. Rows that agree in id, text and source are
    drawn together, except where the end of the sample falls among them: there as many as fit get the copy, by an order of all columns (``dealt``). So the result is the same rows however the table is split or ordered. An empty table gives no rows. Other columns stay,
    but for those with the names of the new ones, which are replaced.
    """
    columns = {"doc": id_col, "body": text_col, "origin": source_col}
    size = F.coalesce(F.regexp_count("body", F.lit(WORD)), F.lit(0)).cast("long")
    rows = carried(docs, **columns).withColumns({
        "key": F.when(F.col("origin").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("origin"))),
        "size": size,
        "u": (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc", "body"), 11) + 0.5) / float(1 << 53),
    })
    length = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) + 1e-12)).otherwise(0).cast("int")
    slim = cut(rows.select("key", "size", "u"))
    classes = cut(copies_wanted(slim.groupBy("key", length.alias("class")).agg(F.sum("size").alias("words")), weights, cap))
    plan = cut(classes.select("key", "class", "source_size", "target", "certain", "p"))
    drawn = slim.withColumn("class", length).join(small(plan.where("p > 0").select("key", "class", "p")), ["key", "class"])
    drawn = drawn.select("key", "size", "u", rank_key(F.col("u"), F.col("p")).alias("rank_key"))
    wanted = cut(classes.groupBy("key").agg(F.round(F.sum(F.col("p") * F.col("words")), 3).alias("wanted")))
    ends = cut(sample_ends(drawn, wanted))
    fits = (F.col("part_rows") > 0) & (F.col("rank_key") == F.col("part_key"))
    tied = F.coalesce(fits | (F.col("close_rows") > 1) & (F.col("rank_key") == F.col("close_key")), F.lit(False))
    ties = cut(drawn.join(small(ends), "key").where(tied).select("key", "u", F.when(fits, F.col("part_rows")).otherwise(1).alias("to_deal")).distinct())
    out = rows.withColumn("class", length).join(small(plan), ["key", "class"]).join(small(ends), "key", "left").withColumn("rank_key", rank_key(F.col("u"), F.col("p")))
    out = out.withColumn("bin", F.floor(F.col("rank_key") * float(1 << 2 * BITS)).cast("long"))
    extra = F.col("rank_key").isNotNull() & (taken() | F.coalesce((F.col("rank_key") == F.col("close_key")) & (F.col("close_rows") == 1), F.lit(False)))
    out = out.where(~tied).withColumn("copies", (F.col("certain") + extra.cast("long")).cast("long"))
    if not ties.isEmpty():  # only then are these rows read again
        again = dealt(rows.drop("size").join(small(ties), ["key", "u"])).withColumn("size", size).withColumn("class", length)
        again = again.join(small(plan), ["key", "class"]).withColumn("copies", (F.col("certain") + F.col("dealt")).cast("long"))
        out = out.select(*(names := ["row", *columns, "size", "source_size", "target", "copies"])).unionByName(again.select(*names))
    return restored(out.withColumn("taken", F.col("copies") * F.col("size")), docs, columns, ["size", "source_size", "target", "copies", "taken"])


def op4(spark, sf_dir: str) -> DataFrame:
    """``pareto_mix`` over all documents; null texts and sources, repeated rows and an empty table as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
