"""Token counts: additive totals by source, language and tokenizer version, kept up by signed deltas in idempotent batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm.shared import WORD, cut, scratch, tidy

KEYS = ["source", "lang", "tokenizer_version"]

#: Versions that are no tokenizer but a pattern, for text that is counted without one.
PATTERNS = {"words-1": WORD, "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"}

#: Texts that a tokenizer gets at a time.
TEXTS = 128


class Ranked:
    """Token counts of a byte-level tokenizer given as ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.encode(t)) for t in texts]


class Worded:
    """Token counts of a word tokenizer, by the cache of its words' ids."""

    def __init__(self, path: str):
        from tracegraph.llm.tokens import word_ids

        self.ids = word_ids(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids.encode(texts)]


def tokenizer_counts(docs: DataFrame, columns: list[str], tokenizers: dict[str, tuple[str, str | None]]) -> DataFrame:
    """For each row and text column the number of tokens by each version, as an array of (tokenizer_version, one number per column) in ``counts``.

    ``tokenizers`` maps versions to (path, pattern): files of ranks with the pattern that splits text, or word tokenizers without one.
    Null text has no tokens; a column whose text is that of the column before is not counted again. Other columns stay, but for one named ``counts``.
    """
    keep = [c for c in docs.columns if c not in (*columns, "counts")]
    rows = docs.select(F.struct(*[f"`{c}`" for c in keep] or [F.lit(0).alias("none")]).alias("row"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(columns)])
    kind = rows.select("row").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {v: Ranked(p, x) if x else Worded(p) for v, (p, x) in tokenizers.items()}
        for batch in batches:
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                texts = [[t or "" for t in part.column(k + 1).to_pylist()] for k in range(len(columns))]
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for v, t in made.items():
                    numbers: list[list[int]] = []
                    for k, own in enumerate(texts):
                        new = [i for i, x in enumerate(own) if not k or x != texts[k - 1][i]]
                        out = list(numbers[-1]) if k else [0] * len(own)
                        for i, n in zip(new, t.counts([own[i] for i in new]), strict=True):
                            out[i] = n
                        numbers.append(out)
                    for i, x in enumerate(zip(*numbers, strict=True)):
                        found[i].append({"tokenizer_version": v, "tokens": list(x)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.struct([("tokenizer_version", pa.string()), ("tokens", pa.list_(pa.int64()))])))], ["row", "counts"])

    out = rows.mapInArrow(tidy(run), f"row {kind}, counts array<struct<tokenizer_version:string,tokens:array<bigint>>>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "counts")


def pattern_counts(docs: DataFrame, columns: list[str], patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """The same as ``tokenizer_counts`` with the matches of a pattern as tokens."""
    keep = [f"`{c}`" for c in docs.columns if c not in (*columns, "counts")]
    number = lambda p, c: F.coalesce(F.regexp_count(F.col(f"`{c}`"), F.lit(p)), F.lit(0)).cast("long")
    each = [F.struct(F.lit(v).alias("tokenizer_version"), F.array(*[number(p, c) for c in columns]).alias("tokens")) for v, p in patterns.items()]
    return docs.select(*keep, F.array(*each).alias("counts"))


class Rollup:
    """Totals under one folder: ``base`` (batches summed up by ``compact``) and ``batches``, a folder of deltas for each batch since.

    A batch is committed when its folder has Spark's ``_SUCCESS`` mark, which is written last; committing it again does nothing, and
    what a failed attempt left is written over. Totals are sums over committed batches, so batches may come in any order. A
    folder has one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.folder}/{name}"))

    def names(self, of: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.folder}/{of}"))) if self.exists(of) else []

    def base(self) -> str | None:
        """The newest whole base: its totals are written first, then the batches that it holds."""
        return max((f"base/{n}" for n in self.names("base") if self.exists(f"base/{n}/batches/_SUCCESS")), default=None)

    def committed(self, batch: str) -> bool:
        if self.exists(f"batches/{batch}/_SUCCESS"):
            return True
        base = self.base()
        return base is not None and not self.spark.read.schema("batch string").parquet(f"{self.folder}/{base}/batches").where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the changes (op, ``KEYS``, tokens before and after as old_tokens and tokens) as batch ``batch``, once; False if it was there.

        insert: one document and its tokens more. delete: one document and its old tokens less. revise: its tokens instead of the
        old ones; where ``changes`` also has old_source, old_lang and old_tokenizer_version, the document moves from those keys. Null
        counts are 0, null keys are keys of their own; other values of op are an error. Repeated rows are changes of their own, other
        columns are ignored, and a batch may be empty. Deltas are summed before they are shuffled.
        """
        if self.committed(batch):
            return False
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
        keys = [F.col(k) for k in KEYS]
        before = [F.when((F.col("op") == "revise"), F.col(f"old_{k}")).otherwise(F.col(k)) if f"old_{k}" in changes.columns else F.col(k) for k in KEYS]
        named = lambda by, docs, tokens: F.struct(*[c.alias(k) for k, c in zip(KEYS, by, strict=True)], F.lit(docs).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
        more, less = named(keys, 1, new), named(before, -1, -old)
        signed = F.when(F.col("op") == "insert", F.array(more)).when(F.col("op") == "delete", F.array(less)).when(F.col("op") == "revise", F.array(more, less)).otherwise(F.array(named(keys, 0, wrong.cast("int"))))
        deltas = changes.select(F.explode(signed).alias("x")).groupBy(*[F.col(f"x.{k}").alias(k) for k in KEYS]).agg(F.sum("x.docs").alias("n_docs"), F.sum("x.tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def batches(self) -> list[str]:
        """Committed batches that no base holds yet."""
        found = [n for n in self.names("batches") if self.exists(f"batches/{n}/_SUCCESS")]
        base = self.base()
        held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/{base}/batches").where(F.col("batch").isin(found)).collect()} if base and found else set()
        return [n for n in found if n not in held]

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by ``KEYS``; keys without documents and tokens are left out."""
        base = self.base()
        paths = [f"{self.folder}/{base}/totals"] * (base is not None) + [f"{self.folder}/batches/{b}" for b in self.batches()]
        schema = ", ".join(f"{k} string" for k in KEYS) + ", n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> int:
        """Sums base and batches up into a new base and removes their folders; returns how many batches went in. Totals stay the same.

        The new base counts once it is whole, and batches that it holds are left out by name from then on, so a stop anywhere loses and
        doubles nothing.
        """
        old, found = self.base(), self.batches()
        if found:
            to = f"{self.folder}/base/{int(old.rpartition('/')[2]) + 1 if old else 1:012d}"
            self.totals().write.mode("overwrite").parquet(f"{to}/totals")
            held = self.spark.createDataFrame([(b,) for b in found], "batch string")
            if old:
                held = held.unionByName(self.spark.read.schema("batch string").parquet(f"{self.folder}/{old}/batches"))
            held.write.mode("overwrite").parquet(f"{to}/batches")
            for name in [*([old] if old else []), *(f"batches/{b}" for b in found)]:
                self.fs.delete(self.path(f"{self.folder}/{name}"), True)
        return len(found)


def changes(rows: DataFrame, op: str) -> DataFrame:
    """Change rows of one kind; absent counts are null."""
    have = rows.columns
    return rows.select(F.lit(op).alias("op"), *KEYS, *[(F.col(c) if c in have else F.lit(None)).cast("long").alias(c) for c in ("old_tokens", "tokens")])


def life_of_a_corpus(spark, counted: DataFrame) -> DataFrame:
    """Totals after these batches: load all, revise texts that scrubbing changes, delete those of fewer than 20 words, and one batch again.

    ``counted``: source, lang, words, changed, and counts of the text before and after.
    """
    rows = counted.select("source", "lang", "words", "changed", F.explode("counts").alias("x")).select("source", "lang", "words", "changed", "x.tokenizer_version", F.col("x.tokens")[0].alias("before"), F.col("x.tokens")[1].alias("after"))
    state = Rollup(spark, scratch(spark))
    state.commit("1-load", changes(rows.withColumn("tokens", F.col("before")), "insert"))
    revised = changes(rows.where("changed").withColumnsRenamed({"before": "old_tokens", "after": "tokens"}), "revise")
    state.commit("2-scrub", revised)
    state.compact()
    state.commit("3-short", changes(rows.where("words < 20").withColumnRenamed("after", "old_tokens"), "delete"))
    state.commit("2-scrub", revised)
    return state.totals()


def scrubbed(docs: DataFrame) -> DataFrame:
    clean = F.regexp_replace("text", "[0-9]+", "")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    return docs.select("source", "lang", words.alias("words"), F.coalesce(F.col("text") != clean, F.lit(False)).alias("changed"), "text", clean.alias("clean"))


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents by two public tokenizers: loaded, digits scrubbed, documents of fewer than 20 words deleted, a batch repeated."""
    import public_tokenizers as public

    versions = {"word_bpe_49k": (public.path("word_bpe_49k.json"), None), "byte_bpe_multi_50k": (public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return life_of_a_corpus(spark, cut(tokenizer_counts(scrubbed(docs), ["text", "clean"], versions)))


def by_pattern(spark, sf_dir: str) -> DataFrame:
    """The same by patterns, which SQL can count."""
    return life_of_a_corpus(spark, cut(pattern_counts(scrubbed(spark.read.parquet(f"{sf_dir}/documents.parquet")), ["text", "clean"])))


SQL = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT source, lang, regexp_replace(t, '[0-9]+', '', 'g') AS t FROM d WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 20)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens FROM c GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*), sum(len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')))::BIGINT FROM c GROUP BY ALL
"""
