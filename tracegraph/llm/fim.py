"""Fill-in-middle: texts cut in three at unit borders, found by a Fenwick tree over fixed blocks, and put together in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegraph.llm.shared import buffers, carried, restored, tidy

#: What stands before prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of a block of the tree.
BLOCK = 1024

#: Bytes whose unit starts are looked for at once; a multiple of ``BLOCK``.
SPAN = 1 << 20

#: The six ASCII white-space characters.
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def char_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which of the bytes a to b begin a code point."""
    return (data[a:b] & 0xC0) != 0x80


def word_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which of the bytes a to b begin a word (the white space after a word belongs to it, that before the first one is a unit by itself)."""
    space = SPACE[data[a:b]]
    out = ~space
    if b > a:
        out[1:] &= space[:-1]
        out[0] = a == 0 or out[0] and SPACE[data[a - 1]]
    return out


UNITS = {"char": char_starts, "word": word_starts}


class Fenwick:
    """Prefix sums over the blocks of one text, of two counts each: units and code points that start there."""

    def __init__(self, counts: np.ndarray):
        """``counts``: blocks x 2."""
        n = len(counts)
        self.size, self.top = n, 1 << max(0, n.bit_length() - 1)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0, dtype=np.int64)])
        i = np.arange(1, n + 1)
        self.tree = np.concatenate([np.zeros((1, 2), np.int64), sums[i] - sums[i - (i & -i)]]).tolist()  # node i covers the blocks i - (i & -i) to i

    def descend(self, units: int) -> tuple[int, int, int]:
        """The block in which unit number ``units`` (from 0) starts, and the units and code points before that block: steps of falling powers of two,
        each taken if its blocks start no more than ``units`` units. Beyond the last unit: the number of blocks."""
        at, before, points, step = 0, 0, 0, self.top
        while step:
            if at + step <= self.size and before + self.tree[at + step][0] <= units:
                at += step
                before += self.tree[at][0]
                points += self.tree[at][1]
            step >>= 1
        return at, before, points


class Text:
    """One text's bytes with its tree."""

    def __init__(self, data: np.ndarray, unit: str = "char"):
        self.data, self.starts = data, UNITS[unit]
        blocks = -(-len(data) // BLOCK)
        counts = np.zeros((blocks, 2), np.int64)
        for a in range(0, len(data), SPAN):
            b = min(len(data), a + SPAN)
            edges = np.arange(0, b - a, BLOCK)
            points = np.add.reduceat(char_starts(data, a, b), edges, dtype=np.int64)
            counts[a // BLOCK : a // BLOCK + len(edges), 1] = points
            counts[a // BLOCK : a // BLOCK + len(edges), 0] = points if unit == "char" else np.add.reduceat(self.starts(data, a, b), edges, dtype=np.int64)
        self.n, self.points = counts.sum(axis=0).tolist() if blocks else (0, 0)
        self.tree = Fenwick(counts)

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code-point place before unit ``units`` (of all n: the end)."""
        block, before, points = self.tree.descend(units)
        a, b = block * BLOCK, min(len(self.data), (block + 1) * BLOCK)
        if units >= self.n:
            return len(self.data), self.points
        at = int(np.flatnonzero(self.starts(self.data, a, b))[units - before])
        return a + at, points + int(char_starts(self.data, a, a + at).sum())


def draws(seed: int, key: object) -> list[int]:
    """The first four 8-digit groups of the sha256 of ``seed:key``, as unsigned integers."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(found[4 * i : 4 * i + 4], "big") for i in range(4)]


def transformed(data: np.ndarray, drawn: list[int], unit: str, fim: int, spm: int) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, number of units, form, and the code points of prefix and middle (None in plain form)."""
    text = Text(data, unit)
    raw = data.tobytes()
    if not raw or drawn[2] % 100 >= fim or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return raw, text.n, "plain", None, None
    lo, hi = sorted((drawn[0] % (text.n + 1), drawn[1] % (text.n + 1)))
    (a, p), (b, q) = text.cut(lo), text.cut(hi)
    parts = [(PREFIX, raw[:a]), (SUFFIX, raw[b:]), (MIDDLE, raw[a:b])]
    form = "spm" if drawn[3] % 100 < spm else "psm"
    if form == "spm":
        parts[:2] = parts[1::-1]
    return b"".join(m.encode() + x for m, x in parts), text.n, form, p, q - p


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", fim: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """Adds n (units of the text), form, prefix_chars, middle_chars and ``fim``, the output text, to every row; columns of these names are replaced.

    Units are code points (``unit="char"``) or words. The sha256 of ``seed:id`` gives two cuts among the n + 1 unit borders, the form (``fim``
    of 100 rows are transformed, the rest is plain) and the order (``spm`` of 100 of those have the suffix first), so a row's output depends on
    its id and text alone and reruns agree. A block of ``BLOCK`` bytes holds a leaf of the text's tree; a cut descends to its block and is
    then found in it. Outputs leave the task some texts at a time.

    Null text: empty. Empty texts, and those that contain one of the markers, are plain; so every output can be turned back (``restore``). A null
    id is drawn as an empty one. Rows that repeat give equal outputs, an empty table gives no rows.
    """
    held = {"doc": id_col, "body": text_col}
    new = ["n", "form", "prefix_chars", "middle_chars", "fim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            start, out, size = 0, [], 0
            keys = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                out.append(transformed(data[at[i] : at[i + 1]], draws(seed, keys[i]), unit, fim, spm))
                size += len(out[-1][0])
                if i + 1 == batch.num_rows or size > 4 * SPAN:
                    text, n, form, prefix, middle = zip(*out, strict=True)
                    own = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(text, pa.binary()).cast(pa.string(), safe=False)], [*own.schema.names, *new])
                    start, out, size = i + 1, [], 0

    rows = carried(docs, **held)
    made = rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, fim string").fields]))
    return restored(made, docs, held, new)


def restore(form: Column, output: Column) -> Column:
    """The text again, from form and output alone: a marker cannot arise where two parts meet, as it neither begins nor ends with what another one does."""
    between = lambda a, b: F.substring_index(F.substr(output, F.instr(output, a) + len(a)), b, 1)
    after = lambda a: F.substr(output, F.instr(output, a) + len(a))
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13(spark, sf_dir: str) -> DataFrame:
    """``fill_in_middle`` of all documents with code points as units, and digests of outputs and of the texts restored from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("fim")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
x AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""
