"""Toxicity: a weighted finite-state grammar over clauses; insult terms and the grammar's weights are learnt from labels.

The grammar is a composition of small transducers (threat, insult, negation, reported speech, target, weights) over word classes. A
lexicon turns the tokens of a clause into classes; the composed machine reads them and puts out what the clause says, with weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegraph.llm.langid import remainder
from tracegraph.llm.shared import carried, cut, restored, tidy

#: Closed word classes of the grammar, in English, German, French and Spanish.
TARGET = set("you your yours u he she him her they them their these those this that du dich dir ihr euch sie er dein deine tu toi te vous il elle ils elles ton ta usted ustedes ti él ella ellos tú".split())
NEGATION = set("not no never nobody nothing isn't aren't wasn't weren't don't doesn't didn't won't cannot can't without nicht kein keine keinen niemals nie ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split())
REPORT = set("said says say saying called calls wrote writes claimed claims told tells quoted quote reported reportedly allegedly sagte sagt schrieb nannte behauptete dit disait écrit affirme selon dijo dice escribió llamó afirmó según".split())
HARM = set("kill hurt murder stab shoot strangle burn töten umbringen verletzen erschießen tuer frapper blesser poignarder matar herir golpear apuñalar".split())
INTENT = set("will shall going gonna want should must i'll we'll werde werden wird will soll vais va allons vont veux voy vas va vamos van quiero".split())

#: A clause ends at one of these; a quotation mark inside it marks reported speech.
CLAUSE = re.compile(r"[^.!?;:,\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
QUOTES = set('"“”«»„')

#: Tokens for which a negation stays in force.
SCOPE = 3

#: What a clause can say, in order of the learnt weights.
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "reported threat")

#: What the lexicon makes of a token: the input symbols of the grammar.
SYMBOLS = ("other", "target", "negation", "report", "harm", "intent", "insult")

PREFIXES = range(4, 8)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: arcs from (state, symbol) to (symbol put out, weight, state). State 0 is the start; every state
    may end. The weight of a path is the sum of its arcs' weights."""

    arcs: dict[tuple[int, str], tuple[str, float, int]]

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        """Symbols and weights along the one path that reads ``symbols``."""
        state, out = 0, []
        for x in symbols:
            y, w, state = self.arcs[state, x]
            out.append((y, w))
        return out


def machine(states: int, symbols: Iterable[str], rules: dict[tuple[int | None, str], tuple[str, int | None]], rest: Callable[[int], int] = lambda s: s) -> Transducer:
    """A transducer that passes symbols on and goes from state s to ``rest`` (s), but for ``rules``: (state or any, symbol) -> (output, next state or ``rest``)."""
    arcs = {}
    for s in range(states):
        for x in symbols:
            y, to = rules.get((s, x), rules.get((None, x), (x, None)))
            arcs[s, x] = y, 0.0, rest(s) if to is None else to
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` makes of the output of ``a``, as one machine: the pairs of states that can be reached, weights added."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    reads: dict[int, list[str]] = {}
    for s, x in a.arcs:
        reads.setdefault(s, []).append(x)
    while todo:
        p, q = pair = todo.pop()
        for x in reads[p]:
            y, w, p2 = a.arcs[p, x]
            z, v, q2 = b.arcs[q, y]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[pair], x] = z, w + v, number[p2, q2]
    return Transducer(arcs)


def threats() -> Transducer:
    """A word of harm after one of intent is a threat; without it, nothing."""
    return machine(2, SYMBOLS, {(None, "intent"): ("intent", 1), (0, "harm"): ("other", 0), (1, "harm"): ("threat", 1)})


def insults() -> Transducer:
    """Every insult is one; the words that only threats need are no more than words from here on."""
    return machine(1, (*SYMBOLS, "threat"), {(0, "intent"): ("other", 0), (0, "harm"): ("other", 0)})


def negation(scope: int) -> Transducer:
    """Within ``scope`` tokens of a negation an insult is a negated one, and a threat none. The state counts the tokens left."""
    rules: dict = {(None, "negation"): ("other", scope)}
    for s in range(1, scope + 1):
        rules |= {(s, "insult"): ("negated insult", s - 1), (s, "threat"): ("other", s - 1)}
    return machine(scope + 1, ("other", "target", "negation", "report", "insult", "threat"), rules, lambda s: max(0, s - 1))


def reports() -> Transducer:
    """After a verb of speech or a quotation mark what is said is reported."""
    rules: dict = {(None, "report"): ("other", 1), (1, "insult"): ("reported insult", 1), (1, "negated insult"): ("reported insult", 1), (1, "threat"): ("reported threat", 1)}
    return machine(2, ("other", "target", "report", "insult", "negated insult", "threat"), rules)


def targets() -> Transducer:
    """After a word for a person an insult is aimed."""
    return machine(2, ("other", "target", *KINDS), {(None, "target"): ("other", 1), (1, "insult"): ("aimed insult", 1)})


def weighed(weights: np.ndarray) -> Transducer:
    """One state that gives each kind its weight."""
    return Transducer({(0, "other"): ("other", 0.0, 0)} | {(0, k): (k, float(w), 0) for k, w in zip(KINDS, weights, strict=True)})


def grammar_of(weights: np.ndarray) -> Transducer:
    """The insult, threat, negation, reported-speech and target transducers composed, and weighed."""
    out = threats()
    for t in (insults(), negation(SCOPE), reports(), targets(), weighed(weights)):
        out = compose(out, t)
    return out


@dataclass
class Grammar:
    """Insult terms with weights (a final * stands for any ending), the logistic weights of ``KINDS`` with a bias, and the machine they make."""

    terms: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.ones(len(KINDS)))
    bias: float = -4.0

    def __post_init__(self) -> None:
        self.stems = {t[:-1]: w for t, w in self.terms.items() if t.endswith("*")}
        words = [t for t in self.terms if not t.endswith("*")]
        parts = sorted([re.escape(w) + r"\b" for w in {*words, *HARM}] + [re.escape(s) for s in self.stems])
        first = "".join(sorted({re.escape(p.lstrip("\\")[0]) for p in parts}))
        self.seek = re.compile(rf"\b(?=[{first}])(?:{'|'.join(parts)})").search
        self.classes = {t: c for c, found in (("intent", INTENT), ("target", TARGET), ("report", REPORT | QUOTES), ("negation", NEGATION), ("harm", HARM)) for t in found}
        self.machine = grammar_of(self.weights)

    def insult(self, token: str) -> float:
        w = self.terms.get(token, 0.0)
        return max([w, *(self.stems.get(token[:k], 0.0) for k in PREFIXES)]) if self.stems else w

    def clauses(self, text: str) -> Iterator[tuple[str, list[tuple[str, float, float]]]]:
        """Clauses of the lower-cased text that hold an insult or a threat: what they say, its term's weight and its arc's."""
        at = 0
        while hit := self.seek(text, at):
            start = max(text.rfind(c, at, hit.start()) for c in ".!?;:,\n") + 1
            clause = CLAUSE.match(text, max(at, start))
            terms = [(t, self.insult(t)) for t in TOKEN.findall(clause[0])]
            path = self.machine.run("insult" if w > 0 else self.classes.get(t, "other") for t, w in terms)
            said = [(kind, w or 1.0, arc) for (kind, arc), (_, w) in zip(path, terms, strict=True) if kind != "other"]
            if said:
                yield clause[0], said
            at = max(clause.end(), hit.end())

    def read(self, text: str | None) -> tuple[np.ndarray, float, list[str]]:
        """For each kind the log of one plus its terms' weights summed over clauses, the score, and the clauses with their kinds."""
        sums, arcs, shown = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0), []
        for clause, said in self.clauses((text or "").lower()):
            for kind, w, arc in said:
                sums[kind] += w
                arcs[kind] = arc
            shown.append(f"{'+'.join(k for k, _, _ in said)}: {clause.strip()}")
        x = np.log1p([sums[k] for k in KINDS])
        return x, float(1 / (1 + np.exp(-(sum(arcs[k] * v for k, v in zip(KINDS, x, strict=True)) + self.bias)))), shown


def keys(text: str) -> set[str]:
    """Distinct words of a text and their beginnings, which end in a star."""
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}


def choose(found: list[tuple[int, list[str]]], weight: dict[str, float], least: int) -> dict[str, float]:
    """Terms that explain toxic documents, by greedy cover: each next term is the one that occurs in most documents that fewer than two
    terms explain so far, until none does so in ``least``; of terms that explain as much, the most specific."""
    holds: dict[str, set[int]] = {}
    for doc, terms in found:
        for t in terms:
            holds.setdefault(t, set()).add(doc)
    need = dict.fromkeys((doc for doc, _ in found), 2)
    out: dict[str, float] = {}
    while holds:
        gain = {t: sum(need[d] > 0 for d in docs) for t, docs in holds.items()}
        top = max(gain.values())
        if top < least:
            break
        near = [t for t, g in gain.items() if g >= (0.97 if t.endswith("*") else 0.7) * top]
        t = max(near, key=lambda x: (not x.endswith("*"), len(x) if x.endswith("*") else gain[x], x))
        out[t] = weight[t]
        for d in holds.pop(t):
            need[d] -= need[d] > 0
        holds = {k: v for k, v in holds.items() if gain[k] >= least}
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps; weights stay at or above zero, so that no match lowers a score."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w = np.maximum(w - (x.T @ (p - y) / len(y) + l2 * 0.1 * w) * 2.0, 0.0)
        b -= float(np.mean(p - y)) * 2.0
    return w, b


def learn(labelled: DataFrame, sample_rows: int = 4000, least: int = 8, ratio: float = 20.0, stem_ratio: float = 150.0) -> Grammar:
    """Fits terms and weights to (text, toxic) rows: a sample of about ``sample_rows`` of each label, chosen by a hash of the text.

    A candidate term is a word or a beginning of 4 to 7 letters that occurs in at least ``least`` toxic documents and ``ratio`` times
    as often in toxic as in other documents (``stem_ratio`` for a beginning, which also stands for words not seen). Texts never leave the
    executors; candidate terms of the sample do, so their number is bounded by its size. Copies of a text are one row of the sample.
    Without rows of both labels nothing is learnt.
    """
    known = labelled.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("h"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Grammar({})
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_rows / counts[1]))).otherwise(F.lit(min(1.0, sample_rows / counts[0])))
    rows = cut(known.where((F.shiftrightunsigned("h", 11) + 0.5) / float(1 << 53) < rate).dropDuplicates(["h", "toxic"]))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(keys(text))
        every = list(seen[1].keys() | seen[0].keys())
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][k] for k in part], pa.int64()), pa.array([seen[0][k] for k in part], pa.int64())], ["term", "pos", "neg"])

    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    odds = rows.select("text", "toxic").mapInArrow(tidy(tally), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = odds.where(F.col("pos") >= least).withColumn("w", F.log(share("pos", size.get(1, 0)) / share("neg", size.get(0, 0)))).where(F.col("w") >= F.when(F.col("term").endswith("*"), float(np.log(stem_ratio))).otherwise(float(np.log(ratio))))
    weight = {r.term: r.w for r in best.select("term", "w").collect()}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(keys(t) & weight.keys()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

    toxic = rows.where("toxic = 1").orderBy("h").select("text").mapInArrow(tidy(matched), "terms array<string>").collect()
    grammar = Grammar(choose([(i, r.terms) for i, r in enumerate(toxic)], weight, least))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.read(t)[0].tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(tidy(measured), "x array<double>, toxic int").toPandas().sort_values("toxic", kind="stable")
    x, y = np.array(seen.x.tolist(), float).reshape(-1, len(KINDS)), seen.toxic.to_numpy(float)
    order = np.lexsort(x.T)
    w, b = fit_weights(x[order], y[order])
    # kinds that the labels hardly show get what the plain insult has, lessened by what the modifier means
    plain = w[:2].max()
    floor = plain * np.array([0.8, 1.0, 0.4, 0.4, 1.0, 0.4])
    rare = (x > 0).sum(0) < least
    return Grammar(grammar.terms, np.where(rare, np.maximum(w, floor), w), b)


def score_rows(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """Adds score, predicted and clauses (the matched clauses, each with its kinds) to every row; input columns of these names are replaced.

    Null or empty text: the score of a text without a match.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [grammar.read(text)[1:] for text in batch.column(1).to_pylist()]
            score, said = [s for s, _ in read], [c for _, c in read]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(said, pa.list_(pa.string()))], ["row", "body", "score", "predicted", "clauses"])

    rows = carried(docs, body=text_col)
    out = rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, *StructType.fromDDL("score double, predicted int, clauses array<string>").fields]))
    return restored(out, docs, {"body": text_col}, ["score", "predicted", "clauses"])


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted and matched clauses for every row, learnt from labels whose crc32(id) mod 5 is not 0.

    Null or empty text: no clause, so the score of a clean text. Null ids are not held out and match no label; null labels and other
    values than 0 and 1 are left out. Without labels of both kinds nothing matches. Repeated rows are rows of their own, an empty
    table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), "toxic").where((remainder("doc_id", 5) != 0) & F.col("toxic").isin(0, 1))
    n = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("toxic").n
    drawn = F.lit(0.0)
    for k, v in n.items():  # a bounded number of labels goes to the documents, so that texts are not shuffled
        drawn = F.when(F.col("toxic") == int(k), F.lit(min(1.0, 2.0 * sample_rows / v))).otherwise(drawn)
    known = known.where((F.shiftrightunsigned(F.xxhash64("doc_id"), 11) + 0.5) / float(1 << 53) < drawn)
    grammar = learn(rows.join(F.broadcast(known), "doc_id").select("text", "toxic"), sample_rows)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_rows(rows.select("doc_id", held, "text"), grammar).drop("text")


def op1(spark, sf_dir: str) -> DataFrame:
    """``toxicity`` over all documents and labels; null, empty, repeated and absent rows as there."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", "clauses")
