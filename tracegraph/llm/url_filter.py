"""URL filter by rules and by the ratio of two character models, in DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.llm.shared import cut

#: (verdict, host and path from its first slash on); the longest rule that fits decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Characters of context that a model looks back at most.
ORDER = 4

#: Times that a model must have met a context to use it; below, the next shorter context speaks.
LEAST = 2

#: Symbols that may come next: the printable ASCII characters, one for all others, and the end.
SYMBOLS = 94 + 1 + 1
OTHER, START, END = "\x7f", "\x02", "\x03"

#: Steps of a natural logarithm unit in which differences are added, as whole numbers, so that sums do not depend on their order.
STEPS = 1 << 20

#: Bins of a natural logarithm unit, and the last bin either way, of the histogram that the threshold is found from.
BINS, LAST_BIN = 256, 4096

#: A gram with more than one part in so many of all occurrences is sent to every executor, so at most so many grams are.
HOT = 20_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and path (then up to ``?``, ``#`` or the end); '' where there is no ``://``."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest of ``rules`` that fits as struct (rule, verdict), or null. A rule fits its host and the hosts under it if the path starts with its own.
    Rules are a parameter of a few rows, one branch each."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        said = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def grams(url: Column) -> Column:
    """Every symbol of ``url`` and its end, each behind the ``ORDER`` symbols before it."""
    text = F.concat(F.lit(START * ORDER), F.regexp_replace(F.coalesce(url, F.lit("")), r"[^\x21-\x7E]", OTHER), F.lit(END))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def log_ratios(counts: DataFrame) -> DataFrame:
    """Log-likelihood differences of grams (gram, accepted, rejected: occurrences in either kind of URLs, 0 where a gram is only asked for): gram, ratio.

    For either kind the probability of a symbol behind a context is (n + t p) / (N + t): n of N occurrences of the context are followed by
    the symbol, t different symbols follow it, and p is the probability behind the context that is one shorter; a context met fewer
    than ``LEAST`` times adds nothing to the shorter one. So every symbol is judged behind the longest context that its model knows well.
    Counts of shorter grams are sums over the symbol in front. A context is followed by at most ``SYMBOLS`` symbols, which bounds its window.
    """
    kinds = ("accepted", "rejected")
    levels = [counts]
    for _ in range(ORDER):
        levels.append(cut(levels[-1].groupBy(F.expr("substr(gram, 2)").alias("gram")).agg(*[F.sum(c).alias(c) for c in kinds])))
    known = None
    for order, level in enumerate(reversed(levels)):
        behind = Window.partitionBy(F.substring("gram", 1, order))
        rows = level.select("gram", *kinds, *[x for c in kinds for x in (F.sum(c).over(behind).alias(f"{c}_of"), F.sum((F.col(c) > 0).cast("long")).over(behind).alias(f"{c}_kinds"))])
        if known is None:
            rows = rows.withColumns({f"{c}_p": F.lit(1.0 / SYMBOLS) for c in kinds})
        else:
            rows = rows.withColumn("tail", F.expr("substr(gram, 2)")).join(known.withColumnRenamed("gram", "tail"), "tail")
        p = [F.when(F.col(f"{c}_of") >= LEAST, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_of") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")).alias(f"{c}_p") for c in kinds]
        known = cut(rows.select("gram", *p))
    return known.select("gram", F.round((F.ln("accepted_p") - F.ln("rejected_p")) * STEPS).cast("long").alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """The score from which on URLs are accepted: where rows (score, accepted) not learnt from have the smallest sum of both error rates, in the middle of
    the widest gap between bins that has it. Without rows of both kinds 0."""
    at = F.greatest(F.least(F.round(F.col("score") * BINS), F.lit(LAST_BIN)), F.lit(-LAST_BIN)).cast("int")
    bins = scores.groupBy(at.alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    order = Window.orderBy("bin")  # at most 2 LAST_BIN + 1 bins
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(before), F.lit(0)), F.sum(c).over(whole))
    found = bins.select("bin", F.lag("bin").over(order).alias("last"), (share("a") - share("r")).alias("error")).where("last is not null and error is not null")
    best = found.orderBy(F.round("error", 12), F.col("last") - F.col("bin"), "bin").select((F.col("bin") + F.col("last")) / (2.0 * BINS)).first()
    return best[0] if best else 0.0


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Columns of ``pages``' id, then host, path, rule, verdict and score (null where a rule decides), one row for each row.

    URLs that a rule allows or blocks teach two character models, all but about a fifth (by the md5 of the URL), which calibrates: a URL's score is
    its log-likelihood under the accepted model less that under the rejected one, over its symbols, less the threshold found on that
    fifth; 0 and above is allowed. Grams are counted before they are shuffled. To score, grams that stand in many URLs (at most
    ``HOT`` of them, whatever the corpus) are sent to every executor, the others are joined by gram, so no key is hot.

    Null and empty URLs, and those without ``://``, have an empty host and path, fit no rule and are judged by the models. Null ids stay null, rows that
    repeat are judged each, an empty table gives no rows, other columns are ignored. If no rule allows or none blocks a URL, the
    models differ in nothing but what one side has taught and the threshold is 0.
    """
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), path.alias("path"))
    held = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin("0", "1", "2")
    rows = rows.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "own.rule", F.col("own.verdict").alias("ruled"), held.alias("held"), F.monotonically_increasing_id().alias("row_id"))
    rows = cut(rows)  # from here on row_id stands for the row
    teaches = lambda v: F.coalesce(((F.col("ruled") == v) & ~F.col("held")).cast("long"), F.lit(0))
    asks = F.col("ruled").isNull() | F.col("held")
    each = rows.select(teaches("allow").alias("accepted"), teaches("block").alias("rejected"), asks.cast("long").alias("asked"), F.explode(grams(F.col("url"))).alias("gram"))
    counts = cut(each.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("asked").alias("asked")))
    ratios = cut(log_ratios(counts.drop("asked")).join(counts.where("asked > 0").select("gram", "asked"), "gram"))
    total = ratios.agg(F.sum("asked")).first()[0] or 0
    hot = F.broadcast(ratios.where(F.col("asked") * HOT > total).select("gram", "ratio"))  # fewer than HOT rows by that condition
    seen = rows.where(asks).select("row_id", F.explode(grams(F.col("url"))).alias("gram"))
    cold = seen.join(hot, "gram", "left_anti").join(ratios.where(F.col("asked") * HOT <= total).select("gram", "ratio"), "gram")
    sums = seen.join(hot, "gram").select("row_id", "ratio").unionByName(cold.select("row_id", "ratio"))
    scores = cut(sums.groupBy("row_id").agg((F.sum("ratio") / STEPS / F.count(F.lit(1))).alias("score")))
    judged = cut(rows.join(scores, "row_id", "left"))
    least = threshold(judged.where("held and ruled is not null").select("score", (F.col("ruled") == "allow").alias("accepted")))
    margin = F.when(F.col("ruled").isNull(), F.col("score") - F.lit(least))
    verdict = F.coalesce("ruled", F.when(margin >= 0, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), margin.alias("score"))


def op12(spark, sf_dir: str) -> DataFrame:
    """``filter_urls`` over all pages; null URLs and repeated rows as there."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("score")


def twin(rules=RULES) -> str:
    """The same in DuckDB SQL, level by level."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}'))"
    case = lambda i: f"CASE {' '.join(f'WHEN {fits(r[1])} THEN {chr(39)}{r[i]}{chr(39)}' for r in ranked)} END"
    levels = [f"n{ORDER} AS MATERIALIZED (SELECT gram, sum(acc) AS acc, sum(rej) AS rej FROM g GROUP BY gram)"]
    levels += [f"n{k} AS MATERIALIZED (SELECT substr(gram, 2) AS gram, sum(acc) AS acc, sum(rej) AS rej FROM n{k + 1} GROUP BY ALL)" for k in reversed(range(ORDER))]
    for k in range(ORDER + 1):
        over = f"OVER (PARTITION BY substr(n.gram, 1, {k}))"
        one = lambda c: f"CASE WHEN sum({c}) {over} >= {LEAST} THEN ({c} + sum(({c} > 0)::INT) {over} * {f'p.{c}_p' if k else f'{1.0 / SYMBOLS!r}::DOUBLE'}) / (sum({c}) {over} + sum(({c} > 0)::INT) {over})::DOUBLE ELSE {f'p.{c}_p' if k else f'{1.0 / SYMBOLS!r}::DOUBLE'} END AS {c}_p"  # noqa: B023, E731
        levels.append(f"p{k} AS MATERIALIZED (SELECT n.gram, {one('acc')}, {one('rej')} FROM n{k} n" + (f" JOIN p{k - 1} p ON p.gram = substr(n.gram, 2))" if k else ")"))
    return rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS row_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(0)} AS ruled, md5(url)[1] IN ('0', '1', '2') AS held,
  repeat(chr(2), {ORDER}) || regexp_replace(url, '[^\x21-\x7E]', chr(127), 'g') || chr(3) AS padded FROM u),
g AS MATERIALIZED (SELECT row_id, ruled IS NULL OR held AS asked, coalesce((ruled = 'allow' AND NOT held)::INT, 0) AS acc, coalesce((ruled = 'block' AND NOT held)::INT, 0) AS rej,
  unnest(list_transform(range(1, length(padded) - {ORDER} + 1), lambda i: substring(padded, i, {ORDER + 1}))) AS gram FROM r),
{", ".join(levels)},
s AS MATERIALIZED (SELECT row_id, sum(round((ln(acc_p) - ln(rej_p)) * {STEPS})::BIGINT)::DOUBLE / {STEPS} / count(*) AS score FROM g JOIN p{ORDER} USING (gram) WHERE asked GROUP BY row_id),
b AS (SELECT greatest(least(round(score * {BINS}), {LAST_BIN}), -{LAST_BIN})::INT AS bin, sum((ruled = 'allow')::INT) AS a, sum((ruled = 'block')::INT) AS j FROM r JOIN s USING (row_id) WHERE held AND ruled IS NOT NULL GROUP BY bin),
e AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS last, (sum(a) OVER w) / nullif(sum(a) OVER (), 0)::DOUBLE - (sum(j) OVER w) / nullif(sum(j) OVER (), 0)::DOUBLE AS error
      FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT (bin + last) / (2.0 * {BINS}) FROM e WHERE last IS NOT NULL AND error IS NOT NULL ORDER BY round(error, 12), last - bin, bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score - least >= 0 THEN 'allow' ELSE 'block' END) AS verdict FROM r LEFT JOIN s USING (row_id), t
"""


SQL = twin()
