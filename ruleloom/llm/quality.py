"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in expressions: no Python runs on executors and nothing is shuffled.
A word is a match of ``[^\\x20\\x09-\\x0D]+``; a symbol one of ``#*$%&|<>``; a line
what ``\\n`` separates.

Defined cases: a null text counts as empty; a text without words fails the base
rule; ratios over nothing are 0; repeated rows stay repeated; other columns of
the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his at from this have are or an they which you were "
    "le la les de des du et un une en est que qui dans pour sur pas plus par au avec ce "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es an "
    "el los las y que en por con no una su para es al lo como se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie between two bounds (both included; None: open)."""

    measure: str
    low: float | None
    high: float | None


#: Ratios a text must keep beside the base rule.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)

_MEASURES = {
    "mean_word_chars": "if(n_words > 0, word_chars / n_words, 0D)",
    "symbol_ratio": "if(n_words > 0, n_symbols / n_words, 0D)",
    "stop_word_ratio": "if(n_words > 0, n_stop_words / n_words, 0D)",
    "dup_line_ratio": "if(n_lines > 0, n_dup_lines / n_lines, 0D)",
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression over the counts: every rule holds."""
    out = F.lit(True)
    for rule in rules:
        x = F.expr(_MEASURES[rule.measure])
        out = out & (x >= rule.low if rule.low is not None else F.lit(True)) & (x <= rule.high if rule.high is not None else F.lit(True))
    return out


def quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """Counts and verdict for every row; with ``carry`` beside the row itself as ``row``.

    ``base_failed``: under 50 words, or over half of the words lie in three-word
    windows found twice or more in the text.
    """
    lower = ", ".join(f"'{w}'" for w in STOP_WORDS)
    keep = [F.struct("*").alias("row")] if carry else []
    base = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"), *keep)
    carried = ["row"] if carry else []
    words = base.select(
        "key", *carried,
        F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x != '')").alias("w"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr(r"cast(length(translate(t, ' \t\n\u000b\u000c\r', '')) as long)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as long)").alias("n_symbols"),
    )
    # Windows of three words as (hash, place), sorted: equal windows are neighbours.
    windows = words.select("*", F.expr("if(size(w) < 3, array(), array_sort(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as p))))").alias("s"))
    counts = windows.select(
        "key", *carried, "word_chars", "n_symbols",
        F.expr("cast(size(w) as long)").alias("n_words"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)), x -> array(x.p, x.p + 1, x.p + 2))))) as long)").alias("n_repeat_words"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr(f"cast(size(filter(w, x -> lower(x) in ({lower}))) as long)").alias("n_stop_words"),
    )
    judged = counts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A filter on the result would be pushed below the projections and repeat each of their expressions
    # inside the others; a number that isn't deterministic holds it above them.
    verdict = ~F.col("base_failed") & compile_rules(rules) & (F.monotonically_increasing_id() >= 0)
    return judged.select(F.col("key").alias(key), *order, verdict.alias("kept"), *carried)


def oracle(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of ``quality``."""
    ws = r"[\x20\x09-\x0D]+"
    verdict = " AND ".join(f"{m} {op} {b}" for r in rules for m, op, b in ((_MEASURES[r.measure].replace("0D", "0.0").replace("if(", "IF("), ">=", r.low), (_MEASURES[r.measure].replace("0D", "0.0").replace("if(", "IF("), "<=", r.high)) if b is not None)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept FROM b"""


def passing(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that all rules accept, with their own columns."""
    return quality(docs, key=key, text=text, rules=rules, carry=True).where("kept").select("row.*")
