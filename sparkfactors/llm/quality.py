"""Quality rules as a short-circuit cascade.

On a sample each rule's work is counted, and its rate of rejection, among the documents that the rules before it leave;
rules are ordered by rejection per cost, and each document is tested only until one rule rejects it. The order
never changes which documents stay, only the work and the rule that is named first.

Only DataFrame functions are used; there is no shuffle, as every feature is computed within its row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SYMBOLS = "#*$%&|<>"


def n_repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs at least twice in the row.

    Windows are sorted by hash, so that equal ones are neighbours; the starts of those, sorted again, give the covered
    words as a sum of gaps of at most three. n log n for any text.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(
            starts,
            F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
            lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def repeated(grams: Column) -> Column:
        tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = c.let(
            tagged,
            lambda t: F.transform(
                F.filter(t, lambda x, i: (F.get(t, i - 1)["h"] == x["h"]) | (F.get(t, i + 1)["h"] == x["h"])), lambda x: x["i"]
            ),
        )
        return c.let(F.sort_array(starts), covered)

    def grams_of(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))

    return c.let(
        c.let(words, grams_of),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(repeated(g)),
    )


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the same text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, c.SPACES, "")) > 0)
    return c.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, c.SPACES, "")).cast("long")


def n_upper(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, c.UPPER, ""))).cast("long")


@dataclass(frozen=True)
class Rule:
    """reject is made of text (never null) and words. cost is the work on a document, in characters looked at; work is
    the same as an expression of the document. Rules that give neither are timed on the sample."""

    name: str
    reject: Callable[[Column, Column], Column]
    cost: float | None = None
    work: Callable[[Column, Column], Column] | None = None


#: Characters that could be looked at while one value is hashed or compared.
HASH = 8


def default_rules() -> list[Rule]:
    """Limits are on whole counts, so that they don't depend on rounding. Work: passes over the characters, and the lines
    or windows that are hashed and sorted."""
    chars, words = lambda t, w: F.length(t), lambda t, w: F.size(w)
    return [
        Rule("few_words", lambda t, w: F.size(w) < 50, work=lambda t, w: F.lit(1)),
        Rule("word_length", lambda t, w: ~word_chars(t).between(2 * F.size(w), 20 * F.size(w)), work=chars),
        Rule("symbols", lambda t, w: 100 * n_symbols(t) > 10 * F.size(w), work=chars),
        Rule("capitals", lambda t, w: 100 * n_upper(t) > 50 * word_chars(t), work=lambda t, w: 2 * chars(t, w)),
        Rule("dup_lines", lambda t, w: 100 * n_dup_lines(t) > 50 * n_lines(t), work=lambda t, w: 3 * chars(t, w) + HASH * n_lines(t)),
        Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 50 * F.size(w), work=lambda t, w: HASH * words(t, w) * (2 + F.log2(words(t, w) + 2))),
    ]


def with_words(docs: DataFrame) -> DataFrame:
    """Text that is never null, and its words."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", c.words_of(F.col("text")))


def timed(sample: DataFrame, rules: list[Rule]) -> list[float]:
    """Seconds that each rule takes over the sample (text, words), which is read anew each time, less those of reading."""

    def seconds(value: Column) -> float:
        took = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            sample.agg(F.sum(value.cast("int"))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.size("words") > F.length("text"))
    return [max(seconds(r.reject(F.col("text"), F.col("words"))) - idle, 1e-3) for r in rules]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejection per cost, greedily: each next one by what it rejects of the sample's rows that are left, over
    its work on them.

    The sample is the rows whose hash of id and text falls in the share of its range that about sample_rows of all rows
    meet, so no rows are gathered to be counted off. It settles the order of work alone, and the same documents give the
    same order. Counts and work of each combination of verdicts come from one pass, and only they reach the driver. Ties
    go to the cheaper rule, then to the order given. Where the sample is empty, the order stays.
    """
    text = F.coalesce("text", F.lit(""))
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = docs.select("doc_id", text.alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) < int(share * 2**31))
    given = all(r.cost is not None or r.work is not None for r in rules)
    sample = with_words(picked) if given else c.materialize(with_words(picked))
    t, w = F.col("text"), F.col("words")
    hits = [F.coalesce(r.reject(t, w), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    work = [(r.work(t, w).cast("double") if r.cost is None and r.work else F.lit(float(r.cost or 0))).alias(f"w{i}") for i, r in enumerate(rules)]
    names = [f"r{i}" for i in range(len(rules))]
    rows = sample.select(*hits, *work).groupBy(*names).agg(F.count("*").alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(rules)))).collect()
    if not rows:
        return rules
    left = [(tuple(row[x] for x in names), row["n"], [row[f"w{i}"] for i in range(len(rules))]) for row in rows]
    if not given:
        seconds, total = timed(sample, rules), sum(n for _, n, _ in left)
        left = [(v, n, [s * n / total for s in seconds]) for v, n, _ in left]
    order, todo = [], list(range(len(rules)))
    while todo:
        cost = {i: max(sum(x[i] for _, _, x in left), 1e-9) for i in todo}
        best = max(todo, key=lambda i: (sum(n for v, n, _ in left if v[i]) / cost[i], -cost[i], -i))
        order.append(rules[best])
        todo.remove(best)
        left = [x for x in left if not x[0][best]]
    return order


def cascade(verdicts: list[tuple[str, Column]]) -> Column:
    """The name of the first of verdicts (name, reject) that rejects the row; null if none does. Lazy, as CASE is."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, reject in verdicts:
        out = out.when(reject, F.lit(name))
    return out


def failed_rule(text: Column, order: list[Rule]) -> Column:
    """The cascade over a text that is never null. Words are split once a row, within the expression, as a column of
    them would be copied into each rule by the optimiser."""
    return c.let(c.words_of(text), lambda w: cascade([(r.name, r.reject(text, w)) for r in order]))


def filter_quality(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with their columns as they were.

    Null and empty texts have no words and are rejected by few_words; a null doc_id is no ground to go; long texts are
    judged whole; repeated rows are judged alike; an empty table gives an empty one. Columns other than text pass
    through, whatever their names.
    """
    order = order_rules(docs, rules or default_rules())
    return docs.where(failed_rule(F.coalesce("text", F.lit("")), order).isNull())


def quality_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row per document: its counts, base_failed, kept and the first rule of the cascade that rejects it.

    Nulls, empty and repeated rows: as filter_quality; a null doc_id stays a row of its own.
    """
    order = order_rules(docs, rules or default_rules())
    text, words = F.col("text"), F.col("words")
    rows = with_words(docs.select("doc_id", "text")).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(words),
            "n_lines": n_lines(text),
            "n_upper": n_upper(text),
        }
    )
    # The counts are wanted for every row here, so the rules read the columns instead of counting again.
    n, counted = F.col("n_words"), {
        "few_words": F.col("n_words") < 50,
        "word_length": ~F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("n_words"),
        "capitals": 100 * F.col("n_upper") > 50 * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    }
    rows = rows.withColumn("failed_rule", cascade([(r.name, counted[r.name] if r.name in counted else r.reject(text, words)) for r in order]))
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("failed_rule").isNull()).alias("kept"),
        "failed_rule",
    )
