"""How filters interact: what each removes, alone and after others, in every order of them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

LETTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(LETTERS)}
#: A text held by more than one in so many rows is hot; there are at most as many of those, so they are broadcast.
HOT_SHARE = 1000


def failures(text: Column) -> Column:
    """Bits of A (under 200 words), B (under half of the words distinct), C (over 3 % capitals A-Z) and D (a mark of
    #$%&*|) of a text that isn't null."""
    # White space at an end, and runs of it, make empty pieces, which are no words.
    words = F.array_remove(F.split(F.translate(text, c.SPACES, " " * len(c.SPACES)), " "), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def bits(w: Column) -> Column:
        n = F.size(w)
        fails = {"A": n < 200, "B": 100 * F.size(F.array_distinct(w)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}
        return sum((F.when(v, BIT[k]).otherwise(0) for k, v in fails.items()), F.lit(0))

    return c.let(words, bits)


def repeats(rows: DataFrame, hashes: DataFrame, salts: int = 64) -> DataFrame:
    """Of rows (doc_id, h, t, ...) those whose text t some row with a smaller doc_id has: a left semi join of the rows
    with themselves on hash, exact text and smaller id. hashes: the column h of the same rows. Null ids are neither
    smaller nor larger.

    One row per text, with its least id, stands for all on the right; it is found with partial minima. Most rows whose
    hash no other row has are left out before their texts are shuffled. A hot text's rows are dealt over `salts` keys, to
    each of which its right row is copied.
    """
    often = c.materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(often.where(F.col("n") * HOT_SHARE > hashes.count()).select("h", F.lit(True).alias("hot")))
    may_repeat = c.membership(often, "h")
    near = rows.where(may_repeat(F.col("h"))).join(hot, "h", "left")
    left = near.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int"))
    right = near.where("doc_id IS NOT NULL").groupBy("h", "t").agg(F.min("doc_id").alias("least"), F.first("hot").alias("hot"))
    copies = F.sequence(F.lit(0), F.when(F.col("hot"), salts - 1).otherwise(0))
    right = right.select("h", "t", "least", F.explode(copies).alias("salt"))
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("h", "salt", "t")] + [F.col("b.least") < F.col("a.doc_id")]
    return a.join(b, on, "left_semi").drop("salt", "hot")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, n_good, n_toxic: documents of each part by the set of filters they fail, and how many of them are
    labelled good and toxic; at most 32 rows a part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), F.xxhash64(text).alias("h"))
    base = c.materialize(rows.select("doc_id", "part", "h", failures(F.col("t")).alias("bits")))
    again = repeats(rows, base.select("h"))
    # The ids that fail E beside those of the other filters; rows that share id and text count once each.
    fails = base.withColumn("n", F.lit(1)).unionByName(again.select("doc_id", "part", "h", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n")))
    per = fails.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Null ids, which have no label, are spread by their hash.
    per = per.withColumns({"k": F.coalesce("doc_id", "h"), "no_id": F.col("doc_id").isNull()})
    known = known.select(F.col("doc_id").cast("long").alias("k"), F.lit(False).alias("no_id"), "good", "toxic")
    of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(f"n_{flag}")
    return per.join(known, ["k", "no_id"], "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(combos: DataFrame) -> DataFrame:
    """The report of audit_filters from the rows of combinations."""
    orders = F.explode(F.lit(["".join(p) for p in permutations(LETTERS)]))
    every = combos.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    in_mask = lambda letters: sum((F.when(F.contains(letters, F.lit(k)), b).otherwise(0) for k, b in BIT.items()), F.lit(0))
    letter, earlier = F.expr("substring(filter_order, step, 1)"), F.expr("substring(filter_order, 1, step - 1)")
    every = every.withColumns({"own": in_mask(letter), "before": in_mask(earlier)})
    bits, n = F.col("bits"), F.col("n")
    fails, gone = bits.bitwiseAND(F.col("own")) != 0, bits.bitwiseAND(F.col("before")) != 0
    # In 1 of so many orders as a document fails filters, each of these is the one that removes it.
    share = n * (F.lit(len(list(permutations(LETTERS)))) / F.greatest(F.bit_count("bits"), F.lit(1))).cast("long")
    total = lambda when, what, name: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long").alias(name)
    return every.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(~fails & ~gone, n, "kept"), total(fails & ~gone, n, "removed"), total(fails & gone, n, "redundant"), total(bits == F.col("own"), n, "unique_fails"),
        total(fails & ~gone, F.col("n_good"), "good_lost"), total(fails & ~gone, F.col("n_toxic"), "toxic_lost"), total(fails, share, "shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each lang
    (null: empty string), each of the 120 orders of the filters A to E and each step, what the step's filter does.

    Only the table of combinations, 32 rows a part, is expanded by the orders. A null or empty text has no words: it fails
    A, and E if a smaller id has one too. Texts are judged whole, however long. Rows alike in doc_id, lang and text each
    count; of rows that share a doc_id each takes its labels (good or toxic if any label row says so). A null doc_id has
    no label, can't fail E and makes no other row fail it. An empty table has no parts and no rows. Only doc_id, lang and
    text of docs, and doc_id, quality and toxic of labels, are read, so extra columns and their names don't matter.
    """
    return interactions(combinations(docs, labels))
