"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are long runs of key characters with a digit. Features are of the candidate (length, classes of characters,
how usual its character transitions are, how much of it dictionary words cover), of where it stands (the assignment
before it, its neighbours) and of its document's path (source). The dictionary and the transitions are counted over all
documents. A forest is fitted on labelled findings, of which at most `most_labelled` are used, and scores every
candidate.

Only DataFrame functions and Spark's own forest are used. Features that depend on the string alone are computed once
per distinct string, so a secret copied into a third of all documents is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Of NAME=value, where the value is long enough by itself, the value.
CANDIDATE = r"(?:-*[A-Za-z_][A-Za-z0-9_-]*=(?=[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{15}))?([A-Za-z0-9+/_=-]{16,})"
#: Names that mark an assigned value as a credential (fixed values).
KEY_NAMES = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
ASSIGNED = r"""[=:]["']?$"""
STRING_FEATURES = ("length", "digits", "uppers", "lowers", "others", "distinct", "changes", "transition", "coverage")
PLACE_FEATURES = ("assigned", "quoted", "key_name", "before_length", "after_length", "path_rate")
FEATURES = STRING_FEATURES + PLACE_FEATURES
#: What label_by_assignment looks at, so that a forest taught by it must do without.
LABELLING_FEATURES = ("assigned", "quoted", "key_name", "before_length")


@dataclass(frozen=True)
class Settings:
    most_labelled: int = 20_000
    dictionary_count: int = 20
    trees: int = 20
    depth: int = 5
    threshold: float = 0.5


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, at (index of the word), nth (of the word's long runs), value, lead (of the word, between the run
    before and the value), b2, b1 and a1 (the words before and after). A word gives all its runs with a digit."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", source.alias("source"), F.split(F.coalesce("text", F.lit("")), c.SPACE_RE).alias("w"))
    near = lambda i, j: F.coalesce(F.get("w", i + j), F.lit(""))
    long = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= 16) & x.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    # A long word takes its neighbours with it, so that no later row holds the whole text.
    placed = F.transform(long, lambda i: F.struct(F.get("w", i).alias("x"), i.alias("at"), near(i, -2).alias("b2"), near(i, -1).alias("b1"), near(i, 1).alias("a1")))
    found = rows.select("doc_id", "source", F.explode(placed).alias("s"))
    # The word is cut at its runs: a run's lead is the gap before it and what stands before the value in the run's match.
    all_of = lambda group: F.regexp_extract_all("s.x", F.lit(CANDIDATE), F.lit(group))
    cut = found.select("doc_id", "source", "s.at", "s.b2", "s.b1", "s.a1", F.arrays_zip(all_of(1).alias("value"), all_of(0).alias("whole"), F.split("s.x", CANDIDATE).alias("gap")).alias("runs"))
    out = cut.select("doc_id", "source", "at", "b2", "b1", "a1", F.posexplode("runs").alias("nth", "run"))
    value, whole = F.col("run.value"), F.col("run.whole")
    lead = F.concat(F.coalesce("run.gap", F.lit("")), F.substring(whole, F.lit(1), F.length(whole) - F.length(value)))
    return out.where(value.rlike("[0-9]")).select("doc_id", "source", "at", "nth", value.alias("value"), lead.alias("lead"), "b2", "b1", "a1")


def word_counts(docs: DataFrame) -> DataFrame:
    """Lower-case words of ASCII letters and how often they occur in all documents; partial counts come first."""
    w = F.filter(F.split(c.lower_ascii(F.coalesce("text", F.lit(""))), r"[^a-z]+"), lambda x: F.length(x) >= 2)
    return docs.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def transitions(words: DataFrame) -> DataFrame:
    """pair, p: log of the share that the second of two neighbouring letters has after the first; at most 26 * 26 rows."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = counts.groupBy(F.substring("pair", 1, 1).alias("x")).agg(F.sum("n").alias("total"))
    return counts.join(first, F.substring("pair", 1, 1) == F.col("x")).select("pair", F.log((F.col("n") + 1e0) / (F.col("total") + 26e0)).alias("p"))


def transition_table(words: DataFrame) -> DataFrame:
    """One row: an array of transitions' p by 26 times the first letter's place in the alphabet plus the second's, -9 for
    pairs that don't occur."""
    place = lambda i: F.ascii(F.substring("pair", i, 1)) - 97
    known = transitions(words).select((place(1) * 26 + place(2)).alias("i"), "p")
    every = words.sparkSession.range(26 * 26).select(F.col("id").cast("int").alias("i")).join(known, "i", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("p", F.lit(-9e0)).alias("p")))), lambda x: x["p"]).alias("table"))


def mean_transition(value: Column, table: Column) -> Column:
    """Mean of the table's entries over a string's neighbouring characters, -9 for pairs that aren't two letters."""
    places = F.transform(F.split(F.lower(value), ""), lambda x: F.when((x >= "a") & (x <= "z"), F.ascii(x) - 97))

    def mean(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.coalesce(F.get(table, a * 26 + b), F.lit(-9e0)))
        return F.aggregate(pairs, F.lit(0e0), lambda s, v: s + v) / F.greatest(F.size(x) - 1, F.lit(1))

    return c.let(places, mean)


def classes(value: Column) -> Column:
    """The value with each character replaced by its class: 0, A, a or -."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")


def string_features(values: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """digest and STRING_FEATURES; values: digest, value of distinct strings. The value itself is in one row alone, so a
    very long one is not copied for each of its parts."""
    table = F.lit(transition_table(words).first()["table"])  # 26 * 26 numbers, whatever the input
    known = words.where(F.col("n") >= settings.dictionary_count).select("word")
    parts = values.select("digest", F.array_distinct(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda x: F.length(x) >= 2)).alias("parts"))
    parts = parts.select("digest", F.explode("parts").alias("word"))
    covered = parts.join(known, "word").groupBy("digest").agg(F.sum(F.length("word")).alias("covered"))
    k = classes(F.col("value"))
    n = F.length("value").cast("double")
    share = lambda cls: F.length(F.regexp_replace(k, f"[^{cls}]", "")) / n
    return (
        values.join(covered, "digest", "left")
        .select(
            "digest",
            n.alias("length"),
            share("0").alias("digits"),
            share("A").alias("uppers"),
            share("a").alias("lowers"),
            share("\\-").alias("others"),
            (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
            (F.length(F.regexp_replace(k, r"(.)\1*", "x")) / n).alias("changes"),
            mean_transition(F.col("value"), table).alias("transition"),
            F.least(F.coalesce("covered", F.lit(0)) / n, F.lit(1e0)).alias("coverage"),
        )
    )


def place_features(found: DataFrame, labelled: DataFrame, settings: Settings) -> DataFrame:
    """found with PLACE_FEATURES. path_rate: the smoothed share of positive labels in the document's source."""
    before = F.concat_ws(" ", "b2", "b1", "lead")
    rate = labelled.groupBy("source").agg(((F.sum("label") + 1e0) / (F.count("*") + 2e0)).alias("path_rate"))
    rows = found.withColumns(
        {
            "assigned": (F.col("lead").rlike(ASSIGNED) | ((F.col("lead").isin("", '"', "'")) & F.col("b1").rlike("[=:]$"))).cast("double"),
            "quoted": F.col("lead").rlike("[\"']$").cast("double"),
            "key_name": before.rlike(KEY_NAMES).cast("double"),
            "before_length": F.length("b1").cast("double"),
            "after_length": F.length("a1").cast("double"),
        }
    )
    return rows.join(rate.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("path_rate", F.coalesce("path_rate", F.lit(0.5e0)))


def label_by_assignment(found: DataFrame) -> DataFrame:
    """doc_id, at, nth, label of findings whose place settles them: 1 if assigned to a credential's name, 0 if nothing is
    assigned and no such name is near. The rest has no label."""
    before = F.concat_ws(" ", "b2", "b1", "lead")
    named, assigned = before.rlike(KEY_NAMES), before.rlike(r"""[=:]\s*["']?$""")
    return found.select("doc_id", "at", "nth", F.when(named & assigned, 1e0).when(~named & ~assigned, 0e0).alias("label")).where("label IS NOT NULL")


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, at (word index), value_sha256, score, is_secret: a row per candidate.

    labels: doc_id, at, label (1 or 0) of reviewed findings. Without it, label_by_assignment labels those whose place
    settles them, and the forest learns from the other features only, so that it says of the string, the words after it
    and the path what the place says elsewhere. The most_labelled labels with the least hash are used. With labels of one kind only, or none, there is nothing to
    learn: score is null and every candidate stays. Null and empty texts have no candidates; a null doc_id stays in its
    findings, but gives no labels; long texts are read whole; repeated rows give repeated findings; of the other columns
    only source is read, if there is one; an empty table gives an empty one.
    """
    features = FEATURES if labels is not None else tuple(x for x in FEATURES if x not in LABELLING_FEATURES)
    found = c.materialize(find_candidates(docs))
    labels = labels if labels is not None else label_by_assignment(found)
    # Reviewed labels are of a word, so of each finding in it.
    keys = [x for x in ("doc_id", "at", "nth") if x in labels.columns]
    labels = labels.dropDuplicates(keys)
    known = found.join(labels, keys).select("doc_id", "at", "nth", "value", "source", "label")
    few = c.materialize(known.orderBy(F.xxhash64("value", "doc_id", "at"), "doc_id", "at", "nth").limit(settings.most_labelled))
    digest = F.sha2("value", 256).alias("value_sha256")
    key = F.unhex(F.sha2("value", 256)).alias("digest")
    if few.select("label").distinct().count() < 2:
        return found.select("doc_id", "at", digest, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    words = c.materialize(word_counts(docs).where("n > 1"))
    strings = string_features(found.groupBy(key).agg(F.first("value").alias("value")), words, settings)
    placed = place_features(found.select("*", key).drop("value"), few, settings)
    rows = c.materialize(placed.join(strings, "digest").select("doc_id", "at", "nth", "digest", *features))
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    # Bounded by most_labelled; one sorted partition, so that the fit doesn't depend on how rows were dealt.
    train = ready.join(few.select("doc_id", "at", "nth", key, "label").distinct(), ["doc_id", "at", "nth", "digest"]).select("features", "label", "doc_id", "at", "nth")
    train = train.coalesce(1).sortWithinPartitions("doc_id", "at", "nth")
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=7, featureSubsetStrategy="sqrt").fit(train)
    score = F.round(vector_to_array("probability")[1], 6)
    out = forest.transform(ready).withColumn("score", score)
    return out.select("doc_id", F.col("at").cast("long").alias("at"), F.lower(F.hex("digest")).alias("value_sha256"), "score", (F.col("score") >= settings.threshold).alias("is_secret"))
