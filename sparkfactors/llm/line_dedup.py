"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches, the newest (largest doc_id) first. A batch is reduced to one row per line key (128-bit hash)
with the number of documents and the keeper, the largest doc_id that holds the line. A merge anti-join against the runs
so far takes the keeper from keys that a run holds already: newer documents hold those lines. The batch is then added
as a run of its own in level 0. When a level has `fan_out` runs they are merged into one run of the next level. Merged,
the runs say which lines are frequent and who keeps them.

Runs are bucketed and sorted by hash in the shared scratch folder, so a lost executor costs a re-read, and joins and
merges of runs need no shuffle: a batch is shuffled once, however many runs there are. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return c.lower_ascii(F.btrim(line, F.lit(c.SPACES)))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, k (tells rows of one doc_id apart) and lines: the array of (h1, h2, i) of lines with long enough keys."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("i")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(
        long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["i"].alias("i"))
    )
    return docs.select("doc_id", c.text_key(F.col("text")).alias("k"), hashed.alias("lines"))


class LineRuns:
    """The levelled runs. Each has one row per key: h1, h2, n_docs and keeper, which only the first run with the key has."""

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _sorted(self, run: DataFrame) -> DataFrame:
        table, name = c.bucketed(run, *KEY)
        self.tables.append(name)
        return table

    def add(self, batch: DataFrame) -> None:
        """Add a batch's keys (h1, h2, n_docs, keeper, one row a key) as a run and compact full levels."""
        for run in self.runs():
            batch = batch.join(run.select(*KEY, F.lit(True).alias("held")), list(KEY), "left")
            batch = batch.select(*KEY, "n_docs", F.when(F.col("held").isNull(), F.col("keeper")).alias("keeper"))
        self._push(0, self._sorted(batch))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._sorted(merged(full)))

    def drop(self) -> None:
        """Forget the runs; their files go with the scratch folder."""
        c.drop_tables(self.spark, *self.tables)
        self.levels, self.tables = [], []


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of many, two at a time, as a merge of sorted rows; a key's keeper is in one of them at most."""
    out = runs[0]
    for run in runs[1:]:
        both = out.join(run.select(*KEY, F.col("n_docs").alias("n"), F.col("keeper").alias("other")), list(KEY), "full_outer")
        out = both.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.coalesce("keeper", "other").alias("keeper"))
    return out


def in_batches(docs: DataFrame, min_chars: int, n_batches: int) -> DataFrame:
    """keyed_lines of the documents that have any, with batch: 0 for the largest doc_ids. Batches are ranges of doc_id of
    about equal size; a null doc_id is in the last."""
    at = [i / n_batches for i in range(n_batches - 1, 0, -1)]
    edges = docs.agg(F.percentile_approx("doc_id", at, 1000)).first()[0] if at else None
    batch = sum((F.when(F.col("doc_id") > e, 0).otherwise(1) for e in edges or []), F.lit(0))
    return c.materialize(keyed_lines(docs, min_chars).where(F.size("lines") > 0).withColumn("batch", batch), "batch")


def index_lines(staged: DataFrame, n_batches: int, fan_out: int = 2) -> LineRuns:
    """Runs over all documents of in_batches."""
    runs = LineRuns(staged.sparkSession, fan_out)
    for b in range(n_batches):
        lines = F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
        keys = staged.where(F.col("batch") == b).select("doc_id", F.explode(lines).alias("x"))
        # Once per document and key, so that n_docs counts documents; partial sums precede the shuffle.
        runs.add(keys.groupBy("x.h1", "x.h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
    return runs


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fan_out: int = 2) -> DataFrame:
    """A row per document: row (a struct of all its columns), n_lines, n_dropped and kept_text.

    A line whose key has at least min_chars code points and occurs in at least min_docs documents goes from every
    document but the one with the largest doc_id that holds it. Null or empty text: one empty line, kept. Each row is a
    document; rows that share the largest doc_id of a key all keep its lines; a null doc_id counts as a document and is
    smaller than any other. Lines and texts may have any length; an empty table gives an empty one. Extra columns,
    whatever their names, stay inside row.
    """
    staged = in_batches(docs, min_chars, n_batches)
    runs = index_lines(staged, n_batches, fan_out)
    # Written, so that the join below reads both sides by exchanges of its own and a very common line's can be split.
    often = c.materialize(merged(runs.runs()).where(F.col("n_docs") >= min_docs).select(*KEY, "keeper"))
    runs.drop()
    lines = staged.select("doc_id", "k", F.explode("lines").alias("x")).select("doc_id", "k", "x.*")
    hits = lines.join(often, list(KEY)).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hits.groupBy("doc_id", "k").agg(F.collect_set("i").alias("drop"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), c.text_key(F.col("text")).alias("k0"), F.coalesce("text", F.lit("")).alias("t"))
    out = row.join(drops, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k0") == F.col("k")), "left")
    kept = c.let(
        F.split("t", "\n"),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop")), lambda i: F.get(x, i)), "\n"
        ),
    )
    return out.select(
        "row",
        F.size(F.split("t", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )
