"""Pieces that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch

#: The ASCII white space that separates words: U+0020 and U+0009 to U+000D (fixed values of the contract).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[ \t\n\x0B\f\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lost executors then cost no recomputation. The folder
    goes when the application ends."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """df as a table in the shared scratch folder, bucketed and sorted by keys, so that joins and merges on them need no
    shuffle of it; and the table's name, for drop_tables once nothing more is read from it."""
    spark, name = df.sparkSession, f"scratch_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name), name


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Forget tables of bucketed(); their files stay in the scratch folder."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def membership(keys: DataFrame, *names: str, bits: int = 24):
    """A test of columns that holds for every row of keys and seldom for others, so that a large table is thinned before
    it is shuffled to be joined with keys. It is 2 ** bits bits (2 MB), whatever the number of keys: with very many of
    them it lets all rows pass, which changes nothing but the work."""
    place = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(2**bits))
    at = place(*names)
    words = keys.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("w"))
    words = words.groupBy("i").agg(F.bit_or("w").alias("w"))
    every = keys.sparkSession.range(2 ** (bits - 6)).withColumnRenamed("id", "i").join(words, "i", "left").select("i", F.coalesce("w", F.lit(0)).alias("w"))
    table = materialize(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")))

    def may_hold(*cols: Column) -> Column:
        x = place(*cols)
        word = F.get(table.scalar(), F.shiftright(x, 6).cast("int"))
        return F.getbit(word, x.bitwiseAND(63).cast("int")) == 1

    return may_hold


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """With doc_id, tells rows apart that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def id_columns() -> list[Column]:
    """doc_id without nulls, and no_id where it was null: pandas would turn long ids beside a null into floats."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]


def with_id(df: DataFrame) -> DataFrame:
    """df with its doc_id null again where no_id says so."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when it holds `most`, so that its memory is bounded."""

    def __init__(self, most: int = 100_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(a: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash of each k consecutive items; empty if there are fewer."""
    n = len(a) - k + 1
    if n <= 0:
        return a[:0]
    base, out = np.uint64(0x9E3779B97F4A7C15 | 1), a[:n].copy()
    for j in range(1, k):
        out *= base
        out += a[j : j + n]
    return mix(out)
