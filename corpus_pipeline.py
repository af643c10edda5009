"""The training-corpus pipeline: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfactors.llm import common as c
from sparkfactors.llm.decontaminate import decontaminate
from sparkfactors.llm.line_dedup import dedup_lines
from sparkfactors.llm.near_dedup import dedup_near
from sparkfactors.llm.packing import pack
from sparkfactors.llm.quality import filter_quality
from sparkfactors.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts go (they have too few words); a null doc_id is no ground to go; very long texts are judged whole;
    repeated rows are judged alike; an empty table stays empty. All columns stay, whatever their names.
    """
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat; n_chars is that of the new text.

    No row goes, only lines: a null text stays null, an empty one empty, one whose lines all go becomes empty; texts of any
    length are cut whole. Of the documents that share a line the one with the largest doc_id keeps it (a null id is the
    smallest; rows that repeat that id all keep it). An empty table stays empty; other columns stay, whatever their names.
    """
    out = dedup_lines(docs)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))}
    new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(x, F.col(f"row.`{x}`")).alias(x) for x in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Null and empty texts have no copies and stay, as do all rows with a null doc_id; very long texts count with all their
    shingles; of rows that repeat doc_id and text one stays. An empty table stays empty; other columns stay, whatever
    their names.
    """
    return dedup_near(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items; n_chars is that of the new text.

    No row goes: a null or empty text stays as it is (n_chars of null is null), and repeated rows are cut alike; items without words, null ones
    among them, cut nothing, and an item that is there twice cuts what it cuts once. Without items nothing changes, and an
    empty table stays empty. Other columns stay, whatever their names.
    """
    out = decontaminate(docs, c.table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null or empty text is a document of one token, the closing one; long texts are cut into pieces; each of repeated
    rows has its own pieces, a null doc_id stays null. An empty table gives no pieces; other columns aren't returned.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("packing", packing),
]

#: Packing tokenises with a public vocabulary, which SQL can't; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written and read back before the next."""
    docs = c.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
