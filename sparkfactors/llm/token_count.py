"""Token counts of documents in flat token files, by a scan for separators.

A flat file is ids of fixed width, documents one after the other, each ended by an end-of-document id, with no index.
It is read as fixed-size blocks, cut anywhere. In each block a vectorised search finds the separators; the lengths of
documents inside it are differences of neighbours. Documents that go over block ends are stitched by a prefix scan over
one small row per block: how many separators came before, and where the last one was. The scan has two levels, runs of
blocks and then blocks in a run, so one huge file does not become one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .tokens import shared_tokenizer

BLOCKS = "file string, block long, n long, ids binary"
#: Blocks in a run of the prefix scan's lower level.
RUN = 4096


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = 1 << 18) -> DataFrame:
    """Blocks of the flat files below path: file, block, n, ids. For files of less than 2 GB each; split larger ones."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                step = width * block_ids
                parts = [raw[i : i + step] for i in range(0, len(raw) - len(raw) % width, step)]
                yield pd.DataFrame({"file": name, "block": range(len(parts)), "n": [len(p) // width for p in parts], "ids": parts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, BLOCKS)


def write_tokens(docs: DataFrame, tokenizer_path: str, eod: int, block_ids: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Tokenise docs into flat token streams of 16-bit ids, one per partition, kept as blocks in the shared folder.

    Returns the blocks (file, block, n, ids) and the order of documents (file, ordinal, doc_id). The strings of special
    tokens in a text are plain text here, so eod stands only where a document ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = shared_tokenizer(tokenizer_path, specials=False)
        file, wait, n, block, ordinal = f"part-{TaskContext.get().partitionId():05d}", [], 0, 0, 0

        def blocks(last: bool) -> Iterator[dict]:
            nonlocal wait, n, block
            if n >= block_ids or (last and n):
                ids = np.concatenate(wait)
                stop = n if last else n - n % block_ids
                for a in range(0, stop, block_ids):
                    part = ids[a : min(a + block_ids, stop)]
                    yield {"kind": "ids", "file": file, "block": block, "n": len(part), "ids": part.tobytes(), "docs": None}
                    block += 1
                wait, n = [ids[stop:].copy()], n - stop

        for batch in batches:
            out = [{"kind": "docs", "file": file, "block": ordinal, "n": len(batch), "ids": None, "docs": [None if no else d for d, no in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), strict=True)]}]
            ordinal += len(batch)
            for ids, _ in tokenizer.encode_many(batch["text"]):
                wait.append(np.append(ids, np.uint16(eod)))
                n += len(wait[-1])
                out += blocks(False)
            yield pd.DataFrame(out)
        if n:
            yield pd.DataFrame(list(blocks(True)))

    both = c.materialize(docs.select(*c.id_columns(), "text").mapInPandas(run, "kind string, file string, block long, n long, ids binary, docs array<long>"), "kind")
    order = both.where("kind = 'docs'").select("file", F.col("block").alias("first"), F.posexplode("docs").alias("i", "doc_id"))
    return both.where("kind = 'ids'").select("file", "block", "n", "ids"), order.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def count_tokens(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal (of the document in its file, from 0), n_tokens (without its separator), complete.

    What follows a file's last separator is a document with complete = false, if it has ids; two separators in a row
    end an empty document. Blocks of a file may come in any order and have any length; an empty table gives an empty one.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch["ids"]:
                at = np.flatnonzero(np.frombuffer(raw, dtype) == eod)
                rows.append((len(at), at[0] if len(at) else -1, at[-1] if len(at) else -1, (np.diff(at) - 1).tolist()))
            found = pd.DataFrame(rows, columns=["n_eod", "head", "last", "inside"])
            yield pd.concat([batch[["file", "block", "n"]].reset_index(drop=True), found], axis=1)

    # The lengths inside are kept, as the scan over blocks is used three times.
    found = c.materialize(blocks.mapInPandas(search, "file string, block long, n long, n_eod long, head long, last long, inside array<long>"))
    small = found.drop("inside").withColumn("run", F.floor(F.col("block") / RUN))

    def before(over) -> dict:
        rows = over.rowsBetween(Window.unboundedPreceding, -1)
        return {
            "ids_before": F.coalesce(F.sum("n").over(rows), F.lit(0)),
            "eods_before": F.coalesce(F.sum("n_eod").over(rows), F.lit(0)),
        }

    runs = small.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("n_eod").alias("n_eod"))
    runs = runs.withColumns(before(Window.partitionBy("file").orderBy("run"))).select("file", "run", F.col("ids_before").alias("ids0"), F.col("eods_before").alias("eods0"))
    placed = small.withColumns(before(Window.partitionBy("file", "run").orderBy("block"))).join(runs, ["file", "run"])
    placed = placed.select("file", "run", "block", "n", "n_eod", "head", "last", (F.col("ids_before") + F.col("ids0")).alias("at"), (F.col("eods_before") + F.col("eods0")).alias("ordinal"))
    # Where the open document began: after the last separator of any block before, which a running maximum finds.
    ends = placed.withColumn("end", F.when(F.col("last") >= 0, F.col("at") + F.col("last") + 1))
    in_run = F.max("end").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    per_run = ends.groupBy("file", "run").agg(F.max("end").alias("end"))
    per_run = per_run.select("file", "run", F.max("end").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("end0"))
    opened = ends.withColumn("open", in_run).join(per_run, ["file", "run"]).withColumn("open", F.coalesce("open", "end0", F.lit(0)))
    crossing = opened.where("head >= 0").select("file", "ordinal", (F.col("at") + F.col("head") - F.col("open")).alias("n_tokens"), F.lit(True).alias("complete"))
    inside = found.select("file", "block", "inside").where(F.size("inside") > 0).join(placed.select("file", "block", "ordinal"), ["file", "block"])
    inside = inside.select("file", (F.col("ordinal") + 1).alias("first"), F.posexplode("inside").alias("i", "n_tokens"))
    inside = inside.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    whole = ends.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_eod").alias("ordinal"), F.coalesce(F.max("end"), F.lit(0)).alias("end"))
    rest = whole.where("n > end").select("file", "ordinal", (F.col("n") - F.col("end")).alias("n_tokens"), F.lit(False).alias("complete"))
    return crossing.unionByName(inside).unionByName(rest)


def count_documents(docs: DataFrame, tokenizer_path: str, eod: int) -> DataFrame:
    """doc_id and n_tokens of every row: written as flat token streams, then counted by their separators.

    Null and empty texts have no tokens; repeated rows and null ids keep rows of their own; a long text goes over as many
    blocks as it fills; an empty table gives an empty one. Only doc_id and text are read.
    """
    blocks, order = write_tokens(docs, tokenizer_path, eod)
    return order.join(count_tokens(blocks, eod), ["file", "ordinal"]).select("doc_id", "n_tokens")
