"""Principal components of very many features: a randomised range finder over sparse values."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .linalg import sum_vector


class Components(NamedTuple):
    """scores (id, h) and directions (gene_id, w; genes without a value have none, their entries are 0), leading first;
    singular: the singular values of the centred matrix; rounds: passes of iteration; moved: the last relative change."""

    scores: DataFrame
    directions: DataFrame
    singular: np.ndarray
    rounds: int
    moved: float


def _rows(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gram_blocks(rows: DataFrame, name: str, width: int) -> np.ndarray:
    """width x width products of an array column: each task multiplies its blocks, entries are summed by a shuffle, so
    only the result's numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _rows(b.column(0), width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    out = np.zeros((width, width))
    for r in rows.select(name).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def times_matrix(rows: DataFrame, key: str, name: str, m: np.ndarray) -> DataFrame:
    """key and name: each row's array times m, a block of rows at a time."""
    width, out = m.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(1), width) @ m
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * out, pa.array(x.ravel()))], names=[key, name])

    return rows.select(key, name).mapInArrow(run, f"{key} long, {name} array<double>")


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Columns that make rows with this Gram matrix orthonormal; directions without length go."""
    size, turn = np.linalg.eigh(gram)
    keep = size > 1e-13 * max(size.max(initial=0.0), 1e-300)
    return turn[:, keep] / np.sqrt(size[keep])


def wide_pca(
    expr: DataFrame, spots: DataFrame, components: int, *, oversample: int = 10, most: int = 40, tol: float = 1e-13, seed: int = 0, broadcast_below: int = 2_000_000
) -> Components:
    """Leading components of the centred spots x genes matrix of sparse values (spot_id, gene_id, value; zeros left out).

    Random combinations of the genes, components + oversample of them, give columns whose span holds the leading scores;
    passes over the values, forth to the genes and back to the spots, turn it towards them until the leading singular
    values change by less than tol of themselves (or `most` passes: moved tells). Centring is a correction by the genes'
    means, so zeros are never filled in, and no matrix has more than (components + oversample) squared numbers on the
    driver; rows of so many numbers per spot and per gene are tables. A direction's largest entry by size is positive.
    """
    if components <= 0 or oversample < 0:
        raise ValueError("components must be positive and oversample not negative")
    spark = spots.sparkSession
    spots = cut(spots.select("spot_id"))
    n = spots.count()
    x = cut(expr.where("value <> 0").select("spot_id", "gene_id", F.col("value").cast("double").alias("value")))
    means = cut(x.groupBy("gene_id").agg((F.sum("value") / max(1, n)).alias("mean")))
    genes = means.count()
    width = min(components + oversample, n, genes)
    if not width:
        none = F.array().cast("array<double>")
        return Components(spots.select(F.col("spot_id").alias("id"), none.alias("h")), means.select("gene_id", none.alias("w")), np.zeros(0), 0, 0.0)
    small = lambda df, rows, k: F.broadcast(df) if rows * k <= broadcast_below else df

    def to_spots(w: DataFrame, k: int) -> DataFrame:
        """spot_id, h: centred values times w, for every spot."""
        shift = np.array(w.join(means, "gene_id").agg(*sum_vector("w", k, F.col("mean"))).first(), float)
        part = x.join(small(w, genes, k), "gene_id").select("spot_id", *((F.get("w", i) * F.col("value")).alias(f"x{i}") for i in range(k)))
        every = part.unionByName(spots.select("spot_id", *(F.lit(0e0).alias(f"x{i}") for i in range(k))))
        return cut(every.groupBy("spot_id").agg(F.array(*(F.sum(f"x{i}") - float(shift[i]) for i in range(k))).alias("h")))

    def to_genes(h: DataFrame, k: int) -> DataFrame:
        """gene_id, w: centred values, turned over, times h."""
        total = np.array(h.agg(*sum_vector("h", k)).first(), float)
        part = x.join(small(h, n, k), "spot_id").groupBy("gene_id").agg(*sum_vector("h", k, F.col("value")))
        return cut(part.join(means, "gene_id").select("gene_id", F.array(*(F.col(f"x{i}") - F.col("mean") * float(total[i]) for i in range(k))).alias("w")))

    def flat(rounds: int) -> Components:
        zeros = F.array_repeat(F.lit(0e0), lead)
        return Components(spots.select(F.col("spot_id").alias("id"), zeros.alias("h")), means.select("gene_id", zeros.alias("w")), np.zeros(lead), rounds, 0.0)

    scale = (x.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0) ** 0.5
    lead = min(components, width)
    u = lambda i, part: (F.pmod(F.xxhash64(F.lit(seed), F.lit(part), F.lit(i), "gene_id"), F.lit(2**52)) + 1).cast("double") / float(2**52 + 1)
    start = [F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * F.pi() * u(i, 1)) for i in range(width)]
    w, k, before, moved = means.select("gene_id", F.array(*start).alias("w")), width, None, float("inf")
    for rounds in range(1, most + 1):
        y = to_spots(w, k)
        # Twice, as a Gram matrix keeps half the digits.
        for _ in range(2):
            m = _whitening(gram_blocks(y, "h", k))
            k = m.shape[1]
            if not k:
                break
            y = cut(times_matrix(y, "spot_id", "h", m))
        if not k:
            return flat(rounds)
        z = to_genes(y, k)
        gram = gram_blocks(z, "w", k)
        size, turn = np.linalg.eigh(gram)
        size, turn = np.sqrt(np.maximum(size[::-1], 0.0)), turn[:, ::-1]
        now = size[: min(lead, k)]
        if now[0] <= 1e-9 * scale:
            # What rounding leaves of a matrix without spread is no direction.
            return flat(rounds)
        if before is not None and len(before) == len(now):
            moved = float(np.max(np.abs(now - before) / max(now[0], 1e-300)))
        if moved <= tol or k == min(n, genes):
            break
        before = now
        m = _whitening(gram)
        w, k = times_matrix(z, "gene_id", "w", m), m.shape[1]
    keep = [i for i in range(len(now)) if size[i] > 1e-7 * size[0]]
    directions = cut(times_matrix(z, "gene_id", "w", turn[:, keep] / size[keep]))
    biggest = directions.agg(*(F.max_by(F.get("w", i), F.struct(F.round(F.abs(F.get("w", i)), 9), -F.col("gene_id"))) for i in range(len(keep)))).first()
    sign = np.array([-1.0 if v is not None and v < 0 else 1.0 for v in biggest])
    scores = times_matrix(y, "spot_id", "h", turn[:, keep] * size[keep] * sign).withColumnRenamed("spot_id", "id")
    return Components(cut(scores), cut(times_matrix(directions, "gene_id", "w", np.diag(sign))), size[keep], rounds, moved)
