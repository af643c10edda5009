"""Sections of one table as one dataset: ids, values and a graph per section in single jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.lattice import spatial_graph
from ..operators.ranks import ranked


class Stack(NamedTuple):
    """spots (spot_id, section_id, section, local_id, x, y and the rest), expr (spot_id, gene_id, value), edges (src,
    dst), sections (section_id, section, n, used_raw)."""

    spots: DataFrame
    expr: DataFrame
    edges: DataFrame
    sections: DataFrame


def stack_tables(
    spots: DataFrame, expr: DataFrame, raw: DataFrame | None = None, *, n_neighs: int = 6, coord_type: str = "grid", pitch: float | None = None, use_raw: bool = True
) -> Stack:
    """Sections of spots (section, local_id, x, y, ...) and values (section, local_id, gene_id, value), stacked.

    spot_id counts all spots in order of section and local_id, so a section's ids follow those before; section_id is the
    section's place. A section that has rows in raw takes its values from there if use_raw, others from expr. The graph
    of all sections is made in one job and joins no two of them. Values of unknown spots are an error.
    """
    placed = cut(ranked(spots, ("local_id",), ("section",), name="__r", size="__n", group="section_id", overall="spot_id"))
    rest = [c for c in spots.columns if c not in ("section", "local_id", "spot_id", "section_id")]
    out = placed.select("spot_id", "section_id", "section", "local_id", *rest)
    n_rows, n_ids = placed.agg(F.count("*"), F.count_distinct("section", "local_id")).first()
    if n_rows != n_ids:
        raise ValueError(f"{n_rows - n_ids} spots repeat another's section and local_id")
    values = expr.select("section", "local_id", "gene_id", F.col("value").cast("double").alias("value"))
    with_raw = (raw if raw is not None and use_raw else expr.limit(0)).select("section").distinct()
    if raw is not None and use_raw:
        # Sections are few; the join is by what they are, not by a broadcast that could grow.
        values = values.join(with_raw, "section", "left_anti").unionByName(raw.select("section", "local_id", "gene_id", F.col("value").cast("double").alias("value")))
    ids = placed.select("section", "local_id", "spot_id")
    stray = values.join(ids, ["section", "local_id"], "left_anti").limit(1).count()
    if stray:
        raise ValueError("values of spots that aren't there")
    stacked = values.join(ids, ["section", "local_id"]).select("spot_id", "gene_id", "value")
    sections = placed.groupBy("section_id", "section").agg(F.count("*").alias("n")).join(with_raw.withColumn("used_raw", F.lit(True)), "section", "left")
    edges = spatial_graph(out, n_neighs, coord_type, pitch)
    return Stack(out, stacked, edges, sections.select("section_id", "section", "n", F.coalesce("used_raw", F.lit(False)).alias("used_raw")))
