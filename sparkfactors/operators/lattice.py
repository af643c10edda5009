"""Neighbour graphs of spots on a lattice: keys and equal joins on offsets, without distances or a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .graph import knn_directed

#: Steps (row, col) to the neighbours, by how many there are. Six: a hexagonal lattice whose columns count half steps,
#: so that row and column are both even or both odd.
OFFSETS = {
    4: ((-1, 0), (0, -1), (0, 1), (1, 0)),
    6: ((-1, -1), (-1, 1), (0, -2), (0, 2), (1, -1), (1, 1)),
    8: ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
}


def lattice_keys(spots: DataFrame, pitch: float, n_neighs: int = 6, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """spots with row, col and off: the nearest lattice point of each (x, y), and how far it is, in pitches. pitch is the
    distance of neighbours, origin a lattice point."""
    if pitch <= 0 or n_neighs not in OFFSETS:
        raise ValueError("pitch must be positive, and n_neighs 4, 6 or 8")
    x, y = (F.col("x") - origin[0]) / pitch, (F.col("y") - origin[1]) / pitch
    if n_neighs != 6:
        at = spots.withColumns({"row": F.round(y).cast("long"), "col": F.round(x).cast("long")})
        return at.withColumn("off", F.sqrt((x - F.col("col")) * (x - F.col("col")) + (y - F.col("row")) * (y - F.col("row"))))
    high = 3**0.5 / 2
    # The point lies between two rows; on each, the nearest column of the row's parity.
    def on(row):
        odd = F.pmod(row, F.lit(2))
        col = 2 * F.round(x - odd / 2).cast("long") + odd
        dx, dy = x - col / 2, y - row * high
        return F.struct((dx * dx + dy * dy).alias("d2"), row.alias("row"), col.alias("col"))

    low = F.floor(y / high).cast("long")
    best = spots.withColumn("__at", F.least(on(low), on(low + 1)))
    return best.withColumns({"row": F.col("__at.row"), "col": F.col("__at.col"), "off": F.sqrt("__at.d2")}).drop("__at")


def lattice_graph(spots: DataFrame, n_neighs: int = 6, rings: int = 1) -> DataFrame:
    """src, dst, ring of spots (spot_id, section_id, row, col): ring 1 are the neighbours on the section's lattice, ring r
    the spots that r steps over present spots reach and fewer don't.

    Both directions are there. Each spot asks for the keys around it in one join, so the work is spots times n_neighs.
    Spots that share a key have each other's neighbours, and aren't neighbours themselves; missing ones are not bridged.
    """
    if n_neighs not in OFFSETS or rings < 1:
        raise ValueError("n_neighs must be 4, 6 or 8, and rings positive")
    step = F.explode(F.lit([list(o) for o in OFFSETS[n_neighs]]))
    asks = spots.select(F.col("spot_id").alias("src"), "section_id", "row", "col", step.alias("o"))
    asks = asks.select("src", "section_id", (F.col("row") + F.get("o", 0)).alias("row"), (F.col("col") + F.get("o", 1)).alias("col"))
    edges = asks.join(spots.select(F.col("spot_id").alias("dst"), "section_id", "row", "col"), ["section_id", "row", "col"]).select("src", "dst")
    if rings == 1:
        return edges.withColumn("ring", F.lit(1))
    edges = cut(edges)
    reached = edges.withColumn("ring", F.lit(1))
    for ring in range(2, rings + 1):
        ahead = reached.where(F.col("ring") == ring - 1).select("src", F.col("dst").alias("via"))
        further = ahead.join(edges.withColumnRenamed("src", "via"), "via").where("src <> dst").select("src", "dst").distinct()
        new = further.join(reached.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("ring", F.lit(ring))
        reached = cut(reached.unionByName(new))
    return reached


def spatial_graph(spots: DataFrame, n_neighs: int = 6, coord_type: str = "grid", pitch: float | None = None, by_section: bool = True) -> DataFrame:
    """src, dst: 'grid' on the lattice of row and col, which come from x, y and pitch where they are not there; 'generic'
    by the n_neighs nearest spots. A generic graph is directed."""
    if coord_type == "generic":
        return knn_directed(spots, n_neighs, by_section)
    if coord_type != "grid":
        raise ValueError(f"coord_type {coord_type!r}")
    if not {"row", "col"} <= set(spots.columns):
        if pitch is None:
            raise ValueError("a grid needs columns row and col, or the pitch")
        spots = lattice_keys(spots, pitch, n_neighs)
    return lattice_graph(spots, n_neighs).select("src", "dst")
