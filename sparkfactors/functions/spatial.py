"""How labels and values lie in space and in an embedding. Metrics are null where they are undefined."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import hash_unit, knn, neighbour_sum
from ..operators.ranks import ranked


def morans_i(values: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, i: Moran's I of each key, for long values (spot_id, key, v) with a row for every spot; edges as given."""
    n = values.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    c = values.join(n, key).select("spot_id", key, (F.col("v") - F.col("m")).alias("v"), "n")
    w = edges.agg(F.count("*").cast("double").alias("w"))
    own = c.groupBy(key).agg(F.sum(F.col("v") * F.col("v")).alias("ss"), F.max("n").alias("n"))
    cross = c.join(neighbour_sum(edges, c, key).withColumnRenamed("v", "av"), ["spot_id", key]).groupBy(key).agg(F.sum(F.col("v") * F.col("av")).alias("cross"))
    i = F.try_divide(F.col("n"), w.scalar()) * F.try_divide(F.coalesce("cross", F.lit(0e0)), "ss")
    return own.join(cross, key, "left").select(key, F.coalesce(i, F.lit(0e0)).alias("i"))


def sparse_morans(expr: DataFrame, edges: DataFrame, n_spots: DataFrame) -> DataFrame:
    """gene_id, i of sparse values (spot_id, gene_id, value; zeros left out), without filling in the zeros.

    With mean m, degrees counted over both ends and W edges: sum over edges of (x-m)(y-m) is
    sum xy - m (sum over edge ends of x) + W m m. n_spots: one row, one column.
    """
    v = expr.select("spot_id", "gene_id", F.col("value").cast("double").alias("v"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("spot_id")).groupBy("spot_id").agg(F.count("*").alias("d"))
    n, w = n_spots.scalar().cast("double"), edges.agg(F.count("*").cast("double")).scalar()
    own = v.join(ends, "spot_id", "left").groupBy("gene_id").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.sum(F.col("v") * F.coalesce("d", F.lit(0))).alias("sd")
    )
    cross = v.join(neighbour_sum(edges, v, "gene_id").withColumnRenamed("v", "av"), ["spot_id", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("v") * F.col("av")).alias("xy"))
    m = F.col("s") / n
    top = F.coalesce("xy", F.lit(0e0)) - m * F.col("sd") + w * m * m
    down = F.col("ss") - n * m * m
    i = F.when(F.abs(down) > 1e-12, n / w * top / down)
    return own.join(cross, "gene_id", "left").select("gene_id", F.coalesce(i, F.lit(0e0)).alias("i"))


def moran_summary(per_gene: DataFrame) -> DataFrame:
    """One row: n, mean, median, std (population), max, p90, frac over 0.1."""
    return per_gene.agg(
        F.count("*").alias("n"), F.avg("i").alias("mean"), F.expr("median(i)").alias("median"), F.stddev_pop("i").alias("std"),
        F.max("i").alias("max"), F.expr("percentile(i, 0.9)").alias("p90"), F.avg((F.col("i") > 0.1).cast("double")).alias("frac"),
    )


def coherence(labels: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, coherence: mean over labels of Moran's I of the label's indicator; labels: by, spot_id, label.

    One pass: of a label with share p among n spots, E edges inside, T edge ends and W edges in all, it is
    (E - p T + p p W) / (W p (1 - p)); 0 for a label that all or none have.
    """
    s, d = labels.select(*by, F.col("spot_id").alias("src"), F.col("label").alias("ls")), labels.select(*by, F.col("spot_id").alias("dst"), F.col("label").alias("ld"))
    e = edges.join(s, "src").join(d, ["dst", *by])
    ends = e.select(*by, F.explode(F.array("ls", "ld")).alias("label"), (F.col("ls") == F.col("ld")).cast("double").alias("same"))
    inside = ends.groupBy(*by, "label").agg(F.count("*").alias("t"), (F.sum("same") / 2).alias("e"))
    n = labels.groupBy(*by, "label").agg(F.count("*").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    w = edges.agg(F.count("*").cast("double")).scalar()
    p = F.col("p")
    i = F.try_divide(F.coalesce("e", F.lit(0e0)) - p * F.coalesce("t", F.lit(0)) + p * p * w, w * p * (1 - p))
    return n.join(inside, [*by, "label"], "left").groupBy(*by).agg(F.avg(F.coalesce(i, F.lit(0e0))).alias("coherence"))


def pas(labels: DataFrame, neighbours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pas: share of spots of whose neighbours (src, dst) less than half have its label; 0 without neighbours."""
    s, d = labels.select(*by, F.col("spot_id").alias("src"), F.col("label").alias("ls")), labels.select(*by, F.col("spot_id").alias("dst"), F.col("label").alias("ld"))
    same = neighbours.join(s, "src").join(d, ["dst", *by]).groupBy(*by, "src").agg(F.avg((F.col("ls") == F.col("ld")).cast("double")).alias("same"))
    out = same.groupBy(*by).agg(F.avg((F.col("same") < 0.5).cast("double")).alias("pas"))
    return out.select(*by, F.coalesce("pas", F.lit(0e0)).alias("pas"))


def chaos(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """chaos: mean over labels (of two spots at least) of their spots' mean distance to the nearest of the label, over
    the mean distance to the nearest of all."""
    near_all = knn(spots, 1, by_section=False).agg(F.avg(F.sqrt("d2")).alias("m"))
    grouped = spots.join(labels, "spot_id").withColumn("section_id", F.xxhash64(F.col("label").cast("string")))
    inside = knn(grouped, 1, by_section=True).join(grouped.select(F.col("spot_id").alias("src"), "label"), "src")
    per = inside.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("m"))
    base = F.coalesce(near_all.scalar(), F.lit(1e0))
    base = F.when(base == 0, 1e0).otherwise(base)
    return per.agg((F.coalesce(F.avg("m"), F.lit(0e0)) / base).alias("chaos"))


def pair_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0e0), lambda s, v: s + v))


def _runs_of(codes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where runs of equal codes begin between start and stop, counted from start."""
    return np.flatnonzero(np.r_[True, np.diff(codes[start:stop]) != 0])


def _distance_sums(points: pd.DataFrame, names: Sequence[str], tile: int = 512) -> pd.DataFrame:
    """id, t, own, label, d, n: for each point and labeling t the sum of distances to the other points of each label, and
    their number; own: the label is the point's. points: two blocks x and y of points (x, y, b, id, h, names), or one
    block with itself; of two blocks, each point meets those of the other.

    Points are sorted by their labels in all labelings, so a tile of distances is summed by runs of its rows and columns.
    """
    x, y = points["x"].iloc[0], points["y"].iloc[0]
    coded = [pd.factorize(points[name]) for name in names]
    kinds, kind = np.unique(np.stack([c for c, _ in coded], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    h = np.stack(points["h"].to_list())
    h, ids, at = h - h.mean(axis=0), points["id"].to_numpy(), points["b"].to_numpy()
    length = (h * h).sum(axis=1)
    left, right = (np.flatnonzero(at == k) for k in (x, y))
    left, right = (i[np.argsort(kind[i], kind="stable")] for i in (left, right))
    if not len(left) or not len(right):
        return _NO_SUMS
    of_left, of_right = kind[left], kind[right]
    sums = {k: (np.zeros((len(i), len(kinds))), np.zeros((len(i), len(kinds)))) for k, i in ((x, left), (y, right))}
    a = np.column_stack([-2 * h[left], length[left], np.ones(len(left))])
    b = np.column_stack([h[right], np.ones(len(right)), length[right]]).T
    for r in range(0, len(left), tile):
        r2 = min(r + tile, len(left))
        rows = _runs_of(of_left, r, r2)
        for c in range(0, len(right), tile):
            c2 = min(c + tile, len(right))
            columns = _runs_of(of_right, c, c2)
            d = a[r:r2] @ b[:, c:c2]
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if x == y:
                other = ids[left[r:r2], None] != ids[right[c:c2]]
                d *= other
                sums[x][1][r:r2, of_right[c + columns]] += np.add.reduceat(other.astype(float), columns, axis=1)
            else:
                sums[y][0][c:c2, of_left[r + rows]] += np.add.reduceat(d, rows, axis=0).T
            sums[x][0][r:r2, of_right[c + columns]] += np.add.reduceat(d, columns, axis=1)
    if x != y:
        for k, others in ((x, of_right), (y, of_left)):
            sums[k][1][:] = np.bincount(others, minlength=len(kinds))
    out = [_NO_SUMS]
    for k, i in dict([(x, left), (y, right)]).items():
        for t, (code, labels) in enumerate(coded):
            of = (kinds[:, t][:, None] == np.arange(len(labels))).astype(float)
            d, n = (m @ of for m in sums[k])
            row, column = np.nonzero((n > 0) & (code[i] >= 0)[:, None])
            out.append(pd.DataFrame({"id": ids[i[row]], "t": np.int32(t), "own": code[i[row]] == column, "label": np.asarray(labels, dtype=object)[column], "d": d[row, column], "n": n[row, column]}))
    return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)


_NO_SUMS = pd.DataFrame({"id": pd.Series(dtype="int64"), "t": pd.Series(dtype="int32"), "own": pd.Series(dtype=bool), "label": pd.Series(dtype=object), "d": pd.Series(dtype=float), "n": pd.Series(dtype=float)})


def silhouettes(points: DataFrame, names: Sequence[str], block: int = 1024) -> DataFrame:
    """One row, a column for each labeling in names: the mean of (b - a) / max(a, b) over points (id, names, h:
    array<double>) with a label; a point alone in its label has a = 0. Null for one label, or with as many labels as
    points.

    Every distance counts, so the work is the square of the points by definition; what is shuffled is not. Points are
    dealt to blocks of about `block`, but to no more than 10, and each two blocks meet in a task that works tile by
    tile, so 10 copies of a point are shuffled however many there are. Only blocks that would be too large for a task
    (of over 65,536 points, less for many labels) are divided further. All labelings share one pass over the distances.
    """
    rows = points.select(F.col("id").cast("long").alias("id"), F.col("h").cast("array<double>").alias("h"), *(F.col(c).cast("string").alias(f"l{t}") for t, c in enumerate(names)))
    codes = [f"l{t}" for t in range(len(names))]
    size = rows.agg(F.count("*"), F.count_distinct(F.struct(*codes)), *(f(c) for c in codes for f in (F.count, F.count_distinct))).first()
    n, kinds, each = size[0], size[1], [(size[2 + 2 * t], size[3 + 2 * t]) for t in range(len(names))]
    defined = [2 <= k < m for m, k in each]
    if not any(defined):
        return points.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in names))
    # Sums by point and kind of a block hold 2^22 numbers at most, or those of 2,048 points.
    blocks = max(min(n // block + 1, 10), n // min(65_536, max(2_048, 2**22 // kinds)) + 1)
    own, k = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("b", own).withColumn("k", k).select(F.least("b", "k").alias("x"), F.greatest("b", "k").alias("y"), "b", "id", "h", *codes)
    # A number of partitions that is given stays: by their bytes, the blocks would be coalesced into few tasks.
    dealt = dealt.repartition(min(1024, blocks * (blocks + 1) // 2), "x", "y")
    sums = dealt.groupBy("x", "y").applyInPandas(lambda p: _distance_sums(p, codes), "id long, t int, own boolean, label string, d double, n double")
    d = sums.repartition("id").groupBy("id", "t", "own", "label").agg((F.sum("d") / F.sum("n")).alias("d"))
    ab = d.groupBy("id", "t").agg(F.coalesce(F.max(F.when(F.col("own"), F.col("d"))), F.lit(0e0)).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0e0))
    return ab.agg(*(F.avg(F.when((F.col("t") == t) & F.lit(defined[t]), s)).alias(c) for t, c in enumerate(names)))


def silhouette(points: DataFrame, block: int = 1024) -> DataFrame:
    """silhouette: that of the one labeling `label`."""
    return silhouettes(points, ("label",), block).withColumnRenamed("label", "silhouette")


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """ch: spread between labels over spread within, for points (id, label, h); null as silhouette, or with none within."""
    long = points.select("id", "label", F.posexplode("h").alias("j", "v"))
    per = long.groupBy("label", "j").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    one = per.groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count("*").alias("k")
    )
    t = one.agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.col("between") - F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("ss") - F.col("between")).alias("w"))
    value = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    return t.select(F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), value).alias("ch"))


def permuted(labels: DataFrame, shuffles: int, seed: int = 0) -> DataFrame:
    """b, spot_id, label: for each b the labels in an order set by the hash of seed, b and spot. Spots are sorted by
    ranges, so no task sees all of a shuffle."""
    rows = ranked(labels.select("spot_id", "label"), ("spot_id",), name="i").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    rows = ranked(rows.withColumn("u", hash_unit(seed, F.col("b"), F.col("spot_id"))), ("u", "spot_id"), ("b",), name="j")
    return rows.select("b", "spot_id", "i").join(rows.select("b", F.col("j").alias("i"), "label"), ["b", "i"]).select("b", "spot_id", "label")
