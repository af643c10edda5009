"""MinHash near-dedup with an LSH forest.

A document's set is its distinct word shingles. Documents with equal sets are one class from the start. Each class has a
signature of minima; a tree of the forest is the classes in the order of the signature read from one of TREES places
on. Neighbours in that order with a longest common prefix of at least DEPTH minima are candidates; regions (classes
with the same DEPTH minima) of few classes give all their pairs, larger ones are ordered by deeper prefixes and give
the nearest neighbours, so that their number grows with the classes alone. Those whose signatures agree enough are
confirmed on the full sets: in two rounds the best of each component, by which most of a group of near copies comes
together, then all that lie between components that are left.

Larger regions that are then one component are done. In the others every class outside the largest component is held
against all of the region, inside tasks, by signature; classes that so have a likely partner in another component are
held against each other on the full sets, by tasks that keep track of what is linked already: they put out no pairs but
the links that join components, fewer than there are classes. Regions too large for one block are replaced by those of
a second forest, twice as deep and with as many more trees as that takes to miss no more pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.contraction import components
from . import common as c

#: A pair of similarity 0.75 shares a region in some tree but for a chance of (1 - 0.75 ** DEPTH) ** TREES, 5e-6.
TREES, DEPTH = 32, 4
N_MINIMA = TREES * DEPTH
#: The same of the second forest: 3e-6.
DEEP_TREES, DEEP_DEPTH = 120, 8


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


_PLAIN, _DEEP = _functions(N_MINIMA, 20), _functions(DEEP_TREES * DEEP_DEPTH, 21)


@dataclass(frozen=True)
class Forest:
    """k: words in a shingle. percent: least similarity. likely: least share of agreeing minima to confirm a candidate
    (five standard deviations below percent; a pair of similarity 0.75 falls short with a chance of 4e-7). all_pairs:
    regions up to this size give all pairs. near: neighbours taken in larger ones. split_at: size at which a region's
    order is parted. block: work that one side of a comparison in a task may hold, in shingles and 512 a class."""

    k: int = 5
    percent: int = 75
    likely: float = 0.55
    all_pairs: int = 6
    near: int = 1
    split_at: int = 2048
    block: int = 1 << 20


def shingles(text: str | None, hashes: c.WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer than k words, of the whole sequence; empty without."""
    words = (text or "").encode("utf-8", "replace").translate(c.LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < k:
        return c.windows(h, len(words)) + np.uint64(len(words))
    return np.unique(c.windows(h, k))


def minima(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _PLAIN) -> np.ndarray:
    """The least of each hash function over s, as 32 bits."""
    a, b = functions
    out, step = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), 2**18 // len(a)
    for i in range(0, len(s), step):
        np.minimum(out, (s[i : i + step, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def region_keys(own: np.ndarray) -> np.ndarray:
    """Of each row of own, a tree's minima, the hash of tree and minima."""
    region = np.arange(len(own), dtype=np.uint64)
    for j in range(own.shape[1]):
        region = c.mix(region * np.uint64(0x9E3779B97F4A7C15) + own[:, j])
    return region.view(np.int64)


def tree_keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tree: the hash of its region (its first DEPTH minima) and the next DEPTH minima, 16 bits each, so that
    the order of these numbers is the order of the prefixes."""
    own = m.reshape(TREES, DEPTH).astype(np.uint64)
    deeper, next_own = np.zeros(TREES, np.uint64), np.roll(own, -1, axis=0)
    for j in range(DEPTH):
        deeper = (deeper << np.uint64(16)) | (next_own[:, j] >> np.uint64(16))
    return region_keys(own), deeper.view(np.int64)


SKETCH = "doc_id long, no_id boolean, k long, n_shingles long, f1 long, f2 long, regions array<long>, deeper array<long>, sig binary"


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """Of each row doc_id, k (a key of the text), n_shingles, f1 and f2 (a fingerprint of the set), regions, deeper and
    sig (the low byte of each minimum)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = c.WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, hashes, k)
                if not len(s):
                    rows.append((0, None, None, None, None, None))
                    continue
                f = xxhash.xxh3_128_intdigest(s.tobytes())
                m = minima(s)
                f1, f2 = np.array([f >> 64, f & (2**64 - 1)], np.uint64).view(np.int64).tolist()
                region, deeper = tree_keys(m)
                rows.append((len(s), f1, f2, region, deeper, m.astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "regions", "deeper", "sig"])
            out["f1"], out["f2"] = out["f1"].astype("Int64"), out["f2"].astype("Int64")
            yield pd.concat([batch[["doc_id", "no_id", "k"]].reset_index(drop=True), out], axis=1)

    rows = docs.select(*c.id_columns(), c.text_key(F.col("text")).alias("k"), "text")
    return c.with_id(rows.mapInPandas(run, SKETCH))


def in_regions(classes: DataFrame, least: int = 2) -> DataFrame:
    """cid, n_shingles, region, deeper, size of each class in each tree, for regions of at least `least` classes."""
    rows = classes.select("cid", "n_shingles", F.explode(F.arrays_zip("regions", "deeper")).alias("z"))
    rows = rows.select("cid", "n_shingles", F.col("z.regions").alias("region"), F.col("z.deeper").alias("deeper"))
    sizes = rows.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return rows.join(sizes, "region")


def forest(classes: DataFrame, f: Forest) -> DataFrame:
    """cid, region, deeper, size, part of each class in each tree.

    A region over split_at is parted by its next minima, then by the class's hash in this tree: trees part it
    differently, so that together they connect most of it; link_regions compares what lies in different parts.
    """
    rows = in_regions(classes)
    depth = F.when(F.col("size") <= f.split_at, F.lit(0)).when(F.col("size") <= 16 * f.split_at, 16).otherwise(32)
    return rows.withColumn(
        "part",
        F.when(F.col("size") <= f.split_at, F.lit(0).cast("long")).otherwise(
            F.xxhash64(
                F.col("deeper").bitwiseAND(F.when(depth == 16, F.lit(-(2**48))).otherwise(F.lit(-(2**32)))),
                F.pmod(F.xxhash64("region", "cid"), F.ceil(F.col("size") / f.split_at)),
            )
        ),
    )


def candidates(classes: DataFrame, f: Forest) -> DataFrame:
    """a < b (class ids): pairs that are neighbours in some tree."""
    rows = forest(classes, f)
    order = Window.partitionBy("region", "part").orderBy("deeper", "cid")
    steps = max(f.all_pairs - 1, f.near)
    ahead = F.array(*(F.struct(F.lead("cid", j).over(order).alias("o"), F.lit(j).alias("j")) for j in range(1, steps + 1)))
    near = rows.withColumn("ahead", ahead).select("cid", "size", F.explode("ahead").alias("x")).where(F.col("x.o").isNotNull())
    near = near.where((F.col("size") <= f.all_pairs) | (F.col("x.j") <= f.near))
    pairs = near.select(F.least("cid", "x.o").alias("a"), F.greatest("cid", "x.o").alias("b"))
    return pairs.where("a <> b").distinct()


def likely_pairs(pairs: DataFrame, classes: DataFrame, f: Forest) -> DataFrame:
    """Those of pairs whose signatures agree in at least f.likely of the minima, with that share as score."""
    sig = classes.select("cid", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[s]), np.uint8).reshape(len(p), N_MINIMA) for s in ("sa", "sb"))
                share = np.count_nonzero(x == y, axis=1) / N_MINIMA
                yield p[["a", "b"]].assign(score=share)[share >= f.likely]

    return both.mapInPandas(run, "a long, b long, score double")


def shingle_sets(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """cid and s (the set) of the documents whose ids are among the cid of named."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = c.WordHashes()
        for batch in batches:
            yield pd.DataFrame({"cid": batch["doc_id"], "s": [shingles(t, hashes, k).tobytes() for t in batch["text"]]})

    rows = docs.select("doc_id", "text", c.text_key(F.col("text")).alias("k")).where(F.col("doc_id").isNotNull() & c.membership(named, "cid")(F.col("doc_id")))
    rows = rows.join(named.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "k"])
    return rows.select("doc_id", "text").mapInPandas(run, "cid long, s binary").where("length(s) > 0")


def confirm(pairs: DataFrame, sets: DataFrame, f: Forest) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for sa, sb in zip(p["sa"], p["sb"], strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= f.percent * (len(x) + len(y) - common))
            yield p.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def apply_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with ca, cb: the components of a and b so far; only those where these differ."""
    out = pairs.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left")
    out = out.withColumns({"ca": F.coalesce("ra", "a"), "cb": F.coalesce("rb", "b")}).drop("ra", "rb")
    return out.where("ca <> cb")


def best_first(cross: DataFrame) -> DataFrame:
    """The best pair of each component to another; ties are spread by a hash."""
    ends = cross.select("a", "b", F.explode(F.array("ca", "cb")).alias("side"), "score")
    pick = F.struct("score", F.xxhash64("a", "b", "side").alias("h"), "a", "b")
    return ends.groupBy("side").agg(F.max(pick).alias("x")).select("x.a", "x.b").distinct()


def mixed_regions(rows: DataFrame, labels: DataFrame, f: Forest) -> DataFrame:
    """Of rows (region, cid, n_shingles) those in regions of more than one component, with root (the component), largest
    (the root of the region's largest component), nx and ny: how many blocks the classes outside it, and all, make."""
    rows = rows.select("region", "cid", "n_shingles").join(labels.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    members = rows.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") + 512).alias("w"))
    regions = members.groupBy("region").agg(F.max(F.struct("n", "root", "w")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("n_roots")).where("n_roots > 1")
    blocks = lambda w: F.ceil(w / f.block)
    regions = regions.select("region", F.col("top.root").alias("largest"), blocks(F.col("w") - F.col("top.w")).alias("nx"), blocks(F.col("w")).alias("ny"))
    return rows.join(regions, "region").select("region", "cid", "n_shingles", "root", "largest", "nx", "ny")


def deep_regions(sets: DataFrame) -> DataFrame:
    """region, cid, n_shingles of each class in each tree of the second forest, for regions of two or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            own = [minima(np.frombuffer(s, np.uint64), _DEEP).reshape(DEEP_TREES, DEEP_DEPTH).astype(np.uint64) for s in p["s"]]
            yield pd.DataFrame({"cid": p["cid"], "n_shingles": [len(s) // 8 for s in p["s"]], "regions": [region_keys(x) for x in own]})

    keys = sets.mapInPandas(run, "cid long, n_shingles long, regions array<long>")
    rows = c.materialize(keys).select("cid", "n_shingles", F.explode("regions").alias("region"))
    return rows.join(rows.groupBy("region").count().where("count > 1").select("region"), "region")


class Block:
    """Rows of a pair of blocks of one region, and what is linked in it so far."""

    def __init__(self, g: pd.DataFrame, f: Forest):
        self.f, self.cid, self.n, self.left, self.right = f, *(g[x].to_numpy() for x in ("cid", "n_shingles", "left", "right"))
        self.outside = (g["root"] != g["largest"]).to_numpy()
        self.sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), N_MINIMA)
        self.label = np.unique(g["root"].to_numpy(), return_inverse=True)[1]

    def likely(self, i: int) -> np.ndarray:
        """Rows of other components that may be similar to row i: by size, then by signature. Of two classes outside the
        largest component, the one with the smaller cid looks for the other."""
        n, most = self.n, np.maximum(self.n, self.n[i])
        meet = self.right & (self.label != self.label[i]) & (~self.outside | (self.cid > self.cid[i])) & (100 * np.minimum(n, n[i]) >= self.f.percent * most)
        j = np.flatnonzero(meet)
        return j[np.count_nonzero(self.sig[j] == self.sig[i], axis=1) >= self.f.likely * N_MINIMA]


def likely_rows(g: pd.DataFrame, f: Forest) -> pd.DataFrame:
    """region, cid of the rows that are likely similar to one of another component."""
    block, found = Block(g, f), np.zeros(len(g), bool)
    for i in np.flatnonzero(block.left):
        j = block.likely(i)
        found[j] = True
        found[i] |= len(j) > 0
    return g.loc[found, ["region", "cid"]]


def local_links(g: pd.DataFrame, f: Forest) -> pd.DataFrame:
    """a < b: pairs of classes similar enough that join components. Pairs of what is linked already are not tested."""
    block, n = Block(g, f), g["n_shingles"].to_numpy()
    first, cid, label = np.cumsum(n) - n, block.cid, block.label
    words, codes = np.unique(np.frombuffer(b"".join(g["s"]), np.uint64), return_inverse=True)
    mine, links = np.zeros(len(words), bool), []
    for i in np.flatnonzero(block.left):
        j = block.likely(i)
        if not len(j):
            continue
        own = codes[first[i] : first[i] + n[i]]
        mine[own] = True
        start = np.cumsum(n[j]) - n[j]
        common = np.add.reduceat(mine[codes[np.repeat(first[j] - start, n[j]) + np.arange(n[j].sum())]], start, dtype=np.int64)
        mine[own] = False
        for k in j[100 * common >= f.percent * (n[i] + n[j] - common)]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                links.append((min(cid[i], cid[k]), max(cid[i], cid[k])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def in_blocks(rows: DataFrame, held: DataFrame, kernel, f: Forest, schema: str) -> DataFrame:
    """What kernel makes of each pair of blocks of each region, for rows of mixed_regions and what is held of a class.

    The classes outside the largest component are held against all of their region. Both sides are dealt to blocks of
    about f.block, and each pair of blocks is compared by itself, so a hot region is spread over tasks.
    """
    # x: block of classes outside the largest component, y: block of all. A class is held against others where it is
    # `left`, and others against it where it is `right`; each pair meets once.
    odd = F.col("root") != F.col("largest")
    own = F.xxhash64("region", "cid")
    x, y = F.pmod(own, F.col("nx")), F.pmod(own, F.col("ny"))
    place = lambda x, y, left, right: F.struct(x.alias("x"), y.alias("y"), left.alias("left"), right.alias("right"))
    to_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1), lambda i: place(i, y, odd & (i == x), F.lit(True)))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1), lambda j: odd & (j != y))
    places = F.concat(to_all, F.transform(others, lambda j: place(x, j, F.lit(True), F.lit(False))))
    cols = ("cid", "n_shingles", "root", "largest")
    rows = rows.select("region", *cols, F.explode(places).alias("at")).select("region", "at.*", *cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            key = batch[["region", "x", "y"]].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            found = []
            for i, j in zip(starts, starts[1:], strict=False):
                if rest and i < j and tuple(key[i]) != last:
                    found.append(kernel(pd.concat(rest), f))
                    rest = []
                if i < j:
                    rest.append(batch.iloc[i:j])
                    last = tuple(key[i])
            if found:
                yield pd.concat(found)
        if rest:
            yield kernel(pd.concat(rest), f)

    order = ("region", "x", "y")
    return rows.join(held, "cid").repartition(*order).sortWithinPartitions(*order, "cid").mapInPandas(run, schema)


def link_regions(rows: DataFrame, docs: DataFrame, classes: DataFrame, f: Forest) -> DataFrame:
    """a < b: links that join components, from the rows of mixed_regions."""
    sig = classes.select("cid", "sig")
    found = c.materialize(in_blocks(rows, sig, likely_rows, f, "region long, cid long").distinct())
    sets = shingle_sets(docs, found.select("cid").distinct(), f.k)
    return in_blocks(rows.join(found, ["region", "cid"], "left_semi"), sets.join(sig, "cid"), local_links, f, "a long, b long")


def link_components(docs: DataFrame, classes: DataFrame, f: Forest) -> DataFrame:
    """v, root of classes that are linked to another: neighbours of the forest first, then what is left in large regions."""
    pairs = c.materialize(likely_pairs(candidates(classes, f), classes, f))
    named = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets, table = c.bucketed(shingle_sets(docs, named, f.k), "cid")
    labels = docs.sparkSession.createDataFrame([], "v long, root long")

    def confirmed(links: DataFrame) -> None:
        """Link what links join: only the roots they name pass through another search of components."""
        nonlocal labels
        links = c.materialize(links)
        if links.take(1):
            up = components(apply_labels(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            every = labels.unionByName(up.join(labels, "v", "left_anti").select("v", F.col("v").alias("root")))
            over = up.select(F.col("v").alias("root"), F.col("root").alias("top"))
            labels = c.materialize(every.join(over, "root", "left").select("v", F.coalesce("top", "root").alias("root")))

    todo = pairs
    for best in (True, True, False):
        todo = c.materialize(apply_labels(todo.select("a", "b", "score"), labels))
        if not todo.take(1):
            break
        tried = c.materialize(best_first(todo)) if best else todo
        confirmed(confirm(tried, sets, f))
        todo = todo.join(tried, ["a", "b"], "left_anti")
    c.drop_tables(docs.sparkSession, table)
    mixed = c.materialize(mixed_regions(in_regions(classes, f.all_pairs + 1), labels, f))
    found = link_regions(mixed.where("nx = 1"), docs, classes, f)
    hot = mixed.where("nx > 1").select("cid").distinct()
    if hot.take(1):
        deep = c.materialize(mixed_regions(deep_regions(shingle_sets(docs, hot, f.k)), labels, f))
        found = found.unionByName(link_regions(deep, docs, classes, f))
    confirmed(found)
    return labels


def _components(docs: DataFrame, f: Forest) -> DataFrame:
    """Of each row doc_id, k (a key of the text), n_shingles and component_id."""
    rows = c.materialize(sketch(docs, f.k))
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = c.materialize(
        usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("cid"), *(F.first(x).alias(x) for x in ("n_shingles", "regions", "deeper", "sig")))
    )
    labels = link_components(docs, classes, f)
    named = classes.select("f1", "f2", "cid").join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("f1", "f2", F.coalesce("root", "cid").alias("component_id"))
    out = rows.select("doc_id", "k", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("f1")).alias("f1"), "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "k", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_components(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id).

    Null and empty texts have no shingles and are linked with nothing. Rows with a null doc_id are linked with nothing
    and kept. Rows that repeat a doc_id follow each its own text. Texts may have any length; the order of rows and ties
    in the forest change nothing but the work. Only doc_id and text are read; an empty table gives an empty one.
    """
    rows = _components(docs, f)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def dedup_near(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """docs with one row of each component, one with its least doc_id; of rows that repeat doc_id and text, one stays.

    Rows with a null doc_id stay. Columns, whatever their names, are as they were.
    """
    marks = _components(docs, f).where("doc_id IS NOT NULL").groupBy("doc_id", "k").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))
    marks = c.materialize(marks.where("NOT kept OR n > 1"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", c.text_key(F.col("text")).alias("k"))
    # Only rows that may be marked are shuffled.
    marked = F.col("doc_id").isNotNull() & c.membership(marks, "doc_id", "k")(F.col("doc_id"), F.col("k"))
    met = rows.where(marked).join(marks.select("doc_id", "k", "kept"), ["doc_id", "k"], "left")
    parts = rows.where(~marked), met.where("kept IS NULL"), met.where("kept").dropDuplicates(["doc_id", "k"])
    return reduce(DataFrame.unionByName, (p.select("row") for p in parts)).select("row.*")
