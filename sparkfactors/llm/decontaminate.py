"""Benchmark decontamination with an FM-index per training shard.

The words of benchmark items are numbered; a shard is a run of documents whose words are written with these numbers. As
a test phrase can only lie where each pair of neighbouring words is a pair of some item, the shard's text keeps just the
stretches of such pairs, parted by a separator: nothing that could match is left out. Over that text stand a suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and a sample of suffix positions. All phrases are searched
backward at once; occurrences are located by walking to the next sampled position, and their spans are merged.

Shards hold at most `shard_words` words, so memory doesn't grow with the input. Items are dealt to blocks of at most
`block_items`, and each block is a pass over the documents, so the phrases sent to executors are bounded too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: ASCII letters and digits and all characters above U+007F are in words (fixed values of the contract, before A-Z are
#: lower-cased).
WORD_RE = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: bytes.translate table: A-Z to lower case, every other ASCII byte that is in no word to a blank.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


class WaveletMatrix:
    """Symbols of an integer array, with ranks by bit level."""

    def __init__(self, a: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks, self.rows = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((a >> level) & 1).astype(bool)
            self.rows.append(bit)
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(int(len(a) - self.ranks[-1][-1]))
            a = np.concatenate([a[~bit], a[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at; both arrays."""
        start, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            r = self.ranks[k]
            start = np.where(bit, self.zeros[k] + r[start], start - r[start])
            at = np.where(bit, self.zeros[k] + r[at], at - r[at])
        return at - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a position, and how often it occurs before that position."""
        symbol, start, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit, r = self.rows[k][at], self.ranks[k]
            symbol = symbol * 2 + bit
            start = np.where(bit, self.zeros[k] + r[start], start - r[start])
            at = np.where(bit, self.zeros[k] + r[at], at - r[at])
        return symbol, at - start


def suffix_array(a: np.ndarray) -> np.ndarray:
    """By prefix doubling; the end sorts before every symbol."""
    rank, k, n = np.unique(a, return_inverse=True)[1].astype(np.int64), 1, len(a)
    while True:
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        if k >= n or fresh[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """text: positive integers; a final 0 is added."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.symbols = np.unique(text)
        coded = np.searchsorted(self.symbols, text)
        self.bwt = WaveletMatrix(coded[order - 1], max(1, int(len(self.symbols) - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(self.symbols)))])
        self.sampled = order % sample == 0
        self.n_sampled = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of phrases (all of one length) the range of suffixes that begin with it; empty: equal ends."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            at = np.searchsorted(self.symbols, phrases[:, j])
            known = self.symbols[np.minimum(at, len(self.symbols) - 1)] == phrases[:, j]
            at = np.where(known, at, 0)
            lo, hi = self.first[at] + self.bwt.rank(at, lo), self.first[at] + self.bwt.rank(at, hi)
            hi = np.where(known, hi, lo)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out, todo, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.n_sampled[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.bwt.access_rank(at)
            at, steps = self.first[symbol] + before, steps + 1
        return out


@dataclass
class Phrases:
    """Of a block of items: the words' numbers, the distinct phrases by length, and the items of each phrase."""

    window: int
    numbers: dict[bytes, int] = field(default_factory=dict)
    by_length: list[tuple[np.ndarray, list[list[str]]]] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shortest: int = 0

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Phrases:
        """An item is its windows of `window` words, or, with fewer, all its words; without words, nothing."""
        out, found = cls(window), {}
        for item, text in items:
            ids = [out.numbers.setdefault(w, len(out.numbers) + 1) for w in words_of(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                found.setdefault(tuple(ids[i : i + k]), {})[item] = None
        for k in sorted({len(p) for p in found}):
            these = [p for p in found if len(p) == k]
            out.by_length.append((np.array(these, np.int64), [list(found[p]) for p in these]))
        out.shortest = min((p.shape[1] for p, _ in out.by_length), default=0)
        base = len(out.numbers) + 1
        out.pairs = np.unique(np.concatenate([(p[:, :-1] * base + p[:, 1:]).ravel() for p, _ in out.by_length] or [out.pairs]))
        return out


def scan_shard(docs: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Occurrences in a shard: of each, its first word (counted over the shard's documents, each followed by one
    separator), its length, and its items as a list shared by all occurrences of the phrase."""
    text = np.concatenate([x for d in docs for x in (d, [0])]) if docs else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not len(text) or not phrases.shortest:
        return none
    # Maximal stretches of known words with known neighbours.
    base, known = len(phrases.numbers) + 1, text > 0
    linked = known[:-1] & known[1:]
    at = np.flatnonzero(linked)
    pair = text[at] * base + text[at + 1]
    if len(phrases.pairs):
        j = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
        linked[at] = phrases.pairs[j] == pair
    else:
        linked[:] = False
    start = np.flatnonzero(known & ~np.concatenate([[False], linked]))
    stop = np.flatnonzero(known & ~np.concatenate([linked, [False]])) + 1
    long = stop - start >= phrases.shortest
    start, stop = start[long], stop[long]
    if not len(start):
        return none
    # The stretches one after the other, with a separator (number `base`) after each.
    size = stop - start + 1
    first = np.cumsum(size) - size
    source = np.repeat(start - first, size) + np.arange(size.sum())
    kept = text[np.minimum(source, len(text) - 1)]
    kept[first + size - 1] = base
    index = FMIndex(kept)
    begins, lengths, items = [], [], []
    for table, of in phrases.by_length:
        lo, hi = index.search(table)
        n = hi - lo
        which = np.repeat(np.arange(len(table)), n)
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begins.append(source[index.locate(rows)])
        lengths.append(np.full(len(rows), table.shape[1]))
        items += [of[i] for i in which.tolist()]
    return np.concatenate(begins), np.concatenate(lengths), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "doc_id long, no_id boolean, k long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _scan(docs: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """FOUND: of each row, the merged spans of words that occurrences cover and the items that occur."""

    def shard(ids: list, docs: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(d) for d in docs])
        first = np.cumsum(sizes + 1) - sizes - 1
        begins, lengths, of = scan_shard(docs, phrases)
        doc = np.searchsorted(first, begins, "right") - 1
        spans: list[list] = [[] for _ in docs]
        items: list[dict] = [{} for _ in docs]
        for d, a, n, names in zip(doc.tolist(), (begins - first[doc]).tolist(), lengths.tolist(), of, strict=True):
            spans[d].append((a, a + n))
            items[d].update(dict.fromkeys(names))
        merged = [[{"a": a, "b": b} for a, b in merge_spans(s)] for s in spans]
        return pd.DataFrame(ids, columns=["doc_id", "no_id", "k"]).assign(**{"n_words": sizes, "spans": merged, "items": [list(i) for i in items]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, docs, n = [], [], 0
        number = phrases.numbers.get
        for batch in batches:
            for *key, text in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["k"].tolist(), batch["text"], strict=True):
                words = words_of(text)
                ids.append(key)
                docs.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
                n += len(words)
                if n >= shard_words:
                    yield shard(ids, docs)
                    ids, docs, n = [], [], 0
        if docs:
            yield shard(ids, docs)

    return c.with_id(docs.select(*c.id_columns(), c.text_key(F.col("text")).alias("k"), "text").mapInPandas(run, FOUND))


def phrase_blocks(benchmark: DataFrame, window: int, block_items: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about block_items the items make, and the blocks, each read to the driver when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    n = max(1, math.ceil(items.count() / block_items))
    block = lambda i: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).where("text <> ''").collect()
    return n, (Phrases.of(sorted(map(tuple, block(i))), window) for i in range(n))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 400_000, block_items: int = 20_000) -> DataFrame:
    """FOUND for every row of docs: word spans covered by benchmark phrases, merged, and the items found.

    Null and empty texts have no words and no spans; so do all rows if the benchmark is empty. Rows are judged by their
    own text, so repeated ids do no harm. Only doc_id and text are read, whatever other columns there are.
    """
    n_blocks, blocks = phrase_blocks(benchmark, window, block_items)
    if n_blocks == 1:
        return _scan(docs, next(blocks), shard_words)
    # More than one block: each is a pass, run before the next block is read, so that the driver holds one at a time;
    # what the passes found of a row is put together.
    every = None
    for p in blocks:
        found = _scan(docs, p, shard_words)
        every = c.materialize(found) if every is None else every.unionByName(c.materialize(found.where(F.size("spans") > 0)))
    both = every.groupBy("doc_id", "k").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    joined = F.aggregate(
        "spans",
        F.struct(F.array().cast("array<struct<a:long,b:long>>").alias("done"), start.alias("now")),
        lambda s, x: F.when(s["now"]["a"].isNull(), F.struct(s["done"].alias("done"), x.alias("now")))
        .when(x["a"] <= s["now"]["b"], F.struct(s["done"].alias("done"), F.struct(s["now"]["a"].alias("a"), F.greatest(s["now"]["b"], x["b"]).alias("b")).alias("now")))
        .otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), x.alias("now"))),
        lambda s: F.when(s["now"]["a"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])),
    )
    found = both.withColumn("spans", joined).withColumnsRenamed({"doc_id": "d", "k": "k0"})
    # Rows that repeat doc_id and text were one group; each gets its findings back.
    rows = docs.select("doc_id", c.text_key(F.col("text")).alias("k"))
    back = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("k0")))
    return back.select("doc_id", "k", "n_words", "spans", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items; a row per row of docs.

    Null, empty, repeated and very long texts, ties and an empty benchmark: as find_overlaps says; an empty table gives
    an empty one. An item found more than once counts once.
    """
    found = find_overlaps(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the words that benchmark phrases cover; rows that nothing is found in are as they were.

    From the first to the last character of a span, the text is replaced by one line feed. Other columns, whatever their
    names, stay; a null text stays null; repeated rows are cut alike; an empty table gives an empty one.
    """
    found = find_overlaps(docs, benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("k").alias("k0"), "spans").dropDuplicates(["d", "k0"])
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", c.text_key(F.col("text")).alias("k"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("k0")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is not None and s is not None and len(s):
                at, parts, last = [m.span() for m in WORD_RE.finditer(t)], [], 0
                for x in s:
                    parts.append(t[last : at[x["a"]][0]])
                    last = at[x["b"] - 1][1]
                t = "\n".join([*parts, t[last:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return joined.withColumn("cut", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))).select(
        *(F.col("cut").alias(x) if x == "text" else F.col(f"row.`{x}`").alias(x) for x in docs.columns)
    )

