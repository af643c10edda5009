"""Substring dedup by relative Lempel-Ziv parsing.

A window is `window` consecutive words of a document; a word goes if a window over it also starts earlier (smaller
doc_id, or same document and earlier start).

Windows are dealt to reference blocks by their least gram (the least hash of GRAM words in them), so equal windows meet
in one block, and consecutive windows with the same least gram travel as one run of words.

1. Each task reads its documents in local blocks. A run equal to an earlier one of the same local block is a factor of
   it as a whole. What is left of each least gram is announced, packed and at most once per local block and gram.
2. Grams announced once occur once: their runs match nothing. Runs of the others become candidates.
3. Candidates fetch their words and go to the reference block of their gram. There, in document order, each run is
   parsed greedily against all runs before it, which are indexed by window: where a window is found, the factor is
   extended word by word; windows over a factor's end are looked up in turn. Factors are at least a window long.
   Grams with very many runs are dealt to blocks by whole windows, so no block holds a hot gram.
4. Factors are gathered by document and their words removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

GRAM = 6
NULL_ID = -(2**63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def least_grams(grams: np.ndarray, window: int) -> np.ndarray:
    """Of each window of words, the least of its grams."""
    m, width, need = grams, 1, window - GRAM + 1
    while width * 2 <= need:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (need - width)], m[need - width :]) if need > width else m


def runs_of(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one least gram: that gram, the first window, the number of windows, and whether the
    gram occurs again in the document, so that the run may repeat itself."""
    if len(h) < window:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = c.windows(h, GRAM)
    m = least_grams(grams, window)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    grams.sort()
    twice = grams[1:][grams[1:] == grams[:-1]]
    return m[first], first, np.diff(np.append(first, len(m))), np.isin(m[first], twice)


#: kind: token (packed announcements of a part), cand (a run: a first window, b windows) or span (words a to b).
NUMBERS = ("m", "d", "k", "a", "b")
STEP1 = "part int, kind string, m long, d long, k int, a long, b long, packed binary"
TOKEN = np.dtype([("m", "<i8"), ("d", "<i8"), ("k", "<i4"), ("a", "<i4"), ("b", "<i4"), ("n", "<i4")])
CAND = "kind string, m long, d long, k int, a long, b long, hot boolean"


def _columns(tokens: np.ndarray) -> bytes:
    """By column, which compresses better than by row."""
    return b"".join(np.ascontiguousarray(tokens[x]).tobytes() for x in TOKEN.names)


def _tokens(packed: bytes) -> np.ndarray:
    n = len(packed) // TOKEN.itemsize
    out, at = np.empty(n, TOKEN), 0
    for x in TOKEN.names:
        size = n * TOKEN[x].itemsize
        out[x] = np.frombuffer(packed[at : at + size], TOKEN[x])
        at += size
    return out


def announce(rows: DataFrame, window: int, parts: int, block_words: int) -> DataFrame:
    """Step 1 over rows d, k, text: STEP1."""

    def block(d: list, k: list, start: list, runs: list, content: list) -> Iterator[pd.DataFrame]:
        n = [len(r[0]) for r in runs]
        m = np.concatenate([r[0] for r in runs]).view(np.int64)
        a, b, again = (np.concatenate([r[i] for r in runs]) for i in (1, 2, 3))
        d, k, h = np.repeat(np.array(d, np.int64), n), np.repeat(np.array(k, np.int32), n), np.concatenate(content)
        order = np.lexsort((a, d, b, h, m))
        m, a, b, d, k, h, again = m[order], a[order], b[order], d[order], k[order], h[order], again[order]
        same_gram = m[1:] == m[:-1]
        same = same_gram & (h[1:] == h[:-1]) & (b[1:] == b[:-1])
        # The first of equal runs is the reference; those that start later are factors of it, rows of one id aren't.
        lead = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(m)), 0))
        factor = (d > d[lead]) | ((d == d[lead]) & (a > a[lead]))
        spans = pd.DataFrame({"d": d[factor], "k": k[factor], "a": a[factor], "b": a[factor] + b[factor] + window - 1})
        keep = ~factor
        m, a, b, d, k, again = m[keep], a[keep], b[keep], d[keep], k[keep], again[keep]
        head = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        size = np.diff(np.append(head, len(m)))
        count = size + np.maximum.reduceat(again, head)
        many = np.repeat(count > 1, size)
        cands = pd.DataFrame({"m": m[many], "d": d[many], "k": k[many], "a": a[many], "b": b[many]})
        tokens = np.empty(len(head), TOKEN)
        for name, values in zip(TOKEN.names, (m[head], d[head], k[head], a[head], b[head], count), strict=True):
            tokens[name] = values
        part = tokens["m"] % parts
        tokens = tokens[np.argsort(part, kind="stable")]
        ends = np.cumsum(np.bincount(part, minlength=parts))
        packed = [(i, _columns(tokens[x:y])) for i, (x, y) in enumerate(zip(np.append(0, ends), ends, strict=False)) if y > x]
        out = pd.DataFrame(packed, columns=["part", "packed"]).assign(kind="token")
        for kind, found in (("span", spans), ("cand", cands)):
            if len(found):
                out = pd.concat([out.astype(object), found.assign(kind=kind, part=np.arange(len(found)) % parts).astype(object)])
        # No nulls among the numbers: pandas would read them back as floats.
        out = out.reindex(columns=[x.split()[0] for x in STEP1.split(", ")])
        yield out.assign(**{x: out[x].where(out[x].notna(), 0).astype("int64") for x in NUMBERS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, wait, n = c.WordHashes(), ([], [], [], [], []), 0
        for batch in batches:
            for d, k, text in zip(batch["d"].tolist(), batch["k"].tolist(), batch["text"], strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                h = hashes.of(words)
                m, a, b, again = runs_of(h, window)
                raw = h.tobytes()
                content = [xxhash.xxh3_64_intdigest(raw[8 * x : 8 * y]) for x, y in zip(a.tolist(), (a + b + window - 1).tolist(), strict=True)]
                for to, x in zip(wait, (d, k, 0, (m, a, b, again), np.array(content, np.uint64)), strict=True):
                    to.append(x)
                n += len(words)
                if n >= block_words:
                    yield from block(*wait)
                    wait, n = ([], [], [], [], []), 0
        if n:
            yield from block(*wait)

    return rows.mapInPandas(run, STEP1)


def repeated(step1: DataFrame, parts: int, hot: int) -> DataFrame:
    """Step 2: CAND; spans and candidates of step 1, and announced runs of grams that were announced more than once.

    A gram's part reaches one task, with at most one token of each local block per gram. hot: the gram has at least so
    many runs; known for announced runs and, by `hot_grams`, joined to the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(wait: list[bytes]) -> Iterator[pd.DataFrame]:
            t = np.concatenate([_tokens(x) for x in wait])
            t = t[np.argsort(t["m"], kind="stable")]
            head = np.flatnonzero(np.concatenate([[True], t["m"][1:] != t["m"][:-1]]))
            size = np.diff(np.append(head, len(t)))
            total = np.add.reduceat(t["n"].astype(np.int64), head)
            again, is_hot = np.repeat(size > 1, size) & (t["n"] == 1), np.repeat(total >= hot, size)
            out = pd.DataFrame({x: t[x][again] for x in ("m", "d", "k", "a", "b")}).assign(kind="cand", hot=is_hot[again])
            grams = pd.DataFrame({"m": t["m"][head][total >= hot]}).assign(kind="hot")
            yield out[names]
            if len(grams):
                yield grams.reindex(columns=names).astype(dict.fromkeys(NUMBERS, "Int64"))

        names, part, wait = [x.split()[0] for x in CAND.split(", ")], None, []
        for batch in batches:
            token = batch["kind"] == "token"
            for p, raw in zip(batch["part"][token], batch["packed"][token], strict=True):
                if wait and p != part:
                    yield from flush(wait)
                    wait = []
                part = p
                wait.append(raw)
            if len(rest := batch[~token]):
                yield rest.assign(hot=None)[names]
        if wait:
            yield from flush(wait)

    return step1.repartition("part").sortWithinPartitions("part").mapInPandas(run, CAND)


SEGMENT = "key long, d long, k int, a long, b long, words binary"


def segments(joined: DataFrame, window: int) -> DataFrame:
    """Step 3, fetching words: SEGMENT from text, d, k and runs (m, a, b, hot); words null: b is the end of a factor,
    and key just spreads these rows.

    Equal runs in a batch are sent once; the later ones are factors of the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first: dict[tuple[int, bytes], tuple] = {}
            out = []
            for text, d, k, runs in zip(batch["text"], batch["d"].tolist(), batch["k"].tolist(), batch["runs"], strict=True):
                words = words_of(text)
                for r in runs:
                    m, a, b, is_hot = r["m"], r["a"], r["b"], r["hot"]
                    pieces = [(m, a, b)] if not is_hot else [(None, i, 1) for i in range(a, a + b)]
                    for key, at, n in pieces:
                        raw = b" ".join(words[at : at + n + window - 1])
                        if key is None:
                            key = xxhash.xxh3_64_intdigest(raw) - 2**63
                        was = first.get((key, raw))
                        if was is not None and was[:2] < (d, at):
                            out.append((d, d, k, at, at + n + window - 1, None))
                            continue
                        if was is not None and was[:2] > (d, at):
                            out.append((d, was[0], was[2], was[1], was[1] + was[3] + window - 1, None))
                        elif was is not None:
                            out.append((key, d, k, at, n, raw))
                            continue
                        first[key, raw] = (d, at, k, n)
            out += [(key, d, k, at, n, raw) for (key, raw), (d, at, k, n) in first.items()]
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SEGMENT.split(", ")])
            yield frame.astype(dict.fromkeys(("key", "d", "k", "a", "b"), "int64"))

    return joined.mapInPandas(run, SEGMENT)


class ReferenceBlock:
    """The runs of one least gram seen so far, and where each of their windows first began."""

    def __init__(self, window: int):
        self.window = window
        self.index: dict[bytes, tuple[int, int, list[bytes], int]] = {}

    def parse(self, d: int, a: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Factors of a run that starts at word a of document d, as word ranges of the document; then index the run.

        Runs come in order of (d, a). Greedy: a factor begins at the first window that is found, and is extended as far
        as the words agree. The next window looked up is the first that goes over the factor's end.
        """
        w, n, i, out, index = self.window, len(words), 0, [], self.index
        while i + w <= n:
            key = b" ".join(words[i : i + w])
            found = index.get(key)
            if found is None:
                index[key] = (d, a + i, words, i)
                i += 1
            elif (found[0], found[1]) < (d, a + i):
                ref, r, j = found[2], found[3], w
                while i + j < n and r + j < len(ref) and ref[r + j] == words[i + j]:
                    j += 1
                out.append((a + i, a + i + j))
                i += j - w + 1
            else:
                i += 1
        return out


FACTOR = "d long, k int, a long, b long"


def parse_blocks(sent: DataFrame, window: int) -> DataFrame:
    """Step 3, parsing: the factors (words a to b of a document) of all runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block = None, None
        for batch in batches:
            out = []
            for x, d, k, a, b, raw in zip(*(batch[y] for y in ("key", "d", "k", "a", "b", "words")), strict=True):
                if raw is None:
                    out.append((d, k, a, b))
                    continue
                if block is None or x != key:
                    key, block = x, ReferenceBlock(window)
                out += [(d, k, p, q) for p, q in block.parse(d, a, raw.split(b" "))]
            yield pd.DataFrame(out, columns=["d", "k", "a", "b"])

    by_key = sent.repartition("key").sortWithinPartitions("key", "d", "a")
    return by_key.mapInPandas(run, FACTOR)


def find_factors(docs: DataFrame, window: int = 20, block_words: int = 500_000, hot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """rows (row, d, k, text) and factors (d, k, spans): sorted, maybe overlapping word ranges to remove."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.hash(text).alias("k"), text.alias("text"))
    parts = 2 * max(4, docs.rdd.getNumPartitions())
    found = c.materialize(repeated(announce(rows, window, parts, block_words), parts, hot), "kind")
    grams = found.where("kind = 'hot'").select("m", F.lit(True).alias("is_hot"))
    cands = found.where("kind = 'cand'").join(grams, "m", "left").select("d", "k", F.struct("m", "a", "b", F.coalesce("is_hot", "hot", F.lit(False)).alias("hot")).alias("run"))
    by_doc = cands.groupBy("d", "k").agg(F.collect_list("run").alias("runs"))
    sent = segments(rows.join(by_doc, ["d", "k"]).select("text", "d", "k", "runs"), window)
    spans = parse_blocks(sent, window).unionByName(found.where("kind = 'span'").select("d", "k", "a", "b"))
    return rows, spans.groupBy("d", "k").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_text (the words that stay, joined by blanks), kept_sha256.

    Words are parted by ASCII white space. Null and empty texts have no words. A null doc_id is smaller than any other.
    Rows that repeat a doc_id start at the same place, so neither is earlier than the other. Only doc_id and text are
    read; an empty table gives an empty one.
    """
    rows, factors = find_factors(docs, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, text, spans in zip(batch["d"].tolist(), batch["text"], batch["spans"], strict=True):
                words = words_of(text)
                kept, last = [], 0
                for s in spans if spans is not None else ():
                    kept += words[last : max(last, s["a"])]
                    last = max(last, s["b"])
                kept += words[last:]
                raw = b" ".join(kept)
                out.append((d, len(words), len(words) - len(kept), raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    joined = rows.join(factors, ["d", "k"], "left").select("d", "text", "spans")
    kept = joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
