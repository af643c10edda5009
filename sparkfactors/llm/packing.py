"""Packing of documents, in order, into sequences by dynamic programming.

The ids of consecutive documents form one line, cut into windows of at most `size`. Cuts fall at ends of documents (no
penalty) or of sentences (small penalty); where neither comes for long, cuts at regular steps are offered (large
penalty). The best cuts minimise padding plus penalties. Padding to `size` is linear in the window's
length, so the best start of a window is the minimum over a sliding range: a monotone queue makes that constant time
per cut. Windows whose length is a power of two need no padding and are extra transitions.

Documents are ordered by doc_id over range partitions; each partition packs its own run in blocks of bounded size.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .tokens import shared_tokenizer

SCHEMA = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Costs:
    """In ids of padding. each: of a sequence as such, so that short unpadded ones are no end in themselves."""

    sentence: float = 3.0
    forced: float = 48.0
    each: float = 12.0


def cut_positions(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions where a window may end, from 0 on, and the kind of each: 0 document, 1 sentence, 2 forced."""
    pos = np.concatenate([[0], doc_ends, sentence_ends])
    kind = np.concatenate([np.zeros(1 + len(doc_ends), np.int8), np.ones(len(sentence_ends), np.int8)])
    order = np.lexsort((kind, pos))
    pos, kind = pos[order], kind[order]
    first = np.concatenate([[True], pos[1:] != pos[:-1]])
    pos, kind = pos[first], kind[first]
    step = max(1, size // 32)
    gaps = np.flatnonzero(np.diff(pos) > 2 * step)
    if len(gaps):
        extra = np.concatenate([np.arange(pos[g] + step, pos[g + 1], step) for g in gaps])
        pos = np.concatenate([pos, extra])
        kind = np.concatenate([kind, np.full(len(extra), 2, np.int8)])
        order = np.argsort(pos, kind="stable")
        pos, kind = pos[order], kind[order]
    return pos, kind


def best_cuts(pos: np.ndarray, kind: np.ndarray, size: int, costs: Costs) -> np.ndarray:
    """The positions of the best cuts, from 0 to the last."""
    n = len(pos)
    fee = (np.array([0.0, costs.sentence, costs.forced])[kind] + costs.each).tolist()
    # Starts that make a window of a power of two, as (end, start) sorted by end.
    ends, starts, p = [], [], 1
    while p <= size:
        at = np.searchsorted(pos, pos - p)
        hit = np.flatnonzero((pos >= p) & (pos[np.minimum(at, n - 1)] == pos - p))
        ends.append(hit)
        starts.append(at[hit])
        p *= 2
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    exact, upto = starts[order].tolist(), np.searchsorted(ends[order], np.arange(n), "right").tolist()
    at = pos.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])  # starts by position, with best + position rising
    done = upto[0]
    for j in range(1, n):
        x = at[j]
        while x - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        cost = best[i] + size - (x - at[i])
        for k in range(done, upto[j]):
            if best[exact[k]] < cost:
                i, cost = exact[k], best[exact[k]]
        done = upto[j]
        best[j], back[j] = cost + fee[j], i
        key = best[j] + x
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return pos[cuts[::-1]]


class Block:
    """Documents' ids, waiting to be cut."""

    def __init__(self, size: int, costs: Costs):
        self.size, self.costs = size, costs
        self.docs: list[tuple] = []  # (doc_id, no_id), ids, start of ids in the document, ids in the whole document
        self.sentences: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray, start: int = 0, whole: int | None = None) -> None:
        self.docs.append((doc_id, ids, start, len(ids) if whole is None else whole))
        self.sentences.append(sentences)
        self.n += len(ids)

    def cut(self, last: bool) -> tuple[list[tuple], Block]:
        """Rows of the block's sequences (numbered from 0), and a new block with what is left over.

        But for the last block, the last sequence is left over, so that no block ends in padding. The last sequence of
        all is cut at powers of two.
        """
        starts = np.cumsum([0, *(len(d[1]) for d in self.docs)])
        inner = np.concatenate([s + a for s, a in zip(self.sentences, starts, strict=False)]) if self.docs else starts[:0]
        pos, kind = cut_positions(starts[1:], inner[(inner > 0) & (inner < self.n)], self.size)
        cuts = best_cuts(pos, kind, self.size, self.costs).tolist()
        if last:
            a, b = cuts[-2], cuts.pop()
            while a < b:
                a += min(self.size, 1 << (b - a).bit_length() - 1)
                cuts.append(a)
        elif len(cuts) > 2:
            cuts.pop()
        rows, rest, d = [], Block(self.size, self.costs), 0
        for seq, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            while starts[d + 1] <= a:
                d += 1
            x = a
            while x < b:
                doc_id, ids, start, whole = self.docs[d]
                y, s = min(b, int(starts[d + 1])), int(starts[d])
                rows.append((*doc_id, start + x - s, y - x, zlib.crc32(ids[x - s : y - s].astype("<u4").tobytes()), whole, seq, x - a))
                x = y
                d += x == starts[d + 1] and x < self.n
        end = cuts[-1]
        for k in range(len(self.docs)):
            if (b := int(starts[k + 1])) > end:
                doc_id, ids, start, whole = self.docs[k]
                skip = max(0, end - int(starts[k]))
                s = self.sentences[k] - skip
                rest.add(doc_id, ids[skip:], s[s > 0], start + skip, whole)
        return rows, rest


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, eod: int = 1, costs: Costs = Costs(), block_ids: int = 600_000) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then eod; null and empty texts are eod alone. Documents are packed by doc_id, null first;
    rows that repeat a doc_id are documents of their own, ordered by a hash of the text. A text of any length is cut into
    as many pieces as it takes; of equally good cuts the first found is taken. Columns other than doc_id and text are not
    read; an empty table gives an empty one. sequence_id holds the partition's number in its upper bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, block = shared_tokenizer(tokenizer_path), Block(size, costs)
        first = TaskContext.get().partitionId() << 40

        def frame(rows: list[tuple]) -> pd.DataFrame:
            nonlocal first
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            out["sequence_id"] += first
            first = int(out["sequence_id"].iloc[-1]) + 1
            return out

        for batch in batches:
            for doc_id, no_id, (ids, ends) in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), tokenizer.encode_many(batch["text"]), strict=True):
                block.add((doc_id, no_id), np.append(ids, np.uint16(eod)), ends)
                if block.n >= block_ids:
                    rows, block = block.cut(last=False)
                    yield frame(rows)
        if block.n:
            yield frame(block.cut(last=True)[0])

    rows = docs.select(*c.id_columns(), F.coalesce("text", F.lit("")).alias("text"))
    # The text's hash parts rows that share one doc_id, or have none, however many they are.
    order = [F.col("no_id").desc(), F.col("doc_id"), F.xxhash64("text")]
    return c.with_id(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInPandas(run, SCHEMA))
