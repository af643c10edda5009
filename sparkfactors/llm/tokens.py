"""Token ids of public vocabularies, with a bounded cache of words."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands between words that are encoded together; words that contain it are encoded alone.
_BAR = b"|"


#: Bytes of lower-case Latin letters up to U+00FF in UTF-8. Words of these alone pass the vocabulary's normaliser and
#: splitter as they are.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), 0xC3]] = True
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_CAPITAL_AFTER_C3 = np.zeros(256, bool)
_CAPITAL_AFTER_C3[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
#: The splitter parts a letter from punctuation after it; a blank there changes no ids and makes for fewer words.
_LETTER_MARK = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-/:-@\\[-`{-~])"
_NO_RANK = np.uint32(0xFFFFFFFF)


class Merger:
    """Byte-pair merges of many words at once, as the library's model does them one by one.

    In each round every word's pair of least rank, leftmost first, is merged; words without a pair to merge are done.
    Ranks are looked up in an open hash table.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = iter(range(256, 512))
        chars = [chr(b) if b in printable else chr(next(extra)) for b in range(256)]
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[x] for x in chars], np.int64)
        self.last = np.array([vocab[x + end] for x in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_RANK, np.uint32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 16 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], _NO_RANK)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as bytes one after the other and their sizes (not 0): their ids likewise and the numbers of ids."""
        n, ends = len(sizes), np.cumsum(sizes)
        counts = np.zeros(n, np.int64)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        over_ids, over_words = [], []
        which, word = np.arange(n), np.repeat(np.arange(n), sizes)
        rank = np.full(len(ids), _NO_RANK, np.uint32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(which):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            done = least == _NO_RANK
            if done.any():
                over = np.repeat(done, sizes)
                over_ids.append(ids[over])
                over_words.append(np.repeat(which[done], sizes[done]))
                counts[which[done]] = sizes[done]
                ids, rank, least, sizes, which = ids[~over], rank[~over], least[~done], sizes[~done], which[~done]
                if not len(which):
                    break
            word = np.repeat(np.arange(len(which)), sizes)
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank, sizes = ids[keep], word[keep], rank[keep], sizes - 1
            # Pairs that begin or end at a merged place.
            at = at - np.arange(len(at))
            rank[at] = _NO_RANK
            a = np.concatenate([at, at[at > 0] - 1])
            a = a[a + 1 < len(ids)]
            a = a[word[a] == word[a + 1]]
            rank[a] = self.rank(ids[a], ids[a + 1])
        if not over_ids:
            return np.zeros(0, np.uint16), counts
        order = np.argsort(np.concatenate(over_words), kind="stable")
        return np.concatenate(over_ids)[order].astype(np.uint16), counts


class WordTokenizer:
    """Ids (16 bits) of whole texts by a vocabulary that drops white space and never joins what it parts.

    For such a vocabulary the ids of a text are those of its words (parted by ASCII white space) one after the other.
    Texts are taken in chunks, and each distinct word of a chunk is encoded once: plain ones by Merger, others by the
    library, whose results a cache of at most `most` words keeps.
    """

    def __init__(self, path: str, most: int = 100_000, specials: bool = True):
        """specials: the strings of special tokens in a text become those tokens, as the library does by default."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        self.tokenizer.encode_special_tokens = not specials
        (self.bar,) = self.tokenizer.encode(_BAR.decode(), add_special_tokens=False).ids
        self.most, self.cache = most, {}
        vocab, end = self.tokenizer.get_vocab(), "</w>"
        #: By id: whether it ends a word with . ! or ?
        self.closing = np.zeros(1 << 16, bool)
        self.closing[[i for x, i in vocab.items() if x.removesuffix(end)[-1:] in (".", "!", "?") and x.endswith(end)]] = True
        self.merger = Merger(json.loads(self.tokenizer.to_str())["model"])

    def _encode(self, words: list[bytes]) -> None:
        """Encode distinct words into the cache by the library, most of them as one text."""
        alone = [w for w in words if _BAR in w]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u2").tobytes()
        rest = [w for w in words if _BAR not in w] if alone else words
        if rest:
            (e,) = self.tokenizer.encode_batch_fast([b" | ".join([*rest, b""]).decode()], add_special_tokens=False)
            ids = np.array(e.ids, "<u2")
            ends, raw = np.flatnonzero(ids == self.bar), ids.tobytes()
            assert len(ends) == len(rest)
            starts = np.append(0, ends[:-1] + 1) * 2
            self.cache.update(zip(rest, [raw[a:b] for a, b in zip(starts.tolist(), (ends * 2).tolist(), strict=True)], strict=True))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, by the library or from the cache."""
        if len(self.cache) + len(words) > self.most:
            self.cache.clear()
        self._encode([w for w in words if w not in self.cache])
        return list(map(self.cache.__getitem__, words))

    def _distinct(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        n = len(words)
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].copy()
        sizes = np.diff(bounds)
        c3 = np.concatenate([[False], raw[:-1] == 0xC3]) if len(raw) else np.zeros(0, bool)
        low = raw + np.uint8(32) * (c3 & _CAPITAL_AFTER_C3[raw])
        good = np.where(c3, _AFTER_C3[low], _LETTER[low])
        plain = (sizes > 0) & (sizes <= 64)
        if len(raw):
            some = np.flatnonzero(sizes)
            plain[some] &= np.logical_and.reduceat(good, (bounds[:-1] - bounds[0])[some])
        flat, counts = self.merger.encode(low[np.repeat(plain, sizes)], sizes[plain])
        odd = self._ids_of(words.filter(pa.array(~plain & (sizes > 0))).to_pylist())
        out = np.zeros(n, np.int64)
        out[plain] = counts
        out[~plain & (sizes > 0)] = np.fromiter(map(len, odd), np.int64, len(odd)) >> 1
        ids = np.zeros(out.sum(), np.uint16)
        of_plain = np.repeat(plain, out)
        ids[of_plain] = flat
        ids[~of_plain] = joined(odd)
        return ids, out

    def _chunk(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and ends of texts. Words are parted and numbered by Arrow, so each distinct one is encoded once."""
        text = pa.array(texts, pa.large_string())
        special = pc.match_substring(text, "<|")
        split = pc.replace_substring_regex(pc.ascii_lower(text), _LETTER_MARK, r"\1 \2")
        # What might hold a special token's name stays as it is.
        split = pc.ascii_split_whitespace(pc.if_else(special, text, split))
        coded = split.flatten().dictionary_encode()
        flat, sizes = self._distinct(coded.dictionary.cast(pa.large_binary()))
        first = np.cumsum(sizes) - sizes
        closes = np.zeros(len(sizes), bool)
        some = sizes > 0
        closes[some] = self.closing[flat[(first + sizes - 1)[some]]]
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[code] - (ends - n), n) + np.arange(n.sum())]
        close = closes[code]
        at = np.append(0, ends)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return [(out[at[x] : at[y]], ends[x:y][close[x:y]] - at[x]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def encode_many(self, texts, chunk_chars: int = 3_000_000):
        """Of each text, in order: its ids, and how many of them precede the end of each sentence, which is a word
        that ends with . ! or ?"""
        wait, n = [], 0
        for text in texts:
            wait.append(text or "")
            n += len(wait[-1])
            if n >= chunk_chars:
                yield from self._chunk(wait)
                wait, n = [], 0
        if wait:
            yield from self._chunk(wait)

    def encode(self, text: str | None) -> np.ndarray:
        return self._chunk([text or ""])[0][0]


@lru_cache(maxsize=2)
def shared_tokenizer(path: str, specials: bool = True) -> WordTokenizer:
    """One for all tasks that a Python worker runs, so that words stay cached from one task to the next."""
    return WordTokenizer(path, specials=specials)


def joined(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u2")
